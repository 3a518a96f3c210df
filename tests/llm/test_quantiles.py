import math

import numpy as np
import pytest

from skein.llm.quantiles import RANK_ERROR, BothEnds, RelativeRankSketch, merge_sketches, rank_bounds, sketch_quantiles, sketch_values

FRACTIONS = [0.01, 0.1, 0.5, 0.9, 0.99, 0.999]


def within(values, fractions, estimates, error):
    values = np.sort(values)
    for q, x in zip(fractions, estimates):
        below, upto = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        allowed = error * (1 - q) * len(values) + 1
        assert below <= q * len(values) + allowed and upto >= q * len(values) - allowed, (q, x)


@pytest.mark.parametrize("order", ["random", "sorted", "reversed", "ties"])
def test_relative_error_of_merged_parts(order):
    rng = np.random.default_rng(1)
    values = rng.lognormal(0, 2, 120_000)
    values = {"random": values, "sorted": np.sort(values), "reversed": np.sort(values)[::-1], "ties": np.round(values)}[order]
    merged = RelativeRankSketch()
    for part in np.array_split(values, 37):
        merged.merge(RelativeRankSketch.from_bytes(RelativeRankSketch().add(part).to_bytes()))
    assert merged.n == len(values) and merged.held < 8000
    within(values, FRACTIONS, merged.quantiles(FRACTIONS), RANK_ERROR)


def test_low_end_and_small_sets_are_exact():
    values = np.random.default_rng(2).normal(size=50_000)
    low = RelativeRankSketch(high=False).add(values)
    assert low.quantiles([1 / 50_000]) == [values.min()]
    assert RelativeRankSketch().add(np.array([3.0, 1.0, 2.0])).quantiles([0.5, 1.0]) == [2.0, 3.0]
    assert RelativeRankSketch().quantiles([0.5]) == [None]


def test_days_combine(spark):
    rng = np.random.default_rng(3)
    values = rng.exponential(1.0, 6000)
    rows = [("a" if i % 3 else None, i % 5, float(v), "x") for i, v in enumerate(values)]
    rows += [("a", 0, math.nan, "x"), ("a", 0, math.inf, "x"), ("a", 0, None, "x"), ("empty", 1, None, "x")]
    daily = sketch_values(spark.createDataFrame(rows, "label string, day long, v double, sketch string"), ["label", "day"], "v")
    found = {r.label: r for r in sketch_quantiles(merge_sketches(daily, ["label"]), FRACTIONS).collect()}
    assert set(found) == {"a", None}
    for label, row in found.items():
        mine = np.array([v for name, _, v, _ in rows[:6000] if name == label])
        assert row.n == len(mine)
        within(mine, FRACTIONS, row.quantiles, RANK_ERROR)
    none = spark.createDataFrame([], "label string, day long, v double")
    assert sketch_values(none, ["label"], "v").count() == 0


@pytest.mark.parametrize("order", ["random", "sorted", "reversed"])
def test_both_tails_are_relative_to_their_own_end(order):
    rng = np.random.default_rng(4)
    values = rng.lognormal(0, 2, 400_000)
    values = {"random": values, "sorted": np.sort(values), "reversed": np.sort(values)[::-1]}[order]
    merged = BothEnds()
    for k, part in enumerate(np.array_split(values, 100)):
        merged.merge(BothEnds.from_bytes(BothEnds(seed=k).add(part).to_bytes()))
    fractions = [0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]
    ordered = np.sort(values)
    for q, x in zip(fractions, merged.quantiles(fractions)):
        below, upto = np.searchsorted(ordered, x, "left"), np.searchsorted(ordered, x, "right")
        allowed = RANK_ERROR * min(q, 1 - q) * len(values) + 1
        assert below <= q * len(values) + allowed and upto >= q * len(values) - allowed, (q, x)


def test_coins_differ_between_sketches_and_come_in_pairs():
    def coins(seed):
        sketch, seen = RelativeRankSketch(seed=seed), []
        for part in np.array_split(np.arange(60_000.0), 120):
            before = sketch.levels[0][1] if sketch.levels else 0
            sketch.add(part)
            if sketch.levels[0][1] > before:
                seen.append(sketch.levels[0][4])
        return seen

    first, second = coins(1), coins(2)
    assert first != second and coins(1) == first
    assert all(a != b for a, b in zip(first[::2], first[1::2]))


def test_bounds_are_exact_ranks(spark):
    values = [float(v) for v in np.random.default_rng(5).integers(0, 50, 700)]
    frame = spark.createDataFrame([(None, v) for v in values] + [("x", math.nan)], "label string, v double")
    ordered = sorted(values)
    for r in rank_bounds(frame, ["label"], "v", [0.01, 0.5, 0.9]).collect():
        allowed = RANK_ERROR * min(r.fraction, 1 - r.fraction) * 700 + 1
        low, high = max(1, math.floor(r.fraction * 700 - allowed)), min(700, math.ceil(r.fraction * 700 + allowed))
        assert (r.n, r.low_value, r.high_value) == (700, ordered[low - 1], ordered[high - 1])
