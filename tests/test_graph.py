import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.stats import poisson_draws
from skein.operators.breaks import break_bootstrap, jenks_two_class, two_line_cdf
from skein.operators.graph import coherence_threshold, connected_components, forest_scan, grouped_components, percolation, percolation_limit, spanning_forest
from skein.operators.running import running


def components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(99, i) for i in range(40)], [(1, 1), (2, 3), (3, 2), (2, 3)], []])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges + [(None, 5)] if edges else [], "u long, v long")
    assert {r.id: r.component for r in connected_components(frame).collect()} == components(edges)


def kruskal(edges):
    parent, tree = {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, u, v in sorted((w, *sorted((u, v))) for u, v, w in edges):
        if root(u) != root(v):
            parent[root(v)] = root(u)
            tree.append((u, v, w))
    return tree


def test_forest_with_ties_and_parallel_edges(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randrange(6))) for _ in range(150)]
    edges = [(u, v, w) for u, v, w in edges if u != v] + [(100, 101, 1.0)]
    got = sorted(tuple(r) for r in spanning_forest(spark.createDataFrame(edges + [(1, 1, 0.0), (1, 2, None)], "u long, v long, w double")).collect())
    assert got == sorted(kruskal(edges))
    assert spanning_forest(spark.createDataFrame([], "u long, v long, w double")).count() == 0


def scan(tree):
    size, parent, largest, out = {}, {}, 1, []

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, u, v in sorted((w, u, v) for u, v, w in tree):
        a, b = root(u), root(v)
        total = size.get(a, 1) + size.get(b, 1)
        parent[b] = a
        size[a] = total
        out.append((w, largest, max(largest, total)))
        largest = max(largest, total)
    return out


@pytest.mark.parametrize("run", [1_000_000, 7])
def test_percolation_in_runs(spark, run):
    rnd = random.Random(5)
    points = [(rnd.random(), rnd.random()) for _ in range(40)]
    tree = kruskal([(i, j, math.dist(points[i], points[j])) for i in range(40) for j in range(i)])
    frame = spark.createDataFrame([(0, *e) for e in tree], "g long, u long, v long, w double")
    got = sorted((r.w, r.largest_before, r.largest_after) for r in percolation(frame, scan_edges=run).collect())
    assert got == sorted(scan(tree))
    jumps = [(-(after - before), i, w) for i, (w, before, after) in enumerate(scan(tree))]
    assert percolation_limit(percolation(frame, scan_edges=run)).first().limit == min(jumps)[2]


def test_percolation_of_several_groups_in_halves(spark):
    rnd = random.Random(11)
    rows, want = [], []
    for g, n in enumerate((50, 9, 2, 23)):
        points = [(rnd.random(), rnd.random()) for _ in range(n)]
        tree = kruskal([(100 * g + i, 100 * g + j, math.dist(points[i], points[j])) for i in range(n) for j in range(i)])
        rows += [(g, *e) for e in tree]
        want += [(g, *x) for x in scan(tree)]
    frame = spark.createDataFrame(rows, "g long, u long, v long, w double")
    got = sorted((r.g, r.w, r.largest_before, r.largest_after) for r in percolation(frame, scan_edges=8).collect())
    assert got == sorted(want)
    assert percolation(frame.limit(0)).count() == 0


def test_running_ranks_and_sums(spark):
    frame = spark.range(200).select((F.col("id") % 3).alias("g"), F.col("id"), F.expr("pmod(id * 7919, 101)").alias("x"))
    out = running(frame, ["g"], ["x", "id"], {"s": F.col("x")}).toPandas()
    for _, part in out.groupby("g"):
        part = part.sort_values(["x", "id"])
        assert list(part["rank"]) == list(range(1, len(part) + 1)) and (part["s"] == part["x"].cumsum()).all() and (part["group_rows"] == len(part)).all()
    assert running(frame.limit(0), ["g"], ["x"], {}).count() == 0


def test_jenks_equals_exhaustive_search(spark):
    rnd = random.Random(8)
    values = [round(rnd.gauss(0, 1) + 4 * (i % 2), 3) for i in range(41)]
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 1, 2.0), ("c", 1, 1.0), ("c", 2, 3.0), (None, 1, 5.0), ("d", 1, float("nan")), ("e", 1, 2.0), ("e", 2, 2.0)], "g string, id long, v double")
    got = {r.g: r for r in jenks_two_class(frame, ["g"], "v", "id").collect()}
    ordered = sorted(values)

    def sse(x):
        return sum((v - sum(x) / len(x)) ** 2 for v in x)

    best = min(range(1, len(ordered)), key=lambda k: (round(sse(ordered[:k]) + sse(ordered[k:]), 9), k))
    assert got["a"].n_low == best and math.isclose(got["a"].cut, (ordered[best - 1] + ordered[best]) / 2)
    assert got["b"].cut == 2.0 and got["b"].n_low is None and got["c"].cut == 2.0 and got[None].cut == 5.0 and "d" not in got and got["e"].cut == 2.0


def test_two_lines_meet_at_the_bend(spark):
    values = [i / 100 for i in range(100)] + [1 + i / 5 for i in range(1, 50)]
    frame = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)] + [(2, 1, 3.0)], "g long, id long, v double")
    got = {r.g: r for r in two_line_cdf(frame, ["g"], "v", "id").collect()}
    assert abs(got[1].threshold - 1.0) < 0.05 and got[1].improvement > 0.9 and got[2].threshold == 3.0


def test_small_groups_in_tasks_and_large_ones_as_tables_agree(spark):
    rnd = random.Random(9)
    points = [(g, 100 * g + i, rnd.random(), rnd.random()) for g in (0, 1) for i in range(30)]
    edges = [(p[0], p[1], q[1], round(math.dist(p[2:], q[2:]), 2)) for p in points for q in points if p[0] == q[0] and p[1] < q[1]]
    frame = spark.createDataFrame(edges, "g long, u long, v long, w double")
    one, other = (sorted(tuple(r) for r in forest_scan(frame, task_edges=n).collect()) for n in (10**6, 0))
    assert one == other and len(one) == 58
    assert [(w, b, a) for g, _, _, _, w, b, a in one if g == 1] == scan(kruskal([e[1:] for e in edges if e[0] == 1]))
    few = frame.where("w < 0.1")
    a, b = (sorted(tuple(r) for r in grouped_components(few, task_edges=n).collect()) for n in (10**6, 0))
    assert a == b and dict(a) == components([(u, v) for _, u, v, w in edges if w < 0.1])
    assert forest_scan(frame.limit(0)).count() == 0 and grouped_components(frame.limit(0)).count() == 0
    rows = [(w, after) for g, _, _, _, w, _, after in one if g == 0]
    assert {r.g: r.threshold for r in coherence_threshold(forest_scan(frame)).collect()}[0] == min(w for w, after in rows if after >= 24)


def two_lines(x, min_segment=20):
    """Two-line fit of sorted values by least squares of every split."""
    n = len(x)
    if n < 4:
        return float(np.median(x)), None
    segment = min_segment if n >= 2 * min_segment else max(2, n // 4)
    y = np.arange(1, n + 1) / n

    def line(at, to):
        slope = 0.0 if np.ptp(x[at:to]) == 0 else np.polyfit(x[at:to], y[at:to], 1)[0]
        cut = y[at:to].mean() - slope * x[at:to].mean()
        return slope, cut, ((y[at:to] - cut - slope * x[at:to]) ** 2).sum()

    fits = [(round((line(0, k)[2] + line(k, n)[2]) / (y * y).sum(), 12), k) for k in range(segment, n - segment + 1)]
    k = min(fits)[1]
    (b1, a1, _), (b2, a2, _) = line(0, k), line(k, n)
    meet = (a2 - a1) / (b1 - b2) if b1 != b2 else math.nan
    return (meet if x[0] <= meet <= x[-1] else (x[k - 1] + x[k]) / 2), (k, b1, a1, b2, a2, line(0, k)[2] + line(k, n)[2], line(0, n)[2])


def natural_break(x):
    if len(x) < 4 or np.ptp(x) == 0:
        return float(np.median(x))
    inside = lambda part: ((part - part.mean()) ** 2).sum()
    k = min((round((inside(x[:k]) + inside(x[k:])) / ((x - x.mean()) ** 2).sum(), 11), k) for k in range(2, len(x) - 1))[1]
    return (x[k - 1] + x[k]) / 2


def break_rows():
    rnd = np.random.default_rng(7)
    groups = {"a": np.concatenate([rnd.exponential(0.2, 90), 1 + rnd.exponential(1.0, 60)]), None: rnd.normal(5, 1, 30), "few": np.array([1.0, 2.0, 4.0]), "one": np.array([3.5])}
    return [(k, float(v), 1000 * i + j) for i, (k, values) in enumerate(groups.items()) for j, v in enumerate(values)]


def test_two_line_result_is_whole(spark):
    rows = break_rows()
    frame = spark.createDataFrame([*rows, ("a", math.nan, -1), ("a", None, -2), ("a", math.inf, -3)], "k string, v double, id long")
    got = {r.k: r for r in two_line_cdf(frame, ["k"], "v", "id").collect()}
    for k, row in got.items():
        x = np.sort([v for key, v, _ in rows if key == k])
        threshold, fit = two_lines(x)
        assert row.n == len(x) and row.threshold == pytest.approx(threshold)
        if fit is None:
            assert (row.method, row.n_low, row.sse_two, row.min_segment) == ("median_fallback", max(1, len(x) // 2), None, 2)
            continue
        assert (row.n_low, row.slope_low, row.intercept_low, row.slope_high, row.intercept_high, row.sse_two, row.sse_one) == pytest.approx(fit)
        assert (row.x_low, row.x_high) == (x[row.n_low - 1], x[row.n_low])
        assert row.method == ("line_intersection" if not math.isclose(threshold, (row.x_low + row.x_high) / 2) else "midpoint_at_best_split")
        assert row.min_segment == (20 if len(x) >= 40 else max(2, len(x) // 4))


@pytest.mark.parametrize("kind", ["two_line", "jenks"])
def test_break_bootstrap_equals_brute_force(spark, kind):
    resamples = 12
    rows = break_rows()
    frame = spark.createDataFrame([*rows, ("a", math.nan, -1), ("nothing", None, -2)], "k string, v double, id long")
    seeds = {r.id: r.s for r in frame.select("id", F.xxhash64("id", F.lit(12345)).alias("s")).collect()}
    got = {r.k: r for r in break_bootstrap(frame, ["k"], "v", "id", kind=kind, resamples=resamples).collect()}
    again = {r.k: r for r in break_bootstrap(frame.repartition(7), ["k"], "v", "id", kind=kind, resamples=resamples).collect()}
    assert set(got) == {"a", None, "few", "one"}
    for k, row in got.items():
        mine = sorted((v, i) for key, v, i in rows if key == k)
        weights = poisson_draws(np.array([seeds[i] for _, i in mine]).astype(np.uint64), resamples).astype(int)
        cuts = []
        for b in range(resamples):
            x = np.repeat([v for v, _ in mine], weights[:, b])
            if len(x):
                cuts.append(two_lines(x)[0] if kind == "two_line" else natural_break(x))
        assert (row.n, row.resamples) == (len(mine), len(cuts))
        assert (row.mean, row.p16, row.p50, row.p84) == pytest.approx((np.mean(cuts), *np.percentile(cuts, [16, 50, 84])), rel=1e-6)
        assert row.sd == pytest.approx(np.std(cuts, ddof=1), rel=1e-5, abs=1e-9)
        assert again[k].mean == pytest.approx(row.mean)
    assert break_bootstrap(frame.limit(0), ["k"], "v", "id", kind=kind).count() == 0
    with pytest.raises(ValueError):
        break_bootstrap(frame, ["k"], "v", "id", kind="else")
