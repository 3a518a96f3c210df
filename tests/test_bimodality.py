import math
import random

from skein.operators import bimodality as b


def test_two_and_one_populations(spark):
    rnd = random.Random(1)
    rows = [("two", rnd.gauss(0 if i % 3 else 6, 1)) for i in range(300)] + [("one", rnd.gauss(0, 1)) for i in range(300)]
    rows += [("few", 1.0 * i) for i in range(5)] + [("flat", 2.0)] * 30 + [(None, rnd.gauss(0, 1)) for _ in range(30)] + [("two", math.nan), ("two", math.inf), ("two", None)]
    got = {r.k: r for r in b.bimodality(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", resamples=19).collect()}
    assert set(got) == {"two", "one", "few", "flat", None}
    assert got["two"].n == 300 and got["two"].p == 0.05 and got["two"].ashman_d > 4 and abs(got["two"].least_weight - 1 / 3) < 0.05 and got["two"].mean_high > 5
    assert got["one"].p > 0.05 and got["few"].ashman_d is None and got["flat"].likelihood_ratio is None and got[None].n == 30


def test_bins_change_little(spark, monkeypatch):
    rnd = random.Random(2)
    frame = spark.createDataFrame([(1, rnd.gauss(0 if i % 2 else 5, 1)) for i in range(400)], "k long, v double")
    exact = b.bimodality(frame, ["k"], "v").first()
    monkeypatch.setattr(b, "BINS", 100)
    coarse = b.bimodality(frame, ["k"], "v").first()
    assert coarse.n == exact.n and abs(coarse.mean_low - exact.mean_low) < 0.05 and abs(coarse.ashman_d - exact.ashman_d) < 0.1
    assert b.bimodality(frame.limit(0), ["k"], "v").count() == 0


def test_large_groups_are_exact_and_samples_whole(spark, monkeypatch):
    rnd = random.Random(3)
    frame = spark.createDataFrame([(None, rnd.gauss(0 if i % 2 else 5, 1)) for i in range(400)] + [(1, 90.0 if i == 0 else rnd.gauss(i % 2 * 8, 1)) for i in range(60)], "k long, v double")
    inside = {r.k: r for r in b.bimodality(frame, ["k"], "v").collect()}
    monkeypatch.setattr(b, "TASK_VALUES", 100)
    beyond = {r.k: r for r in b.bimodality(frame, ["k"], "v", resamples=3).collect()}
    for k in (None, 1):
        for c in ("n", "likelihood_ratio", "ashman_d", "least_weight", "mean_low", "mean_high"):
            assert abs(beyond[k][c] - inside[k][c]) < 1e-6 * (1 + abs(inside[k][c])), (k, c)
        assert beyond[k].p == 0.25
    # the ratio of one normal doesn't grow with its rows
    assert max(b.null_ratio(500_000, 3.0, 2.0, [1, i]) for i in range(5)) < 40
