import math
import random
import statistics

import numpy as np

import pytest
from pyspark.sql import functions as F

from skein.functions import astro
from skein.functions.ids import canonical_id, safe_double
from skein.functions.stats import bh_qvalues, bootstrap_mean, effect_size, mann_whitney, paired_deltas, robust_scatter, wilson_interval
from skein.operators.score import adjusted_rand, best_match, better_equal_worse, fragments_and_merges, partition_signature, resolution_flags, retention_agreement


def test_wilson(spark):
    row = spark.createDataFrame([(825, 1000), (0, 0)], "k long, n long").select(*(c.alias(a) for c, a in zip(wilson_interval(F.col("k"), F.col("n")), "plh"))).collect()
    assert (row[0].l, row[0].h) == (pytest.approx(0.800218, abs=1e-6), pytest.approx(0.847294, abs=1e-6)) and row[1].p is None


def test_robust_scatter_and_effect(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 10.0)] + [("b", 5.0), ("c", 1.0), ("c", 1.0), ("c", 1.0), ("c", 9.0), ("d", math.nan), (None, 1.0), (None, 3.0)]
    got = {r.k: r for r in robust_scatter(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["a"].scatter == pytest.approx(1.4826 * 1.0) and got["b"].scatter is None and "d" not in got and got[None].n == 2
    assert got["c"].scatter == pytest.approx(2.0 / 1.349)
    one = spark.range(1).select(effect_size(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(0.0)).alias("e")).first().e
    assert one == math.inf


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04]
    got = {r.i: r.q_value for r in bh_qvalues(spark.createDataFrame([(1, i, x) for i, x in enumerate(p)] + [(1, 99, None)], "g int, i long, p double"), ["g"], "p", "i").collect()}
    order = sorted(range(len(p)), key=lambda i: p[i])
    want, least = {}, 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        want[order[rank - 1]] = least
    assert got == pytest.approx(want)


def test_mann_whitney(spark):
    rnd = random.Random(1)
    rows = [(bool(i % 2), round(rnd.gauss(0.3 * (i % 2), 1), 1)) for i in range(80)]
    got = mann_whitney(spark.createDataFrame([(*r, 1) for r in rows] + [(None, 1.0, 1), (True, None, 1), (True, 2.0, 2)], "s boolean, v double, g int"), ["g"], F.col("s"), "v").collect()
    row = next(r for r in got if r.g == 1)
    a, b = [v for s, v in rows if s], [v for s, v in rows if not s]
    assert row.u == sum((x > y) + (x == y) / 2 for x in a for y in b)
    assert row.p == pytest.approx(math.erfc(row.z / math.sqrt(2))) and next(r for r in got if r.g == 2).p == 1.0


def test_paired_deltas(spark):
    runs = spark.createDataFrame([(1, 0.0, 0.5, True), (1, 1.0, 0.75, False), (2, 1.0, 0.1, True), (3, 0.0, 1.0, True), (3, 0.0, 2.0, True)], "k long, sigma double, m double, ok boolean")
    got = {(r.k, r.sigma): (r.delta_m, r.delta_ok) for r in paired_deltas(runs, "k", F.col("sigma") == 0, ["m", "ok"]).collect()}
    assert got[1, 1.0] == (0.25, -1.0) and got[2, 1.0] == (None, None) and got[3, 0.0] == (None, None)
    counts = {r.metric: (r.better, r.equal, r.worse) for r in better_equal_worse(paired_deltas(runs, "k", F.col("sigma") == 0, ["m", "ok"]), ["delta_m", "delta_ok"]).collect()}
    assert counts == {"delta_m": (1, 1, 0), "delta_ok": (0, 1, 1)}


def test_bootstrap_doesnt_depend_on_partitions(spark):
    rnd = random.Random(2)
    values = [rnd.gauss(1, 2) for _ in range(200)]
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(1, 900, None)], "g long, i long, v double")
    a, b = (bootstrap_mean(frame.repartition(n), ["g"], "v", "i", resamples=500).first() for n in (1, 5))
    assert (a.low, a.high) == pytest.approx((b.low, b.high)) and a.mean == pytest.approx(statistics.fmean(values))
    half = 1.96 * statistics.stdev(values) / math.sqrt(200)
    assert a.low == pytest.approx(a.mean - half, abs=0.3 * half) and a.high == pytest.approx(a.mean + half, abs=0.3 * half)


def test_frames(spark):
    one = spark.range(1)
    l, b = one.select(*astro.icrs_to_galactic(F.lit(192.85948), F.lit(27.12825))).first()
    assert b == pytest.approx(90, abs=1e-3)
    l, b = one.select(*astro.icrs_to_galactic(F.lit(266.405), F.lit(-28.936))).first()
    assert min(l, 360 - l) < 0.01 and abs(b) < 0.01
    x = one.select(*astro.spherical_to_cartesian(F.lit(90.0), F.lit(0.0), F.lit(2.0))).first()
    assert tuple(x) == pytest.approx((0, 2, 0))
    pm = one.select(*astro.proper_motion_to_galactic(F.lit(10.0), F.lit(20.0), F.lit(3.0), F.lit(4.0))).first()
    assert math.hypot(*pm) == pytest.approx(5)
    assert one.select(astro.proper_motion_velocity(F.lit(1.0), F.lit(-1.0)).alias("v")).first().v is None


def test_ids_and_numbers(spark):
    texts = [" 12 ", "12345.0", None, "a1", "1.5", "　-7.00\n", "nan", "1e3", "inf"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(canonical_id(frame.t)).collect()] == ["12", "12345", "", "a1", "1.5", "-7", "nan", "1e3", "inf"]
    assert [r[0] for r in frame.select(safe_double(frame.t)).collect()][-4:] == [None, None, 1000.0, None]


def test_scores(spark):
    truth = [(1, i, "a") for i in range(20)] + [(1, 20 + i, "b") for i in range(10)] + [(1, 40 + i, "background") for i in range(5)] + [(1, 60, "lost"), (1, 61, None)]
    members = [(1, i, 1) for i in range(12)] + [(1, i, 2) for i in range(12, 20)] + [(1, 20 + i, 1) for i in range(6)] + [(1, 40, 2)]
    m, t = spark.createDataFrame(members, "g long, id long, group_id long"), spark.createDataFrame(truth, "g long, id long, label string")
    got = {r.label: r for r in best_match(m, t).collect()}
    assert set(got) == {"a", "b", "lost"}
    assert (got["a"].best_group, got["a"].completeness, got["a"].purity) == (1, 0.6, pytest.approx(12 / 18)) and got["a"].jaccard == pytest.approx(12 / 26)
    assert got["lost"].best_group is None and got["lost"].completeness == 0.0 and got["a"].detected and not got["a"].strict
    rich = {r.label: r for r in fragments_and_merges(m, t).collect()}
    assert rich["a"].fragment_count == 2 and rich["a"].merged_with == "b" and rich["b"].merged_with == "a" and rich["lost"].fragment_count == 0
    assert tuple(resolution_flags(best_match(m, t), "a", "b").first()) == (1, False, False, False)
    swapped = m.withColumn("group_id", 3 - F.col("group_id"))
    assert partition_signature(m).first() == partition_signature(swapped).first() != partition_signature(m.where("id <> 0")).first()
    assert retention_agreement(t, m, m.where("group_id = 1")).first().agreement == pytest.approx(1 - 9 / 37)
    pairs = m.select("g", F.col("group_id").alias("a"), F.col("group_id").alias("b"))
    assert adjusted_rand(pairs).first().adjusted_rand == 1.0


def test_quantiles_from_ranks(spark):
    rnd = random.Random(5)
    frame = spark.createDataFrame([(k, rnd.gauss(0, 1)) for k in (1, 2, None) for _ in range(20 + (k or 0))], "g long, v double")
    out = robust_scatter(frame, ["g"], "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan
    for r in out.collect():
        values = [x.v for x in frame.where(F.col("g").eqNullSafe(F.lit(r.g))).collect()]
        assert r.middle == pytest.approx(statistics.median(values)) and r.scatter == pytest.approx(1.4826 * statistics.median(abs(v - r.middle) for v in values))


def test_bootstrap_takes_the_reference_s_resamples(spark):
    frame = spark.createDataFrame([(1, i, float(i % 7)) for i in range(30)], "g long, i long, v double")
    usual, many = bootstrap_mean(frame, ["g"], "v", "i").first(), bootstrap_mean(frame, ["g"], "v", "i", resamples=20_000).first()
    assert (usual.low, usual.high) == pytest.approx((many.low, many.high), abs=1e-12)


def test_breaks_do_not_depend_on_the_scale(spark):
    from skein.operators.breaks import jenks_two_class, two_line_cdf

    rng = np.random.default_rng(12)
    values = np.concatenate([rng.normal(0, 1, 50), rng.normal(1, 1, 50)])
    rows = [(name, i, float(v) * scale) for name, scale in (("one", 1.0), ("small", 1e-5), ("tiny", 1e-12), ("large", 1e7)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k string, i long, v double")
    jenks = {r.k: r for r in jenks_two_class(frame, ["k"], "v", "i").collect()}
    lines = {r.k: r for r in two_line_cdf(frame, ["k"], "v", "i").collect()}
    for name, scale in (("small", 1e-5), ("tiny", 1e-12), ("large", 1e7)):
        assert jenks[name].n_low == jenks["one"].n_low and abs(jenks[name].cut / scale - jenks["one"].cut) < 1e-9
        assert lines[name].n_low == lines["one"].n_low and abs(lines[name].threshold / scale - lines["one"].threshold) < 1e-6
