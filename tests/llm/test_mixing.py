import pytest

from skein.llm.mixing import mix_sources, weight_schedule

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("gone", 0.1, 2), (None, 0.1, 2)]


def mixed(spark, rows, targets=TARGETS, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "i long, s string, n long, epoch int")
    return mix_sources(docs, "i", "s", "n", spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **options)


def corpus():
    rows = [(i, "a", 50 + i % 100) for i in range(900)] + [(2000 + i, "b", 40 + i % 50) for i in range(300)] + [(4000 + i, "c", 30 + i % 40) for i in range(80)]
    return rows + [(6000, "other", 10), (6001, None, 10), (6002, "a", 0), (6003, "a", None), (None, "a", 10)]


def test_shares_repeats_and_order(spark):
    mixture, report = mixed(spark, corpus() + corpus()[:50])
    rows = mixture.collect()
    shares = {r.source: r for r in report.collect()}
    assert set(shares) == {"a", "b", "c", "gone"}
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(shares[source].reached_share - share) < 0.01
    assert shares["gone"].reached_share == 0 and shares["gone"].available == 0
    assert shares["c"].most_uses == 4
    positions = [r.position for r in rows]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert len({(r.i, r.epoch) for r in rows}) == len(rows)
    uses = {}
    for r in rows:
        uses[r.i] = uses.get(r.i, 0) + 1
    limits = {"a": 1, "b": 3, "c": 4}
    assert all(uses[r.i] <= limits[r.source] for r in rows)


def test_weights_add_up_and_repeats_come_late(spark):
    demand = spark.createDataFrame([("a", 0.6, 60.0, 100), ("b", 0.3, 30.0, 10), ("c", 0.1, 10.0, 2)], "source string, share double, need double, available long")
    rows = weight_schedule(demand, 0.5).collect()
    for t in (0.0, 0.5):
        assert sum(r.w0 for r in rows if r.t0 == t) == pytest.approx(1)
    assert sum(r.w1 for r in rows if r.t1 == 1.0) == pytest.approx(1)
    grows = {r.source: r.w1 > r.w0 for r in rows}
    assert grows == {"a": False, "b": True, "c": True}
    assert all(min(r.w0, r.w1) > 0 for r in rows)


def test_a_fixed_total_reports_what_falls_short(spark):
    _, report = mixed(spark, corpus(), total_tokens=10**6)
    rows = {r.source: r for r in report.collect()}
    assert rows["c"].most_uses == 4 and rows["c"].used_tokens == 4 * rows["c"].available and rows["a"].used_tokens == rows["a"].available


def test_empty(spark):
    mixture, report = mixed(spark, [])
    assert mixture.count() == 0 and all(r.reached_share == 0 for r in report.collect())
    mixture, report = mixed(spark, corpus(), targets=[])
    assert mixture.count() == 0 and report.count() == 0
