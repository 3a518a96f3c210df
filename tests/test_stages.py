import random

import pytest
from pyspark.sql import functions as F

from skein.operators.mixture import Gate, fit_one, fit_two, gate_nodes
from skein.operators.mixture import score_verdicts
from skein.plans.analysis import analyse, write_analysis
from skein.plans.orders import order_aggregate, paired_orders, paired_scores
from skein.plans.refine import REDDENING_ONLY_ENDS, membership, numbered_leaves, pipeline, refine, refine_shared_parent, seed_nodes
from skein.plans.stage1 import Stage1, groups_at_radius, spatial_groups
from skein.scratch import Scratch

AT = ["x", "y", "z"]


def planted(seed=1):
    """Two blobs on top of each other in space but apart in reddening, and one plain blob."""
    rnd = random.Random(seed)
    rows = []
    for i in range(60):
        rows.append((i, 0, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1), (0.5 if i % 2 else 1.5) + rnd.gauss(0, 0.1), rnd.gauss(0, 1), rnd.gauss(0, 1)))
    for i in range(60, 100):
        rows.append((i, 0, 40 + rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1), 0.7 + rnd.gauss(0, 0.1), (3 if i % 2 else -3) + rnd.gauss(0, 0.5), rnd.gauss(0, 0.5)))
    return rows


SCHEMA = "id long, g long, x double, y double, z double, av double, vl double, vb double"


@pytest.fixture(scope="module")
def nodes(spark):
    frame = spark.createDataFrame(planted(), SCHEMA)
    members = groups_at_radius(frame, "id", "g", AT, 3.0, min_size=10)
    scales = spark.createDataFrame([(0, 3.0)], "g long, cut double")
    return seed_nodes(members.drop("x", "y", "z")).join(frame.drop("g"), "id"), scales


def test_splits_in_either_order(spark, nodes):
    members, scales = nodes
    both = pipeline(members, scales, [Gate(("vl", "vb")), Gate(("av",))])
    assert [r.accepted_splits for r in both[0].passes.orderBy("pass").collect()] == [1, 0]
    last = numbered_leaves(both[1]).toPandas()
    groups = {frozenset(p["id"]) for _, p in last.groupby("group_id")}
    assert frozenset(range(1, 60, 2)) in groups and frozenset(range(0, 60, 2)) in groups and len(groups) == 4
    assert sorted(last["group_id"].unique()) == [1, 2, 3, 4]
    # children and orphans together are the parents
    assert both[1].members.count() + both[0].orphans.count() + both[1].orphans.count() == 100
    table = membership(members.select("g", "id"), [members.select("g", "id", "root").withColumnRenamed("root", "group_id"), numbered_leaves(both[1]).select("g", "id", "group_id")], [both[1].orphans])
    assert {r.status for r in table.collect()} == {"stage2_grouped"}


def test_policies_and_limits(spark, nodes):
    members, scales = nodes
    single = refine(members, scales, Gate(("av",)), policy="single")
    assert {r.node for r in single.members.select("node").distinct().collect()} == {"0:G001.a", "0:G001.b", "0:G002"}
    assert {r.status for r in single.nodes.collect()} == {"split", "final_no_significant_reddening_bimodality"}
    with pytest.raises(RuntimeError):
        refine(members, scales, Gate(("av",)), max_passes=1)
    with pytest.raises(ValueError):
        refine(members, scales, Gate(("av",)), policy="none")
    assert refine(members.limit(0), scales, Gate(("av",))).members.count() == 0


def test_only_the_shared_parent(spark, nodes):
    members, scales = nodes
    scores = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (0, "c", 2)], "g long, label string, best_group long")
    one = refine_shared_parent(members, scores, scales, Gate(("av",)), ("a", "b"))
    assert {r.node for r in one.members.select("node").distinct().collect()} == {"0:G001.a1", "0:G001.b1", "0:G002"}
    apart = refine_shared_parent(members, scores, scales, Gate(("av",)), ("a", "c"))
    assert {r.node for r in apart.members.select("node").distinct().collect()} == {"0:G001", "0:G002"}


def test_halves_that_fall_apart_or_are_too_small(spark):
    rnd = random.Random(11)
    spread = [(i, 0, 50.0 * i if i % 2 else rnd.gauss(0, 1), 0.0, 0.0, 2.0 + rnd.gauss(0, 0.05) if i % 2 else rnd.gauss(0, 0.05)) for i in range(40)]
    small = [(100 + i, 0, rnd.gauss(0, 1), 500.0, 0.0, 3.0 + rnd.gauss(0, 0.05) if i < 8 else rnd.gauss(0, 0.05)) for i in range(40)]
    frame = spark.createDataFrame(spread + small, "id long, g long, x double, y double, z double, av double").selectExpr("*", "if(id < 100, '0:G001', '0:G002') as node", "if(id < 100, 1, 2) as root", "0 as generation")
    scales = spark.createDataFrame([(0, 5.0)], "g long, cut double")
    for policy, apart in (("all", "final_reddening_bimodal_one_side_no_spatial_component"), ("single", "final_reddening_bimodal_spatial_split_not_binary")):
        ended = {r.node: r.status for r in refine(frame, scales, Gate(("av",)), policy=policy).nodes.collect()}
        assert ended == {"0:G001": apart, "0:G002": "final_reddening_bimodal_jenks_side_below_min_group"}


def test_gate_reasons(spark):
    rnd = random.Random(4)
    rows = [("two", i, rnd.gauss(0 if i % 2 else 5, 0.5)) for i in range(40)] + [("one", 100 + i, rnd.gauss(0, 1)) for i in range(40)]
    rows += [("holes", 200 + i, None if i == 0 else 1.0 * i) for i in range(20)] + [("few", 300 + i, float(i)) for i in range(5)] + [("odd", 400 + i, 50.0 if i == 0 else rnd.gauss(0, 0.1)) for i in range(30)]
    frame = spark.createDataFrame(rows, "node string, id long, v double")
    got = {r.node: r for r in gate_nodes(frame, Gate(("v",)), Scratch(spark, "t"))[0].collect()}
    assert got["two"].reason == "pass" and (got["two"].n_low, got["two"].n_high) == (20, 20)
    assert got["one"].reason.startswith("failed:delta_bic")
    assert got["holes"].reason == "insufficient_reddening_coverage" and got["few"].reason == "too_few_finite_reddening_values"
    assert got["odd"].reason == "failed:component_n_high,component_fraction_high"
    as_table = {r.node: r for r in gate_nodes(frame, Gate(("v",)), Scratch(spark, "t"), task_rows=0)[0].collect()}
    assert as_table["two"].delta_bic == pytest.approx(got["two"].delta_bic, abs=1e-4) and as_table["two"].n_low == 20


def test_two_vector_populations(spark):
    rnd = random.Random(6)
    rows = [("n", i, rnd.gauss(0 if i % 2 else 12, 1), rnd.gauss(0, 1)) for i in range(60)]
    frame = spark.createDataFrame(rows, "node string, id long, a double, b double")
    for most in (100_000, 0):
        verdicts, sides = gate_nodes(frame, Gate(("a", "b")), Scratch(spark, "t"), task_rows=most)
        assert verdicts.first().reason == "pass"
        assert {(r.id % 2, r.side) for r in sides.collect()} == {(1, 0), (0, 1)}


def test_fit_of_equal_values_is_defined():
    import numpy as np

    x = np.zeros((8, 1))
    assert np.isfinite(fit_one(x)) and np.isfinite(fit_two(x)[0])


def test_stage1_on_a_field(spark):
    rnd = random.Random(2)
    rows = [(i, 1, 100 * (i % 3) + rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(90)] + [(100, 2, 0.0, 0.0, 0.0), (101, 3, None, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "id long, g long, x double, y double, z double")
    found = spatial_groups(frame, "id", "g", AT)
    scales = {r.g: r for r in found.scales.collect()}
    assert set(scales) == {1, 2} and scales[2].cut is None
    # the scale must be that of the whole tree
    import math

    points = {r[0]: r[2:] for r in rows[:90]}
    inside, edges = {0}, []
    while len(inside) < 90:
        w, v = min((math.dist(points[u], points[v]), v) for u in inside for v in points if v not in inside)
        inside.add(v)
        edges.append(w)
    assert scales[1].limit == pytest.approx(max(e for e in edges if e <= scales[1].limit + 1e-9))


def test_one_population_isnt_two_halves(spark, monkeypatch):
    import numpy as np

    from skein.operators import mixture

    rng = np.random.default_rng(5)
    one, near = rng.normal(0, 1, 600), np.where(np.arange(600) % 2, 0.0, 1.5) + rng.normal(0, 1, 600)
    flat = rng.normal(0, 1, (600, 2))
    rows = [(name, i, float(v), float(flat[i, 0]), float(flat[i, 1])) for name, x in (("one", one), ("near", near)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "node string, id long, v double, a double, b double")
    monkeypatch.setattr(mixture, "MOST_STEPS", 20)
    for gate, failed, most in ((Gate(("v",)), "ashman_d", 100_000), (Gate(("v",)), "ashman_d", 0), (Gate(("a", "b")), "separation_d", 100_000)):
        for r in gate_nodes(frame, gate, Scratch(spark, "t"), task_rows=most)[0].collect():
            assert r.separation < 2 and failed in r.reason, (r, most)
    fit = fit_two(one.reshape(-1, 1))
    assert fit[3].shape == (2, 1) and abs(fit[2] @ fit[3][:, 0] - one.mean()) < 1e-6


def test_overlapping_populations_settle_on_both_paths(spark, monkeypatch):
    import numpy as np

    from skein.operators import mixture

    monkeypatch.setattr(mixture, "MOST_STEPS", 12)

    rng = np.random.default_rng(2)
    slow = np.where(np.arange(500) % 5 == 0, 0.0, 3.0) + rng.normal(0, 1, 500)  # takes many steps
    frame = spark.createDataFrame([("slow", i, float(v)) for i, v in enumerate(slow)] + [("fast", 1000 + i, float(v)) for i, v in enumerate(np.where(np.arange(60) % 2, 0.0, 9.0) + rng.normal(0, 1, 60))], "node string, id long, v double")
    beyond = {r.node: r for r in gate_nodes(frame, Gate(("v",)), Scratch(spark, "t"), task_rows=0)[0].collect()}
    for node, rows in frame.toPandas().groupby("node"):
        x = rows[["v"]].to_numpy()
        ll, resp, _, means, covs = fit_two(x)
        assert beyond[node].delta_bic == pytest.approx(2 * (ll - fit_one(x)) - 3 * np.log(len(x)), abs=1e-6)
        assert beyond[node].separation == pytest.approx(np.sqrt(2) * abs(means[1, 0] - means[0, 0]) / np.sqrt(covs.sum()), abs=1e-6)
        assert sorted((beyond[node].n_low, beyond[node].n_high)) == sorted([(resp[:, 1] > resp[:, 0]).sum(), (resp[:, 1] <= resp[:, 0]).sum()])


def test_verdicts_hold_the_fitted_populations_on_both_paths(spark, monkeypatch):
    from skein.operators import mixture

    # of the aggregates; tasks load the module anew and take all their steps
    monkeypatch.setattr(mixture, "MOST_STEPS", 40)
    rnd = random.Random(9)
    rows = [("n", i, (0.0 if i % 3 else 6.0) + rnd.gauss(0, 1), (0.0 if i % 3 else 2.0) + rnd.gauss(0, 0.5)) for i in range(90)]
    frame = spark.createDataFrame(rows, "node string, id long, v double, w double")
    found = []
    for most in (100_000, 0):
        verdicts, _ = gate_nodes(frame, Gate(("v",)), Scratch(spark, "t"), task_rows=most)
        one = verdicts.first()
        again = score_verdicts(frame, verdicts, Gate(("v",))).first()
        assert again.bic_again == pytest.approx(one.bic_2, abs=1e-6) and again.separation_again == pytest.approx(one.separation, abs=1e-9)
        assert one.delta_bic == pytest.approx(one.bic_1 - one.bic_2, abs=1e-9) and one.weight_low + one.weight_high == pytest.approx(1)
        assert one.mean_low == pytest.approx(0, abs=0.5) and one.mean_high == pytest.approx(6, abs=0.7) and one.weight_high == pytest.approx(1 / 3, abs=0.05)
        two = gate_nodes(frame, Gate(("v", "w")), Scratch(spark, "t"), task_rows=most)[0].first()
        assert two.mean2_high == pytest.approx(2, abs=0.4) and two.sigma2_low == pytest.approx(0.5, abs=0.15) and two.centroid_separation == pytest.approx(6.3, abs=0.7)
        found.append((one, two))
    for a, b in zip(*found):
        for name in a.asDict():
            if isinstance(a[name], float):
                assert a[name] == pytest.approx(b[name], abs=1e-3), name


def test_reddening_as_the_only_stage(spark, nodes):
    members, scales = nodes
    done = refine(members, scales, Gate(("av",)), ends=REDDENING_ONLY_ENDS)
    assert {r.status for r in done.nodes.collect()} == {"split", "final_no_significant_bimodality"}
    split = done.splits.where("accepted").first()
    assert (split.parts_0, split.parts_1, split.orphans_n, split.rejected_as) == (1, 1, 0, "") and 0.6 < split.cut < 1.4
    assert {split.sizes_0, split.sizes_1} == {"30"} and split.weight_low == pytest.approx(0.5, abs=0.01)


def test_both_orders_are_paired(spark, nodes):
    members, scales = nodes
    frame = spark.createDataFrame(planted(), SCHEMA)
    stage1 = Stage1(scales, groups_at_radius(frame, "id", "g", AT, 3.0, min_size=10), None)
    truth = [(r[0], r[1], "t1" if r[0] < 60 and r[0] % 2 else "t2" if r[0] < 60 else "background") for r in planted()]
    truth = spark.createDataFrame(truth, "id long, g long, label string")
    both = paired_orders(stage1, frame.drop("g"), frame.select("g", "id"), truth, ("t1", "t2"), Gate(("av",)), Gate(("vl", "vb")))
    labels = both.labels.collect()
    assert [(r.jaccard_forward, r.jaccard_reverse, r.delta_jaccard) for r in labels] == [(1.0, 1.0, 0.0)] * 2
    one = order_aggregate(both.fields).first()
    assert (one.n_runs, one.forward_strict_recoveries, one.reverse_formal_rate, one.same_retention) == (1, 2.0, 1.0, 1.0)
    assert (one.mean_jaccard_better, one.mean_jaccard_equal, one.mean_jaccard_worse) == (0, 1, 0)
    assert one.forward_s2_accepted_splits == one.reverse_s2_accepted_splits == 1.0
    twice = both.labels.select("g", "label", "true_size", *(f"{c}_forward" for c in ("best_group", "overlap", "best_size", "completeness", "purity", "jaccard", "detected", "strict")))
    twice = twice.toDF(*(c.removesuffix("_forward") for c in twice.columns))
    with pytest.raises(ValueError):
        paired_scores(twice.unionByName(twice), twice)


@pytest.fixture(scope="module")
def analysed(spark):
    rows = planted()
    dirty = [(200, 0, None, 0.0, 0.0, 1.0, 0.0, 0.0), (201, 0, float("inf"), 0.0, 0.0, 1.0, 0.0, 0.0), (202, None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (203, 0, 500.0, 500.0, 500.0, 1.0, 0.0, 0.0), (204, 7, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    frame = spark.createDataFrame([*rows, rows[0], *dirty], SCHEMA)
    gates = [Gate(("av",)), Gate(("vl", "vb"))]
    return frame, gates, analyse(frame, "id", "g", AT, gates)


def test_whole_analysis(analysed):
    frame, _, done = analysed
    members = done.membership.toPandas().set_index("id")
    assert len(members) == 104 and members.index.is_unique
    assert list(members.loc[[200, 201], "status"]) == ["not_placed"] * 2 and members.loc[203, "status"] == members.loc[204, "status"] == "stage1_field"
    seen = frame.where("g = 0 and id < 200").dropDuplicates(["id"]).toPandas().set_index("id")
    groups = done.groups.toPandas()
    grouped = members[members["stage3_group_id"] > 0]
    assert sorted(groups["group_id"]) == list(range(1, len(groups) + 1)) and groups["n_members"].sum() == len(grouped)
    for row in groups.itertuples():
        mine = seen.loc[grouped.index[grouped["stage3_group_id"] == row.group_id]]
        assert row.n_members == len(mine) and row.node == members.loc[mine.index[0], "stage3_node"]
        assert (row.median_av, row.mean_vl, row.median_vb) == pytest.approx((mine["av"].median(), mine["vl"].mean(), mine["vb"].median()))
        assert (row.min_x, row.max_z) == (mine["x"].min(), mine["z"].max())
    field = {r.g: r for r in done.fields.collect()}
    assert field[0].n_points == 103 and field[7].n_points == 1 and field[7].stage1_groups == 0
    assert field[0].stage3_members + field[0].stage2_orphans + field[0].stage3_orphans == field[0].stage1_members
    assert field[0].stage2_splits >= 1 and field[0].stage2_tested >= field[0].stage2_significant >= field[0].stage2_splits


def test_node_table_holds_split_nodes_too(analysed):
    frame, _, done = analysed
    seen = frame.where("g = 0 and id < 200").dropDuplicates(["id"]).toPandas().set_index("id")
    first = done.stage1.members.toPandas()
    nodes = done.nodes.where("stage = 2").toPandas()
    assert "split" in set(nodes["status"])
    for row in nodes[nodes["generation"] == 0].itertuples():
        mine = seen.loc[first["id"][first["group_id"] == row.root]]
        assert row.n == len(mine) and (row.median_av, row.mean_av) == pytest.approx((mine["av"].median(), mine["av"].mean()))


def test_analysis_is_written_and_empty_is_empty(spark, analysed, tmp_path):
    frame, gates, done = analysed
    write_analysis(done, str(tmp_path / "out"), gates)
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "membership")).count() == 104
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {"membership", "final_groups", "nodes", "fields", "scales", *(f"stage{n}_{x}" for n in (2, 3) for x in ("splits", "passes", "orphans")), "config.json", "summary.txt"}
    assert "n points: 104" in (tmp_path / "out" / "summary.txt").read_text()
    empty = analyse(frame.limit(0), "id", "g", AT, gates)
    assert [x.count() for x in (empty.membership, empty.nodes, empty.groups, empty.fields)] == [0, 0, 0, 0]
    plain = analyse(frame, "id", "g", AT, [], observables=["av"])
    assert plain.groups.agg({"n_members": "sum"}).first()[0] == plain.stage1.members.count() and plain.nodes.count() == 0


def test_stage1_in_a_task_and_as_tables_agree(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(g * 1000 + k, g, *(rnd.gauss(c, 1.5) if k % 3 else rnd.uniform(0, 60) for c in ((10, 10, 10), (40, 40, 40))[k % 2])) for g, n in ((1, 200), (2, 90), (3, 2), (4, 1)) for k in range(n)]
    rows += [(9000 + k, 5, 1.0, 1.0, 1.0) for k in range(3)]
    frame = spark.createDataFrame(rows, "id long, g long, x double, y double, z double")

    def found(most):
        s = spatial_groups(frame, "id", "g", ["x", "y", "z"], task_points=most)
        return [sorted(t.select(*columns).collect()) for t, columns in ((s.members, ("g", "id", "group_id", "group_rows")), (s.forest, ("g", "u", "v", "w")))], sorted(((r.g, r.n, r.limit, r.cut, r.edges_used) for r in s.scales.collect()), key=lambda r: r[0])

    whole = found(1000)
    assert whole[0][0] and len(whole[1]) == 5
    assert found(0) == whole
    # too many edges for a task: the field goes on as tables, its parts thinned first
    monkeypatch.setattr("skein.plans.stage1.SCAN_EDGES", 100)
    assert found(1000) == whole


def test_refinement_in_a_task_and_as_tables_agrees(spark, nodes, monkeypatch):
    members, scales = nodes

    def found(gate, policy, most):
        done = refine(members, scales, gate, policy=policy, task_rows=most)
        exact = [sorted(map(str, getattr(done, t).select(*c).collect())) for t, c in (("members", ("g", "node", "root", "generation", "id", "x", "av", "vl")), ("nodes", ("node", "n", "n_observed", "n_low", "n_high", "passed", "reason", "g", "root", "generation", "rows_0", "rows_1", "parts_0", "parts_1", "orphans_n", "status", "pass")), ("splits", ("pass", "node", "rows_0", "sizes_0", "sizes_1", "accepted", "rejected_as", "status", "child_ids")), ("passes", ("pass", "clusters_tested", "significant_bimodality", "accepted_splits", "new_children")), ("orphans", ("g", "id", "root", "parent", "pass", "reason")))]
        numbers = [c for c, kind in done.nodes.dtypes if kind == "double"]
        return exact, {r.node: [r[c] for c in numbers] for r in done.nodes.collect()}

    exact, numbers = found(Gate(("av",)), "all", 1000)
    # too many links for a task: the split node goes on as tables, the other one stays
    monkeypatch.setattr("skein.plans.refine.SCAN_EDGES", 5)
    as_tables, theirs = found(Gate(("av",)), "all", 1000)
    assert exact == as_tables
    for node, values in numbers.items():
        assert values == [None if t is None else pytest.approx(t, rel=1e-6, abs=1e-9) for t in theirs[node]]


def test_fits_side_by_side_are_those_of_each_node():
    import numpy as np

    from skein.operators.mixture import fits_two, verdicts_in_task

    rng = np.random.default_rng(3)
    nodes = [np.where(rng.random(n) < 0.4, 0.0, gap)[:, None] + rng.normal(0, 1, (n, 2)) for n, gap in ((12, 6.0), (40, 0.0), (300, 3.0), (10, 50.0))]
    for dims, gate in ((1, Gate(("v",))), (2, Gate(("v", "w")))):
        own = [x[:, :dims] for x in nodes] + [np.full((11, dims), 2.0)]
        for x, got in zip(own, fits_two(own)):
            alone = fit_two(x)
            assert got[0] == pytest.approx(alone[0], abs=1e-9) and got[1].shape == (len(x), 2)
            for a, b in zip(got[1:], alone[1:]):
                np.testing.assert_allclose(a, b, atol=1e-9)
        holes = own[0].copy()
        holes[0] = np.nan
        reasons = [v["reason"] for v, _ in verdicts_in_task([holes, *own, own[0][:4]], gate)]
        assert reasons[0].startswith("insufficient") and reasons[-1].startswith("too_few") and reasons[1] == verdicts_in_task([own[0]], gate)[0][0]["reason"]


def test_a_field_of_many_edges_is_thinned_as_they_come():
    import numpy as np

    from skein.operators.graph import forest_of
    from skein.operators.near import array_pairs
    from skein.plans.stage1 import thinned_edges

    rng = np.random.default_rng(4)
    at = np.round(rng.random((300, 3)) * 8)  # many equal lengths
    ids = rng.permutation(300) * 7
    a, b = array_pairs(at, 3.0, 10**6)
    u, v, w = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), np.sqrt(((at[a] - at[b]) ** 2).sum(axis=1))
    whole = forest_of(u, v, w)
    assert len(a) > 4 * 600
    for hold in (1, 10**6):
        for got, want in zip(thinned_edges(ids, at, at, 3.0, hold=hold), (u[whole], v[whole], w[whole])):
            np.testing.assert_array_equal(got, want)
    assert thinned_edges(ids, at, at, 3.0, most=100) is None


def test_an_analysis_makes_only_what_is_asked_for(spark, monkeypatch):
    from skein.plans import analysis

    made = []
    monkeypatch.setattr(analysis, "node_table", lambda *a: made.append("nodes"))
    rows = [(k, 1, 0.1 * (k % 5), 0.1 * (k // 5 % 5), 0.1 * (k // 25), 1.0) for k in range(50)]
    frame = spark.createDataFrame(rows, "id long, g long, x double, y double, z double, av double")
    done = analyse(frame, "id", "g", AT, [], observables=["av"])
    assert done.fields.first().n_points == 50 and done.groups is done.groups and not made


def test_both_orders_are_those_of_the_pipeline(spark, nodes, monkeypatch):
    from skein.plans import orders, refine as plans

    made = []
    monkeypatch.setattr(orders, "retention_agreement", lambda *a: made.append("fields"))
    members, scales = nodes
    rows = [(*r[:5], 7.0 if 10 <= r[0] < 13 else r[5], *r[6:]) for r in planted()]  # a few far off in reddening
    rows += [(200 + i, 1, 0.1 * i, 0.0, 0.0, (0.5 if i % 2 else 1.5) + 0.001 * i, 5.0 * (i // 30), 0.01 * i) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    groups = groups_at_radius(frame, "id", "g", AT, 3.0, min_size=10)
    scales = spark.createDataFrame([(0, 3.0), (1, 3.0)], "g long, cut double")
    truth = frame.select("g", "id", F.when(F.col("id") % 2 == 0, "t1").otherwise("t2").alias("label"))
    gates = Gate(("av",)), Gate(("vl", "vb"))
    seeds = seed_nodes(groups).join(frame.drop("g"), "id")
    of = lambda t: sorted(map(tuple, t.select("g", "id", "group_id").collect()))
    want = {order: of(numbered_leaves(pipeline(seeds, scales, each)[-1])) for order, each in (("forward", list(gates)), ("reverse", list(gates)[::-1]))}
    assert len({x[::2] for x in want["forward"]}) > 5
    columns = (("forward_s2", "forward_s3"), ("reverse_s3", "reverse_s2"))

    def counts():
        placed, splits = plans.refine_orders(seed_nodes(groups, sized=True).join(frame.drop("g"), "id"), scales, gates, columns)
        return sorted(map(str, placed.collect())), sorted(map(str, splits.collect()))

    whole = counts()
    both = paired_orders(Stage1(scales, groups, None), frame.drop("g"), frame.select("g", "id"), truth, ("t1", "t2"), *gates)
    assert {order: of(t) for order, t in both.final.items()} == want
    assert both.labels.count() == 4 and not made
    # too many links for a task: such nodes go on as tables
    monkeypatch.setattr("skein.plans.refine.SCAN_EDGES", 5)
    assert counts() == whole
    with pytest.raises(RuntimeError):
        plans.refine_orders(seed_nodes(groups, sized=True).join(frame.drop("g"), "id"), scales, gates, columns, max_passes=1)


def test_a_node_that_stays_whole_is_fitted_once_for_both_orders(monkeypatch):
    import numpy as np
    import pandas as pd

    from skein.plans import refine as plans

    asked = []
    real = plans.verdicts_in_task
    monkeypatch.setattr(plans, "verdicts_in_task", lambda xs, gate: (asked.append((gate.what, len(xs))), real(xs, gate))[1])
    rng = np.random.default_rng(2)
    n = 40
    rows = pd.DataFrame({"node": np.repeat(["0:G001", "0:G002"], n), "g": 0, "root": np.repeat([1, 2], n), "generation": 0, "id": np.arange(2 * n), "scale": 3.0, "x": rng.normal(0, 1, 2 * n), "y": rng.normal(0, 1, 2 * n), "z": rng.normal(0, 1, 2 * n)})
    rows = rows.assign(o0_0=rng.normal(1, 0.1, 2 * n), o1_0=rng.normal(0, 1, 2 * n), o1_1=rng.normal(0, 1, 2 * n))
    trees = tuple(plans._Trees(gate, "all", 10, 20, plans.ENDS[gate.scalar]) for gate in (Gate(("av",)), Gate(("vl", "vb"))))
    out = plans._Orders(trees, (("a", "b"), ("c", "d"))).together(rows, [n, 2 * n])
    assert sum(k for what, k in asked if what == "reddening") == sum(k for what, k in asked if what == "kinematic") == 2
    assert (out.loc[out.kind == "row", ["a", "b", "c", "d"]] == 1).all(axis=None) and (out.kind == "splits").sum() == 2


def test_stage1_carries_what_is_asked_for(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(g * 1000 + k, g, *(rnd.gauss(20 * (k % 2), 1.5) for _ in range(3)), None if k % 7 == 0 else 0.5 * k) for g, n in ((1, 120), (2, 40)) for k in range(n)]
    frame = spark.createDataFrame(rows, "id long, g long, x double, y double, z double, av double")
    plain = spatial_groups(frame, "id", "g", AT)
    want = sorted((*map(tuple, plain.members.join(frame, ["g", "id"]).select("g", "id", "group_id", "group_rows", *AT, F.nanvl("av", F.lit(None)).alias("av")).collect()),), key=lambda r: r[:2])
    monkeypatch.setattr("skein.plans.stage1.EARLY_POINTS", 100)  # one field goes first
    for most in (1000, 100):
        got = spatial_groups(frame, "id", "g", AT, carry=("av",), forest=False, distinct=True, task_points=most)
        members = got.members.select("g", "id", "group_id", "group_rows", *AT, F.nanvl("av", F.lit(None)).alias("av"))
        assert sorted(map(tuple, members.collect()), key=lambda r: r[:2]) == want and got.forest is None
        assert sorted(map(str, got.scales.collect())) == sorted(map(str, plain.scales.collect()))


def test_a_crowded_field_goes_on_without_its_pairs_written(spark, monkeypatch):
    """Copies of a field at the same places have many pairs; neither these nor a part of them is written."""
    import numpy as np

    from skein.plans import stage1

    rng = np.random.default_rng(6)
    places = np.r_[rng.random((250, 3)) * 40, rng.normal(20, 1, (60, 3))]
    at = np.round(np.r_[places, places + rng.normal(0, 0.01, places.shape), places], 3)
    frame = spark.createDataFrame([(k, 1, *map(float, p)) for k, p in enumerate(at)] + [(5000, 2, 1.0, 1.0, 1.0)], "id long, g long, x double, y double, z double")

    def found(most):
        s = stage1.spatial_groups(frame, "id", "g", AT, task_points=most)
        return [sorted(map(tuple, t.select(*c).collect()), key=str) for t, c in ((s.members, ("g", "id", "group_id", "group_rows")), (s.forest, ("g", "u", "v", "w")), (s.scales, ("g", "n", "limit", "cut", "edges_used")))]

    whole = found(10_000)
    written: dict[str, int] = {}
    keep = Scratch.keep

    def seen(self, df, name="t"):
        table = keep(self, df, name)
        written[name] = max(written.get(name, 0), table.count())
        return table

    monkeypatch.setattr(Scratch, "keep", seen)
    assert found(0) == whole and max(written.values()) < 4 * len(at), written
    # cubes divided, and fields whose forests are too many for a task
    monkeypatch.setattr(stage1, "CUBE_POINTS", 10)
    monkeypatch.setattr(stage1, "CUBE_PARTS", 16)
    assert found(0) == whole
    monkeypatch.setattr(stage1, "TASK_FOREST", 5)
    assert found(0) == whole


def test_points_of_one_place_have_the_forest_of_their_pairs():
    import numpy as np

    from skein.operators.graph import forest_of
    from skein.operators.near import array_pairs
    from skein.plans.stage1 import thinned_edges

    rng = np.random.default_rng(8)
    at = np.round(rng.random((400, 3)) * 4)  # several points a place
    ids = rng.permutation(400) * 3
    a, b = array_pairs(at, 1.5, 10**6)
    u, v, w = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), np.sqrt(((at[a] - at[b]) ** 2).sum(axis=1))
    whole = forest_of(u, v, w)
    # 125 places at most have few pairs
    for got, want in zip(thinned_edges(ids, at, at, 1.5, most=2000), (u[whole], v[whole], w[whole])):
        np.testing.assert_array_equal(got, want)


def test_pairs_of_one_cell_come_in_runs(monkeypatch):
    import numpy as np

    from skein.operators import near

    at = np.random.default_rng(1).random((80, 3)) * 3
    whole = {tuple(sorted(p)) for a, b in near.pair_runs(at, 1.0) for p in zip(a.tolist(), b.tolist())}
    monkeypatch.setattr(near, "RUN", 7, raising=False)
    runs = list(near.pair_runs(at, 1.0))
    assert max(len(a) for a, _ in runs) <= 7 and len(whole) > 100
    assert sorted(tuple(sorted(p)) for a, b in runs for p in zip(a.tolist(), b.tolist())) == sorted(whole)


def written_names(monkeypatch):
    names, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": names.append(name) or keep(self, df, name))
    return names


def test_the_analysis_writes_its_points_once(spark, monkeypatch):
    names = written_names(monkeypatch)
    done = analyse(spark.createDataFrame(planted(), SCHEMA), "id", "g", AT, [Gate(("av",))], observables=["vl"])
    assert names.count("points") == 1 and "seeds" not in names
    first = done.stages[0].members.first()
    assert done.stage1.forest is None and {"x", "y", "z", "av", "vl"} <= set(first.asDict()) and first.av is not None and first.vl is not None


def test_refined_queries_tell_the_records_apart_once(spark, monkeypatch):
    from skein.plans import catalogue

    names, seen = written_names(monkeypatch), []
    monkeypatch.setattr(catalogue, "pipeline", lambda members, scales, gates: seen.append(members))
    found, _ = catalogue._staged(spark, "/root/testdata/sf0.001", [Gate(("reddening_mag",))])
    assert names.count("stars") == 1 and "points" not in names and found.forest is None
    assert {"g", "node", "root", "generation", "id", "x", "y", "z", "reddening_mag"} <= set(seen[0].columns)
