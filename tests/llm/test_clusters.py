import math
import random

from skein.llm.clusters import MarkovClustering, clean_records, describe_clusters, isolated_clusters, markov_clusters

SCHEMA = "i long, g long, px double, py double, pz double, av double, x string, flow int"
AT = ["px", "py", "pz"]


def field(seed=1):
    rnd = random.Random(seed)
    rows, ident = [], 0
    for centre, size in ((0, 30), (60, 14), (120, 25)):
        for _ in range(size):
            ident += 1
            rows.append((ident, 1, centre + rnd.gauss(0, 0.8), rnd.gauss(0, 0.8), rnd.gauss(0, 0.8), 1.0 + rnd.gauss(0, 0.05), "clash", 1))
    for _ in range(60):
        ident += 1
        rows.append((ident, 1, rnd.uniform(-40, 160), rnd.uniform(20, 200), rnd.uniform(20, 200), rnd.uniform(0, 3), "", 1))
    return rows


def sets(rows):
    groups = {}
    for ident, cluster in rows:
        groups.setdefault(cluster, set()).add(ident)
    return {frozenset(s) for s in groups.values()}


def clusters(spark, rows, **parameters):
    return markov_clusters(spark.createDataFrame(rows, SCHEMA), "i", "g", AT, "av", MarkovClustering(**parameters))


def test_planted_clusters_and_their_centres(spark):
    rows = field()
    members = clusters(spark, rows + rows[:10])
    assert {frozenset(range(1, 31)), frozenset(range(31, 45)), frozenset(range(45, 70))} <= sets((r.id, r.cluster_id) for r in members.collect())
    described = {r.cluster_id: r for r in describe_clusters(members).collect()}
    first = described[1]
    assert first.size == 30 and len({first.typical_1, first.typical_2, first.typical_3}) == 3
    at = {r[0]: r[2:5] for r in rows}
    # the most typical member lies nearer to the middle than most
    gaps = sorted(math.dist(at[i], (first.mean_x, first.mean_y, first.mean_z)) for i in range(1, 31))
    assert math.dist(at[first.typical_1], (first.mean_x, first.mean_y, first.mean_z)) <= gaps[14]


def test_blocks_in_tasks_and_as_tables_agree(spark):
    rows = field(2)
    one, other = (sets((r.id, r.cluster_id) for r in clusters(spark, rows, block_rows=n).collect()) for n in (1024, 1))
    assert one == other


def test_isolation_check(spark):
    rows = field(3)
    near = (5000, 1, 6.0, 0.0, 0.0, 1.0, "", 1)
    options = dict(inner=(4.0, 0.25), outer=(8.0, 0.6), min_size=10)
    for extra, wanted in (([], 3), ([near], 2)):
        frame = spark.createDataFrame(rows + extra, SCHEMA)
        found = isolated_clusters(markov_clusters(frame, "i", "g", AT, "av"), clean_records(frame, "i", "g", AT, "av"), **options)
        assert len({r.cluster_id for r in found.collect()}) == wanted


def test_dirty_and_empty(spark):
    bad = [(None, 1, 0.0, 0.0, 0.0, 1.0, "", 1), (1, None, 0.0, 0.0, 0.0, 1.0, "", 1), (2, 1, math.inf, 0.0, 0.0, 1.0, "", 1), (3, 1, 0.0, 0.0, 0.0, math.nan, "", 1), (4, 1, 0.0, 0.0, 0.0, None, "", 1)]
    assert clusters(spark, bad).count() == 0
    assert clusters(spark, []).count() == 0
    same = [(i, 1, 0.0, 0.0, 0.0, 1.0, "", 1) for i in range(12)]
    assert sets((r.id, r.cluster_id) for r in clusters(spark, same).collect()) == {frozenset(range(12))}


def test_every_record_is_in_one_cluster(spark):
    rows = field(4)
    members = clusters(spark, rows + rows[:5]).collect()
    assert sorted(r.id for r in members) == sorted(r[0] for r in rows)
    assert all(r.settled for r in members)
    # the scattered ones are too sparse: clusters of their own
    assert sum(len(s) == 1 for s in sets((r.id, r.cluster_id) for r in members)) >= 50


def test_records_at_one_place_count_with_their_number(spark):
    rows = field(5)
    # thirty more at the place of one member, and a crowd of their own
    more = [(1000 + k, *rows[3][1:]) for k in range(30)] + [(2000 + k, 1, -80.0, 0.0, 0.0, 1.0, "", 1) for k in range(20)]
    found = {}
    for n in (1024, 1):
        members = clusters(spark, rows + more, block_rows=n, hot_products=50).collect()
        found[n] = sets((r.id, r.cluster_id) for r in members)
        flow = {r.id: r.flow for r in members}
        assert abs(flow[1000] - flow[rows[3][0]]) < 1e-9
    assert found[1024] == found[1]
    assert frozenset(range(2000, 2020)) in found[1]
    assert any({rows[3][0], *range(1000, 1030)} <= s for s in found[1])


def test_an_unsettled_matrix_is_reported(spark):
    for n in (1024, 1):
        members = clusters(spark, field(6), max_rounds=1, block_rows=n)
        assert members.where("not settled").count() > 0
        assert describe_clusters(members).where("not settled").count() > 0


def test_every_similar_pair_counts(spark):
    # two records far from all others: each is similar to one only
    pair = [(3000, 1, 400.0, 0.0, 0.0, 1.0, "", 1), (3001, 1, 401.0, 0.0, 0.0, 1.0, "", 1)]
    assert frozenset({3000, 3001}) in sets((r.id, r.cluster_id) for r in clusters(spark, field(7) + pair).collect())
