import math
import random

from skein.operators.near import neighbour_counts, pairs_between, pairs_within
from skein.operators.regions import pairs_by_regions, points_in_regions

SCHEMA = "g long, id long, x double, y double, z double, id_a string, c0 int"


def brute(points, radius):
    good = sorted({p[:5] for p in points if p[0] is not None and p[1] is not None and all(v is not None and math.isfinite(v) for v in p[2:5])}, key=lambda p: p[1])
    return {(p[1], q[1]) for i, p in enumerate(good) for q in good[i + 1 :] if p[0] == q[0] and p[1] < q[1] and math.dist(p[2:5], q[2:5]) <= radius}


def cloud(n, seed, spread):
    rnd = random.Random(seed)
    return [(rnd.randrange(2), i, *(rnd.gauss(0, spread) for _ in range(3)), "clash", 1) for i in range(n)]


def found(spark, points, radius, **options):
    pairs = pairs_within(spark.createDataFrame(points, SCHEMA), "id", ["x", "y", "z"], radius, group="g", **options).collect()
    assert len(pairs) == len({(r.id_a, r.id_b) for r in pairs})
    return {(r.id_a, r.id_b) for r in pairs}


def test_equals_brute_force(spark):
    points = cloud(400, 1, 3.0)
    assert found(spark, points, 0.7) == brute(points, 0.7)


def test_hot_cells_are_split_exactly(spark):
    points = cloud(300, 2, 0.4) + [(0, 1000 + i, 0.0, 0.0, 0.0, "", 1) for i in range(20)]
    assert found(spark, points, 0.3, hot_cell=10) == brute(points, 0.3)


def test_dirty_rows(spark):
    bad = [(None, 9001, 0.0, 0.0, 0.0, "", 1), (0, None, 0.0, 0.0, 0.0, "", 1), (0, 9002, math.nan, 0.0, 0.0, "", 1), (0, 9003, math.inf, 0.0, 0.0, "", 1), (0, 9004, None, 0.0, 0.0, "", 1)]
    good = [(0, 1, 1e300, -1e300, 0.0, "", 1), (0, 2, 0.0, 0.0, 0.0, "", 1), (0, 3, 0.5, 0.0, 0.0, "", 1), (1, 4, 0.0, 0.0, 0.0, "", 1)]
    assert found(spark, bad + good + good, 0.5) == {(2, 3)}
    assert found(spark, [], 0.5) == set()


def test_cell_borders(spark):
    points = [(0, i, 4.0 * i, 0.0, 0.0, "", 1) for i in range(-5, 6)] + [(0, 100 + i, 4.0 * i - 0.5, 0.0, 0.0, "", 1) for i in range(-5, 6)]
    points = [(g, i + 10, *rest) for g, i, *rest in points]
    assert found(spark, points, 0.5) == brute(points, 0.5)


def test_small_right_side_is_broadcast_with_equal_rows(spark, tmp_path):
    left, right = (spark.createDataFrame(cloud(150, s, 1.0), SCHEMA) for s in (3, 4))
    right.write.parquet(str(tmp_path / "r"))
    right = spark.read.parquet(str(tmp_path / "r"))
    sets = []
    for few in (True, False):
        pairs = pairs_between(left, right, "id", "id", ["x", "y", "z"], 0.5, group="g", few_right=few)
        sets.append({(r.group_key, r.id_a, r.id_b) for r in pairs.collect()})
    assert sets[0] == sets[1] and sets[0]


def test_neighbour_counts(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    assert {(r.id, r.n_neighbours) for r in neighbour_counts(pairs).collect()} == {(1, 2), (2, 1), (3, 1)}


def inside(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return "edge"
        if (y1 <= y < y2 and side > 0) or (y2 <= y < y1 and side < 0):
            hit = not hit
    return "in" if hit else None


def test_regions_with_boundaries(spark):
    rings = {"star": [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)], "box": [(2, 2), (6, 2), (6, 6), (2, 6)]}
    vertices = spark.createDataFrame([(0, r, i, float(x), float(y)) for r, ring in rings.items() for i, (x, y) in enumerate(ring)], "group_key long, region string, seq int, x double, y double")
    points = [(0, 100 * i + j, i / 2, j / 2) for i in range(-2, 24) for j in range(-2, 24)]
    frame = spark.createDataFrame(points + points[:50] + [(0, 9999, None, 1.0), (None, 9998, 1.0, 1.0), (0, 9997, float("nan"), 1.0)], "group_key long, id long, x double, y double")
    got = {(r.region, r.id, "edge" if r.on_boundary else "in") for r in points_in_regions(frame, vertices, 1.5).collect()}
    want = {(r, i, inside(ring, x, y)) for _, i, x, y in points for r, ring in rings.items() if inside(ring, x, y)}
    assert got == want
    assert points_in_regions(frame, vertices.limit(0), 1.5).count() == 0


def region_pairs(spark, points, radius, **options):
    pairs = pairs_by_regions(spark.createDataFrame(points, SCHEMA), "id", ["x", "y", "z"], radius, "g", **options).collect()
    assert len(pairs) == len({(r.id_a, r.id_b) for r in pairs})
    return {(r.id_a, r.id_b) for r in pairs}


def test_pairs_by_regions_equal_brute_force(spark):
    points = cloud(400, 5, 2.5)
    assert region_pairs(spark, points + points[:40], 0.7) == brute(points, 0.7)


def test_crowded_bins_are_divided_exactly(spark):
    # some parts stay crowded, as their points coincide
    points = cloud(250, 6, 0.5) + [(0, 1000 + i, 0.1, -0.2, 0.3, "", 1) for i in range(40)]
    assert region_pairs(spark, points, 0.3, crowded=10) == brute(points, 0.3)


def test_pairs_by_regions_on_bin_borders_and_dirty_rows(spark):
    points = [(0, i + 10, 4.0 * i, -4.0 * i, 8.0, "", 1) for i in range(-5, 6)] + [(0, 100 + i, 4.0 * i - 0.5, -4.0 * i, 8.0, "", 1) for i in range(-5, 6)]
    points += [(0, 200 + i, 4.0 * i, -4.0 * i + 0.5, 8.0, "", 1) for i in range(-5, 6)] + [(0, 300 + i, 4.0 * i, -4.0 * i, 7.5, "", 1) for i in range(-5, 6)]
    assert region_pairs(spark, points, 0.5) == brute(points, 0.5)
    bad = [(None, 9001, 0.0, 0.0, 0.0, "", 1), (0, None, 0.0, 0.0, 0.0, "", 1), (0, 9002, math.nan, 0.0, 0.0, "", 1), (0, 9003, math.inf, 0.0, 0.0, "", 1), (0, 9004, None, 0.0, 0.0, "", 1)]
    good = [(0, 1, 1e300, -1e300, 0.0, "", 1), (0, 2, 0.0, 0.0, 0.0, "", 1), (0, 3, 0.5, 0.0, 0.0, "", 1), (1, 4, 0.0, 0.0, 0.0, "", 1)]
    assert region_pairs(spark, bad + good + good, 0.5) == {(2, 3)}
    assert region_pairs(spark, [], 0.5) == set()


def test_regions_of_all_sizes(spark):
    rings = {f"r{k}": [(0.0, 0.0), (2.0**k, 0.0), (2.0**k, 2.0**k), (2.0 ** (k - 1), 2.0 ** (k - 2)), (0.0, 2.0**k)] for k in range(-3, 7)}
    vertices = spark.createDataFrame([(0, r, i, x - 3, y - 3) for r, ring in rings.items() for i, (x, y) in enumerate(ring)], "group_key long, region string, seq int, x double, y double")
    rnd = random.Random(8)
    points = [(0, i, rnd.uniform(-4, 64), rnd.uniform(-4, 64)) for i in range(300)] + [(0, 1000 + i, rnd.uniform(-3, -2), rnd.uniform(-3, -2)) for i in range(100)]
    got = {(r.region, r.id) for r in points_in_regions(spark.createDataFrame(points, "group_key long, id long, x double, y double"), vertices, 1.0, crowded=20).collect()}
    assert got == {(r, i) for _, i, x, y in points for r, ring in rings.items() if inside([(a - 3, b - 3) for a, b in ring], x, y)}
