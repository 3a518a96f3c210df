"""The region that holds a point, by crossing parity, and points near others by the regions around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.near import finite
from skein.scratch import Scratch

#: Bins that hold more points than this are divided.
CROWDED = 4096
#: A crowded bin is divided into so many parts along each axis.
PARTS = 8
#: Strips of the next level are so many times as high.
STEP = 8.0
#: A list of crowded bins is broadcast up to so many rows.
BROADCAST_ROWS = 100_000

BOX = ("low_x", "high_x", "low_y", "high_y", "far_x")
EDGE = ("x1", "y1", "x2", "y2")


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Edges of the rings in ``vertices`` (``group_key``, ``region``, ``seq``, ``x``, ``y``), closed at the end.

    A repeated vertex gives an edge of no length, which no ray crosses.
    ``low_x`` and ``far_x`` are the whole ring's, as points left of an edge have it on their rays.
    """
    ring = Window.partitionBy("group_key", "region").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = vertices.select(
        "group_key",
        "region",
        "seq",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("x2"),
        F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)).alias("y2"),
        F.min("x").over(whole).alias("low_x"),
        F.max("x").over(whole).alias("far_x"),
    )
    return edges.withColumns({"high_x": F.greatest("x1", "x2"), "low_y": F.least("y1", "y2"), "high_y": F.greatest("y1", "y2")})


def points_in_regions(points: DataFrame, vertices: DataFrame, strip: float, **options) -> DataFrame:
    """Every pair of a point and a region of its group that holds it.

    ``points`` has ``group_key``, ``id``, ``x``, ``y``; ``vertices`` as in
    :func:`ring_edges`, one ring a region; those with a missing coordinate are
    left out.  Result and options as in :func:`count_crossings`.
    """
    good = F.col("group_key").isNotNull() & finite(F.col("x")) & finite(F.col("y"))
    ring = vertices.where(good).select("group_key", "region", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    of_edge = (*EDGE, "seq", *BOX)
    return count_crossings(points, ring_edges(ring), F.array(F.struct(*EDGE)), strip, region_columns=of_edge, **options).drop(*of_edge)


def count_crossings(
    points: DataFrame,
    outlines: DataFrame,
    edges: Column,
    strip: float,
    *,
    by: tuple[str, ...] = ("group_key",),
    point_columns: tuple[str, ...] = (),
    region_columns: tuple[str, ...] = (),
    box: dict[str, Column] | None = None,
    condition: Column | None = None,
    widest: float | None = None,
    crowded: int = CROWDED,
) -> DataFrame:
    """Every pair of a point and a region of its group (``by``) that holds it, by crossing parity.

    ``points`` has ``by``, ``id``, ``x``, ``y`` and ``point_columns``.  A row
    of ``outlines`` is an edge of a region or several: ``by``, ``region``,
    ``region_columns``, from which ``edges`` gives an array of ``x1``, ``y1``,
    ``x2``, ``y2``, and the ``box`` (by default the columns of those names)
    that holds those edges (``high_x``, ``low_y``, ``high_y``) and, along x,
    the whole region (``low_x``, ``far_x``).  Result: ``by``, ``region``, ``id``, ``on_boundary`` and
    those columns (the region's of one of its rows).  ``condition`` on them drops
    pairs that aren't wanted before any edge is looked at.

    Edges are binned into strips along y, points join the edges of their
    strip, and the crossings of the ray towards greater x are counted by point
    and region: an odd count is inside.  An edge crosses the ray of a point if
    it holds the point's y at its lower end but not at its upper end, so a
    vertex counts once and a level edge never.  A point on an edge, which is
    tested exactly, is inside with ``on_boundary`` true, whatever its parity.

    Strips are cut into bins along x.  Both are of the least size ``strip`` x
    8^n that the box fits, so an edge meets at most four bins however large
    its region is, and a point one bin of each size there is (``widest``, a
    bound of all boxes, saves looking them up).  A bin of more than
    ``crowded`` points is divided into smaller ones, and the points of those
    that still are crowded are dealt to several tasks, each with all edges of
    the bin.

    Points with a missing or infinite coordinate, null ids or null groups are
    in no region; repeated points and edges count once; points in no region
    give no row; empty tables give none.
    """
    known = F.lit(True)
    for c in by:
        known &= F.col(c).isNotNull()
    box = box or {c: F.col(c) for c in BOX}
    real = known & F.col("region").isNotNull()
    for c in BOX:
        real &= finite(box[c])
    outlines = outlines.select(*by, "region", *region_columns).where(real)
    if widest is None:
        for level, low, high in (("level_y", "low_y", "high_y"), ("level_x", "low_x", "far_x")):
            side = F.greatest((box[high] - box[low]) / strip, F.lit(1.0))
            outlines = outlines.withColumn(level, F.ceil(F.log(STEP, side) - 1e-9).cast("int"))
        # as many as powers of the step between the least and the greatest sizes
        levels = sorted((r.level_y, r.level_x) for r in outlines.select("level_y", "level_x").distinct().collect())
    else:
        levels, strip = [(0, 0)], max(strip, widest)
        outlines = outlines.withColumns({"level_y": F.lit(0), "level_x": F.lit(0)})
    pts = points.select(*by, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(c for c in point_columns if c not in ("x", "y")))
    pts = pts.where(known & F.col("id").isNotNull() & finite(F.col("x")) & finite(F.col("y")))
    if len(levels) == 1:
        pts = pts.withColumns({"level_y": F.lit(levels[0][0]), "level_x": F.lit(levels[0][1])})
    elif levels:
        pts = pts.select("*", F.inline(F.array(*(F.struct(F.lit(a).alias("level_y"), F.lit(b).alias("level_x")) for a, b in levels))))
    else:
        pts = pts.withColumns({"level_y": F.lit(0), "level_x": F.lit(0)})
    tall, wide = (F.lit(float(strip)) * F.pow(F.lit(STEP), F.col(c)) for c in ("level_y", "level_x"))
    pts = pts.withColumns({"row": F.floor(F.col("y") / tall), "column": F.floor(F.col("x") / wide)})
    span = lambda low, high, size: F.sequence(F.floor(box[low] / size), F.floor(box[high] / size))
    binned = outlines.withColumn("row", F.explode(span("low_y", "high_y", tall))).withColumn("column", F.explode(span("low_x", "high_x", wide)))
    # a level that all have is no key: a constant would cost the aggregations the partitioning
    keys = [*by, *(("level_y", "level_x") if len(levels) > 1 else ()), "row", "column"]
    hot = pts.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    if hot.take(1):
        pts, binned = _divided(pts, binned, box, hot.select(*keys), keys, tall, wide, crowded)
        keys += ["sub_row", "sub_column", "share"]
    # one shuffle each: repeats meet in their bin, and the join keeps the partitioning
    pts, binned = (t.repartition(*keys).dropDuplicates() for t in (pts, binned))
    right = binned.select(*(F.col(c).alias(f"{c}__r") for c in keys), "region", *region_columns)
    # rays that miss the box cross none of its edges
    met = F.col("y").between(box["low_y"], box["high_y"]) & (F.col("x") <= box["high_x"])
    for c in keys:
        met &= F.col(c) == F.col(f"{c}__r")
    if condition is not None:
        met &= condition
    held = [*point_columns, *region_columns]
    rays = pts.join(right, met).select(*keys, "region", "id", "x", "y", *(F.col(c).alias(f"__{c}") for c in held), F.inline(edges))
    cross = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("x") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    on_edge = (cross == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    upward = (F.col("y1") <= F.col("y")) & (F.col("y") < F.col("y2"))
    downward = (F.col("y2") <= F.col("y")) & (F.col("y") < F.col("y1"))
    crossing = (upward & (cross > 0)) | (downward & (cross < 0))
    seen = rays.withColumns({"crossing": crossing, "on_edge": on_edge}).where("crossing or on_edge")
    # with one size a point meets a region in one bin only, and the grouping keeps the partitioning of the join
    within = keys if len(levels) == 1 else [*by]
    counted = seen.groupBy(*within, "region", "id").agg(F.sum(F.col("crossing").cast("int")).alias("crossings"), F.max("on_edge").alias("on_boundary"), *(F.any_value(f"__{c}").alias(c) for c in held))
    return counted.where(F.col("on_boundary") | (F.col("crossings") % 2 == 1)).select(*by, "region", "id", "on_boundary", *held)


def _divided(pts: DataFrame, binned: DataFrame, box: dict[str, Column], hot: DataFrame, keys: list[str], tall: Column, wide: Column, crowded: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``sub_row``, ``sub_column`` (0 in bins that aren't ``hot``) and ``share``, which deals the points of one smaller bin to several tasks."""
    scratch = Scratch(pts.sparkSession, "regions")

    def marked(t: DataFrame, some: DataFrame, on: list[str], few: bool) -> DataFrame:
        return t.join(F.broadcast(some) if few else some, on, "left")

    hot = scratch.keep(hot.withColumn("hot", F.lit(True)), "hot")
    few = hot.count() <= BROADCAST_ROWS
    pts, binned = marked(pts, hot, keys, few), marked(binned, hot, keys, few)
    for sub, bin_, axis, size in (("sub_row", "row", "y", tall / PARTS), ("sub_column", "column", "x", wide / PARTS)):
        pts = pts.withColumn(sub, F.when(F.col("hot"), F.floor(F.col(axis) / size)).otherwise(F.lit(0)))
        # only the parts within the bin, and those beside it that rounding may give its points
        first, last = F.floor(box[f"low_{axis}"] / size), F.floor(box[f"high_{axis}"] / size)
        parts = F.sequence(F.greatest(first, F.col(bin_) * PARTS - 1), F.least(last, (F.col(bin_) + 1) * PARTS))
        binned = binned.withColumn(sub, F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.lit(0).cast("bigint")))))
    both = [*keys, "sub_row", "sub_column"]
    still = pts.where("hot").groupBy(*both).agg(F.count("*").alias("n")).where(F.col("n") > crowded)
    still = scratch.keep(still.select(*both, F.ceil(F.col("n") / crowded).cast("int").alias("shares")), "still")
    few = still.count() <= BROADCAST_ROWS
    pts, binned = marked(pts.drop("hot"), still, both, few), marked(binned.drop("hot"), still, both, few)
    shares = F.coalesce("shares", F.lit(1))
    pts = pts.withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int")).drop("shares")
    return pts, binned.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")


def pairs_by_regions(points: DataFrame, ident: str, coords: list[str], radius: float, group: str, *, coarse: float = 8.0, crowded: int = CROWDED) -> DataFrame:
    """All pairs of points of one group at most ``radius`` apart in three coordinates: ``group_key``, ``id_a`` < ``id_b``, ``dist2``.

    The region of a point is a square that holds its disc of ``radius`` in the
    first two coordinates; which points are in which squares is told by
    :func:`count_crossings`, in slices along the third coordinate, and the
    exact distance follows.  Points with a missing or infinite coordinate, a
    null id or group are in no pair; a record repeated under one id counts
    once and must carry equal coordinates; other columns are ignored; an empty
    table gives no row.
    """
    good = points.select(F.col(group).alias("group_key"), F.col(ident).alias("id"), *(F.col(c).cast("double").alias(a) for c, a in zip(coords, "xyz")))
    good = good.where(F.col("id").isNotNull() & finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    slab, by, centre = coarse * radius, ("group_key", "slice"), {a: F.col(f"centre_{a}") for a in "xyz"}
    reach = {a: F.lit(radius * (1 + 1e-9)) + F.abs(c) * 1e-15 for a, c in centre.items()}  # wider by what rounding may take
    low, high = ({a: centre[a] + sign * reach[a] for a in "xyz"} for sign in (-1, 1))
    edge = lambda a, b: F.struct(*(c.alias(n) for n, c in zip(EDGE, (*a, *b))))
    corners = [(low["x"], low["y"]), (high["x"], low["y"]), (high["x"], high["y"]), (low["x"], high["y"])]
    square = F.array(*(edge(a, b) for a, b in zip(corners, corners[1:] + corners[:1])))
    discs = good.select("group_key", F.col("id").alias("region"), *(F.col(a).alias(f"centre_{a}") for a in "xyz"))
    discs = discs.withColumn("slice", F.explode(F.sequence(F.floor(low["z"] / slab), F.floor(high["z"] / slab))))
    box = {"low_x": low["x"], "high_x": high["x"], "low_y": low["y"], "high_y": high["y"], "far_x": high["x"]}
    wanted = (F.col("id") < F.col("region")) & (F.abs(F.col("z") - centre["z"]) <= reach["z"])
    held = count_crossings(
        good.withColumn("slice", F.floor(F.col("z") / slab)), discs, square, slab,
        by=by, point_columns=("x", "y", "z"), region_columns=tuple(f"centre_{a}" for a in "xyz"), box=box, condition=wanted, widest=2.1 * radius, crowded=crowded,
    )
    gaps = [F.col(a) - centre[a] for a in "xyz"]
    dist2 = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
    return held.select("group_key", F.col("id").alias("id_a"), F.col("region").alias("id_b"), dist2.alias("dist2")).where(F.col("dist2") <= F.lit(radius * radius))
