"""Stage 1: one linking scale per field from its own spanning tree, and the groups at that scale."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.breaks import array_break, jenks_two_class
from skein.operators.graph import SCAN_EDGES, components_of, forest_of, forest_scan, grouped_components, percolation_limit, scan_of
from skein.operators.near import finite, pair_runs, pairs_within
from skein.operators.running import running
from skein.scratch import Scratch, busy_parts

AXES = ["x", "y", "z"]
#: Fields of up to so many points, and ``TASK_EDGES`` edges within the radius, are done inside a task.
TASK_POINTS = 1_500_000
TASK_EDGES = 50_000_000
#: The forests of a larger field's cubes are joined inside a task up to so many edges, as tables beyond.
TASK_FOREST = 4_000_000
#: Side of these cubes in mean spacings, and the points beyond which one is divided by ``CUBE_PARTS`` a side.
CUBE, CUBE_POINTS, CUBE_PARTS = 32.0, 150_000, 8
#: Fields of more points are begun before the others, so that none is left alone at the end.
EARLY_POINTS = 50_000
START, GROWTH = 1.3, 1.6


@dataclass
class Stage1:
    """``scales``: g, n, limit, cut, edges_used.  ``members``: g, id, group_id, group_rows and what was carried.  ``forest``: g, u, v, w up to the radius searched, None if not asked for."""

    scales: DataFrame
    members: DataFrame
    forest: DataFrame | None


def clean_points(df: DataFrame, ident: str, group: str, coords: list[str], carry: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """``g``, ``id``, ``x``, ``y``, ``z`` and ``carry``: one row per id with finite coordinates (``distinct``: no id is repeated)."""
    points = df.select(F.col(group).cast("long").alias("g"), F.col(ident).cast("long").alias("id"), *(F.col(c).cast("double").alias(a) for c, a in zip(coords, AXES)), *carry)
    good = F.col("g").isNotNull() & F.col("id").isNotNull()
    for a in AXES:
        good &= finite(F.col(a))
    return points.where(good) if distinct else points.where(good).dropDuplicates(["g", "id"])


def mean_spacing(points: DataFrame) -> DataFrame:
    """Per field the edge of the cube that holds one point on average (1 where all points coincide)."""
    spans = [F.max(a) - F.min(a) for a in AXES]
    box = points.groupBy("g").agg(F.count("*").alias("n"), *(s.alias(f"s{a}") for s, a in zip(spans, AXES)))
    widest = F.greatest(*(F.col(f"s{a}") for a in AXES))
    # a flat field counts as a hundredth as deep as it is wide
    volume = F.lit(1.0)
    for a in AXES:
        volume = volume * F.greatest(F.col(f"s{a}"), widest / 100)
    spacing = F.when(widest > 0, F.pow(volume / F.col("n"), F.lit(1 / 3))).otherwise(1.0)
    return box.select("g", "n", spacing.alias("spacing"), F.when(widest > 0, F.sqrt(sum((F.col(f"s{a}") ** 2 for a in AXES[1:]), F.col("sx") ** 2)) / spacing).otherwise(0.0).alias("diameter"))


def _in_cubes(points: DataFrame, radius: float, side: float, name: str) -> DataFrame:
    """``points`` in their cube and in those that end less than ``radius`` below them, so any pair within it shares a cube; ``name``: the cube."""
    for a in AXES:
        points = points.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(f"{a}s") - radius * (1 + 1e-9)) / side), F.floor(F.col(f"{a}s") / side))))
    return points.withColumn(name, F.xxhash64(*(f"c{a}" for a in AXES))).drop(*(f"c{a}" for a in AXES))


def cube_forests(points: DataFrame, spacing: DataFrame, radius: float, scratch: Scratch) -> DataFrame:
    """Spanning forests of the pairs of a field within ``radius`` times its mean spacing, cube by cube: ``g``, ``u``, ``v``, ``w``.

    An edge that isn't in a cube's forest isn't in the field's, so no other
    pair is ever written.  An edge of two cubes may come twice.
    """
    scaled = points.join(spacing.select("g", "spacing"), "g").select("g", "id", *AXES, "spacing", *((F.col(a) / F.col("spacing")).alias(f"{a}s") for a in AXES))
    cubes = _in_cubes(scaled, radius, max(CUBE, 4 * radius), "part")
    full = scratch.keep(cubes.groupBy("g", "part").agg(F.count("*").alias("held")).where(F.col("held") > CUBE_POINTS).select("g", "part"), "full")
    whole = cubes.join(full, ["g", "part"], "left_anti").withColumn("fine", F.lit(0).cast("bigint"))
    if full.take(1):
        whole = whole.unionByName(_in_cubes(cubes.join(full, ["g", "part"], "left_semi"), radius, max(CUBE / CUBE_PARTS, 2 * radius), "fine"))
    where = ["g", "part", "fine"]

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[AXES].to_numpy()
        u, v, w = thinned_edges(pdf["id"].to_numpy(), at, at / pdf["spacing"].iloc[0], radius, most=None)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "u": u, "v": v, "w": w})

    laid = whole.select(*where, "id", *AXES, "spacing").repartition(busy_parts(points.sparkSession), *where)
    return laid.groupBy(*where).applyInPandas(forest, "g bigint, u bigint, v bigint, w double")


def linking_scale(points: DataFrame, scratch: Scratch, *, start: float = START, growth: float = GROWTH) -> tuple[DataFrame, DataFrame]:
    """Each field's percolation limit, and the spanning forest that it was read from.

    Candidate edges are the pairs within a radius.  The forest of the pairs
    within R holds exactly the tree's edges up to R, and the largest jump seen
    is final once the points outside the largest component are no more than
    it.  Fields that aren't settled are searched again with a larger radius;
    the whole tree is never needed.
    """
    spacing = scratch.keep(mean_spacing(points), "spacing")
    waiting, radius, limits, forests = points, start, [], []
    while True:
        edges = scratch.keep(cube_forests(waiting, spacing, radius, scratch), "edges")
        scan = scratch.keep(forest_scan(edges), "scan")
        scratch.drop(edges)
        forest = scan.select("g", "u", "v", "w")
        limit = percolation_limit(scan).join(spacing, "g", "right")
        # the scan ends with the largest component that the radius shows
        ends = scan.groupBy("g").agg(F.max("largest_after").alias("largest"))
        judged = scratch.keep(limit.join(ends, "g", "left").join(waiting.select("g").distinct(), "g", "left_semi"), "limits")
        settled = (F.col("n") - F.coalesce("largest", F.lit(1)) <= F.coalesce("jump", F.lit(-1))) | (F.col("diameter") <= radius) | (F.col("n") < 2)
        done = judged.where(settled).select("g", "n", "limit", "jump")
        limits.append(done)
        forests.append(forest.join(done.select("g"), "g", "left_semi"))
        waiting = scratch.keep(waiting.join(judged.where(~settled).select("g"), "g", "left_semi"), "waiting")
        if not waiting.take(1):
            break
        radius *= growth
    out, tree = limits[0], forests[0]
    for more, edges in zip(limits[1:], forests[1:]):
        out, tree = out.unionByName(more), tree.unionByName(edges)
    return out, tree


def numbered_groups(links: DataFrame, fields: DataFrame, min_size: int, scratch: Scratch) -> DataFrame:
    """Components of ``links`` (``g``, ``u``, ``v``) with ``min_size`` members, numbered 1, 2 ... per field by their smallest id."""
    named = scratch.keep(grouped_components(scratch.keep(links, "links")).join(fields.select("g", "id"), "id"), "components")
    sizes = named.groupBy("g", "component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    numbers = running(sizes, ["g"], ["component"], None, "groups").select("g", "component", "size", F.col("rank").alias("group_id"))
    return named.join(numbers, ["g", "component"]).select("g", "id", "group_id", F.col("size").alias("group_rows"))


_FIELD = "g bigint, kind string, u bigint, v bigint, w double, n bigint, cut double"


def thinned_edges(ids: np.ndarray, at: np.ndarray, scaled: np.ndarray, radius: float, hold: int = SCAN_EDGES, most: int | None = TASK_EDGES) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The spanning forest (u < v, w) of all pairs at most ``radius`` apart, in order; None if there are more than ``most``.

    Whenever ``hold`` pairs (twice the points, if that is more) are gathered
    they are thinned to their forest: an edge that isn't in a part's forest
    isn't in the whole.  Of the points of one place only the least id meets
    other places, and the rest of them meet it, as their ties would have it.
    """
    by_id = np.argsort(ids)
    ids, at, scaled = ids[by_id], at[by_id], scaled[by_id]  # so that positions are in the order of the ids
    by_place = np.lexsort(at.T)  # ids of a place stay in order
    new = np.r_[True, (at[by_place[1:]] != at[by_place[:-1]]).any(axis=1)]
    places, others = by_place[new], by_place[~new]
    first = places[np.cumsum(new)[~new] - 1]
    places = np.sort(places)
    held, n, seen = [(first, others, np.zeros(len(others)))], len(others), 0
    hold = max(hold, 2 * len(ids))

    def forest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, v, w = (np.concatenate(x) for x in zip(*held))
        tree = forest_of(u, v, w, len(ids))
        return u[tree], v[tree], w[tree]

    for a, b in pair_runs(scaled[places], radius):
        a, b = places[a], places[b]
        gap = at[a] - at[b]
        held.append((np.minimum(a, b), np.maximum(a, b), np.sqrt((gap[:, 0] ** 2 + gap[:, 1] ** 2) + gap[:, 2] ** 2)))
        n, seen = n + len(a), seen + len(a)
        if most is not None and seen > most:
            return None
        if n > hold:
            held = [forest()]
            n = len(held[0][0])
    u, v, w = forest()
    return ids[u], ids[v], w


def field_rows(g: int, n: int, diameter: float, radius: float, edges: tuple[np.ndarray, np.ndarray, np.ndarray], min_size: int, forest: bool) -> pd.DataFrame | None:
    """One field's limit, cut, forest and groups from its forest up to ``radius``, as rows of ``_FIELD``; None if that is not far enough."""
    u, v, w = edges
    before, after = scan_of(u, v)
    grown = after - before
    if n - (after[-1] if len(w) else 1) > (grown.max() if len(w) else -1) and diameter > radius and n >= 2:
        return None
    limit = w[grown.argmax()] if len(w) else np.nan
    below = w <= limit
    used = int(below.sum())
    cut = array_break(w[below]) if used >= 2 else np.nan
    named, component = components_of(u[w <= cut], v[w <= cut])
    _, at_, size = np.unique(component, return_inverse=True, return_counts=True)
    number = np.cumsum(size >= min_size)
    kept = size[at_] >= min_size
    if not forest:
        u, v, w = u[:0], v[:0], w[:0]
    parts = [1, len(w), int(kept.sum())]
    rows = lambda first, edges, members, none=0: np.concatenate([[first], edges if edges is not None else np.full(parts[1], none), members if members is not None else np.full(parts[2], none)])
    return pd.DataFrame(
        {
            "g": g,
            "kind": np.repeat(np.array(["limit", "edge", "member"], dtype=object), parts),
            "u": rows(used, u, named[kept]),
            "v": rows(0, v, number[at_][kept]),
            "w": rows(limit, w, None, np.nan),
            "n": rows(n, None, size[at_][kept]),
            "cut": rows(cut, None, None, np.nan),
        }
    )


def _one_row(g: int, kind: str, n: int) -> pd.DataFrame:
    return pd.DataFrame({"g": g, "kind": [kind], "u": 0, "v": 0, "w": np.nan, "n": n, "cut": np.nan})


def field_in_task(pdf: pd.DataFrame, min_size: int, carry: tuple[str, ...] = (), forest: bool = True) -> pd.DataFrame:
    """One field's limit, cut, forest and groups by the same steps on arrays, as rows of ``_FIELD`` and ``carry``.

    ``limit``: w, n, cut, u edges used; ``edge``: u, v, w; ``member``: u id,
    v group, n its rows, and ``carry``.  A field with too many edges has one row ``crowded``.
    """
    g, n = pdf["g"].iloc[0], len(pdf)
    ids, at = pdf["id"].to_numpy(), pdf[AXES].to_numpy()
    sides = np.ptp(at, axis=0)
    widest = sides.max()
    # as mean_spacing
    spacing = (np.maximum(sides, widest / 100).prod() / n) ** (1 / 3) if widest > 0 else 1.0
    diameter = np.sqrt((sides**2).sum()) / spacing if widest > 0 else 0.0
    radius, done = START, None
    while done is None:
        edges = thinned_edges(ids, at, at / spacing, radius)
        if edges is None:
            return _one_row(g, "crowded", n).assign(**dict.fromkeys(carry, np.nan))
        done = field_rows(g, n, diameter, radius, edges, min_size, forest)
        radius *= GROWTH
    member = (done["kind"] == "member").to_numpy()
    by_id = np.argsort(ids)
    held = by_id[np.searchsorted(ids, done["u"].to_numpy()[member], sorter=by_id)]
    for c in carry:
        values = np.full(len(done), np.nan)
        values[member] = pdf[c].to_numpy(dtype=float)[held]
        done[c] = values
    return done


def spatial_groups(df: DataFrame, ident: str, group: str, coords: list[str], *, min_size: int = 10, task_points: int = TASK_POINTS, carry: tuple[str, ...] = (), forest: bool = True, distinct: bool = False) -> Stage1:
    """Fields are split into spatial groups at a scale of their own.

    The percolation limit of the field's Euclidean minimum spanning tree and
    then the two-class natural break of the edges up to it give the cut; the
    components at the cut with ``min_size`` members or more are the groups.
    Points with missing coordinates, ids or fields are left out, repeated ids
    count once.  A field of fewer than three points, or with fewer than two
    edges up to the limit, has no groups and a null cut.  Fields of up to
    ``task_points`` points are done whole inside a task, larger and crowded
    ones cube by cube, with equal results.

    With ``carry`` (columns of numbers) the members have these and their
    positions, so nobody has to look them up.  ``distinct``: ``df`` is a
    written table that repeats no id.
    """
    scratch = Scratch(df.sparkSession, "stage1")
    points = clean_points(df, ident, group, coords, tuple(F.col(c).cast("double").alias(c) for c in carry), distinct)
    points = points if distinct else scratch.keep(points, "points")
    carried = (*AXES, *carry) if carry else ()
    sizes = points.groupBy("g").agg(F.count("*").alias("n"))
    early = scratch.keep(sizes.where(F.col("n") > min(EARLY_POINTS, task_points)), "early")
    schema = _FIELD + "".join(f", `{c}` double" for c in carried)
    # the largest fields come first among the tasks
    first, rest = points.join(early.where(F.col("n") <= task_points).select("g"), "g", "left_semi"), points.join(early.select("g"), "g", "left_anti")
    parts = [some.repartition(busy_parts(df.sparkSession), "g").groupBy("g").applyInPandas(lambda pdf: field_in_task(pdf, min_size, carried, forest), schema) for some in (first, rest)]
    done = scratch.keep(parts[0].unionByName(parts[1]), "fields")
    found = _of_rows(done, carried, forest)
    large = early.where(F.col("n") > task_points).select("g").unionByName(done.where("kind = 'crowded'").select("g"))
    if not large.take(1):
        return found
    hard = scratch.keep(points.join(large, "g", "left_semi"), "large")
    more = _groups_by_cubes(hard.select("g", "id", *AXES), min_size, scratch, forest)
    if carried:
        more.members = more.members.join(hard.select("g", "id", *carried), ["g", "id"])
    return _both(found, more)


def _of_rows(done: DataFrame, carried: tuple[str, ...], forest: bool) -> Stage1:
    """The written rows of ``field_rows`` as tables."""
    null = lambda c: F.nanvl(c, F.lit(None).cast("double")).alias(c)
    scales = done.where("kind = 'limit'").select("g", "n", null("w").alias("limit"), null("cut"), F.when(F.col("u") >= 2, F.col("u")).alias("edges_used"))
    members = done.where("kind = 'member'").select("g", F.col("u").alias("id"), F.col("v").alias("group_id"), F.col("n").alias("group_rows"), *carried)
    return Stage1(scales, members, done.where("kind = 'edge'").select("g", "u", "v", "w") if forest else None)


def _both(a: Stage1, b: Stage1) -> Stage1:
    return Stage1(a.scales.unionByName(b.scales), a.members.unionByName(b.members), a.forest.unionByName(b.forest) if a.forest is not None else None)


def _groups_by_cubes(points: DataFrame, min_size: int, scratch: Scratch, forest: bool) -> Stage1:
    """As :func:`spatial_groups` of clean points: pairs are searched and thinned cube by cube in many tasks, and the forests of a field's cubes joined in one, or as tables if they are too many."""
    fields = scratch.keep(mean_spacing(points), "spacing")
    radius, out, tall = START, None, []
    while True:
        thin = scratch.keep(cube_forests(points, fields, radius, scratch), "thinned")
        over = scratch.keep(thin.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > TASK_FOREST).select("g"), "tall")
        tall.append(over)
        # a row of each field ahead of its edges: some have none
        heads = fields.select("g", F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("v"), F.lit(0.0).alias("w"), "n", "diameter")
        rows = heads.unionByName(thin.select("*", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("diameter"))).join(over, "g", "left_anti")

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            n = pdf["n"].to_numpy()
            head, g = int(n.argmax()), pdf["g"].iloc[0]
            u, v, w = (pdf[c].to_numpy()[n == 0] for c in "uvw")
            tree = forest_of(u, v, w)
            done = field_rows(g, n[head], pdf["diameter"].iloc[head], radius, (u[tree], v[tree], w[tree]), min_size, forest)
            return _one_row(g, "open", n[head]) if done is None else done

        done = scratch.keep(rows.repartition(busy_parts(points.sparkSession), "g").groupBy("g").applyInPandas(whole, _FIELD), "fields")
        scratch.drop(thin)
        found = _of_rows(done, (), forest)
        out = found if out is None else _both(out, found)
        fields = scratch.keep(fields.join(done.where("kind = 'open'").select("g"), "g", "left_semi"), "spacing")
        if not fields.take(1):
            break
        radius *= GROWTH
    for over in tall:
        if over.take(1):
            more = _groups_by_tables(points.join(over, "g", "left_semi"), min_size, scratch)
            out = _both(out, more if forest else Stage1(more.scales, more.members, None))
    return out


def _groups_by_tables(points: DataFrame, min_size: int, scratch: Scratch) -> Stage1:
    """As :func:`spatial_groups` of clean points, for fields of any size."""
    limits, forest = linking_scale(points.select("g", "id", *AXES), scratch)
    limits = scratch.keep(limits, "scales")
    forest = scratch.keep(forest, "tree")
    below = forest.join(limits.select("g", "limit"), "g").where("w <= limit").select("g", "u", "v", "w")
    breaks = jenks_two_class(below.withColumn("tie", F.struct("u", "v")), ["g"], "w", "tie").where("n >= 2").select("g", "cut", F.col("n").alias("edges_used"))
    scales = scratch.keep(limits.join(breaks, "g", "left").select("g", "n", "limit", "cut", "edges_used"), "cuts")
    kept = below.join(scales.select("g", "cut"), "g").where("w <= cut")
    members = scratch.keep(numbered_groups(kept, points, min_size, scratch), "members")
    return Stage1(scales, members, forest)


def groups_at_radius(df: DataFrame, ident: str, group: str, coords: list[str], radius: float, *, min_size: int = 1) -> DataFrame:
    """Components of all pairs within ``radius``: ``g``, ``id``, ``group_id``, ``group_rows``.

    The same groups as cutting the spanning tree at ``radius``, without a
    tree.  Points near no other are groups of one.
    """
    scratch = Scratch(df.sparkSession, "radius")
    points = scratch.keep(clean_points(df, ident, group, coords), "points")
    pairs = pairs_within(points, "id", AXES, radius, group="g").select(F.col("group_key").alias("g"), F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    if min_size <= 1:
        pairs = pairs.unionByName(points.select("g", F.col("id").alias("u"), F.col("id").alias("v")))
    return numbered_groups(pairs, points, min_size, scratch)
