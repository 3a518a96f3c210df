"""Components, spanning forests and percolation of edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.running import running
from skein.scratch import Scratch

#: The percolation scan holds so many edges of a group in one task.
SCAN_EDGES = 1_000_000


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", job: str = "components") -> DataFrame:
    """``id`` and ``component`` (its smallest id) of every id on an edge.

    Alternating large-star and small-star steps: each id's greater
    neighbours, then its smaller ones, are tied to the smallest neighbour.
    The edge table never grows by more than it holds ids, and each step is a
    grouped minimum with partial aggregation and a join.  Written out after
    each round; ends when the edges no longer change.  Null ends and loops
    tie nothing; loops still name their id.
    """
    scratch = Scratch(edges.sparkSession, job)
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    now = scratch.keep(pairs.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")

    def star(table: DataFrame, large: bool) -> DataFrame:
        both = table if not large else table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("m", "a").alias("m"))
        tied = both.join(least, F.col("a") == F.col("c"))
        if large:
            moved = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = tied.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        return moved.where("a <> b").distinct()

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())

    before = mark(now)
    while before[0]:
        after = scratch.keep(star(star(now, True), False), "edges")
        scratch.drop(now)
        now = after
        seen = mark(now)
        if seen == before:
            break
        before = seen
    return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def spanning_forest(edges: DataFrame, job: str = "forest") -> DataFrame:
    """The minimum spanning forest of ``edges`` (``u``, ``v``, ``w``), ties by (w, u, v) with u < v.

    Borůvka rounds: the least edge that leaves a set of points is in the
    forest whatever the set, so each set hooks onto the set behind its least
    edge (a grouped minimum); the hooks are shortened by two jumps, the edges
    relabelled, those within a set dropped, and of the edges between two sets
    only the least kept.  Sets at least halve each round.  Edges with a null
    end or weight and loops are left out; of parallel edges the least counts.
    """
    scratch = Scratch(edges.sparkSession, job)
    clean = edges.where("u is not null and v is not null and u <> v and w is not null")
    clean = clean.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w"))
    left = scratch.keep(clean.select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.struct("w", "u", "v").alias("e")), "edges")
    chosen: list[DataFrame] = []
    while left.take(1):
        ends = left.select(F.inline(F.array(F.struct(F.col("cu").alias("c"), F.struct("e", F.col("cv").alias("to")).alias("x")), F.struct(F.col("cv").alias("c"), F.struct("e", F.col("cu").alias("to")).alias("x")))))
        hooks = scratch.keep(ends.groupBy("c").agg(F.min("x").alias("x")).select("c", "x.to", "x.e"), "hooks")
        chosen.append(hooks.select("e.u", "e.v", "e.w").distinct())
        # two sets that hook onto each other: the smaller one is the root
        there = hooks.select(F.col("c").alias("to"), F.col("to").alias("next"))
        up = hooks.join(there, "to").select("c", F.when((F.col("next") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        for _ in range(2):
            up = up.join(up.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", F.col("q").alias("p"))
        a, b = (up.select(F.col("c").alias(f"c{x}"), F.col("p").alias(f"n{x}")) for x in "uv")
        moved = left.join(a, "cu").join(b, "cv").select(F.col("nu").alias("x"), F.col("nv").alias("y"), "e").where("x <> y")
        after = scratch.keep(moved.groupBy(F.least("x", "y").alias("cu"), F.greatest("x", "y").alias("cv")).agg(F.min("e").alias("e")), "edges")
        scratch.drop(left)
        left = after
    if not chosen:
        return clean.limit(0).select("u", "v", "w")
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _scan(edges: pd.DataFrame, sizes: dict, largest: int) -> tuple[list[tuple], dict, int]:
    """Kruskal scan of edges in order: size of the largest component before and after each edge."""
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    rows = []
    for u, v in zip(edges["cu"].to_numpy(), edges["cv"].to_numpy()):
        a, b = root(u), root(v)
        total = sizes.get(a, 1) + sizes.get(b, 1)
        low, high = (a, b) if a < b else (b, a)
        parent[high] = low
        sizes[low] = total
        rows.append((largest, max(largest, total)))
        largest = max(largest, total)
    return rows, sizes, largest


def percolation(forest: DataFrame, job: str = "percolation", scan_edges: int = SCAN_EDGES) -> DataFrame:
    """For each edge of a forest (``g``, ``u``, ``v``, ``w``) in order of (w, u, v) within its
    group: ``rank`` and the size of the group's largest component before and
    after it (``largest_before``, ``largest_after``).

    Runs of ``scan_edges`` ranks are scanned, each in one task per group, so no
    task holds more than a run, however large its group.  Ranks are halved
    down to such runs: the components of a lower half become the ends of the
    upper half's edges, so each edge is relabelled once a halving and never
    searched again from the start.
    """
    scratch = Scratch(forest.sparkSession, job)
    ranked = running(forest.select("g", "u", "v", "w"), ["g"], ["w", "u", "v"], None, job).drop("group_rows")
    one = F.lit(1).cast("bigint")
    ranked = scratch.keep(ranked.withColumns({"cu": F.col("u"), "cv": F.col("v"), "su": one, "sv": one, "largest": one}), "ranked")
    top = ranked.agg(F.max("rank")).first()[0] or 0
    schema = "g bigint, rank bigint, u bigint, v bigint, w double, largest_before bigint, largest_after bigint"
    parts: list[DataFrame] = []

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        sizes = dict(zip(pdf["cu"], pdf["su"])) | dict(zip(pdf["cv"], pdf["sv"]))
        rows, _, _ = _scan(pdf, sizes, int(pdf["largest"][0]))
        before, after = np.array(rows, dtype=np.int64).T if rows else (np.empty(0, np.int64),) * 2
        return pdf[["g", "rank", "u", "v", "w"]].assign(largest_before=before, largest_after=after)

    def solve(edges: DataFrame, first: int, last: int) -> None:
        """Scan the ranks after ``first`` up to ``last``, whose ends are the components before ``first``."""
        runs = -(-(last - first) // scan_edges)
        if runs <= 1:
            parts.append(scratch.keep(edges.groupBy("g").applyInPandas(scan, schema), "scan"))
            return
        middle = first + runs // 2 * scan_edges
        low, high = edges.where(F.col("rank") <= middle), edges.where(F.col("rank") > middle)
        solve(low, first, middle)
        # a group with ranks above the middle has all those below
        low = low.join(high.select("g").distinct(), "g", "left_semi")
        named = scratch.keep(connected_components(low.select(F.col("cu").alias("u"), F.col("cv").alias("v")), job=f"{job}-half"), "named")
        ends = low.select("g", F.col("cu").alias("id"), F.col("su").alias("size")).unionByName(low.select("g", F.col("cv").alias("id"), F.col("sv").alias("size"))).distinct()
        sizes = scratch.keep(ends.join(named, "id").groupBy("g", "component").agg(F.sum("size").alias("size")), "sizes")
        grown = sizes.groupBy("g").agg(F.max("size").alias("grown"))
        sized = named.join(sizes.drop("g"), "component")
        a, b = (sized.select(F.col("id").alias(f"c{x}"), F.col("component").alias(f"n{x}"), F.col("size").alias(f"m{x}")) for x in "uv")
        high = high.join(a, "cu", "left").join(b, "cv", "left").join(grown, "g")
        high = high.select("g", "rank", "u", "v", "w", *(F.coalesce(f"n{x}", f"c{x}").alias(f"c{x}") for x in "uv"), *(F.coalesce(f"m{x}", f"s{x}").alias(f"s{x}") for x in "uv"), F.greatest("largest", "grown").alias("largest"))
        high = scratch.keep(high, "high")
        scratch.drop(named, sizes)
        solve(high, middle, last)
        scratch.drop(high)

    if top:
        solve(ranked, 0, top)
        scratch.drop(ranked)
    if not parts:
        return forest.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _by_size(edges: DataFrame, task_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges of groups that fit a task, and those of larger groups (None if there are none)."""
    large = edges.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > task_edges).select("g")
    if not large.take(1):
        return edges, None
    return edges.join(large, "g", "left_anti"), edges.join(large, "g", "left_semi")


def _edge_order(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions in order of (w, u, v)."""
    order = np.argsort(w)
    same = np.diff(w[order]) == 0
    if same.any():
        tied = np.r_[False, same] | np.r_[same, False]
        at = order[tied]
        order[tied] = at[np.lexsort((v[at], u[at], w[at]))]
    return order


def forest_of(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int | None = None) -> np.ndarray:
    """Positions of the edges of the minimum spanning forest in order of (w, u, v), by Borůvka rounds on arrays.

    ``n``: the ends are numbers from 0 to n - 1 already.
    """
    order = _edge_order(u, v, w)
    if n is None:
        ids, ends = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
        a, b, n = ends[: len(order)], ends[len(order) :], len(ids)
    else:
        a, b = u[order], v[order]
    at, chosen, none = np.arange(len(order)), np.zeros(len(order), dtype=bool), len(order)
    while True:
        open_ = a != b
        a, b, at = a[open_], b[open_], at[open_]
        if not len(at):
            break
        # positions are in order, so the first edge of a set is its least
        least = np.full(n, none)
        np.minimum.at(least, a, np.arange(len(at)))
        np.minimum.at(least, b, np.arange(len(at)))
        sets = np.flatnonzero(least < none)
        edge = least[sets]
        chosen[at[edge]] = True
        parent = np.arange(n)
        parent[sets] = np.where(a[edge] == sets, b[edge], a[edge])
        # two sets that hook onto each other: the smaller one is the root
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
    return order[chosen]


def scan_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of the largest component before and after each edge of a forest, in its order."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent, sizes, largest = list(range(len(ids))), [1] * len(ids), 1
    before, after = [], []
    for x, y in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if sizes[x] < sizes[y]:
            x, y = y, x
        parent[y] = x
        sizes[x] += sizes[y]
        before.append(largest)
        largest = max(largest, sizes[x])
        after.append(largest)
    return np.array(before, dtype=np.int64), np.array(after, dtype=np.int64)


def _task_forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The forest of one group's edges with the percolation scan along it."""
    u, v, w = (pdf[c].to_numpy() for c in "uvw")
    at = forest_of(u, v, w)
    before, after = scan_of(u[at], v[at])
    return pd.DataFrame({"g": pdf["g"].iloc[0], "rank": np.arange(1, len(at) + 1), "u": u[at], "v": v[at], "w": w[at], "largest_before": before, "largest_after": after})


def _part_forest(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[["g", "u", "v", "w"]].iloc[forest_of(*(pdf[c].to_numpy() for c in "uvw"))]


def forest_scan(edges: DataFrame, job: str = "forest-scan", task_edges: int = SCAN_EDGES) -> DataFrame:
    """Spanning forest and percolation scan of every group of ``edges`` (``g``, ``u`` < ``v``, ``w``, written).

    As :func:`percolation` of :func:`spanning_forest`.  Groups of up to
    ``task_edges`` edges are done inside a task.  The edges of larger ones are
    first thinned to the forests of their parts (a column ``part``, if there is
    one: an edge that isn't in a part's forest isn't in the whole); what is
    still larger is done as tables.
    """
    schema = "g bigint, rank bigint, u bigint, v bigint, w double, largest_before bigint, largest_after bigint"
    small, large = _by_size(edges, task_edges)
    out = small.groupBy("g").applyInPandas(_task_forest, schema)
    if large is not None and "part" in edges.columns:
        scratch = Scratch(edges.sparkSession, job)
        # a crowded part is dealt to several tasks
        shares = large.groupBy("g", "part").agg(F.ceil(F.count("*") / task_edges).alias("shares"))
        dealt = large.join(shares, ["g", "part"]).withColumn("share", F.pmod(F.xxhash64("u", "v"), F.col("shares")))
        small, large = _by_size(scratch.keep(dealt.groupBy("g", "part", "share").applyInPandas(_part_forest, "g bigint, u bigint, v bigint, w double"), "thinned"), task_edges)
        out = out.unionByName(small.groupBy("g").applyInPandas(_task_forest, schema))
    if large is not None:
        forest = spanning_forest(large.select("u", "v", "w"), job)
        field = large.select("g", "u", "v")
        out = out.unionByName(percolation(forest.join(field, ["u", "v"]).select("g", "u", "v", "w").distinct(), job))
    return out


def components_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids on edges, and the smallest id of the component of each."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = ends[: len(u)], ends[len(u) :], np.arange(len(ids))
    while len(a):
        # roots take the least root among their neighbours, and all point at roots again
        x, y = least[a], least[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := least[least], least):
            least = up
    return ids, ids[least]


def _task_components(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, component = components_of(pdf["u"].to_numpy(), pdf["v"].to_numpy())
    return pd.DataFrame({"id": ids, "component": component})


def grouped_components(edges: DataFrame, job: str = "grouped", task_edges: int = SCAN_EDGES) -> DataFrame:
    """As :func:`connected_components`, for ``edges`` (``g``, ``u``, ``v``, written) that never cross groups: small groups inside a task."""
    edges = edges.where("g is not null and u is not null and v is not null")
    small, large = _by_size(edges, task_edges)
    out = small.groupBy("g").applyInPandas(_task_components, "id bigint, component bigint")
    return out if large is None else out.unionByName(connected_components(large, job=job))


def percolation_limit(scan: DataFrame) -> DataFrame:
    """Per group the first edge weight with the strictly largest growth of the largest component.

    Result: ``g``, ``limit``, ``jump``, ``largest_before``, ``largest_after``
    and ``midpoint`` with the edge before it (the edge itself if it is the first).
    """
    grown = F.col("largest_after") - F.col("largest_before")
    best = scan.groupBy("g").agg(F.max(F.struct(grown.alias("jump"), (-F.col("rank")).alias("back"), "w", "largest_before", "largest_after")).alias("b"))
    at = best.select("g", "b.*", (-F.col("b.back") - 1).alias("rank_before"))
    previous = scan.select(F.col("g").alias("pg"), F.col("rank").alias("prank"), F.col("w").alias("pw"))
    joined = at.join(previous, (F.col("g") == F.col("pg")) & (F.col("rank_before") == F.col("prank")), "left")
    return joined.select("g", F.col("w").alias("limit"), "jump", "largest_before", "largest_after", ((F.col("w") + F.coalesce("pw", "w")) / 2).alias("midpoint"))


def coherence_threshold(scan: DataFrame, share: float = 0.8) -> DataFrame:
    """Per group the first edge weight at which the largest component holds ``share`` of its points (those on the forest)."""
    total = scan.groupBy("g").agg((F.count("*") + 1).alias("n"))
    held = scan.join(total, "g").where(F.col("largest_after") >= F.ceil(F.col("n") * share))
    return held.groupBy("g").agg(F.min("w").alias("threshold"))
