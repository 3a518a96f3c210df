"""Consolidating pairwise matches into groups (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scratch import Scratch


def _jump(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer jumping until every node points at its root; each written table holds two jumps, which quarter the depth."""
    while True:
        hop = lambda t, n: t.join(parents.select(F.col("id").alias("parent"), F.col("parent").alias(f"above{n}")), "parent", "left")
        jumped = parents.select("id", "parent")
        for n in range(3):
            # a node without parent of its own is a root
            jumped = hop(jumped, n).select("id", F.coalesce(f"above{n}", "parent").alias("parent"), F.col(f"above{n}").isNotNull().alias("moved"))
        jumped = scratch.keep(jumped, "jump")
        scratch.drop(parents)
        parents = jumped
        if not parents.where("moved").take(1):
            return parents.select("id", "parent")


def group_links(links: DataFrame, a: str, b: str, job: str = "links") -> DataFrame:
    """One group per set of records linked directly or through others.

    ``a`` and ``b`` are integer ids.  Result: ``id``, ``group_id``, the
    smallest id of the group, for every id in a link with both ends (also one
    linked only with itself).  Links with a null end are left out; repeated
    links, either direction and other columns change nothing; no link gives no
    row.

    Each round every node takes the smallest label among its neighbours
    (pre-aggregated per task, so a hub's links meet as partial minima), the
    resulting trees are flattened by pointer jumping, and the links are
    relabelled to the roots, with repeats and loops removed.  A round ends in
    written tables.  The rounds end when no link is left, that is when no
    label changes any more; their number follows the logarithm of the longest
    chain.  The roots' tables are then looked up from the last round back.
    """
    scratch = Scratch(links.sparkSession, job)
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    ends = scratch.keep(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    ids = ends.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    edges = ends.where("u <> v")
    rounds: list[DataFrame] = []
    while edges.take(1):
        # in a link u < v, so only the greater end can take a smaller label
        hooks = scratch.keep(edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("parent")), "hooks")
        parents = scratch.keep(_jump(hooks, scratch), "parents")
        rounds.append(parents)
        p, q = (parents.select(F.col("id").alias(end), F.col("parent").alias(f"r{end}")) for end in "uv")
        moved = edges.join(q, "v").join(p, "u", "left").select(F.coalesce("ru", "u").alias("x"), F.col("rv").alias("y")).where("x <> y")
        relabelled = scratch.keep(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        scratch.drop(edges)  # the links themselves stay: their ids are read at the end
        edges = relabelled
    if not rounds:
        return ids.select("id", F.col("id").alias("group_id"))
    roots = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        top = roots.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        looked = earlier.join(top, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"))
        roots = looked.unionByName(roots) if rounds else scratch.keep(looked.unionByName(roots), "roots")
    return ids.join(roots, "id", "left").select("id", F.coalesce("parent", "id").alias("group_id"))
