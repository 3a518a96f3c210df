"""Grouping records into similarity clusters by Markov clustering (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.components import group_links
from skein.operators.near import finite, pairs_between
from skein.scratch import Scratch

AT = ["x", "y", "z", "extra"]


@dataclass(frozen=True)
class MarkovClustering:
    """Parameters.

    Two records are similar if they are within ``radius`` in space and
    ``spread`` in the extra value; the similarity falls as a normal curve
    of width ``radius`` / 4 in space and ``spread`` / 2 in the extra value.
    """

    radius: float = 8.0
    spread: float = 0.5
    inflation: float = 2.0
    prune: float = 1e-4
    settled: float = 1e-6
    max_rounds: int = 60
    #: Diagonal blocks of the matrix up to this size are squared within a task.
    block_rows: int = 1024
    #: A record whose row and column of the matrix give more products is dealt to several tasks.
    hot_products: int = 4_000_000


def _weight_sql(p: MarkovClustering, d2: str, gap: str) -> str:
    return f"exp(-8D * ({d2}) / {p.radius**2!r}D - 2D * ({gap}) * ({gap}) / {p.spread**2!r}D)"


def clean_records(points: DataFrame, ident: str, group: str, coords: list[str], extra: str) -> DataFrame:
    """``g``, ``id``, ``x``, ``y``, ``z``, ``extra`` of the rows that have them all; repeats stay."""
    clean = points.select(F.col(group).alias("g"), F.col(ident).alias("id"), *(F.col(c).cast("double").alias(n) for c, n in zip([*coords, extra], AT)))
    good = F.col("g").isNotNull() & F.col("id").isNotNull()
    for c in AT:
        good &= finite(F.col(c))
    return clean.where(good)


def linked_records(clean: DataFrame, p: MarkovClustering, scratch: Scratch) -> DataFrame:
    """The records, each once, that are similar to another: all that the matrix ties to anything."""
    pairs = pairs_between(clean, clean, "id", "id", ["x", "y", "z"], p.radius, group="g", carry=tuple(AT), condition=F.abs(F.col("extra_a") - F.col("extra_b")) <= p.spread)
    counted = pairs.groupBy("group_key", "id_a", *(f"{c}_a" for c in AT)).agg(F.count("*").alias("similar"))
    # a record meets itself once
    kept = counted.where("similar > 1").toDF("g", "id", *AT, "similar")
    return scratch.keep(kept.drop("similar"), "linked")


def distinct_places(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """One row (``id``, the least, and ``copies``) for each place in (``g``, ``x``, ``y``, ``z``, ``extra``), and the place of every record.

    Records at one place have equal rows in the matrix, so a place stands for them with a weight.
    """
    places = scratch.keep(records.groupBy("g", *AT).agg(F.min("id").alias("id"), F.count("*").alias("copies")), "places")
    shared = places.where("copies > 1").withColumnRenamed("id", "place").drop("copies")
    same = records.join(shared, ["g", *AT], "left").select("g", "id", *AT, F.coalesce("place", "id").alias("place"))
    return places, same


def diagonal_blocks(records: DataFrame, p: MarkovClustering, scratch: Scratch) -> DataFrame:
    """``records`` with ``block``: records of different blocks are never similar.

    Blocks are connected sets of occupied cells of ``radius``, found by
    linking each cell to its occupied neighbours.
    """
    cell = [F.floor(F.col(c) / p.radius).alias(f"c{c}") for c in "xyz"]
    placed = records.select("*", *cell)
    where = ["g", "cx", "cy", "cz"]
    cells = scratch.keep(placed.groupBy(*where).agg(F.min("id").alias("cell")), "cells")
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    moves = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for d, c in zip(s, "xyz"))) for s in steps))
    aside = cells.select(F.col("cell").alias("a"), "g", "cx", "cy", "cz", F.inline(moves)).select("a", "g", *((F.col(f"c{c}") + F.col(f"d{c}")).alias(f"c{c}") for c in "xyz"))
    links = aside.join(cells.withColumnRenamed("cell", "b"), where).select("a", "b")
    groups = group_links(links, "a", "b", "blocks").toDF("cell", "block")
    named = cells.join(groups, "cell", "left").select(*where, F.coalesce("block", "cell").alias("block"))
    return scratch.keep(placed.join(named, where).drop("cx", "cy", "cz"), "blocks")


def _flow(m: np.ndarray, n: np.ndarray, p: MarkovClustering) -> tuple[np.ndarray, np.ndarray, bool]:
    """Strongest attractor of each column, the flow each row received, and whether the columns settled, of one block's similarities.

    ``m`` has a row and a column for each place, ``n`` its number of records:
    an entry is the flow to one of them, so a column's weighted sum is 1.
    """
    flow = np.zeros(len(m))
    m = m / (n @ m)
    for _ in range(p.max_rounds):
        m = ((m * n) @ m) ** p.inflation
        m /= n @ m
        m[m < p.prune] = 0
        m /= n @ m
        flow += m @ n
        if (m.max(axis=0) - n @ (m * m)).max() < p.settled:
            return np.round(m, 6).argmax(axis=0), flow, True
    return np.round(m, 6).argmax(axis=0), flow, False


def _inner_blocks(records: DataFrame, p: MarkovClustering) -> DataFrame:
    """Markov clustering of small blocks, each squared in the task that holds it."""

    def one(block: pd.DataFrame) -> pd.DataFrame:
        at = block[["x", "y", "z"]].to_numpy()
        extra = block["extra"].to_numpy()
        d2 = ((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
        gap = np.abs(extra[:, None] - extra[None, :])
        weight = np.exp(-8 * d2 / p.radius**2 - 2 * gap**2 / p.spread**2)
        weight[(d2 > p.radius**2) | (gap > p.spread)] = 0
        attractor, flow, settled = _flow(weight, block["copies"].to_numpy(dtype=float), p)
        ids = block["id"].to_numpy()
        return pd.DataFrame({"id": ids, "attractor": ids[attractor], "flow": flow, "settled": settled})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            starts = np.flatnonzero(np.r_[True, batch["block"].to_numpy()[1:] != batch["block"].to_numpy()[:-1]]) if len(batch) else []
            if len(starts) > 1:
                yield pd.concat([one(batch.iloc[i:j]) for i, j in zip(starts[:-1], starts[1:])], ignore_index=True)
            rest = batch.iloc[starts[-1] :] if len(starts) else None
        if rest is not None:
            yield one(rest)

    columns = records.repartition("block").sortWithinPartitions("block", "id").select("block", "id", *AT, "copies")
    return columns.mapInPandas(run, "id bigint, attractor bigint, flow double, settled boolean")


def _normal(m: DataFrame, value: Column, p: MarkovClustering) -> DataFrame:
    """Columns scaled to a weighted sum of 1, small entries pruned, and scaled again."""
    column = Window.partitionBy("j")
    m = m.select("i", "j", "n", value.alias("v")).withColumn("v", F.col("v") / F.sum(F.col("v") * F.col("n")).over(column))
    m = m.where(F.col("v") >= p.prune)
    return m.withColumn("v", F.col("v") / F.sum(F.col("v") * F.col("n")).over(column))


def _spread_blocks(records: DataFrame, p: MarkovClustering, scratch: Scratch) -> DataFrame:
    """Markov clustering of blocks of any size: the matrix is a table, squared by join and grouping."""
    near = F.abs(F.col("extra_a") - F.col("extra_b")) <= p.spread
    pairs = pairs_between(records, records, "id", "id", ["x", "y", "z"], p.radius, group="g", carry=("extra", "copies"), condition=near)
    start = pairs.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), F.col("copies_a").alias("n"), F.expr(_weight_sql(p, "dist2", "extra_a - extra_b")).alias("w"))
    m = scratch.keep(start.withColumn("v", F.col("w") / F.sum(F.col("w") * F.col("n")).over(Window.partitionBy("j"))).select("i", "j", "n", "v"), "m")
    copies = records.select(F.col("id").alias("j"), F.col("copies").alias("m"))
    received, chaos = None, None
    for _ in range(p.max_rounds):
        # entries (i, k) meet (k, j): a record with many products has its columns dealt to shares, and its rows sent to each
        ends = m.select(F.inline(F.array(F.struct(F.col("j").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("i").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))))
        hot = ends.groupBy("k").agg(F.ceil(F.sum("a") * F.sum("b") / p.hot_products).cast("int").alias("shares")).where("shares > 1")
        left = m.select("i", F.col("j").alias("k"), "n", F.col("v").alias("v1"))
        right = m.select(F.col("i").alias("k"), "j", (F.col("v") * F.col("n")).alias("v2"))
        hot = scratch.keep(hot, "hot")
        if hot.take(1):
            shares = F.coalesce("shares", F.lit(1))
            left = left.join(hot, "k", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
            right = right.join(hot, "k", "left").withColumn("share", F.pmod(F.xxhash64("j"), shares).cast("int")).drop("shares")
        met = left.join(right, ["k", "share"] if "share" in left.columns else ["k"])
        squared = met.groupBy("i", "j").agg(F.sum(F.col("v1") * F.col("v2")).alias("s"), F.max("n").alias("n"))
        after = scratch.keep(_normal(squared, F.pow("s", F.lit(p.inflation)), p), "m")
        scratch.drop(m, hot)
        m = after
        rows = m.join(copies, "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("v") * F.col("m")).alias("flow"))
        total = rows if received is None else received.unionByName(rows).groupBy("id").agg(F.sum("flow").alias("flow"))
        total = scratch.keep(total, "flow")
        if received is not None:
            scratch.drop(received)
        received = total
        chaos = m.groupBy("j").agg((F.max("v") - F.sum(F.col("n") * F.col("v") * F.col("v"))).alias("c")).agg(F.max("c")).first()[0]
        if chaos is None or chaos < p.settled:
            break
    settled = chaos is None or chaos < p.settled
    strongest = m.groupBy(F.col("j").alias("id")).agg(F.max_by("i", F.struct(F.round("v", 6), -F.col("i"))).alias("attractor"))
    return strongest.join(received, "id", "left").select("id", "attractor", F.coalesce("flow", F.lit(0.0)).alias("flow"), F.lit(settled).alias("settled"))


def markov_clusters(points: DataFrame, ident: str, group: str, coords: list[str], extra: str, p: MarkovClustering = MarkovClustering(), *, sparse: bool = True) -> DataFrame:
    """Clusters of mutually similar records within each group.

    Result: ``group_key``, ``cluster_id`` (least id of its members), ``id``,
    ``x``, ``y``, ``z``, ``extra``, ``flow``, the flow a member received
    over the rounds: the members with the most flow are the most typical; and
    ``settled``, false where the matrix still changed after ``max_rounds``.

    Alternates squaring, inflation and pruning of the column-stochastic
    similarity matrix until it is settled; each column's strongest attractor,
    followed to the end, defines its cluster.  Every similar pair counts, and
    every record is in exactly one cluster, one without a similar other in one
    of its own; ``sparse=False`` leaves those out of the result.  The matrix falls into diagonal blocks
    (connected occupied cells): blocks of up to ``block_rows`` places are
    squared inside a task, larger ones as a distributed table, with equal
    results.  Records at one place and with one extra value are one row and
    column with a weight.

    Records with a null id or group or a missing or infinite coordinate or
    extra value belong to no cluster.  Repeated records count once; ties go to
    the smaller id; other columns are ignored; an empty table gives no row.
    """
    scratch = Scratch(points.sparkSession, "clusters")
    clean = clean_records(points, ident, group, coords, extra)
    linked = linked_records(clean, p, scratch)
    places, same = distinct_places(linked, scratch)
    records = diagonal_blocks(places, p, scratch)
    sizes = records.groupBy("block").agg(F.count("*").alias("rows"))
    large = sizes.where(F.col("rows") > p.block_rows).select("block")
    if large.take(1):
        large = scratch.keep(large, "large")
        inner = _inner_blocks(records.join(large, "block", "left_anti"), p)
        flows = inner.unionByName(_spread_blocks(records.join(large, "block", "left_semi"), p, scratch))
    else:
        flows = _inner_blocks(records, p)
    flows = scratch.keep(flows, "flows")
    groups = group_links(flows, "id", "attractor", "attractors").toDF("place", "cluster_id")
    named = flows.select(F.col("id").alias("place"), "flow", "settled").join(groups, "place")
    member = same.join(named, "place").select(F.col("g").alias("group_key"), "cluster_id", "id", *AT, "flow", "settled")
    member = scratch.keep(member, "members")
    scratch.drop(linked, places, records, flows)
    if not sparse:
        return member
    alone = clean.join(member.select("id"), "id", "left_anti").distinct()
    return member.unionByName(alone.select(F.col("g").alias("group_key"), F.col("id").alias("cluster_id"), "id", *AT, F.lit(1.0).alias("flow"), F.lit(True).alias("settled")))


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """Size, mean position, the ``typical`` members with the most flow (ties: smaller id) of each cluster, and whether it is settled."""
    by = ["group_key", "cluster_id"]
    summary = members.groupBy(*by).agg(F.count("*").alias("size"), *(F.avg(c).alias(f"mean_{c}") for c in AT), F.bool_and("settled").alias("settled"))
    rest = members.select(*by, "id", F.struct("flow", (-F.col("id")).alias("back")).alias("rank"))
    # the best, then the best of the rest: no cluster is sorted in one task
    for n in range(typical):
        top = rest.groupBy(*by).agg(F.max("rank").alias("top"))
        summary = summary.join(top.select(*by, (-F.col("top.back")).alias(f"typical_{n + 1}")), by, "left")
        rest = rest.join(top, by).where(F.col("rank") < F.col("top")).drop("top")
    return summary


def isolated_clusters(members: DataFrame, records: DataFrame, *, inner: tuple[float, float], outer: tuple[float, float], min_size: int) -> DataFrame:
    """Of ``markov_clusters``' result the clusters that are compact and have none of the ``records`` near: ``id``, ``cluster_id``.

    A cluster passes whole or not at all: ``min_size`` members or more, all
    within ``inner`` (distance, extra) of their mean, and no other record of
    the group (as from :func:`clean_records`) within ``outer`` of it.
    """
    scratch = Scratch(members.sparkSession, "isolated")
    slack = 1e-9

    def within(limits: tuple[float, float], side: str = "") -> Column:
        d2 = sum(((F.col(f"{c}{side}") - F.col(f"m_{c}")) ** 2 for c in ("y", "z")), (F.col(f"x{side}") - F.col("m_x")) ** 2)
        return (F.sqrt(d2) <= limits[0] + slack) & (F.abs(F.col(f"extra{side}") - F.col("m_extra")) <= limits[1] + slack)

    centres = members.groupBy("group_key", "cluster_id").agg(*(F.avg(c).alias(f"m_{c}") for c in AT), F.count("*").alias("size")).where(F.col("size") >= min_size)
    compact = members.join(centres.drop("group_key"), "cluster_id").groupBy("cluster_id").agg(F.bool_and(within(inner)).alias("compact"), F.any_value("group_key").alias("group_key"), F.any_value("size").alias("size"), *(F.any_value(f"m_{c}").alias(f"m_{c}") for c in AT)).where("compact")
    compact = scratch.keep(compact.select("group_key", "cluster_id", "size", *(F.col(f"m_{c}").alias(c) for c in AT)), "compact")
    near = pairs_between(records.withColumnRenamed("g", "group_key"), compact, "id", "cluster_id", ["x", "y", "z"], outer[0] + slack, group="group_key", coarse=2.0, carry=("extra",), condition=F.abs(F.col("extra_a") - F.col("extra_b")) <= outer[1] + slack)
    there = near.groupBy(F.col("id_b").alias("cluster_id")).agg(F.count("*").alias("there"))
    passed = there.join(compact.select("cluster_id", "size"), "cluster_id").where("there = size").select("cluster_id")
    return members.join(passed, "cluster_id", "left_semi").select("id", "cluster_id")
