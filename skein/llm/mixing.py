"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import Scratch

#: Targets are few; more are refused, so that they may be broadcast.
MOST_TARGETS = 10_000
#: Documents of one source are laid out in stretches of about so many.
BUCKET_ROWS = 50_000


def source_demand(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Tokens to take from each source.

    ``sizes`` has ``source`` and ``n_tokens``, ``targets`` has ``source``,
    ``target_share`` and ``max_repeats``.  Shares are taken among the targets
    whose source has tokens.  Without ``total_tokens`` the mixture is the
    largest that keeps every such share: the source that runs out first at
    its ``max_repeats`` sets it.  With it, sources fall short where they run
    out.  Result: a row per target with ``available``, ``n_documents``,
    ``share`` (among available sources) and ``need``.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_documents"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
    joined = wanted.join(F.broadcast(have.join(F.broadcast(wanted.select("source")), "source", "left_semi")), "source", "left")
    usable = (F.coalesce("available", F.lit(0)) > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    joined = joined.withColumn("usable", F.coalesce(usable, F.lit(False)))
    everything = Window.partitionBy(F.lit(0))  # one row for each target, a bounded number
    shared = joined.withColumn("share", F.when(F.col("usable"), F.col("target_share") / F.sum(F.when(F.col("usable"), F.col("target_share"))).over(everything)).otherwise(0.0))
    most = F.col("available") * F.col("max_repeats")
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.when(F.col("usable"), most / F.col("share"))).over(everything)
    return shared.withColumn("total", F.coalesce(total, F.lit(0.0))).withColumn("need", F.least(F.col("share") * F.col("total"), F.coalesce(most, F.lit(0)).cast("double"))).drop("usable")


def weight_schedule(demand: DataFrame, ramp: float = 0.5) -> DataFrame:
    """A piecewise-linear weight over training time 0..1 for each source.

    Sources that are repeated (need above what they have) gain weight, so that
    repeats come late, and the others lose as much, so that all weights add up
    to 1 at any time; the lesser of the two sides goes from (1 - ``ramp``) to
    (1 + ``ramp``) times its share or back.  Result: ``source``, ``t0``, ``t1``, ``w0``, ``w1``, ``area`` (the
    weight's integral before ``t0``), one row for each of two segments.
    """
    grows = F.col("need") > F.col("available")
    everything = Window.partitionBy(F.lit(0))
    up = F.coalesce(F.sum(F.when(grows, F.col("share"))).over(everything), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(~grows, F.col("share"))).over(everything), F.lit(0.0))
    # what the growing sources gain at any time the others lose
    change = F.lit(ramp) * F.least(up, down)
    tilt = F.when(grows, change / up).otherwise(-change / down)
    tilted = demand.withColumn("tilt", F.when(change > 0, tilt).otherwise(0.0)).where("need > 0")
    low, high = F.col("share") * (1 - F.col("tilt")), F.col("share") * (1 + F.col("tilt"))
    first = F.struct(F.lit(0.0).alias("t0"), F.lit(0.5).alias("t1"), low.alias("w0"), F.col("share").alias("w1"), F.lit(0.0).alias("area"))
    second = F.struct(F.lit(0.5).alias("t0"), F.lit(1.0).alias("t1"), F.col("share").alias("w0"), high.alias("w1"), ((low + F.col("share")) / 4).alias("area"))
    return tilted.select("source", F.inline(F.array(first, second)))


def mix_sources(documents: DataFrame, ident: str, source: str, size: str, targets: DataFrame, *, total_tokens: int | None = None, ramp: float = 0.5, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mixture in training order, and the report of shares.

    Mixture: ``position`` (0..1, training time), ``ident``, ``source``,
    ``epoch`` (0 for a document's first use) and ``n_tokens``, range-sorted
    by position.  Report: per target ``source``, ``target_share``,
    ``max_repeats``, ``available``, ``n_documents``, ``used_tokens``,
    ``used_documents``, ``most_uses``, ``reached_share``.

    Every pass over a source is in an order of its own.  Each use of a
    document starts where the tokens before it in its source end; training
    time is where the integral of the source's weight reaches that point.  A
    source's last pass ends with the document that reaches its need, or before
    it if that is nearer, so a share is met to about half a document.

    Sources without target, null sources and ids and documents of no tokens
    aren't used; targets without documents are reported with nothing reached.
    A document repeated under one id counts once.  Empty tables give an empty
    mixture.
    """
    spark = documents.sparkSession
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    scratch = Scratch(spark, "mix")
    sizes = documents.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens"))
    sizes = scratch.keep(sizes.where("id is not null and source is not null and n_tokens > 0").groupBy("id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "sizes")
    demand = scratch.keep(source_demand(sizes, targets, total_tokens), "demand")
    passes = F.when(F.col("need") > 0, F.least(F.ceil(F.col("need") / F.col("available")), F.col("max_repeats"))).otherwise(0)
    plan = demand.where("need > 0").select("source", "need", "available", "share", "total", passes.alias("passes"))
    uses = sizes.join(F.broadcast(plan), "source").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("epoch"))
    # an order of its own for each pass; buckets are stretches of it
    buckets = max(1, sizes.count() // BUCKET_ROWS)
    order = F.xxhash64("id", "epoch", F.lit(seed))
    uses = uses.withColumn("order", order).withColumn("bucket", F.floor((F.col("order") / 2.0**64 + 0.5) * buckets))
    by = ["source", "epoch", "bucket"]
    ahead = Window.partitionBy("source").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    stretches = uses.groupBy(*by).agg(F.sum("n_tokens").alias("tokens")).select(*by, F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*by).orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    laid = uses.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(stretches, by)
    laid = laid.withColumn("offset", F.col("ahead") + F.col("inside"))
    laid = laid.where(F.col("offset") + F.col("n_tokens") / 2 <= F.col("need"))
    # training time: the weight's integral, scaled to the tokens of the mixture, reaches the offset
    schedule = weight_schedule(demand, ramp)
    reach = F.col("share") * F.least(F.col("offset") / F.col("need"), F.lit(1.0))
    a, b, c = (F.col("w1") - F.col("w0")) / (F.col("t1") - F.col("t0")) / 2, F.col("w0"), F.col("area") - reach
    root = F.when(F.abs(a) < 1e-12, -c / b).otherwise((-b + F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))) / (2 * a))
    last = F.col("area") + (F.col("w0") + F.col("w1")) * (F.col("t1") - F.col("t0")) / 2
    placed = laid.join(F.broadcast(schedule), "source").where((reach >= F.col("area")) & ((reach < last) | ((F.col("t1") == 1.0) & (reach >= last))))
    placed = placed.select(F.least(F.greatest(F.col("t0") + root, F.col("t0")), F.col("t1")).alias("position"), F.col("id").alias(ident), "source", F.col("epoch").cast("int").alias("epoch"), "n_tokens")
    mixture = scratch.keep(placed, "placed")
    used = mixture.groupBy("source", ident).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"))
    used = used.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("used_documents"), F.max("uses").alias("most_uses"))
    report = demand.select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("n_documents", F.lit(0)).alias("n_documents")).join(used, "source", "left").na.fill(0, ["used_tokens", "used_documents", "most_uses"])
    every = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    report = report.withColumn("reached_share", F.when(every > 0, F.col("used_tokens") / every).otherwise(0.0))
    return mixture.orderBy("position", "source", ident, "epoch"), report
