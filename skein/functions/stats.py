"""Statistics of groups and of paired runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.near import finite
from skein.operators.running import rank_quantile, running

# Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def wilson_interval(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Rate and its Wilson interval; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return p, middle - half, middle + half


def _clean(df: DataFrame, by: list[str], value: str, *more: str) -> DataFrame:
    number = F.col(value).cast("double")
    return df.select(*by, *more, number.alias("x")).where(finite(number))


def robust_scatter(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``n``, ``middle`` and ``scatter`` of each group's finite values.

    Scatter is 1.4826 times the median absolute deviation; where that is 0
    the interquartile range over 1.349; where that is 0 too the standard
    deviation; null below two values.  Quantiles come from ranks, so a group
    may be of any size.
    """
    clean = running(_clean(df, by, value), by, ["x"], None, "scatter")
    first = clean.groupBy(*by).agg(F.count("*").alias("n"), rank_quantile(0.5, "x").alias("middle"), (rank_quantile(0.75, "x") - rank_quantile(0.25, "x")).alias("iqr"), F.stddev_samp("x").alias("sd"))
    keyed = first.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), "middle")
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)))
    gaps = clean.join(keyed, same).select(*by, F.abs(F.col("x") - F.col("middle")).alias("gap"))
    mad = running(gaps, by, ["gap"], None, "gaps").groupBy(*by).agg(rank_quantile(0.5, "gap").alias("mad"))
    mad = mad.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), "mad")
    scatter = F.when(F.col("n") < 2, F.lit(None)).when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("iqr") > 0, F.col("iqr") / 1.349).otherwise(F.col("sd"))
    return first.join(mad, same).select(*by, "n", "middle", scatter.alias("scatter"))


def effect_size(middle_a: Column, scatter_a: Column, middle_b: Column, scatter_b: Column) -> Column:
    """Difference of medians over the pooled robust scatter; infinite where that is 0 or missing."""
    pooled = F.sqrt((scatter_a * scatter_a + scatter_b * scatter_b) / 2)
    return F.when(pooled > 0, F.abs(middle_a - middle_b) / pooled).otherwise(F.lit(float("inf")))


def bh_qvalues(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """``df``'s keys, ``tie``, ``p`` and the Benjamini-Hochberg ``q_value``; null and NaN p are left out.

    q of a rank is the least p·n/rank at this or any later rank, at most 1.
    Equal p share their q.  The suffix minimum runs over stretches of the
    sorted rows, so a group may be of any size.
    """
    from pyspark.sql import Window

    ranked = running(_clean(df, by, p, tie), by, ["x", tie], None, "bh").withColumn("raw", F.col("x") * F.col("group_rows") / F.col("rank"))
    block = ranked.withColumn("block", F.floor((F.col("rank") - 1) / 100_000))
    least = block.groupBy(*by, "block").agg(F.min("raw").alias("least"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    after = least.withColumn("later", F.min("least").over(group.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))).drop("least")
    keyed = after.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("block").alias("__b"), "later")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)), F.col("block") == F.col("__b"))
    inside = Window.partitionBy(*by, "block").orderBy(F.desc("rank"))
    q = F.least(F.min("raw").over(inside), F.coalesce("later", F.lit(float("inf"))), F.lit(1.0))
    return block.join(keyed, same).select(*by, tie, F.col("x").alias(p), q.alias("q_value"))


def mann_whitney(df: DataFrame, by: list[str], side: Column, value: str) -> DataFrame:
    """Two-sided Mann-Whitney test of the rows where ``side`` holds against the others.

    Average ranks with tie correction and the normal approximation with
    continuity correction.  Result: keys, ``n_a``, ``n_b``, ``u`` (of the
    rows where ``side`` holds), ``z``, ``p``.  p is 1 where a side is empty or
    all values are equal.  Null sides and missing values are left out.

    Works on counts of distinct values, so ties cost nothing.
    """
    number = F.col(value).cast("double")
    rows = df.select(*by, side.alias("side"), number.alias("x")).where(F.col("side").isNotNull() & finite(number))
    counts = rows.groupBy(*by, "x").agg(F.count_if("side").alias("a"), F.count("*").alias("t"))
    ranked = running(counts, by, ["x"], {"upto": F.col("t")}, "ranks")
    rank = F.col("upto") - (F.col("t") - 1) / 2
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("a").cast("double").alias("n_a"), F.sum("t").cast("double").alias("n"), F.sum(F.col("a") * rank).alias("r"), F.sum(t * t * t - t).alias("ties"))
    a, n = F.col("n_a"), F.col("n")
    b = n - a
    u = F.col("r") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    gap = F.greatest(F.abs(u - a * b / 2) - 0.5, F.lit(0.0))
    z = F.when((a > 0) & (b > 0) & (sd > 0), gap / sd)

    @F.pandas_udf(T.DoubleType())
    def two_sided(zs: pd.Series) -> pd.Series:
        return zs.map(lambda x: math.erfc(x / math.sqrt(2)) if x == x and x is not None else 1.0)

    return sums.select(*by, a.cast("bigint").alias("n_a"), b.cast("bigint").alias("n_b"), u.alias("u"), z.alias("z"), two_sided(z).alias("p"))


def paired_deltas(runs: DataFrame, key: str, is_baseline: Column, metrics: list[str]) -> DataFrame:
    """``runs`` with ``delta_<metric>`` against the baseline row of the same key.

    Booleans count 0 and 1, NaN is missing, and a key without exactly one
    baseline row gives null deltas.  One shuffle by key: the baselines are
    taken by a grouped aggregate and joined back.
    """
    value = {m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")) for m in metrics}
    base = runs.where(is_baseline & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), *(F.max(value[m]).alias(f"__{m}") for m in metrics)).where(F.col("__n") == 1)
    joined = runs.join(base, key, "left")
    return joined.select(*runs.columns, *((value[m] - F.col(f"__{m}")).alias(f"delta_{m}") for m in metrics))


#: Rows whose weights are drawn together.
BLOCK_ROWS = 64
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def poisson_draws(seeds: np.ndarray, resamples: int, first: int = 0) -> np.ndarray:
    """Poisson(1) weights, a row for each seed and a column for each resample from ``first`` on, the same for a seed whatever the others.

    Uniform numbers come from a mixing function of 64 bits over seed and resample.
    """
    # Constants of a common mixing function of 64 bits.
    golden, first, second = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
    with np.errstate(over="ignore"):
        z = seeds[:, None] + golden * np.arange(first + 1, first + resamples + 1, dtype=np.uint64)
        z = (z ^ (z >> np.uint64(30))) * first
        z = (z ^ (z >> np.uint64(27))) * second
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53).astype(float)


def bootstrap_mean(df: DataFrame, by: list[str], value: str, ident: str, *, resamples: int = 20_000, seed: int = 12345, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean of each group with a bootstrap interval.

    A Poisson bootstrap: each row weighs Poisson(1) in every resample, drawn
    from its id, so that the result doesn't depend on the partitions.  Tasks
    return only sums per resample.  Result: keys, ``n``, ``mean``, ``low``,
    ``high``.
    """
    keys = [f"k{i}" for i in range(len(by))]
    clean = _clean(df, by, value, ident).toDF(*keys, "id", "x").withColumn("seed", F.xxhash64("id", F.lit(seed)))
    fields = [T.StructField(k, clean.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("resample", T.IntegerType()), T.StructField("w", T.DoubleType()), T.StructField("wx", T.DoubleType())])
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]:
                w, wx = np.zeros(resamples), np.zeros(resamples)
                seeds, values = rows["seed"].to_numpy().astype(np.uint64), rows["x"].to_numpy()
                for at in range(0, len(values), BLOCK_ROWS):
                    draws = poisson_draws(seeds[at : at + BLOCK_ROWS], resamples)
                    w += draws.sum(axis=0)
                    wx += values[at : at + BLOCK_ROWS] @ draws
                key = tuple(None if pd.isna(k) else k for k in key)
                old = held.get(key, (0, 0.0, 0, 0))
                held[key] = (old[0] + len(rows), old[1] + rows["x"].sum(), old[2] + w, old[3] + wx)
        for key, (n, total, w, wx) in held.items():
            out = pd.DataFrame({"n": n, "total": total, "resample": np.arange(resamples, dtype=np.int32), "w": w, "wx": wx})
            for name, k in zip(keys, key):
                out[name] = k
            yield out[[f.name for f in schema]]

    each = clean.mapInPandas(sums, schema).groupBy(*keys, "resample").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("wx") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    out = each.groupBy(*keys).agg(F.max("n").alias("n"), (F.max("total") / F.max("n")).alias("mean"), F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"))
    return out.toDF(*by, "n", "mean", "low", "high")
