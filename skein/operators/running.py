"""Ranks and running sums in a total order within groups of any size.

A plain window would sort a whole group in one task.  Here the rows are
range-partitioned by group and order, ranked within each stretch, and shifted
by the counts and sums of the stretches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import Scratch


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, job: str = "running") -> DataFrame:
    """``df`` with ``rank`` (1, 2 ... in ``order``), ``group_rows``, and for each of ``sums``
    the running sum including the row (its name) and the group's total (``total_<name>``).

    ``order`` should make the rows of a group distinct; rows equal in it get
    ranks in no set order.  Null group keys are a group of their own, null
    order values come first, null addends count as 0.  An empty table stays
    empty.
    """
    sums = sums or {}
    scratch = Scratch(df.sparkSession, job)
    named = df.withColumns({f"__{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()}) if sums else df
    laid = named.repartitionByRange(*by, *order) if by or order else named
    laid = scratch.keep(laid.sortWithinPartitions(*by, *order).withColumn("__stretch", F.spark_partition_id()), "laid")
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")).alias(f"__g{i}") for i, c in enumerate(by)]
    keyed = laid.select("*", *key)
    names = [f"__g{i}" for i in range(len(by))]
    stretch = keyed.groupBy(*names, "__stretch").agg(F.count("*").alias("__n"), *(F.sum(f"__{n}").alias(f"__s_{n}") for n in sums))
    # one row for each group and stretch
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    ahead = group.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretch.select(
        *names,
        "__stretch",
        F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"),
        F.sum("__n").over(group).alias("group_rows"),
        *(F.coalesce(F.sum(f"__s_{n}").over(ahead), F.lit(0.0)).alias(f"__b_{n}") for n in sums),
        *(F.sum(f"__s_{n}").over(group).alias(f"total_{n}") for n in sums),
    )
    inside = Window.partitionBy(*names, "__stretch").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = keyed.select("*", F.row_number().over(inside).alias("__r"), *(F.sum(f"__{n}").over(upto).alias(f"__i_{n}") for n in sums))
    joined = ranked.join(starts, [*names, "__stretch"])
    return joined.select(
        *(F.col(c) for c in df.columns),
        (F.col("__r") + F.col("__before")).alias("rank"),
        "group_rows",
        *(F.expr(f"`__i_{n}` + `__b_{n}`").alias(n) for n in sums),
        *(F.col(f"total_{n}") for n in sums),
    )


def rank_quantile(q: float, value: str) -> Column:
    """An aggregate over the rows of ``running``: the quantile of a group without nulls, interpolated, from the one or two rows at its rank."""
    at = 1 + F.lit(q) * (F.col("group_rows") - 1)
    low = F.floor(at)
    share = at - low
    return F.sum(F.when(F.col("rank") == low, (1 - share) * F.col(value)).when((F.col("rank") == low + 1) & (share > 0), share * F.col(value)))


def neighbour_value(ranked: DataFrame, by: list[str], value: str, name: str = "next_value") -> DataFrame:
    """``ranked`` with the ``value`` of the row one rank further in its group (null for the last)."""
    after = ranked.select(*(F.col(c).alias(f"__n{i}") for i, c in enumerate(by)), (F.col("rank") - 1).alias("__rank"), F.col(value).alias(name))
    same = F.col("rank") == F.col("__rank")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__n{i}"))
    return ranked.join(after, same, "left").drop("__rank", *(f"__n{i}" for i in range(len(by))))
