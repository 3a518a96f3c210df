"""Differences between two copies of a dataset, cell by cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import strip_blanks

NUMBER, TEXT = "number", "text"


def _cell(df: DataFrame, name: str, kind: str) -> Column:
    if kind == NUMBER:
        number = df[name].cast("double")
        return F.when(~F.isnan(number), number)
    return F.lower(strip_blanks(df[name].cast("string")))


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: dict[str, str],
    *,
    latest: str | None = None,
    tolerance: float = 1e-9,
    names: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """Rows held by one side only, and every field whose values differ.

    ``fields`` maps a column to ``number`` (numbers, booleans: differ by more
    than ``tolerance``) or ``text`` (compared trimmed and lower-cased).  Of
    several rows of one key on one side the one with the greatest ``latest``
    counts (null is oldest; equal times: the greatest values), so repeated
    rows report nothing.  NaN and null are both missing; missing on both sides
    is equal, on one side a difference.  Null key parts equal each other.
    Other columns are ignored.  An empty side makes every key of the other
    one-sided; two empty sides give no row.

    Result: the keys and ``difference``: ``only_in_<name>`` or a field's name.

    Both sides go through one shuffle by key, pre-aggregated per task.  Then
    each key's two rows are unpivoted to key-field-value cells with signed
    counts and grouped by key and field, which keeps the same partitioning.
    """
    k = [f"__k{i}" for i in range(len(keys))]

    def side(df: DataFrame, sign: int) -> DataFrame:
        row = F.struct(
            (df[latest] if latest else F.lit(0)).alias("t"),
            *(_cell(df, n, kind).alias(f"f{i}") for i, (n, kind) in enumerate(fields.items())),
        )
        return df.select(*(df[c].alias(a) for c, a in zip(keys, k)), F.lit(sign).alias("sign"), row.alias("row"))

    both = side(left, 1).unionByName(side(right, -1))
    by_key = both.groupBy(*k).agg(
        F.max(F.when(F.col("sign") > 0, F.col("row"))).alias("a"),
        F.max(F.when(F.col("sign") < 0, F.col("row"))).alias("b"),
    )

    def cells(side: str, sign: int) -> Column:
        def cell(name: str, number: Column, text: Column) -> Column:
            return F.struct(F.lit(name).alias("field"), F.lit(sign).alias("sign"), number.alias("number"), text.alias("text"))

        none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
        own = [cell("", none, no_text)]
        for i, (name, kind) in enumerate(fields.items()):
            value = F.col(f"{side}.f{i}")
            own.append(cell(name, value, no_text) if kind == NUMBER else cell(name, none, value))
        there = F.col(side).isNotNull()
        # a key on one side only is told by its presence cell alone
        return F.when(there & F.col("a").isNotNull() & F.col("b").isNotNull(), F.array(*own)).when(there, F.array(own[0])).otherwise(F.array().cast(_CELLS))

    unpivoted = by_key.select(*k, F.inline(F.concat(cells("a", 1), cells("b", -1))))
    plus, minus = F.col("sign") > 0, F.col("sign") < 0
    grouped = unpivoted.groupBy(*k, "field").agg(
        F.sum("sign").alias("signed"),
        F.sum(F.when(F.col("number").isNotNull() | F.col("text").isNotNull(), F.col("sign")).otherwise(0)).alias("held"),
        F.max(F.when(plus, F.col("number"))).alias("na"),
        F.max(F.when(minus, F.col("number"))).alias("nb"),
        F.max(F.when(plus, F.col("text"))).alias("ta"),
        F.max(F.when(minus, F.col("text"))).alias("tb"),
    )
    # equal infinities have no difference, though their subtraction gives NaN
    far = (F.col("na") != F.col("nb")) & ~(F.abs(F.col("na") - F.col("nb")) <= tolerance)
    differs = (F.col("held") != 0) | F.coalesce(far, F.lit(False)) | F.coalesce(F.col("ta") != F.col("tb"), F.lit(False))
    return grouped.where((F.col("signed") != 0) | differs).select(
        *(F.col(a).alias(c) for c, a in zip(keys, k)),
        F.when(F.col("signed") > 0, F.lit(f"only_in_{names[0]}")).when(F.col("signed") < 0, F.lit(f"only_in_{names[1]}")).otherwise(F.col("field")).alias("difference"),
    )


_CELLS = "array<struct<field:string,sign:int,number:double,text:string>>"


def diff_counts(diffs: DataFrame) -> DataFrame:
    """How many keys show each difference."""
    return diffs.groupBy("difference").agg(F.count("*").alias("n_keys"))


def max_abs_difference(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Archive comparison: per metric, whether all joined values agree and the largest gap.  Null key parts equal each other.

    Missing values (null, NaN) on both sides agree; on one side they don't.
    """
    a = left.select(*(F.col(k).alias(f"a{i}__") for i, k in enumerate(keys)), *(F.col(m).cast("double").alias(f"{m}__a") for m in metrics))
    b = right.select(*(F.col(k).alias(f"b{i}__") for i, k in enumerate(keys)), *(F.col(m).cast("double").alias(f"{m}__b") for m in metrics))
    joined = a.join(b, reduce(lambda p, q: p & q, (F.col(f"a{i}__").eqNullSafe(F.col(f"b{i}__")) for i in range(len(keys)))), "inner")

    def per(m: str) -> list[Column]:
        x, y = (F.when(~F.isnan(f"{m}__{s}"), F.col(f"{m}__{s}")) for s in "ab")
        close = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.abs(x - y) <= tolerance)
        return [F.bool_and(close).alias(f"{m}__ok"), F.max(F.abs(x - y)).alias(f"{m}__gap")]

    one = joined.agg(*reduce(lambda p, q: p + q, (per(m) for m in metrics), []))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}__ok").alias("all_close"), F.col(f"{m}__gap").alias("max_abs_difference")) for m in metrics))
    return one.select(F.inline(rows))
