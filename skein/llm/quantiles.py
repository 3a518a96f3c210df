"""Percentiles of very large numeric columns (problem 4).

A relative-error quantile sketch: a stack of compactors, level ``h`` holding
values that stand for ``2**h`` each.  A full compactor sorts its values, keeps
a protected part at the accurate end and passes every other value of the rest
to the next level.  How much of the rest is compacted follows the trailing
ones of the compaction counter, so values near the accurate end are compacted
exponentially rarely and their rank error is relative to their distance from
that end.  A :class:`BothEnds` holds one sketch for each end and answers a
fraction from the nearer one.  Sketches of partitions, files or days are
merged level by level.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.running import running

#: Section size; the stated error holds for it.
SECTION = 64
#: Rank error stated for SECTION, relative to the distance from the nearer end.
RANK_ERROR = 0.01
FIRST_SECTIONS, LEAST_SECTION = 3, 4
#: A task passes its sketches on when they hold this many values.
HELD_VALUES = 2_000_000
#: Partial sketches of one key are merged in so many groups first.
FAN = 64


_HEAD, _LEVEL = "<?iQH", "<qid?q"
# Multiplier and addend of a common linear congruential generator of 64 bits.
_STEP, _ADD, _MASK = 6364136223846793005, 1442695040888963407, (1 << 64) - 1


class RelativeRankSketch:
    """Quantiles with rank error relative to the distance from one end (``high`` or low)."""

    def __init__(self, section: int = SECTION, high: bool = True, seed: int = 0):
        self.section, self.high, self.state = section, high, seed & _MASK
        self.levels: list[list] = []  # [values, counter, sections, section size, last coin]

    def _level(self, h: int) -> list:
        while len(self.levels) <= h:
            self.levels.append([np.empty(0), 0, FIRST_SECTIONS, float(self.section), 0])
        return self.levels[h]

    @property
    def n(self) -> int:
        return sum(len(values) << h for h, (values, *_) in enumerate(self.levels))

    @property
    def held(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def add(self, values: np.ndarray) -> RelativeRankSketch:
        if len(values):
            level = self._level(0)
            level[0] = np.concatenate([level[0], np.asarray(values, dtype=float)])
            self._compress()
        return self

    def merge(self, other: RelativeRankSketch) -> RelativeRankSketch:
        self.state = (self.state ^ (other.state * _STEP)) & _MASK
        for h, (values, counter, sections, size, _) in enumerate(other.levels):
            level = self._level(h)
            level[0] = np.concatenate([level[0], values])
            level[1] |= counter
            level[2], level[3] = max(level[2], sections), min(level[3], size)
        self._compress()
        return self

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            size = max(LEAST_SECTION, 2 * round(level[3] / 2))
            if len(level[0]) >= 2 * level[2] * size:
                self._compact(h, size)
            h += 1

    def _compact(self, h: int, size: int) -> None:
        values, counter, sections, exact, coin = self.levels[h]
        ones = (~counter & (counter + 1)).bit_length() - 1
        compacted_sections = min(ones + 1, sections)
        kept = sections * size + (sections - compacted_sections) * size
        count = (len(values) - kept) // 2 * 2
        values = np.sort(values)
        if not self.high:
            values = values[::-1]
        # a coin of the sketch's own says which of two neighbours goes up, and the next compaction takes the other
        if counter % 2:
            coin = 1 - coin
        else:
            self.state = (self.state * _STEP + _ADD) & _MASK
            coin = self.state >> 63
        level = self.levels[h]
        level[4] = coin
        promoted, level = values[:count][coin::2], self.levels[h]
        level[0] = values[count:]
        level[1] = counter + 1
        if level[1] >= 1 << (sections - 1) and exact / math.sqrt(2) >= LEAST_SECTION:
            level[2], level[3] = sections * 2, exact / math.sqrt(2)
        above = self._level(h + 1)
        above[0] = np.concatenate([above[0], promoted])

    def quantiles(self, fractions: Iterable[float]) -> list[float | None]:
        """For each fraction q the least held value whose estimated rank is at least q·n."""
        if not self.held:
            return [None for _ in fractions]
        values = np.concatenate([level[0] for level in self.levels])
        weights = np.concatenate([np.full(len(level[0]), 1 << h, dtype=np.int64) for h, level in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = [min(int(np.searchsorted(ranks, max(1, math.ceil(q * ranks[-1])))), len(ranks) - 1) for q in fractions]
        return [float(values[order][i]) for i in at]

    def to_bytes(self) -> bytes:
        """Flag of the accurate end, section size, state of the coins, levels; each level's header, then its values as doubles."""
        out = [struct.pack(_HEAD, self.high, self.section, self.state, len(self.levels))]
        for values, counter, sections, size, coin in self.levels:
            out += [struct.pack(_LEVEL, counter, sections, size, coin, len(values)), values.astype("<f8").tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> RelativeRankSketch:
        high, section, state, count = struct.unpack_from(_HEAD, data)
        sketch, at = cls(section, high, state), struct.calcsize(_HEAD)
        for _ in range(count):
            counter, sections, size, coin, held = struct.unpack_from(_LEVEL, data, at)
            at += struct.calcsize(_LEVEL)
            sketch.levels.append([np.frombuffer(data, "<f8", held, at).copy(), counter, sections, size, coin])
            at += 8 * held
        return sketch


class BothEnds:
    """A sketch for each end: fractions below one half come from the low one, the others from the high one."""

    def __init__(self, section: int = SECTION, seed: int = 0):
        self.low, self.high = RelativeRankSketch(section, False, seed), RelativeRankSketch(section, True, seed * _STEP + 1)

    @property
    def n(self) -> int:
        return self.low.n

    @property
    def held(self) -> int:
        return self.low.held + self.high.held

    def add(self, values: np.ndarray) -> BothEnds:
        self.low.add(values)
        self.high.add(values)
        return self

    def merge(self, other: BothEnds) -> BothEnds:
        self.low.merge(other.low)
        self.high.merge(other.high)
        return self

    def quantiles(self, fractions: Iterable[float]) -> list[float | None]:
        fractions = list(fractions)
        low, high = self.low.quantiles(fractions), self.high.quantiles(fractions)
        return [a if q < 0.5 else b for q, a, b in zip(fractions, low, high)]

    def to_bytes(self) -> bytes:
        low = self.low.to_bytes()
        return struct.pack("<q", len(low)) + low + self.high.to_bytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BothEnds:
        (n,) = struct.unpack_from("<q", data)
        both = cls()
        both.low, both.high = RelativeRankSketch.from_bytes(data[8 : 8 + n]), RelativeRankSketch.from_bytes(data[8 + n :])
        return both


def sketch_values(df: DataFrame, keys: list[str], value: str, *, section: int = SECTION) -> DataFrame:
    """One mergeable sketch per key: the keys, ``n`` (values counted) and ``sketch`` (binary).

    Values that are null, NaN or infinite don't count; keys with none of
    others give no row.  Null keys are a group of their own.  Ties and
    repeated values count as often as they occur; other columns are ignored;
    an empty table gives no row.

    Each task sketches its own rows, whatever their keys, so a hot key costs
    nothing more; the small partial sketches are then merged in two rounds.
    """
    names = [f"k{i}" for i in range(len(keys))]
    number = F.col(value).cast("double")
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, names)), number.alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    fields = [T.StructField(a, rows.schema[a].dataType) for a in names]
    part = T.StructType([*fields, T.StructField("salt", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt, held, found, flushed = TaskContext.get().partitionId() % FAN, 0, {}, 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame([(*key, salt, s.n, s.to_bytes()) for key, s in found.items()], columns=[f.name for f in part])

        for batch in batches:
            groups = batch.groupby(names, dropna=False, sort=False)["value"] if names else [((), batch["value"])]
            for key, values in groups:
                key = tuple(None if pd.isna(x) else x for x in key)
                if key not in found:
                    # the same again for a repeated task, another for every task and key
                    found[key] = BothEnds(section, zlib.crc32(repr((TaskContext.get().partitionId(), flushed, key)).encode()))
                sketch = found[key]
                before = sketch.held
                held += sketch.add(values.to_numpy()).held - before
            if held > HELD_VALUES:
                yield flush()
                held, found, flushed = 0, {}, flushed + 1
        if found:
            yield flush()

    partial = rows.mapInPandas(build, part)
    return merge_sketches(_merged(partial, [*names, "salt"]), names).toDF(*keys, "n", "sketch")


@F.pandas_udf(T.BinaryType())
def _merge_all(sketches: pd.Series) -> bytes:
    merged = None
    for data in sketches:
        sketch = BothEnds.from_bytes(data)
        merged = sketch if merged is None else merged.merge(sketch)
    return merged.to_bytes()


def _merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(_merge_all("sketch").alias("sketch"))


@F.pandas_udf(T.LongType())
def _count(sketches: pd.Series) -> pd.Series:
    return sketches.map(lambda data: BothEnds.from_bytes(data).n)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Combine sketches of days, files or partitions: one row for each of ``keys``, with ``n`` and ``sketch``."""
    return _merged(sketches, keys).select(*keys, _count("sketch").alias("n"), "sketch")


def sketch_quantiles(sketches: DataFrame, fractions: list[float]) -> DataFrame:
    """``sketches`` with ``quantiles``, an array in the order of ``fractions``."""

    @F.pandas_udf("array<double>")
    def read(data: pd.Series) -> pd.Series:
        return data.map(lambda x: BothEnds.from_bytes(x).quantiles(fractions))

    return sketches.withColumn("quantiles", read("sketch"))


def rank_bounds(df: DataFrame, keys: list[str], value: str, fractions: list[float], error: float = RANK_ERROR) -> DataFrame:
    """The values between which a quantile of that rank error lies, from the exact ranks of all values.

    Result: keys, ``n``, ``fraction``, ``low_value``, ``high_value``: the
    values at the ranks q·n less and plus ``error`` of the distance from the
    nearer end, and one more.  Works on counts of distinct values, laid out by
    range, so a key may have any number of them.
    """
    number = F.col(value).cast("double")
    counts = df.select(*keys, number.alias("value__")).where(F.col("value__").isNotNull() & ~F.isnan("value__") & (F.abs("value__") < float("inf")))
    ranked = running(counts.groupBy(*keys, "value__").agg(F.count("*").alias("t__")), keys, ["value__"], {"upto__": F.col("t__")}, "ranks")
    n, bounds = F.col("total_upto__"), []
    for i, q in enumerate(fractions):
        allowed = error * min(q, 1 - q) * n + 1
        low, high = F.greatest(F.floor(q * n - allowed), F.lit(1)), F.least(F.ceil(q * n + allowed), n)
        bounds += [F.min(F.when(F.col("upto__") >= rank, F.col("value__"))).alias(f"{side}{i}") for side, rank in (("low", low), ("high", high))]
    by = ranked.groupBy(*keys).agg(F.max(n).cast("long").alias("n"), *bounds)
    each = F.array(*(F.struct(F.lit(float(q)).alias("fraction"), F.col(f"low{i}").alias("low_value"), F.col(f"high{i}").alias("high_value")) for i, q in enumerate(fractions)))
    return by.select(*keys, "n", F.inline(each))
