"""Points near other points, by a grid equi-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.scratch import table_bytes

#: A hot-cell list is broadcast only up to this size; beyond it a shuffle join is used.
BROADCAST_BYTES = 32 << 20
#: Pairs of a run of ``pair_runs``.
RUN = 2_000_000


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _cells(names: list[str], side: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(side)).alias(f"c{i}") for i, c in enumerate(names)]


def _spread(df: DataFrame, prefix: str, names: list[str], side: float, reach: float) -> DataFrame:
    """One row for each cell within ``reach`` of the point along the axes."""
    for i, c in enumerate(names):
        low, high = (F.floor((F.col(c) + F.lit(d)) / F.lit(side)) for d in (-reach, reach))
        df = df.withColumn(f"{prefix}{i}", F.explode(F.sequence(low, high)))
    return df


def pairs_between(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    coords: list[str],
    radius: float,
    *,
    group: str | None = None,
    ordered: bool = False,
    carry: tuple[str, ...] = (),
    condition: Column | None = None,
    coarse: float = 8.0,
    hot_cell: int = 4096,
    few_right: bool = False,
) -> DataFrame:
    """All pairs (a from left, b from right) at most ``radius`` apart.

    Columns: ``group_key``, ``id_a``, ``id_b``, ``dist2``, and ``<c>_a``,
    ``<c>_b`` for each column in ``carry``.  Points with a missing or infinite
    coordinate, a null id or (with ``group``) a null group are in no pair.  A
    record repeated under one id counts once.  ``ordered`` keeps pairs with
    ``id_a < id_b`` only; otherwise a point may pair with its own copy on the
    other side.  ``condition`` may use the ``_a``/``_b`` columns.  Empty inputs
    give no row; other columns are ignored.

    Grid of cells ``coarse`` radii wide: a left point stays in its own cell, a
    right point goes to each cell its ball may touch, so each pair meets in
    exactly one cell, the left point's.  Cells that hold more than ``hot_cell``
    left points are split into cells one radius wide, whose candidates are at
    most a constant times the pairs to report.
    """
    names = [f"x{i}" for i in range(len(coords))]
    side, reach = coarse * radius, radius * (1 + 1e-9) + 1e-12

    def clean(df: DataFrame, ident: str) -> DataFrame:
        key = F.col(group) if group else F.lit(0)
        out = df.select(key.alias("g"), F.col(ident).alias("id"), *(F.col(c).cast("double").alias(n) for c, n in zip(coords, names)), *(F.col(c).alias(f"v_{c}") for c in carry))
        good = F.col("g").isNotNull() & F.col("id").isNotNull()
        for n in names:
            good &= finite(F.col(n))
        return out.where(good)

    cell = [f"c{i}" for i in range(len(coords))]
    home = clean(left, left_id).select("*", *_cells(names, side))
    away = _spread(clean(right, right_id), "c", names, side, reach)
    keys = ["g", *cell]
    small = few_right and table_bytes(right) <= BROADCAST_BYTES
    hot = home.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_cell).select(*keys, F.lit(True).alias("hot"))
    fine = [f"f{i}" for i in range(len(coords))]
    if small:
        fine = []
    elif hot.take(1):
        if table_bytes(hot) <= BROADCAST_BYTES:
            hot = F.broadcast(hot)
        home, away = (x.join(hot, keys, "left") for x in (home, away))
        # cells that aren't split have the one fine cell 0
        home = home.select("*", *(F.when(F.col("hot"), F.floor(F.col(n) / radius)).otherwise(0).alias(f) for n, f in zip(names, fine))).drop("hot")
        for n, f in zip(names, fine):
            low, high = (F.floor((F.col(n) + F.lit(d)) / radius) for d in (-reach, reach))
            away = away.withColumn(f, F.explode(F.when(F.col("hot"), F.sequence(low, high)).otherwise(F.array(F.lit(0).cast("bigint")))))
        away = away.drop("hot")
    else:
        fine = []
    on = [*keys, *fine]
    # one shuffle each: repeats meet in their cell, and the join keeps the partitioning
    if not small:
        home, away = (x.repartition(*on).dropDuplicates() for x in (home, away))
    value = [*names, *(f"v_{c}" for c in carry)]
    a = home.select(*on, F.col("id").alias("id_a"), *(F.col(v).alias(f"{v}_a") for v in value))
    b = away.select(*(F.col(c).alias(f"{c}_r") for c in on), F.col("id").alias("id_b"), *(F.col(v).alias(f"{v}_b") for v in value))
    dist2 = sum(((F.col(f"{n}_a") - F.col(f"{n}_b")) * (F.col(f"{n}_a") - F.col(f"{n}_b")) for n in names[1:]), (F.col("x0_a") - F.col("x0_b")) * (F.col("x0_a") - F.col("x0_b")))
    meet = dist2 <= F.lit(radius * radius)
    for c in on:
        meet &= F.col(c) == F.col(f"{c}_r")
    if ordered:
        meet &= F.col("id_a") < F.col("id_b")
    joined = a.join(F.broadcast(b) if small else b, meet)
    out = joined.select(F.col("g").alias("group_key"), "id_a", "id_b", dist2.alias("dist2"), *(F.col(f"v_{c}_{s}").alias(f"{c}_{s}") for c in carry for s in "ab"))
    out = out.where(condition) if condition is not None else out
    return out.dropDuplicates() if small else out


def pairs_within(points: DataFrame, ident: str, coords: list[str], radius: float, **options) -> DataFrame:
    """All pairs of distinct points at most ``radius`` apart, each once with ``id_a < id_b``.

    A point delivered several times under one id must carry equal coordinates;
    repeats are removed from the pairs.  See :func:`pairs_between`.
    """
    return pairs_between(points, points, ident, ident, coords, radius, ordered=True, **options)


def neighbour_counts(pairs: DataFrame) -> DataFrame:
    """Number of neighbours of each point that has one: ``id``, ``n_neighbours``."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("id_a").alias("id")), F.struct(F.col("id_b").alias("id")))))
    return ends.groupBy("id").agg(F.count("*").alias("n_neighbours"))


def array_pairs(at: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of all pairs of the rows of ``at`` at most ``radius`` apart; None if there are more than ``most``."""
    first, second, n = [], [], 0
    for a, b in pair_runs(at, radius):
        first.append(a)
        second.append(b)
        n += len(a)
        if n > most:
            return None
    return np.concatenate(first), np.concatenate(second)


def pair_runs(at: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of the rows of ``at`` at most ``radius`` apart, a bounded number at once."""
    cell = np.floor(at / (radius * (1 + 1e-9))).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    span = cell.max(axis=0) + 2
    key = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    cells, start, count = np.unique(key[order], return_index=True, return_counts=True)
    for move in [(i, j, k) for i in (0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]:
        there = cells + (move[0] * span[1] + move[1]) * span[2] + move[2]
        to = np.minimum(np.searchsorted(cells, there), len(cells) - 1)
        p = np.flatnonzero(cells[to] == there)
        q = to[p]
        met = count[p] * count[q]
        upto = np.cumsum(met)
        for low in range(0, int(upto[-1]) if len(p) else 0, RUN):  # candidates of a run at once, however many a cell has
            high = min(low + RUN, int(upto[-1]))
            i, j = np.searchsorted(upto, [low, high - 1], side="right") + [0, 1]
            each = np.repeat(np.arange(i, j), np.diff(np.r_[low, np.minimum(upto[i:j], high)]))
            nth = np.arange(low, high) - (upto - met)[each]
            a, b = start[p[each]] + nth // count[q[each]], start[q[each]] + nth % count[q[each]]
            if move == (0, 0, 0):
                a, b = a[a < b], b[a < b]
            a, b = order[a], order[b]
            gap = at[a] - at[b]
            near = (gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]) + gap[:, 2] * gap[:, 2] <= radius * radius
            yield a[near], b[near]
