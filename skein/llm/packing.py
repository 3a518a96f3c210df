"""Filling fixed-capacity containers with items (problem 6).

The items' remainders (sizes modulo the capacity) form a histogram of bounded
size.  Over its classes of at most a 1024th of the capacity, rounded up,
stands the configuration linear program: cover every class's count with as few
containers as possible, a variable for each way to fill a container.
Multiplicative weights solve it: a class's price falls as it gets covered, and
each round takes fillings that are best under the prices, found by a knapsack
dynamic program.  Prices also bound the program from below, which tells when
to stop.  The solution is rounded down, what is left is filled best fit first,
and the items are then dealt to the containers by their rank among the items of their
class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.scratch import Scratch

#: The program works in so many units of capacity at most; lengths are rounded up to units.
UNITS = 1024
#: What rounding leaves is filled in so many units of capacity at most.
FINE_UNITS = 16_384
#: The program ends when its value is within this share of its bound, or after so many rounds.
GAP, ROUNDS = 0.002, 120
#: How fast prices fall at first, how far below the best a filling may be that a round takes, and the least price to start from.
FALL, NEAR, LEAST_PRICE = 1.0, 0.02, 1e-3
#: Fillings are rounded down if their price is short of the best by no more than one of these shares (none at all counts too).
SHORT = (0.0, 0.002, 0.01, 0.05, 1.0)
#: Items of one size are ranked in buckets of about so many.
BUCKET_ROWS = 50_000
#: A histogram is broadcast up to so many rows.
BROADCAST_ROWS = 200_000
#: Capacities are few; more are refused.
MOST_CAPACITIES = 1000


def _best_values(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest price within each room up to ``capacity``, any number of each size (ascending), and the size that ends it (-1 for none)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        fit = fitting[room]
        best[room] = best[room - 1]
        if fit:
            with_it = best[room - sizes[:fit]] + prices[:fit]
            i = with_it.argmax()
            if with_it[i] > best[room] + 1e-12:
                best[room], choice[room] = with_it[i], i
    return best, choice


def _traced(sizes: np.ndarray, choice: np.ndarray, room: int, first: int | None = None) -> dict[int, int]:
    """The filling behind a room's greatest price, with size ``first`` in it."""
    counts: dict[int, int] = {}
    if first is not None:
        counts[first] = 1
        room -= int(sizes[first])
    while room > 0:
        i = int(choice[room])
        if i < 0:
            room -= 1
        else:
            counts[i] = counts.get(i, 0) + 1
            room -= int(sizes[i])
    return counts


def first_prices(sizes: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """Prices under which no filling is worth more than 1: a size's share of the room, but 0 below a limit and 1 above the rest of the room.

    Of all limits the one whose prices bound the program best.
    """
    share = sizes / room
    best, prices = -1.0, share
    for limit in (0, *sizes[sizes * 2 <= room]):
        these = np.where(sizes > room - limit, 1.0, np.where(sizes < limit, 0.0, share))
        worth = float((these * counts).sum())
        if worth > best + 1e-9:
            best, prices = worth, these
    return prices


def solve_program(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[dict[tuple, float], float, float, np.ndarray]:
    """Fractional containers per filling, the program's value, its lower bound, and the prices of the bound (1 for the best filling).

    ``sizes`` ascend.  A round takes one pass of fillings: for each size that
    a near-best filling holds, that filling, as often as the items last.
    """
    need = counts.astype(float)
    fallen, covered = np.zeros(len(sizes)), np.zeros(len(sizes))
    used: dict[tuple, float] = {}
    bound_prices, value = first_prices(sizes, counts, room), np.inf
    bound, start = float((bound_prices * need).sum()), np.maximum(bound_prices, LEAST_PRICE * sizes / room)
    for t in range(ROUNDS):
        prices = start * np.exp(-(fallen - fallen.min()))
        best, choice = _best_values(sizes, prices, room)
        low = float((prices * need).sum() / best[room])
        if low > bound:
            bound, bound_prices = low, prices / best[room]
        through = prices + best[room - sizes]
        left, step = need.copy(), FALL / np.sqrt(t + 1)
        for i in np.argsort(-sizes, kind="stable"):
            if through[i] < (1 - NEAR) * best[room] or left[i] <= 1e-9 * need[i]:
                continue
            filling = _traced(sizes, choice, room, int(i))
            share = min(left[j] / n for j, n in filling.items())
            if share <= 0:
                continue
            key = tuple(sorted(filling.items()))
            used[key] = used.get(key, 0.0) + step * share
            for j, n in filling.items():
                left[j] -= share * n
        pass_ = 1 - left / need
        fallen += step * pass_
        covered += step * pass_
        if covered.min() > 0:
            value = min(value, sum(used.values()) / covered.min())
            if value <= bound * (1 + GAP):
                break
    scale = covered.min()
    if scale > 0:
        used = {k: v / scale for k, v in used.items()}
    return used, value, bound, bound_prices


def best_fit(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[int, dict[int, int]]]:
    """Fillings with their numbers of containers: the longest items first, each into the container that it leaves least room in.

    Equal containers are handled together, so the work follows the number of
    sizes and not of items.
    """
    there: dict[int, list[list]] = {}
    open_rooms = np.zeros(room + 1, dtype=bool)

    def put(space: int, filling: dict[int, int], copies: int) -> None:
        there.setdefault(space, []).append([filling, copies])
        open_rooms[space] = True

    for i in np.argsort(-sizes, kind="stable"):
        size, items = int(sizes[i]), int(counts[i])
        while items:
            at = int(open_rooms[size:].argmax()) + size
            if not open_rooms[at]:
                each = room // size
                if items >= each:
                    put(room - each * size, {int(i): each}, items // each)
                if items % each:
                    put(room - items % each * size, {int(i): items % each}, 1)
                break
            group = there[at][-1]
            each = min(at // size, items)
            copies = min(group[1], items // each)
            put(at - each * size, {**group[0], int(i): each}, copies)
            items -= copies * each
            group[1] -= copies
            if not group[1]:
                there[at].remove(group)
                open_rooms[at] = bool(there[at])
    return [(copies, filling) for groups in there.values() for filling, copies in groups]


def plan_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], float, float]:
    """Which ranks go where, the program's value and its bound.

    ``lengths`` ascend.  Rows: class (length in units, rounded up), slots a
    container, first and end rank within the class (in order of length), first
    container.  All work is bounded by the histogram, whatever the counts.
    """
    unit = -(-capacity // UNITS)
    room = capacity // unit
    units = np.minimum(-(-lengths // unit), room)  # a length that only just fits
    classes, of = np.unique(units, return_inverse=True)
    per_class = np.bincount(of, weights=counts).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    class_start = np.concatenate([[0], np.cumsum(per_class)[:-1]])
    offsets = starts - class_start[of]  # of a length among its class
    used, value, bound, prices = solve_program(classes, per_class, room)
    short = {k: 1 - sum(prices[i] * n for i, n in k) for k in used}
    fine = -(-capacity // FINE_UNITS)
    fine_lengths, fine_of = np.unique(np.minimum(-(-lengths // fine), capacity // fine), return_inverse=True)
    best = None
    for limit in (None, *SHORT):
        left, whole = per_class.copy(), []
        for key in sorted(used, key=lambda k: (short[k], k)) if limit is not None else ():
            copies = min([int(used[key] + 1e-9), *(int(left[i]) // n for i, n in key)]) if short[key] <= limit + 1e-9 else 0
            if copies:
                whole.append((copies, dict(key)))
                for i, n in key:
                    left[i] -= copies * n
        # of each class the longest items go into the fillings of the program
        kept = np.clip(left[of] - offsets, 0, counts)
        rest = best_fit(fine_lengths, np.bincount(fine_of, weights=kept).astype(np.int64), capacity // fine)
        total = sum(c for c, _ in whole) + sum(c for c, _ in rest)
        if best is None or total < best[0]:
            best = (total, whole, rest, left, kept)
    total, whole, rest, left, kept = best
    value = min(value, total)  # whole containers solve the program too
    if unit > 1:
        # the bound must hold for the lengths themselves, which are less than their classes
        less = np.maximum(classes - 1, 0)
        price = np.where(less > 0, prices, 0.0)
        some = less > 0
        bound = float((price * per_class).sum() / max(_best_values(less[some], price[some], room)[0][-1], 1.0)) if some.any() else 0.0
        bound = max(bound, float((first_prices(lengths, counts, capacity) * counts).sum()))
    rows, container = [], 0
    rank = left.copy()  # where the program's items of a class begin
    for copies, filling in whole:
        for i, n in filling.items():
            rows.append((int(classes[i]), n, int(rank[i]), int(rank[i] + copies * n), container))
            rank[i] += copies * n
        container += copies
    # the items of a fine length may be of several lengths and classes
    members: dict[int, list[int]] = {}
    for j in range(len(lengths)):
        members.setdefault(int(fine_of[j]), []).append(j)
    taken = np.zeros(len(lengths), dtype=np.int64)
    for copies, filling in rest:
        for i, n in filling.items():
            wanted, at = copies * n, 0
            for j in members[i]:
                some = min(wanted - at, int(kept[j] - taken[j]))
                if some > 0:
                    first = int(offsets[j] + taken[j])
                    # the slot at which the stretch begins may lie within a container
                    rows += _stretches(int(units[j]), n, first, some, container, at)
                    taken[j] += some
                    at += some
        container += copies
    return rows, value, bound


def _stretches(units: int, slots: int, first: int, count: int, container: int, at: int) -> list[tuple[int, int, int, int, int]]:
    """Rows that deal ``count`` ranks from ``first`` to slots ``at`` and on of containers with ``slots`` each."""
    rows, inside = [], at % slots
    if inside:
        some = min(count, slots - inside)
        rows.append((units, some, first, first + some, container + at // slots))
        first, count, at = first + some, count - some, at + some
    if count:
        rows.append((units, slots, first, first + count, container + at // slots))
    return rows


_PLAN = "container_kind string, units bigint, slots bigint, first_rank bigint, end_rank bigint, first_container bigint, program_value double, program_bound double"


def _plan(histogram: pd.DataFrame) -> pd.DataFrame:
    histogram = histogram.sort_values("length", ignore_index=True)
    rows, value, bound = plan_containers(histogram["length"].to_numpy(), histogram["items"].to_numpy(), int(histogram["capacity"][0]))
    plan = pd.DataFrame(rows, columns=["units", "slots", "first_rank", "end_rank", "first_container"]).assign(program_value=value, program_bound=bound)
    return plan.assign(container_kind=histogram["container_kind"][0])[["container_kind", *plan.columns]]


def pack(items: DataFrame, ident: str, size: str, capacities: DataFrame) -> DataFrame:
    """The packing of :func:`pack_with_program`."""
    return pack_with_program(items, ident, size, capacities)[0]


def pack_with_program(items: DataFrame, ident: str, size: str, capacities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containers of every kind in ``capacities`` (``container_kind``, ``capacity_tokens``) filled with all items.

    Result: ``container_kind``, ``capacity``, ``container_id``, ``ident``,
    ``piece``, ``start`` (of the piece in its item) and ``length``.  An item
    longer than the capacity gives full containers of its own
    (``own-<id>-<piece>``) and a remainder; every other item is whole
    (``mixed-<number>``).  Items of size 0 or null need no space: one row each
    with a null ``container_id``.  An item repeated under one id counts once
    (its greatest size); null ids are left out; capacities that are null or
    below 1 are left out; no items give no row.

    The second table has each kind's ``program_value`` and ``program_bound``:
    containers that the program needs for the mixed ones, and the least that
    any packing of them can do with.
    """
    kinds = capacities.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).where("container_kind is not null and capacity >= 1").distinct()
    kinds = kinds.limit(MOST_CAPACITIES + 1).collect()
    if len(kinds) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    scratch = Scratch(items.sparkSession, "pack")
    sized = items.select(F.col(ident).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size")).where("id is not null")
    sized = scratch.keep(sized.groupBy("id").agg(F.max("size").alias("size")), "sizes")
    kind = F.array(*(F.struct(F.lit(k.container_kind).alias("container_kind"), F.lit(k.capacity).alias("capacity")) for k in kinds)) if kinds else F.expr("cast(array() as array<struct<container_kind:string,capacity:bigint>>)")
    per_kind = sized.select("id", "size", F.inline(kind)).withColumns({"own": F.expr("size div capacity"), "length": F.expr("size % capacity")})

    whole = per_kind.where("own > 0").select("container_kind", "capacity", "id", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("piece"))
    whole = whole.select(
        "container_kind", "capacity", F.format_string("own-%s-%s", F.col("id").cast("string"), F.col("piece").cast("string")).alias("container_id"), "id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("length")
    )
    none = per_kind.where("size = 0").select("container_kind", "capacity", F.lit(None).cast("string").alias("container_id"), "id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))

    unit = F.ceil(F.col("capacity") / F.lit(UNITS))
    most = F.expr("capacity") / unit
    rest = per_kind.where("length > 0").withColumn("units", F.least(F.ceil(F.col("length") / unit), F.floor(most)))
    histogram = scratch.keep(rest.groupBy("container_kind", "capacity", "units", "length").agg(F.count("*").alias("items")), "histogram")
    # a task for each kind
    by_kind = histogram.repartitionByRange(max(1, len(kinds)), "container_kind")
    plan = scratch.keep(by_kind.groupBy("container_kind").applyInPandas(_plan, _PLAN), "plan")
    # ranks within a class in order of length, in two steps: of the buckets of each length, and within a bucket
    known = histogram.select("container_kind", "length", F.ceil(F.col("items") / BUCKET_ROWS).alias("buckets"))
    known = F.broadcast(known) if histogram.count() <= BROADCAST_ROWS else known
    placed = rest.join(known, ["container_kind", "length"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets"))).drop("buckets")
    by = ["container_kind", "units", "length", "bucket"]
    counted = placed.groupBy(*by).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("container_kind", "units").orderBy("length", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select(*by, "n", F.coalesce(before, F.lit(0)).alias("offset"))
    # only the stretches of the plan that a bucket's ranks can fall into
    stretches = plan.drop("program_value", "program_bound")
    spans = starts.join(stretches, ["container_kind", "units"]).where("first_rank < offset + n and end_rank > offset").drop("n")
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("id")) - 1)
    dealt = ranked.join(spans, by).withColumn("rank", F.col("nth") + F.col("offset")).where("rank >= first_rank and rank < end_rank")
    mixed = dealt.select(
        "container_kind", "capacity", F.format_string("mixed-%d", F.expr("first_container + (rank - first_rank) div slots")).alias("container_id"), "id", F.col("own").alias("piece"), (F.col("own") * F.col("capacity")).alias("start"), "length"
    )
    program = plan.groupBy("container_kind").agg(F.max("program_value").alias("program_value"), F.max("program_bound").alias("program_bound"))
    return whole.unionByName(mixed).unionByName(none).withColumnRenamed("id", ident), program


def packing_report(packed: DataFrame, program: DataFrame | None = None) -> DataFrame:
    """Per kind: containers, tokens, the least number of containers that could hold them, and the share of space filled.

    With the ``program`` also its value and bound, with the whole containers
    of long items, and ``gap``, by which share the containers exceed the bound.
    """
    by = ["container_kind", "capacity"]
    own = F.col("container_id").startswith("own-")
    held = packed.where("container_id is not null").groupBy(*by, "container_id").agg(F.sum("length").alias("tokens"))
    report = held.groupBy(*by).agg(F.count("*").alias("n_containers"), F.count_if(own).alias("n_own"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"))
    report = report.withColumns({"least_containers": F.expr("(n_tokens + capacity - 1) div capacity"), "filled": F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))})
    if program is None:
        return report
    report = report.join(program, "container_kind", "left").na.fill(0.0, ["program_value", "program_bound"])
    return report.withColumns({
        "program_value": F.col("program_value") + F.col("n_own"), "program_bound": F.col("program_bound") + F.col("n_own"),
    }).withColumn("gap", F.col("n_containers") / F.col("program_bound") - 1)


def packing_check(packed: DataFrame) -> DataFrame:
    """Per kind: items, and how many rules are broken: containers over capacity, items divided though they fit, pieces that overlap or leave a gap."""
    by = ["container_kind", "capacity"]
    over = packed.where("container_id is not null").groupBy(*by, "container_id").agg(F.sum("length").alias("tokens")).groupBy(*by).agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    ident = [c for c in packed.columns if c not in (*by, "container_id", "piece", "start", "length")][0]
    item = packed.groupBy(*by, F.col(ident).alias("id")).agg(F.count("*").alias("pieces"), F.sum("length").alias("size"), F.max(F.col("start") + F.col("length")).alias("end"), F.min("start").alias("first"), F.countDistinct("start").alias("starts"))
    whole = (F.col("first") == 0) & (F.col("end") == F.col("size")) & (F.col("starts") == F.col("pieces"))
    items = item.groupBy(*by).agg(F.count("*").alias("n_items"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("divided"), F.count_if(~whole).alias("broken"))
    return items.join(over, by, "left").na.fill(0, ["overfull"]).select("container_kind", "n_items", "overfull", "divided", "broken")
