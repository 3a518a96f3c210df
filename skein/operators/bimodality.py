"""Whether one sorted quantity looks like two normal populations, for groups of any size.

A group reaches its task as counts of distinct values; beyond ``TASK_VALUES`` of
them every step of its fit is an aggregate over the counts, with equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.near import finite
from skein.scratch import Scratch

TASK_VALUES = 300_000
#: A null sample is drawn as counts of so many cells of 8.5 deviations on either side, whatever its size.
BINS, REACH = 8_000, 8.5
# Starts (in standard deviations from the mean), floors and steps of the fit.
SHIFTS, STEPS = (0.35, 0.55, 0.75, 1.0, 1.3), 120
QUICK_SHIFTS, QUICK_STEPS = (0.55, 0.9), 60
SD_FLOOR, WEIGHT_FLOOR, COUNT_FLOOR, VARIANCE_FLOOR, SETTLED = 1e-4, 1e-8, 1e-6, 1e-8, 1e-7
LEAST_ROWS, LEAST_SD = 20, 1e-9


def _log_normal(x: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    return -0.5 * ((x - mean) ** 2 / variance + np.log(2 * math.pi * variance))


def one_normal(x: np.ndarray, n: np.ndarray) -> float:
    mean = np.average(x, weights=n)
    variance = max(np.average((x - mean) ** 2, weights=n), VARIANCE_FLOOR)
    return float((n * _log_normal(x, mean, variance)).sum())


def two_normals(x: np.ndarray, n: np.ndarray, shifts: tuple[float, ...] = SHIFTS, steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Best log-likelihood over the starts, with weights, means and deviations in order of the means."""
    middle, best = np.average(x, weights=n), None
    sd = max(math.sqrt(np.average((x - middle) ** 2, weights=n)), SD_FLOOR)
    for shift in shifts:
        weight, mean, variance, before = np.array([0.5, 0.5]), np.array([middle - shift * sd, middle + shift * sd]), np.array([sd * sd] * 2), -np.inf
        for _ in range(steps):
            log = _log_normal(x[:, None], mean, variance) + np.log(np.maximum(weight, WEIGHT_FLOOR))
            top = log.max(axis=1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
            ll = float((n * total).sum())
            share = np.exp(log - total[:, None]) * n[:, None]
            held = np.maximum(share.sum(axis=0), COUNT_FLOOR)
            weight, mean = held / n.sum(), (share * x[:, None]).sum(axis=0) / held
            variance = np.maximum((share * (x[:, None] - mean) ** 2).sum(axis=0) / held, VARIANCE_FLOOR)
            if abs(ll - before) < SETTLED * (1 + abs(ll)):
                break
            before = ll
        if best is None or ll > best[0]:
            order = np.argsort(mean, kind="stable")
            best = (ll, weight[order], mean[order], np.sqrt(variance[order]))
    return best


def _two_normals_large(counts: DataFrame, spans: dict[int, tuple[float, float, float]]) -> dict[int, tuple]:
    """``two_normals`` of groups (``gid``, ``x``, ``n``) as aggregates; ``spans`` has each group's rows, mean and deviation, and parameters pass through the driver."""
    live, best, before = {}, {}, {}
    for gid, (_, _, sd) in spans.items():
        sd = max(sd, SD_FLOOR)
        for start, shift in enumerate(SHIFTS):
            live[gid, start] = ([0.5, 0.5], [-shift * sd, shift * sd], [sd * sd] * 2)
    schema = "gid bigint, start int, middle double, w0 double, w1 double, m0 double, m1 double, v0 double, v1 double"
    ended = {}
    for step in range(1, STEPS + 1):
        params = counts.sparkSession.createDataFrame([(gid, start, float(spans[gid][1]), *map(float, (*w, *m, *v))) for (gid, start), (w, m, v) in live.items()], schema)
        both = counts.join(F.broadcast(params), "gid").withColumn("d", F.col("x") - F.col("middle"))
        log = lambda k: -0.5 * ((F.col("d") - F.col(f"m{k}")) * (F.col("d") - F.col(f"m{k}")) / F.col(f"v{k}") + F.ln(2 * math.pi * F.col(f"v{k}"))) + F.ln(F.greatest(F.col(f"w{k}"), F.lit(WEIGHT_FLOOR)))
        both = both.withColumns({"l0": log(0), "l1": log(1)}).withColumn("top", F.greatest("l0", "l1"))
        both = both.withColumn("total", F.col("top") + F.ln(F.exp(F.col("l0") - F.col("top")) + F.exp(F.col("l1") - F.col("top"))))
        aggs = [F.sum(F.col("n") * F.col("total")).alias("ll")]
        for k in (0, 1):
            share = F.exp(F.col(f"l{k}") - F.col("total")) * F.col("n")
            aggs += [F.sum(share).alias(f"h{k}"), F.sum(share * F.col("d")).alias(f"s{k}"), F.sum(share * F.col("d") * F.col("d")).alias(f"q{k}")]
        for r in both.groupBy("gid", "start").agg(*aggs).collect():
            key = r["gid"], r["start"]
            held = [max(r[f"h{k}"], COUNT_FLOOR) for k in (0, 1)]
            mean = [r[f"s{k}"] / held[k] for k in (0, 1)]
            var = [max((r[f"q{k}"] - 2 * mean[k] * r[f"s{k}"] + mean[k] ** 2 * r[f"h{k}"]) / held[k], VARIANCE_FLOOR) for k in (0, 1)]
            live[key] = ([h / spans[key[0]][0] for h in held], mean, var)
            if step == STEPS or key in before and abs(r["ll"] - before[key]) < SETTLED * (1 + abs(r["ll"])):
                ended[key] = (r["ll"], *live.pop(key))
            before[key] = r["ll"]
        if not live:
            break
    for (gid, _), (ll, w, m, v) in sorted(ended.items()):
        if gid not in best or ll > best[gid][0]:
            order = np.argsort(m, kind="stable")
            best[gid] = (ll, np.array(w)[order], np.array(m)[order] + spans[gid][1], np.sqrt(np.array(v)[order]))
    return best


_EDGES = np.linspace(-REACH, REACH, BINS + 1)
_CENTRES = (_EDGES[:-1] + _EDGES[1:]) / 2
_CELLS = np.diff([0.5 * math.erfc(-e / math.sqrt(2)) for e in _EDGES])
_CELLS = _CELLS / _CELLS.sum()


def null_ratio(n: int, middle: float, sd: float, seed: list[int]) -> float:
    """The likelihood ratio of ``n`` rows drawn from one normal."""
    counts = np.random.default_rng(seed).multinomial(n, _CELLS).astype(float)
    held = counts > 0
    x, counts = middle + sd * _CENTRES[held], counts[held]
    return max(0.0, 2 * (two_normals(x, counts, QUICK_SHIFTS, QUICK_STEPS)[0] - one_normal(x, counts)))


def bimodality(df: DataFrame, by: list[str], value: str, *, resamples: int = 0, seed: int = 1) -> DataFrame:
    """Likelihood-ratio diagnostic of two populations in each group.

    Result: keys, ``n``, ``likelihood_ratio``, ``p`` (share of ``resamples``
    samples of one normal, of the group's size, whose ratio is no less; null
    without resamples), ``ashman_d``, ``least_weight``, ``mean_low``,
    ``mean_high``.  All but ``n`` are null below 20 rows or without spread.
    Missing and infinite values don't count; null keys are a group.  Every
    resample of every group is a row of its own, spread over the tasks.
    """
    names, spark, scratch = [f"k{i}" for i in range(len(by))], df.sparkSession, Scratch(df.sparkSession, "bimodality")
    number = F.col(value).cast("double")
    clean = df.select(*(F.col(c).alias(a) for c, a in zip(by, names)), number.alias("x")).where(finite(number))
    counts = scratch.keep(clean.groupBy(*names, "x").agg(F.count("*").alias("n")), "counts")
    spans = counts.groupBy(*names).agg(F.count("*").alias("values"), F.sum("n").alias("rows"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("middle"))
    large = spans.where(F.col("values") > TASK_VALUES).collect()  # few, as each has so many values
    fields = ", ".join(f"{a} {counts.schema[a].dataType.simpleString()}" for a in names)
    found = ("likelihood_ratio", "ashman_d", "least_weight", "mean_low", "mean_high", "middle", "sd")
    schema = f"{fields}{', ' if fields else ''}n bigint, " + ", ".join(f"{c} double" for c in found)

    def measures(ll2: float, weight: np.ndarray, mean: np.ndarray, spread: np.ndarray, ll1: float) -> dict:
        return {"likelihood_ratio": max(0.0, 2 * (ll2 - ll1)), "ashman_d": math.sqrt(2) * abs(float(mean[1] - mean[0])) / math.hypot(*spread), "least_weight": float(weight.min()), "mean_low": float(mean[0]), "mean_high": float(mean[1])}

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, n = pdf["x"].to_numpy(), pdf["n"].to_numpy(dtype=float)
        middle = np.average(x, weights=n)
        sd = math.sqrt(np.average((x - middle) ** 2, weights=n))
        row = {**{a: pdf[a].iloc[0] for a in names}, "n": int(n.sum()), **dict.fromkeys(found), "middle": middle, "sd": sd}
        if row["n"] >= LEAST_ROWS and sd > LEAST_SD:
            row |= measures(*two_normals(x, n), one_normal(x, n))
        return pd.DataFrame([row])

    small = counts
    if large:
        keys = spark.createDataFrame([(i, float(r["middle"]), *(r[a] for a in names)) for i, r in enumerate(large)], "gid bigint, middle double" + "".join(f", s{a} {counts.schema[a].dataType.simpleString()}" for a in names))
        same = F.lit(True)
        for a in names:
            same &= F.col(a).eqNullSafe(F.col(f"s{a}"))
        small = counts.join(F.broadcast(keys), same, "left_anti")
        theirs = scratch.keep(counts.join(F.broadcast(keys), same).select("gid", "x", "n", "middle"), "large")
        squares = {r["gid"]: r["q"] for r in theirs.groupBy("gid").agg(F.sum(F.col("n") * (F.col("x") - F.col("middle")) * (F.col("x") - F.col("middle"))).alias("q")).collect()}
        sizes = {i: (r["rows"], r["middle"], math.sqrt(squares[i] / r["rows"])) for i, r in enumerate(large)}
        spread = {i: z for i, z in sizes.items() if z[2] > LEAST_SD and z[0] >= LEAST_ROWS}
        fits = _two_normals_large(theirs.drop("middle"), spread) if spread else {}
    judged = small.groupBy(*names).applyInPandas(judge, schema)
    if large:
        out = []
        for i, r in enumerate(large):
            n, middle, sd = sizes[i]
            row = {**{a: r[a] for a in names}, "n": n, **dict.fromkeys(found), "middle": middle, "sd": sd}
            if i in fits:
                variance = max(sd * sd, VARIANCE_FLOOR)
                row |= measures(*fits[i], -0.5 * n * (sd * sd / variance + math.log(2 * math.pi * variance)))
            out.append(tuple(row[c] for c in (*names, "n", *found)))
        judged = judged.unionByName(spark.createDataFrame(out, schema))
    judged = scratch.keep(judged.withColumn("gid", F.monotonically_increasing_id()), "judged")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            more = [null_ratio(int(r.n), r.middle, r.sd, [seed, int(r.resample)]) >= r.likelihood_ratio for r in batch.itertuples()]
            yield pd.DataFrame({"gid": batch["gid"], "more": np.array(more, dtype=np.int64)})

    p = F.lit(None).cast("double")
    if resamples:
        grid = judged.where("likelihood_ratio is not null").select("gid", "n", "middle", "sd", "likelihood_ratio").crossJoin(F.broadcast(spark.range(resamples).toDF("resample")))
        judged = judged.join(grid.repartition(256, "gid", "resample").mapInPandas(draw, "gid bigint, more bigint").groupBy("gid").agg(F.sum("more").alias("more")), "gid", "left")
        p = (1 + F.col("more")) / (1 + resamples)
    return judged.select(*names, "n", "likelihood_ratio", p.alias("p"), *found[1:5]).toDF(*by, "n", "likelihood_ratio", "p", *found[1:5])
