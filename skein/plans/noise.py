"""Noise levels applied to the points of a catalogue."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_draw(*keys: Column | str, seed: int = 0) -> Column:
    """A standard normal number that depends only on ``keys`` and ``seed``."""
    u = [(F.xxhash64(*keys, F.lit(seed * 2 + k)) / F.lit(2.0**64)) + 0.5 for k in (0, 1)]
    return F.sqrt(-2 * F.ln(F.greatest(u[0], F.lit(2.0**-60)))) * F.cos(2 * math.pi * u[1])


def with_levels(points: DataFrame, column: str, levels: list[float], draw: Column) -> DataFrame:
    """Every point at every noise level, one common draw scaled by the levels; only finite values get noise."""
    level = F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("sigma")
    return points.select("*", draw.alias("__draw"), level).withColumn(column, F.col(column) + F.col("sigma") * F.col("__draw")).drop("__draw")
