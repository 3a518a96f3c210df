"""Queries of the general problems 1 and 2 over the run scores and stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.copies import NUMBER, TEXT, diff_copies, diff_counts
from skein.operators.near import finite, neighbour_counts
from skein.operators.regions import pairs_by_regions, points_in_regions

SCORES = {
    "mean_completeness": NUMBER,
    "mean_purity": NUMBER,
    "mean_jaccard": NUMBER,
    "strict_recoveries_of_8": NUMBER,
    "formal_overlap_resolved": NUMBER,
    "s3_accepted_splits": NUMBER,
    "s3_orphans": NUMBER,
    "target_parent_status": TEXT,
}
PAIR_DISTANCE_PC = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed_runs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sigma = F.col("velocity_error_sigma_kms")
    milli = F.when(finite(sigma), F.round(sigma * 1000).cast("bigint"))
    return table(spark, sf_dir, name).where("realisation is not null").select("*", milli.alias("sigma_milli"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_copies(
        _keyed_runs(spark, sf_dir, "s3_runs"),
        _keyed_runs(spark, sf_dir, "s3_runs_archive"),
        ["realisation", "sigma_milli"],
        SCORES,
        latest="loaded_at",
        names=("s3_runs", "s3_runs_archive"),
    )


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_counts(p1_found(spark, sf_dir))


def _latest_sql(name: str) -> str:
    fields = ", ".join(
        f"lower(trim({c})) AS {c}" if kind == TEXT else f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END AS {c}" for c, kind in SCORES.items()
    )
    return f"""SELECT realisation, sigma_milli, {fields}, 1 AS here FROM (
      SELECT *, row_number() OVER (PARTITION BY realisation, sigma_milli ORDER BY loaded_at DESC NULLS LAST) AS nth FROM (
        SELECT *, CASE WHEN isfinite(velocity_error_sigma_kms) THEN CAST(round(velocity_error_sigma_kms * 1000) AS BIGINT) END AS sigma_milli
        FROM {name} WHERE realisation IS NOT NULL)) WHERE nth = 1"""


def _p1_sql() -> str:
    tests = "\nUNION ALL\n".join(
        f"SELECT realisation, sigma_milli, '{c}' AS difference FROM j WHERE here_a = 1 AND here_b = 1 AND "
        + (f"a_{c} IS DISTINCT FROM b_{c}" if kind == TEXT else f"((a_{c} IS NULL) <> (b_{c} IS NULL) OR abs(a_{c} - b_{c}) > 1e-9)")
        for c, kind in SCORES.items()
    )
    columns = ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in SCORES)
    return f"""WITH a AS ({_latest_sql("s3_runs")}), b AS ({_latest_sql("s3_runs_archive")}),
    j AS (SELECT coalesce(a.realisation, b.realisation) AS realisation, coalesce(a.sigma_milli, b.sigma_milli) AS sigma_milli,
                 a.here AS here_a, b.here AS here_b, {columns}
          FROM a FULL JOIN b ON a.realisation = b.realisation AND a.sigma_milli IS NOT DISTINCT FROM b.sigma_milli)
    SELECT realisation, sigma_milli, 'only_in_s3_runs' AS difference FROM j WHERE here_b IS NULL
    UNION ALL SELECT realisation, sigma_milli, 'only_in_s3_runs_archive' FROM j WHERE here_a IS NULL
    UNION ALL {tests}"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_by_regions(table(spark, sf_dir, "stars"), "row_index", ["x_pc", "y_pc", "z_pc"], PAIR_DISTANCE_PC, "realisation")
    return pairs.select(F.col("id_a").alias("row_index_a"), F.col("id_b").alias("row_index_b"))


def p2_neighbour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stars have how many neighbours (those with any)."""
    pairs = pairs_by_regions(table(spark, sf_dir, "stars"), "row_index", ["x_pc", "y_pc", "z_pc"], PAIR_DISTANCE_PC, "realisation")
    return neighbour_counts(pairs).groupBy("n_neighbours").agg(F.count("*").alias("n_stars"))


_STARS_SQL = """SELECT DISTINCT row_index, realisation, x_pc, y_pc, z_pc FROM stars
    WHERE row_index IS NOT NULL AND realisation IS NOT NULL AND isfinite(x_pc) AND isfinite(y_pc) AND isfinite(z_pc)"""
_PAIRS_SQL = f"""WITH s AS ({_STARS_SQL})
    SELECT a.row_index AS row_index_a, b.row_index AS row_index_b
    FROM s a JOIN s b ON a.realisation = b.realisation AND a.row_index < b.row_index
    WHERE (a.x_pc - b.x_pc)*(a.x_pc - b.x_pc) + (a.y_pc - b.y_pc)*(a.y_pc - b.y_pc) + (a.z_pc - b.z_pc)*(a.z_pc - b.z_pc) <= {PAIR_DISTANCE_PC**2}"""

#: Positions in whole units of 1e-4 pc, in which the octagons below are exact.
GRID = 10_000.0


def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of a realisation inside the octagon around each of its labels.

    The octagon is the hull of a label's stars among shapes with sides along
    the axes and the diagonals of x and y.  Counts all stars of the
    realisation that it holds, whatever their label.
    """
    label = F.lower(F.trim("true_label"))
    stars = table(spark, sf_dir, "stars").where("realisation is not null and row_index is not null").where(finite(F.col("x_pc")) & finite(F.col("y_pc")))
    stars = stars.select(F.col("realisation").alias("group_key"), F.col("row_index").alias("id"), F.round(F.col("x_pc") * GRID).alias("x"), F.round(F.col("y_pc") * GRID).alias("y"), label.alias("region"))
    s, d = F.col("x") + F.col("y"), F.col("x") - F.col("y")
    hull = (
        stars.where("region is not null and region <> 'background'")
        .groupBy("group_key", "region")
        .agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"), F.min(s).alias("s0"), F.max(s).alias("s1"), F.min(d).alias("d0"), F.max(d).alias("d1"))
    )
    corners = [("w", "s0-w"), ("s0-s", "s"), ("d1+s", "s"), ("e", "e-d1"), ("e", "s1-e"), ("s1-n", "n"), ("d0+n", "n"), ("w", "w-d0")]
    ring = F.array(*(F.struct(F.lit(i).alias("seq"), F.expr(x).alias("x"), F.expr(y).alias("y")) for i, (x, y) in enumerate(corners)))
    found = points_in_regions(stars.drop("region"), hull.select("group_key", "region", F.inline(ring)), strip=40 * GRID)
    return found.groupBy(F.col("group_key").alias("realisation"), "region").agg(F.count("*").alias("n_inside"), F.count_if("on_boundary").alias("n_boundary"))


_REGIONS_SQL = """WITH s AS (
      SELECT DISTINCT realisation, row_index, round(x_pc * 10000) AS x, round(y_pc * 10000) AS y, lower(trim(true_label)) AS region
      FROM stars WHERE realisation IS NOT NULL AND row_index IS NOT NULL AND isfinite(x_pc) AND isfinite(y_pc)),
    p AS (SELECT DISTINCT realisation, row_index, x, y FROM s),
    h AS (SELECT realisation, region, min(x) w, max(x) e, min(y) lo, max(y) hi, min(x+y) s0, max(x+y) s1, min(x-y) d0, max(x-y) d1
          FROM s WHERE region IS NOT NULL AND region <> 'background' GROUP BY ALL)
    SELECT p.realisation, h.region, count(*) AS n_inside,
           count(*) FILTER (x = w OR x = e OR y = lo OR y = hi OR x+y = s0 OR x+y = s1 OR x-y = d0 OR x-y = d1) AS n_boundary
    FROM p JOIN h ON p.realisation = h.realisation AND x BETWEEN w AND e AND y BETWEEN lo AND hi AND x+y BETWEEN s0 AND s1 AND x-y BETWEEN d0 AND d1
    GROUP BY ALL"""

QUERIES = {
    "p1_found": p1_found,
    "p1_summary": p1_summary,
    "p2_found": p2_found,
    "p2_regions": p2_regions,
    "p2_neighbour_histogram": p2_neighbour_histogram,
}

SQL = {
    "p1_found": _p1_sql(),
    "p1_summary": f"SELECT difference, count(*) AS n_keys FROM ({_p1_sql()}) GROUP BY ALL",
    "p2_found": _PAIRS_SQL,
    "p2_regions": _REGIONS_SQL,
    "p2_neighbour_histogram": f"""SELECT n_neighbours, count(*) AS n_stars FROM (
        SELECT id, count(*) AS n_neighbours FROM (SELECT row_index_a AS id FROM ({_PAIRS_SQL}) UNION ALL SELECT row_index_b FROM ({_PAIRS_SQL})) GROUP BY id) GROUP BY ALL""",
}
