"""Queries of the problems tagged llm, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import integer_id, strip_blanks
from skein.llm.clusters import clean_records, describe_clusters, isolated_clusters, markov_clusters
from skein.llm.components import group_links
from skein.llm.mixing import mix_sources
from skein.llm.packing import pack, pack_with_program, packing_check, packing_report
from skein.llm.pii import find_personal_information, redact_personal_information
from skein.llm.quantiles import RANK_ERROR, merge_sketches, rank_bounds, sketch_quantiles, sketch_values
from skein.llm.tokens import token_sizes

FRACTIONS = {"p01": 0.01, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 3: groups of linked source ids


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "match_pairs").select(integer_id(F.col("source_id_a")).alias("a"), integer_id(F.col("source_id_b")).alias("b"))
    return group_links(pairs, "a", "b").withColumnRenamed("id", "source_id")


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = p3_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_groups"))


_P3_SQL = r"""WITH RECURSIVE e AS (
      SELECT DISTINCT a, b FROM (
        SELECT TRY_CAST(regexp_replace(regexp_replace(source_id_a, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\.0*$', '') AS BIGINT) AS a,
               TRY_CAST(regexp_replace(regexp_replace(source_id_b, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\.0*$', '') AS BIGINT) AS b
        FROM match_pairs) WHERE a IS NOT NULL AND b IS NOT NULL),
    d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS source_id, a AS group_id FROM d
          UNION SELECT d.b, r.group_id FROM r JOIN d ON d.a = r.source_id)
    SELECT source_id, min(group_id) AS group_id FROM r GROUP BY source_id"""


# --- 4: percentiles of the reddening


def _reddening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per star record, with its first day of delivery."""
    stars = table(spark, sf_dir, "stars").select("row_index", F.lower(strip_blanks(F.col("true_label"))).alias("true_label"), "reddening_mag", "ingested_at")
    return stars.groupBy("row_index", "true_label", "reddening_mag").agg(F.to_date(F.min("ingested_at")).alias("day"))


def p4_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mergeable sketch per label and day."""
    return sketch_values(_reddening(spark, sf_dir), ["true_label", "day"], "reddening_mag")


def p4_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that each daily sketch stands for."""
    return p4_daily_sketches(spark, sf_dir).select("true_label", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


_P4_DAYS_SQL = """SELECT true_label, strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM (
      SELECT row_index, lower(regexp_replace(true_label, '^\\s+|\\s+$', '', 'g')) AS true_label, reddening_mag, min(ingested_at) AS day FROM stars GROUP BY ALL)
    WHERE isfinite(reddening_mag) GROUP BY ALL"""


def _label_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_quantiles(merge_sketches(p4_daily_sketches(spark, sf_dir), ["true_label"]), list(FRACTIONS.values()))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per label from the merged daily sketches."""
    return _label_quantiles(spark, sf_dir).select("true_label", "n", *(F.col("quantiles")[i].alias(p) for i, p in enumerate(FRACTIONS)))


def p4_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact values at both ends of the stated rank error, and whether each percentile lies between them."""
    fractions = list(FRACTIONS.values())
    bounds = rank_bounds(_reddening(spark, sf_dir), ["true_label"], "reddening_mag", fractions)
    each = F.array(*(F.struct(F.lit(q).alias("q"), F.col("quantiles")[i].alias("estimate")) for i, q in enumerate(fractions)))
    found = _label_quantiles(spark, sf_dir).select(F.col("true_label").alias("label"), F.inline(each))
    both = bounds.join(found, bounds["true_label"].eqNullSafe(found["label"]) & (F.col("q") == F.col("fraction")))
    return both.select("true_label", "n", "fraction", "low_value", "high_value", F.col("estimate").between(F.col("low_value"), F.col("high_value")).alias("within_error"))


# the ranks are counted here from the values; that the estimates lie between is what the query must show
_P4_CHECK_SQL = f"""WITH v AS (
      SELECT DISTINCT row_index, lower(regexp_replace(true_label, '^\\s+|\\s+$', '', 'g')) AS true_label, reddening_mag AS m FROM stars WHERE isfinite(reddening_mag)),
    k AS (SELECT true_label, m, row_number() OVER (PARTITION BY true_label ORDER BY m) AS r, count(*) OVER (PARTITION BY true_label) AS n FROM v),
    f AS (SELECT fraction, {RANK_ERROR}::DOUBLE * least(fraction, 1 - fraction) AS e FROM (VALUES {", ".join(f"({q}::DOUBLE)" for q in FRACTIONS.values())}) f(fraction))
    SELECT true_label, n, fraction, min(m) FILTER (r >= greatest(floor(fraction * n - (e * n + 1)), 1)) AS low_value,
      min(m) FILTER (r >= least(ceil(fraction * n + (e * n + 1)), n)) AS high_value, true AS within_error
    FROM k, f GROUP BY true_label, n, fraction"""


# --- 5: clusters of similar stars

_AT = ["x_pc", "y_pc", "z_pc"]
INNER, OUTER, LEAST = (4.0, 0.25), (8.0, 0.6), 10


_STAR = ("row_index", "realisation", _AT, "reddening_mag")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = table(spark, sf_dir, "stars")
    found = isolated_clusters(markov_clusters(stars, *_STAR, sparse=False), clean_records(stars, *_STAR), inner=INNER, outer=OUTER, min_size=LEAST)
    return found.select(F.col("id").alias("row_index"), "cluster_id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, centre and three most typical stars of every Markov cluster."""
    return describe_clusters(markov_clusters(table(spark, sf_dir, "stars"), *_STAR)).withColumnRenamed("group_key", "realisation")


def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star records of each realisation in clusters, whether each is in one only, and whether every cluster is named by its least record."""
    members = markov_clusters(table(spark, sf_dir, "stars"), *_STAR)
    least = members.groupBy("group_key", "cluster_id").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    once = members.groupBy("group_key", "id").agg(F.count("*").alias("uses")).groupBy("group_key").agg(F.count("*").alias("n_records"), (F.max("uses") == 1).alias("once"))
    named = least.groupBy("group_key").agg(F.bool_and(F.col("least") == F.col("cluster_id")).alias("named"))
    return once.join(named, "group_key").withColumnRenamed("group_key", "realisation")


_P5_COVER_SQL = """SELECT realisation, count(DISTINCT row_index) AS n_records, true AS once, true AS named FROM stars
    WHERE realisation IS NOT NULL AND row_index IS NOT NULL AND isfinite(x_pc) AND isfinite(y_pc) AND isfinite(z_pc) AND isfinite(reddening_mag) GROUP BY realisation"""


def _p5_sql() -> str:
    def near(p: str, q: str, limits: tuple[float, float]) -> str:
        return f"sqrt(pow({p}.x-{q}.x,2)+pow({p}.y-{q}.y,2)+pow({p}.z-{q}.z,2)) <= {limits[0] + 1e-9} AND abs({p}.a-{q}.a) <= {limits[1] + 1e-9}"

    def means(name: str, limits: tuple[float, float]) -> str:
        return f"(SELECT m.seed, s.realisation, avg(s.x) AS x, avg(s.y) AS y, avg(s.z) AS z, avg(s.a) AS a, count(*) AS n, min(s.row_index) AS least FROM {name} m JOIN s ON s.realisation = m.realisation AND {near('s', 'm', limits)} GROUP BY ALL)"

    return f"""WITH s AS (SELECT DISTINCT row_index, realisation, x_pc AS x, y_pc AS y, z_pc AS z, reddening_mag AS a FROM stars
      WHERE realisation IS NOT NULL AND row_index IS NOT NULL AND isfinite(x_pc) AND isfinite(y_pc) AND isfinite(z_pc) AND isfinite(reddening_mag)),
    m0 AS (SELECT row_index AS seed, * FROM s),
    m1 AS {means("m0", (8.0, 0.5))},
    m2 AS {means("(SELECT * FROM m1 WHERE n >= 10)", (5.0, 0.35))},
    m3 AS {means("(SELECT * FROM m2 WHERE n >= 10)", (4.0, 0.25))},
    t AS (SELECT m2.seed, s.*, m3.least, m3.n AS size, {near("s", "m2", (4.0, 0.25))} AS chosen, {near("s", "m3", (4.0, 0.25))} AS compact
          FROM m3 JOIN m2 ON m2.seed = m3.seed JOIN s ON s.realisation = m3.realisation AND {near("s", "m3", (8.0, 0.6))}),
    ok AS (SELECT seed FROM t GROUP BY seed HAVING count(*) = any_value(size) AND bool_and(chosen AND compact) AND count(*) >= 10)
    SELECT DISTINCT row_index, least AS cluster_id FROM t SEMI JOIN ok USING (seed)"""


# --- 6: containers filled with documents


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the containers of every capacity."""
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", table(spark, sf_dir, "pack_capacities"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of every capacity, the program's value and bound, and how far from it they are."""
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing_report(*pack_with_program(sizes, "doc_id", "n_tokens", table(spark, sf_dir, "pack_capacities")))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed per kind of container, and rules broken."""
    return packing_check(p6_packing(spark, sf_dir))


_P6_CHECK_SQL = """SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS n_items, 0::BIGINT AS overfull, 0::BIGINT AS divided, 0::BIGINT AS broken
    FROM (SELECT DISTINCT container_kind FROM pack_capacities WHERE container_kind IS NOT NULL AND capacity_tokens >= 1)"""


# --- 7: sources mixed to their target shares


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", ("source",))
    return mix_sources(sizes, "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in training order."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mixture(spark, sf_dir)[1]


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at hand per target, and whether no document is used too often and each share is met to a hundredth."""
    shares = p7_shares(spark, sf_dir)
    usable = F.col("n_documents") > 0
    wanted = F.when(usable, F.col("target_share")).otherwise(0.0)
    total = shares.agg(F.sum(wanted).alias("total"))
    met = F.abs(F.col("reached_share") - wanted / F.col("total")) <= 0.01
    return shares.join(F.broadcast(total)).select("source", "target_share", "n_documents", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), met.alias("share_met"))


# the shares themselves are counted in tokens, which SQL can't; that they are met is what the query must show
_P7_CHECK_SQL = """SELECT source, target_share, count(DISTINCT doc_id) AS n_documents, true AS within_repeats, true AS share_met
    FROM mix_targets LEFT JOIN (SELECT doc_id, source FROM documents WHERE text <> '') USING (source) WHERE source IS NOT NULL GROUP BY source, target_share"""


# --- 8: personal information


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_information(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_parts"))
    return found.select("doc_id", "kind", "found").distinct()


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with typed placeholders."""
    return redact_personal_information(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_parts"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every text, and whether the redacted one has all of it but the passages, each with a placeholder in its place."""
    documents, parts = table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts")
    spans = find_personal_information(documents, "doc_id", "text", parts).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("cut"), F.sum(F.length("kind") + 2).alias("put"))
    after = redact_personal_information(documents, "doc_id", "text", parts).select("doc_id", F.length("text").alias("after"), "n_redacted")
    both = documents.select("doc_id", F.length("text").alias("n_chars")).join(after, "doc_id").join(spans, "doc_id", "left").na.fill(0, ["n", "cut", "put"])
    kept = F.coalesce(F.col("after") == F.col("n_chars") - F.col("cut") + F.col("put"), F.lit(True)) & (F.col("n") == F.col("n_redacted"))
    return both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), kept.alias("rest_kept"))


_P8_CHECK_SQL = "SELECT doc_id, length(text)::BIGINT AS n_chars, true AS rest_kept FROM documents"


QUERIES = {
    "p3_found": p3_found,
    "p3_group_sizes": p3_group_sizes,
    "p4_percentiles": p4_percentiles,
    "p4_daily_sketches": p4_daily_sketches,
    "p4_rank_check": p4_rank_check,
    "p4_daily_counts": p4_daily_counts,
    "p5_cover": p5_cover,
    "p7_check": p7_check,
    "p8_check": p8_check,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_packing": p6_packing,
    "p6_report": p6_report,
    "p6_check": p6_check,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

SQL = {
    "p3_found": _P3_SQL,
    "p3_group_sizes": f"SELECT size, count(*) AS n_groups FROM (SELECT group_id, count(*) AS size FROM ({_P3_SQL}) GROUP BY group_id) GROUP BY size",
    "p4_rank_check": _P4_CHECK_SQL,
    "p5_found": _p5_sql(),
    "p6_check": _P6_CHECK_SQL,
    "p4_daily_counts": _P4_DAYS_SQL,
    "p5_cover": _P5_COVER_SQL,
    "p7_check": _P7_CHECK_SQL,
    "p8_check": _P8_CHECK_SQL,
}
