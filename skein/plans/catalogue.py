"""Queries of the staged analysis over the star and run tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import astro
from skein.functions.ids import BLANKS, canonical_id
from skein.functions.stats import Z95, bh_qvalues, bootstrap_mean, effect_size, mann_whitney, paired_deltas, robust_scatter, wilson_interval
from skein.operators.bimodality import bimodality
from skein.operators.breaks import break_bootstrap, jenks_two_class, two_line_cdf
from skein.operators.copies import max_abs_difference
from skein.operators.mixture import REGULARISATION, Gate, gate_nodes, score_verdicts
from skein.operators.near import finite
from skein.operators.running import rank_quantile, running
from skein.operators.score import best_match, better_equal_worse, field_summary, fragments_and_merges, pieces_summary, resolution_flags, retention_agreement
from skein.plans.analysis import analyse
from skein.plans.noise import with_levels
from skein.plans.orders import order_aggregate, paired_orders
from skein.plans.refine import numbered_leaves, pipeline, seed_nodes
from skein.plans.stage1 import groups_at_radius, spatial_groups
from skein.scratch import Scratch
from skein.sources.tables import join_kinematics, unfinished

AT = ["x_pc", "y_pc", "z_pc"]
RADIUS, WIDER = 2.0, 3.0
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star records, each once, with tidy labels."""
    raw = table(spark, sf_dir, "stars").drop("ingested_at", "exported_at").where("row_index is not null")
    return raw.withColumn("label", F.lower(F.trim("true_label"))).drop("true_label").dropDuplicates(["row_index"])


_S = """s AS (SELECT DISTINCT ON (row_index) row_index, realisation, source_id, x_pc, y_pc, z_pc, reddening_mag, distance_pc, vl_lsr_kms, vb_lsr_kms, lower(trim(true_label)) AS label, survey
  FROM stars WHERE row_index IS NOT NULL)"""
_OK = "isfinite(x_pc) AND isfinite(y_pc) AND isfinite(z_pc)"


def r(c: Column | str, digits: int = DIGITS) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- ids, casts, projections


def canonical_ids(spark, sf_dir):
    return stars(spark, sf_dir).select("row_index", canonical_id(F.col("source_id")).alias("canonical_id"))


_BLANKS_SQL = BLANKS.replace(r"\u0085", r"\x{85}")
_CANONICAL = rf"coalesce(regexp_replace(regexp_replace(source_id, '^{_BLANKS_SQL}+|{_BLANKS_SQL}+$', '', 'g'), '^([+-]?\d+)\.0+$', '\1'), '')"


def kinematic_projection(spark, sf_dir):
    """Galactic direction, distance, solar motion along it, and velocities freed of it."""
    s = stars(spark, sf_dir).where(finite(F.col("x_pc")) & finite(F.col("y_pc")) & finite(F.col("z_pc")))
    l, b, d = astro.cartesian_to_spherical(F.col("x_pc"), F.col("y_pc"), F.col("z_pc"))
    s = s.select("row_index", l.alias("l"), b.alias("b"), d.alias("d"), "vl_lsr_kms", "vb_lsr_kms")
    cl, cb = astro.solar_projection(F.col("l"), F.col("b"))
    pm = F.when(finite(F.col("vl_lsr_kms")), F.col("vl_lsr_kms"))
    return s.select("row_index", r("l").alias("l_deg"), r("b").alias("b_deg"), r("d").alias("distance"), r(cl).alias("solar_l"), r(cb).alias("solar_b"), r(astro.proper_motion_velocity(pm, F.col("d"))).alias("velocity"))


_U, _V, _W = astro.SOLAR_MOTION
_PROJECTION_SQL = f"""WITH {_S}, p AS (SELECT row_index, CASE WHEN degrees(atan2(y_pc, x_pc)) < 0 THEN degrees(atan2(y_pc, x_pc)) + 360 ELSE degrees(atan2(y_pc, x_pc)) END AS l,
    degrees(asin(z_pc / sqrt(x_pc*x_pc + y_pc*y_pc + z_pc*z_pc))) AS b, sqrt(x_pc*x_pc + y_pc*y_pc + z_pc*z_pc) AS d, vl_lsr_kms AS v FROM s WHERE {_OK})
  SELECT row_index, round(l, 6) AS l_deg, round(b, 6) AS b_deg, round(d, 6) AS distance,
    round({-_U}::DOUBLE * sin(radians(l)) + {_V}::DOUBLE * cos(radians(l)), 6) AS solar_l,
    round({-_U}::DOUBLE * cos(radians(l)) * sin(radians(b)) - {_V}::DOUBLE * sin(radians(l)) * sin(radians(b)) + {_W}::DOUBLE * cos(radians(b)), 6) AS solar_b,
    CASE WHEN isfinite(v) AND d > 0 THEN round({astro.KM_S_PER_MASYR_KPC}::DOUBLE * v * d / 1000, 6) END AS velocity FROM p"""


def frame_rotation(spark, sf_dir):
    """Unit vectors of the stars rotated from ICRS to Galactic axes."""
    s = stars(spark, sf_dir).where(finite(F.col("x_pc")) & finite(F.col("y_pc")) & finite(F.col("z_pc")))
    d = F.sqrt(F.col("x_pc") * F.col("x_pc") + F.col("y_pc") * F.col("y_pc") + F.col("z_pc") * F.col("z_pc"))
    gx, gy, gz = astro.rotate(astro.ICRS_TO_GALACTIC, F.col("x_pc") / d, F.col("y_pc") / d, F.col("z_pc") / d)
    return s.where(d > 0).select("row_index", r(gx).alias("gx"), r(gy).alias("gy"), r(gz).alias("gz"))


_ROTATION_SQL = (
    f"WITH {_S}, p AS (SELECT row_index, x_pc/d AS x, y_pc/d AS y, z_pc/d AS z FROM (SELECT *, sqrt(x_pc*x_pc + y_pc*y_pc + z_pc*z_pc) AS d FROM s WHERE {_OK}) WHERE d > 0) SELECT row_index, "
    + ", ".join(f"round({a!r}::DOUBLE * x + {b!r}::DOUBLE * y + {c!r}::DOUBLE * z, 6) AS {n}" for n, (a, b, c) in zip(("gx", "gy", "gz"), astro.ICRS_TO_GALACTIC))
    + " FROM p"
)

# --- keyed joins


def kinematics_match(spark, sf_dir):
    """Stars per survey that have a velocity under their canonical id in any realisation."""
    s = stars(spark, sf_dir)
    known = s.where(finite(F.col("vl_lsr_kms")) & (canonical_id(F.col("source_id")) != ""))
    known = known.groupBy(canonical_id(F.col("source_id")).alias("source_id")).agg(F.max("vl_lsr_kms").alias("vl_lsr_kms"))
    joined = join_kinematics(s.select("row_index", "source_id", "survey"), known, ["vl_lsr_kms"])
    return joined.groupBy("survey").agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"), r(F.avg("vl_lsr_kms")).alias("mean_vl"))


_KINEMATICS_SQL = f"""WITH {_S}, c AS (SELECT *, {_CANONICAL} AS sid FROM s),
  k AS (SELECT sid, max(vl_lsr_kms) AS v FROM c WHERE isfinite(vl_lsr_kms) AND sid <> '' GROUP BY sid)
  SELECT survey, count(*) AS n, count(k.sid) AS n_matched, round(avg(v), 6) AS mean_vl FROM c LEFT JOIN k USING (sid) GROUP BY survey"""


def field_stars(spark, sf_dir):
    """Stars per realisation that belong to no known template."""
    known = table(spark, sf_dir, "templates").select(F.col("template_label").alias("label"))
    return stars(spark, sf_dir).join(F.broadcast(known), "label", "left_anti").groupBy("realisation").agg(F.count("*").alias("n_field"))


def linked_stars(spark, sf_dir):
    """Match pairs with both ends among the stars, per day."""
    ids = stars(spark, sf_dir).select(canonical_id(F.col("source_id")).alias("sid")).where("sid <> ''").distinct()
    pairs = table(spark, sf_dir, "match_pairs").select(canonical_id(F.col("source_id_a")).alias("a"), canonical_id(F.col("source_id_b")).alias("b"), F.date_format("matched_at", "yyyy-MM-dd").alias("day"))
    for end in "ab":
        pairs = pairs.join(ids.withColumnRenamed("sid", end), end, "left_semi")
    return pairs.groupBy("day").agg(F.count("*").alias("n_pairs"))


_LINKED_SQL = f"""WITH {_S}, i AS (SELECT DISTINCT {_CANONICAL} AS sid FROM s WHERE {_CANONICAL} <> ''),
  p AS (SELECT {_CANONICAL.replace("source_id", "source_id_a")} AS a, {_CANONICAL.replace("source_id", "source_id_b")} AS b, strftime(matched_at, '%Y-%m-%d') AS day FROM match_pairs)
  SELECT day, count(*) AS n_pairs FROM p WHERE a IN (SELECT sid FROM i) AND b IN (SELECT sid FROM i) GROUP BY day"""

# --- groups at a radius and their scores


def _groups(spark, sf_dir, radius=RADIUS):
    return groups_at_radius(table(spark, sf_dir, "stars"), "row_index", "realisation", AT, radius, min_size=10)


def _truth(spark, sf_dir):
    return _placed(stars(spark, sf_dir))


def _placed(s):
    s = s.where("realisation is not null").where(finite(F.col("x_pc")) & finite(F.col("y_pc")) & finite(F.col("z_pc")))
    return s.select(F.col("realisation").alias("g"), F.col("row_index").alias("id"), "label")


def components_at_radius(spark, sf_dir):
    return _groups(spark, sf_dir).select(F.col("g").alias("realisation"), F.col("id").alias("row_index"), "group_id", "group_rows")


def _components_cte(name: str, radius: float) -> str:
    return f"""{name}_e AS (SELECT a.realisation AS g, a.row_index AS u, b.row_index AS v FROM pts a JOIN pts b ON a.realisation = b.realisation AND a.row_index <> b.row_index
      WHERE (a.x_pc-b.x_pc)*(a.x_pc-b.x_pc)+(a.y_pc-b.y_pc)*(a.y_pc-b.y_pc)+(a.z_pc-b.z_pc)*(a.z_pc-b.z_pc) <= {radius * radius}),
    {name}_r AS (SELECT g, u AS id, u AS root FROM {name}_e UNION SELECT {name}_e.g, {name}_e.v, {name}_r.root FROM {name}_r JOIN {name}_e ON {name}_e.u = {name}_r.id),
    {name}_c AS (SELECT g, id, min(root) AS c FROM {name}_r GROUP BY g, id),
    {name}_k AS (SELECT g, c, count(*) AS group_rows, row_number() OVER (PARTITION BY g ORDER BY c) AS group_id FROM {name}_c GROUP BY g, c HAVING count(*) >= 10),
    {name} AS (SELECT g, id, group_id, group_rows FROM {name}_c JOIN {name}_k USING (g, c))"""


_PTS = f"pts AS (SELECT * FROM s WHERE realisation IS NOT NULL AND {_OK})"
_GROUPS = f"WITH RECURSIVE {_S}, {_PTS}, {_components_cte('m', RADIUS)}"
_SCORES = f"""{_GROUPS}, t AS (SELECT realisation AS g, row_index AS id, label FROM pts WHERE label IS NOT NULL AND label <> 'background'),
  tr AS (SELECT g, label, count(*) AS true_size FROM t GROUP BY ALL), sz AS (SELECT g, group_id, count(*) AS group_size FROM m GROUP BY ALL),
  ov AS (SELECT t.g, label, group_id, count(*) AS overlap FROM t JOIN m ON t.g = m.g AND t.id = m.id GROUP BY ALL),
  be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, label ORDER BY overlap DESC, group_id) AS nth FROM ov) WHERE nth = 1),
  sc AS (SELECT tr.g, tr.label, true_size, be.group_id AS best_group, coalesce(be.overlap, 0) AS overlap, coalesce(group_size, 0) AS best_size,
     coalesce(be.overlap, 0) / true_size AS completeness, coalesce(be.overlap / group_size, 0) AS purity,
     coalesce(be.overlap, 0) / (true_size + coalesce(group_size, 0) - coalesce(be.overlap, 0)) AS jaccard
     FROM tr LEFT JOIN be ON tr.g = be.g AND tr.label = be.label LEFT JOIN sz ON be.g = sz.g AND be.group_id = sz.group_id),
  fl AS (SELECT *, completeness >= 0.5 AS detected, completeness >= 0.8 AND purity >= 0.5 AS strict FROM sc)"""


def best_match_scores(spark, sf_dir):
    s = best_match(_groups(spark, sf_dir), _truth(spark, sf_dir))
    return s.withColumns({c: r(c, 9) for c in ("completeness", "purity", "jaccard")})


def fragment_counts(spark, sf_dir):
    return fragments_and_merges(_groups(spark, sf_dir), _truth(spark, sf_dir))


_FRAGMENTS_SQL = f"""{_SCORES}, fr AS (SELECT ov.g, ov.label, count(*) FILTER (ov.overlap >= greatest(5, ceil(0.1::DOUBLE * true_size))) AS fragment_count FROM ov JOIN tr ON ov.g = tr.g AND ov.label = tr.label GROUP BY ALL),
  gu AS (SELECT ov.g, ov.label AS guest, ov.group_id FROM ov JOIN tr ON ov.g = tr.g AND ov.label = tr.label WHERE ov.overlap >= greatest(5, ceil(0.2::DOUBLE * true_size))),
  me AS (SELECT be.g, be.label, string_agg(guest, ';' ORDER BY guest) AS merged_with, count(*) AS n FROM be JOIN gu ON be.g = gu.g AND be.group_id = gu.group_id AND guest <> be.label GROUP BY ALL)
  SELECT fl.g, fl.label, true_size, coalesce(fragment_count, 0) AS fragment_count, coalesce(merged_with, '') AS merged_with, CAST(coalesce(n, 0) AS INTEGER) AS n_merged, overlap >= greatest(10, ceil(0.5::DOUBLE * true_size)) AS detected_rich
  FROM fl LEFT JOIN fr ON fl.g = fr.g AND fl.label = fr.label LEFT JOIN me ON fl.g = me.g AND fl.label = me.label"""


def fragment_means(spark, sf_dir):
    """Mean fragments and merged labels of each realisation."""
    s = pieces_summary(fragment_counts(spark, sf_dir))
    return s.withColumns({c: r(c) for c in ("mean_fragment_count", "mean_n_merged")})


def overlap_resolution(spark, sf_dir):
    return resolution_flags(best_match(_groups(spark, sf_dir), _truth(spark, sf_dir)), "template_01", "template_02")


_RESOLUTION_SQL = f"""{_SCORES} SELECT a.g, coalesce(a.best_group <> b.best_group, false) AS separate, coalesce(a.best_group <> b.best_group, false) AND a.detected AND b.detected AS formal,
  coalesce(a.best_group <> b.best_group, false) AND a.strict AND b.strict AS strict FROM fl a JOIN fl b ON a.g = b.g WHERE a.label = 'template_01' AND b.label = 'template_02'"""


def realisation_summary(spark, sf_dir):
    s = field_summary(best_match(_groups(spark, sf_dir), _truth(spark, sf_dir)))
    return s.withColumns({f"mean_{c}": r(f"mean_{c}") for c in ("completeness", "purity", "jaccard")})


def retention(spark, sf_dir):
    """Agreement of the groupings at two radii."""
    a = retention_agreement(_truth(spark, sf_dir), _groups(spark, sf_dir), _groups(spark, sf_dir, WIDER))
    return a.select("g", r("agreement").alias("agreement"))


_RETENTION_SQL = f"""{_GROUPS}, {_components_cte("w", WIDER)} SELECT pts.realisation AS g, round(avg(CASE WHEN (m.id IS NOT NULL) = (w.id IS NOT NULL) THEN 1 ELSE 0 END), 6) AS agreement
  FROM pts LEFT JOIN m ON m.g = pts.realisation AND m.id = row_index LEFT JOIN w ON w.g = pts.realisation AND w.id = row_index GROUP BY ALL"""


def group_boxes(spark, sf_dir):
    """Size, observables and bounding box of each group."""
    s = stars(spark, sf_dir).select(F.col("realisation").alias("g"), F.col("row_index").alias("id"), *AT, *(F.when(finite(F.col(c)), F.col(c)).alias(c) for c in ("reddening_mag", "vl_lsr_kms")))
    joined = _groups(spark, sf_dir).select("g", "id", "group_id").join(s, ["g", "id"])
    middle = running(joined.where("reddening_mag is not null"), ["g", "group_id"], ["reddening_mag", "id"], None, "boxes").groupBy("g", "group_id").agg(r(rank_quantile(0.5, "reddening_mag"), 11).alias("median_reddening"))
    boxes = joined.groupBy("g", "group_id").agg(
        F.count("*").alias("n_members"), r(F.avg("reddening_mag"), 11).alias("mean_reddening"), r(F.avg("vl_lsr_kms"), 11).alias("mean_vl"),
        *(f(c).alias(f"{n}_{c}") for c in AT for n, f in (("min", F.min), ("max", F.max))),
    )
    return boxes.join(middle, ["g", "group_id"], "left")


_BOXES_SQL = f"""{_GROUPS} SELECT m.g, group_id, count(*) AS n_members, round(median(reddening_mag) FILTER (isfinite(reddening_mag)), 11) AS median_reddening,
  round(avg(reddening_mag) FILTER (isfinite(reddening_mag)), 11) AS mean_reddening, round(avg(vl_lsr_kms) FILTER (isfinite(vl_lsr_kms)), 11) AS mean_vl,
  {", ".join(f"{f}({c}) AS {f}_{c}" for c in AT for f in ("min", "max"))} FROM m JOIN s ON s.row_index = m.id GROUP BY m.g, group_id"""


def coverage_gate(spark, sf_dir):
    """Early outs of the reddening gate for the groups, before any fit."""
    gate = Gate()
    s = stars(spark, sf_dir).select(F.col("row_index").alias("id"), finite(F.col("reddening_mag")).alias("seen"))
    n = _groups(spark, sf_dir).join(s, "id").groupBy("g", "group_id").agg(F.count("*").alias("n"), F.count_if("seen").alias("n_observed"))
    reason = F.when(F.col("n_observed") / F.col("n") < gate.coverage, F.lit("insufficient_reddening_coverage")).when(F.col("n_observed") < 2 * gate.component_n, F.lit("too_few_finite_reddening_values")).otherwise(F.lit("fit"))
    return n.select("g", "group_id", "n", "n_observed", r(F.col("n_observed") / F.col("n"), 9).alias("coverage"), reason.alias("reason"))


_COVERAGE_SQL = f"""{_GROUPS}, n AS (SELECT m.g, group_id, count(*) AS n, count(*) FILTER (isfinite(reddening_mag)) AS n_observed FROM m JOIN s ON s.row_index = m.id GROUP BY m.g, group_id)
  SELECT *, round(n_observed / n, 9) AS coverage, CASE WHEN n_observed < n THEN 'insufficient_reddening_coverage' WHEN n_observed < 10 THEN 'too_few_finite_reddening_values' ELSE 'fit' END AS reason FROM n"""

def gate_reddening(spark, sf_dir):
    """The reddening gate of the groups, fitted: its evidence of one population, and whether that of two and the separation follow from the parameters it returns."""
    gate = Gate()
    s = stars(spark, sf_dir).select(F.col("row_index").alias("id"), "reddening_mag")
    members = _groups(spark, sf_dir).join(s, "id").withColumn("node", F.format_string("%d:%d", "g", "group_id"))
    scratch = Scratch(spark, "gate")
    members = scratch.keep(members.select("node", "id", "g", "group_id", "reddening_mag"), "members")
    verdicts, _ = gate_nodes(members, gate, scratch)
    again = score_verdicts(members, verdicts, gate)
    close = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= 1e-6 * (1 + F.abs(F.col(b))), F.lit(True))
    keys = members.select("node", "g", "group_id").distinct()
    early = F.when(F.col("reason").startswith("insufficient") | F.col("reason").startswith("too_few"), F.col("reason")).otherwise(F.lit("fit"))
    return keys.join(verdicts, "node").join(again, "node", "left").select(
        "g", "group_id", "n", "n_observed", early.alias("reason"), r("bic_1").alias("bic_1"), close("bic_again", "bic_2").alias("bic_follows"), close("separation_again", "separation").alias("separation_follows"),
    )


# SQL counts the evidence of one population itself; that the rest follows from the parameters is what the query must show
_GATE_SQL = f"""{_GROUPS}, n AS (SELECT m.g, group_id, count(*) AS n, count(*) FILTER (isfinite(reddening_mag)) AS o, var_pop(reddening_mag) FILTER (isfinite(reddening_mag)) AS v FROM m JOIN s ON s.row_index = m.id GROUP BY m.g, group_id)
  SELECT g, group_id, n, o AS n_observed, CASE WHEN o < n THEN 'insufficient_reddening_coverage' WHEN o < 10 THEN 'too_few_finite_reddening_values' ELSE 'fit' END AS reason,
    CASE WHEN o = n AND o >= 10 THEN round(2 * ln(o) + o * (v / (v + {REGULARISATION!r}::DOUBLE) + ln(v + {REGULARISATION!r}::DOUBLE) + ln(2 * pi())), 6) END AS bic_1, true AS bic_follows, true AS separation_follows FROM n"""

# --- breaks and robust statistics of the reddening


def jenks_by_label(spark, sf_dir):
    out = jenks_two_class(stars(spark, sf_dir), ["label"], "reddening_mag", "row_index")
    return out.withColumns({"cut": r("cut"), "gvf": r("gvf")})


_FINITE = f"{_S}, f AS (SELECT label, row_index, reddening_mag - avg(reddening_mag) OVER (PARTITION BY label) AS d, reddening_mag AS x FROM s WHERE isfinite(reddening_mag))"
_JENKS_SQL = f"""WITH {_FINITE}, o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY label) AS n, sum(d) OVER w AS s1, sum(d*d) OVER w AS q1, sum(d) OVER (PARTITION BY label) AS st, sum(d*d) OVER (PARTITION BY label) AS qt, lead(x) OVER w AS nx
    FROM f WINDOW w AS (PARTITION BY label ORDER BY d, row_index)),
  e AS (SELECT *, greatest(q1 - s1*s1/k, 0) + greatest(qt - q1 - (st-s1)*(st-s1)/nullif(n-k, 0), 0) AS sse FROM o),
  b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sse / nullif(qt, 0), 12), k) AS nth FROM e WHERE k < n)
  SELECT label, n, round((x + nx) / 2, 6) AS cut, k AS n_low, round(1 - sse / greatest(qt - st*st/n, 0), 6) AS gvf FROM b WHERE nth = 1"""


def two_line_by_label(spark, sf_dir):
    out = two_line_cdf(stars(spark, sf_dir), ["label"], "reddening_mag", "row_index")
    return out.select("label", "n", r("threshold").alias("threshold"), "n_low", r("improvement").alias("improvement"))


def _line_sql(n: str, x: str, y: str, xx: str, xy: str, yy: str) -> tuple[str, str, str]:
    den = f"({n}*{xx}-{x}*{x})"
    slope = f"(CASE WHEN abs({den}) <= 1e-14 * {n} * {xx} THEN 0 ELSE ({n}*{xy}-{x}*{y})/{den} END)"
    cut = f"(({y}-{slope}*{x})/{n})"
    return slope, cut, f"greatest({yy}+{slope}*{slope}*{xx}+{n}*{cut}*{cut}-2*{slope}*{xy}-2*{cut}*{y}+2*{slope}*{cut}*{x}, 0)"


_LOW = _line_sql("k", "sx", "sy", "sxx", "sxy", "syy")
_HIGH = _line_sql("(n-k)", "(tx-sx)", "(ty-sy)", "(txx-sxx)", "(txy-sxy)", "(tyy-syy)")
_ONE = _line_sql("n", "tx", "ty", "txx", "txy", "tyy")
_LINES = f"""WITH {_FINITE}, q AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY label) AS n, lead(x) OVER w AS nx FROM f WINDOW w AS (PARTITION BY label ORDER BY d, row_index)),
  y AS (SELECT *, k / n AS y FROM q),
  o AS (SELECT *, {", ".join(f"sum({e}) OVER w AS s{a}, sum({e}) OVER (PARTITION BY label) AS t{a}" for a, e in (("x", "d"), ("y", "y"), ("xx", "d*d"), ("xy", "d*y"), ("yy", "y*y")))} FROM y WINDOW w AS (PARTITION BY label ORDER BY k ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT *, {_LOW[2]} + {_HIGH[2]} AS sse, {_ONE[2]} AS one, {_LOW[0]} AS b1, {_LOW[1]} AS a1, {_HIGH[0]} AS b2, {_HIGH[1]} AS a2,
       CASE WHEN n < 40 THEN greatest(2, n // 4) ELSE 20 END AS seg, min(x) OVER (PARTITION BY label) AS lo, max(x) OVER (PARTITION BY label) AS hi FROM o WHERE k < n),
  b AS (SELECT *, x - d + (a2 - a1) / nullif(b1 - b2, 0) AS meet, row_number() OVER (PARTITION BY label ORDER BY round(sse / tyy, 12), k) AS nth FROM e WHERE k >= seg AND n - k >= seg)
"""
_TWO_LINE_SQL = f"""{_LINES}
  SELECT label, n, round(CASE WHEN meet BETWEEN lo AND hi THEN meet ELSE (x + nx) / 2 END, 6) AS threshold, k AS n_low, round(1 - sse / one, 6) AS improvement FROM b WHERE nth = 1"""


def two_line_fits(spark, sf_dir):
    """All that the two-line fit tells of each label's reddening."""
    out = two_line_cdf(stars(spark, sf_dir), ["label"], "reddening_mag", "row_index")
    return out.select("label", "n", "method", "n_low", "min_segment", *(r(c).alias(c) for c in ("slope_low", "intercept_low", "slope_high", "intercept_high", "sse_two", "sse_one", "x_low", "x_high")))


_FITS_SQL = f"""{_LINES}
  SELECT label, n, CASE WHEN meet BETWEEN lo AND (SELECT max(f.x) FROM f WHERE f.label IS NOT DISTINCT FROM b.label) THEN 'line_intersection' ELSE 'midpoint_at_best_split' END AS method, k AS n_low, seg AS min_segment, round(b1, 6) AS slope_low, round(a1 - b1 * (x - d), 6) AS intercept_low,
    round(b2, 6) AS slope_high, round(a2 - b2 * (x - d), 6) AS intercept_high, round(sse, 6) AS sse_two, round(one, 6) AS sse_one, round(x, 6) AS x_low, round(nx, 6) AS x_high FROM b WHERE nth = 1"""


def break_bootstrap_by_label(spark, sf_dir):
    """How far both kinds of break of each label's reddening move over 200 resamples."""
    s = stars(spark, sf_dir)
    line, jenks = (break_bootstrap(s, ["label"], "reddening_mag", "row_index", kind=kind).withColumn("kind", F.lit(kind)) for kind in ("two_line", "jenks"))
    return line.unionByName(jenks)


def scatter_by_label(spark, sf_dir):
    """Robust scatter of each label's reddening and its effect size against the background."""
    s = robust_scatter(stars(spark, sf_dir), ["label"], "reddening_mag")
    ground = s.where("label = 'background'").select(F.col("middle").alias("m0"), F.col("scatter").alias("s0"))
    both = s.join(F.broadcast(ground))  # one row
    return both.select("label", "n", r("middle").alias("middle"), r("scatter").alias("scatter"), r(effect_size(F.col("middle"), F.col("scatter"), F.col("m0"), F.col("s0"))).alias("effect"))


_SCATTER_SQL = f"""WITH {_FINITE}, m AS (SELECT label, count(*) AS n, median(x) AS middle, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, stddev_samp(x) AS sd FROM f GROUP BY label),
  a AS (SELECT f.label, median(abs(x - middle)) AS mad FROM f JOIN m ON f.label IS NOT DISTINCT FROM m.label GROUP BY f.label),
  t AS (SELECT m.label, n, middle, CASE WHEN n < 2 THEN NULL WHEN mad > 0 THEN 1.4826::DOUBLE * mad WHEN iqr > 0 THEN iqr / 1.349::DOUBLE ELSE sd END AS scatter FROM m JOIN a ON a.label IS NOT DISTINCT FROM m.label)
  SELECT t.label, t.n, round(t.middle, 6) AS middle, round(t.scatter, 6) AS scatter, round(abs(t.middle - g.middle) / sqrt((t.scatter*t.scatter + g.scatter*g.scatter) / 2), 6) AS effect FROM t, t g WHERE g.label = 'background'"""


def mann_whitney_by_survey(spark, sf_dir):
    """Reddening of background stars against all others, per survey."""
    out = mann_whitney(stars(spark, sf_dir), ["survey"], F.col("label") == "background", "reddening_mag")
    return out.select("survey", "n_a", "n_b", r("u").alias("u"), r("z").alias("z"))


_MANN_SQL = f"""WITH {_S}, v AS (SELECT survey, label = 'background' AS side, reddening_mag AS x FROM s WHERE label IS NOT NULL AND isfinite(reddening_mag)),
  k AS (SELECT *, rank() OVER (PARTITION BY survey ORDER BY x) + (count(*) OVER (PARTITION BY survey, x) - 1) / 2 AS rk, count(*) OVER (PARTITION BY survey, x) AS t FROM v),
  a AS (SELECT survey, count(*) FILTER (side) AS n_a, count(*) FILTER (NOT side) AS n_b, count(*)::DOUBLE AS n, sum(rk) FILTER (side) AS ra, sum((t::DOUBLE*t*t - t) / t) AS ties FROM k GROUP BY survey),
  u AS (SELECT *, ra - n_a * (n_a + 1) / 2 AS u, sqrt(n_a::DOUBLE * n_b / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM a)
  SELECT survey, n_a, n_b, round(u, 6) AS u, round(greatest(abs(u - n_a::DOUBLE * n_b / 2) - 0.5, 0) / sd, 6) AS z FROM u"""


def bimodality_by_label(spark, sf_dir):
    """Whether each label's reddening looks like two populations."""
    return bimodality(stars(spark, sf_dir), ["label"], "reddening_mag", resamples=250)


def noise_sweep(spark, sf_dir):
    """Reddening with one normal draw a star, scaled by each noise level: spread per label and level."""
    u = lambda m, a: f"((row_index * {m}L + {a}L) % 4294967296L + 0.5D) / 4294967296.0D"
    draw = F.expr(f"sqrt(-2 * ln({u(668265263, 17)})) * cos(2 * pi() * {u(374761393, 5)})")
    s = stars(spark, sf_dir).where(finite(F.col("reddening_mag"))).select("label", "row_index", F.col("reddening_mag").alias("x"))
    noisy = with_levels(s, "x", [0.0, 0.025, 0.05, 0.1, 0.2], draw)
    return noisy.groupBy("label", "sigma").agg(F.count("*").alias("n"), r(F.avg("x")).alias("mean"), r(F.stddev_samp("x")).alias("spread"))


def _noise_sql() -> str:
    u = lambda m, a: f"((row_index * {m} + {a}) % 4294967296 + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    return f"""WITH {_S}, d AS (SELECT label, reddening_mag, sqrt(-2 * ln({u(668265263, 17)})) * cos(2 * pi() * {u(374761393, 5)}) AS draw FROM s WHERE isfinite(reddening_mag))
    SELECT label, sigma, count(*) AS n, round(avg(reddening_mag + sigma * draw), 6) AS mean, round(stddev_samp(reddening_mag + sigma * draw), 6) AS spread
    FROM d, (VALUES (0.0::DOUBLE), (0.025::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) l(sigma) GROUP BY label, sigma"""


# --- run scores


def runs(spark, sf_dir, name="s3_runs", more=()):
    """The latest row of each realisation and noise level (in thousandths); a missing level is one of its own.  ``more`` columns are taken along."""
    sigma = F.col("velocity_error_sigma_kms")
    raw = table(spark, sf_dir, name).where("realisation is not null").withColumn("sigma_milli", F.when(finite(sigma), F.round(sigma * 1000).cast("long")))
    columns = ["condition", "mean_completeness", "mean_purity", "mean_jaccard", "strict_recoveries_of_8", "s3_accepted_splits", "s3_orphans", "formal_overlap_resolved", *more]
    best = raw.groupBy("realisation", "sigma_milli").agg(F.max(F.struct("loaded_at", *columns)).alias("b"))
    return best.select("realisation", "sigma_milli", *(F.col(f"b.{c}").alias(c) for c in columns))


_RUNS = """q AS (SELECT realisation, sigma_milli, condition, {n}, CAST(strict_recoveries_of_8 AS DOUBLE) AS strict, CAST(s3_accepted_splits AS DOUBLE) AS splits, s3_orphans, formal_overlap_resolved AS formal
  FROM (SELECT *, row_number() OVER (PARTITION BY realisation, sigma_milli ORDER BY loaded_at DESC) AS nth
    FROM (SELECT *, CASE WHEN isfinite(velocity_error_sigma_kms) THEN CAST(round(velocity_error_sigma_kms * 1000) AS BIGINT) END AS sigma_milli FROM s3_runs WHERE realisation IS NOT NULL)) WHERE nth = 1)""".format(
    n=", ".join(f"CASE WHEN NOT isnan(mean_{c}) THEN mean_{c} END AS {c}" for c in ("completeness", "purity", "jaccard"))
)
METRICS = ["mean_completeness", "mean_purity", "mean_jaccard"]


def condition_means(spark, sf_dir):
    """Means by condition and noise level; rows without a condition are a group."""
    clean = {m: F.when(~F.isnan(m), F.col(m)) for m in METRICS}
    return runs(spark, sf_dir).groupBy("condition", "sigma_milli").agg(
        F.count("*").alias("n"), *(r(F.avg(clean[m])).alias(m) for m in METRICS), r(F.avg(F.col("strict_recoveries_of_8").cast("double"))).alias("mean_strict"),
        F.count_if("formal_overlap_resolved").alias("n_formal"), F.max("s3_orphans").alias("most_orphans"), F.bool_and("formal_overlap_resolved").alias("all_formal"),
    )


_CONDITION_SQL = f"""WITH {_RUNS} SELECT condition, sigma_milli, count(*) AS n, round(avg(completeness), 6) AS mean_completeness, round(avg(purity), 6) AS mean_purity, round(avg(jaccard), 6) AS mean_jaccard,
  round(avg(strict), 6) AS mean_strict, count(*) FILTER (formal) AS n_formal, max(s3_orphans) AS most_orphans, bool_and(formal) AS all_formal FROM q GROUP BY condition, sigma_milli"""


def headline(spark, sf_dir):
    """Mean Jaccard index and strict recoveries at noise levels close to 0.5 and 1 km/s."""
    near = F.least(F.abs(F.col("sigma_milli") / 1000 - 0.5), F.abs(F.col("sigma_milli") / 1000 - 1.0)) < 1e-8
    q = runs(spark, sf_dir).where(near)
    return q.groupBy("sigma_milli").agg(r(F.avg(F.when(~F.isnan("mean_jaccard"), F.col("mean_jaccard")))).alias("mean_jaccard"), r(F.avg(F.col("strict_recoveries_of_8").cast("double"))).alias("mean_strict"))


def _deltas(spark, sf_dir):
    return paired_deltas(runs(spark, sf_dir), "realisation", F.col("sigma_milli") == 0, [*METRICS, "strict_recoveries_of_8", "formal_overlap_resolved"])


def paired_delta_means(spark, sf_dir):
    d = _deltas(spark, sf_dir)
    return d.groupBy("sigma_milli").agg(F.count("delta_mean_jaccard").alias("n"), *(r(F.avg(f"delta_{m}")).alias(f"delta_{m}") for m in [*METRICS, "formal_overlap_resolved"]))


_DELTAS = f"""{_RUNS}, z AS (SELECT realisation, completeness AS c0, purity AS p0, jaccard AS j0, strict AS s0, CAST(formal AS INTEGER) AS f0 FROM q WHERE sigma_milli = 0),
  d AS (SELECT sigma_milli, completeness - c0 AS dc, purity - p0 AS dp, jaccard - j0 AS dj, strict - s0 AS ds, CAST(formal AS INTEGER) - f0 AS df FROM q LEFT JOIN z USING (realisation))"""


PAIRED = [*METRICS, "mean_fragment_count", "strict_recoveries_of_8", "formal_overlap_resolved", "overlap_best_groups_separate", "s3_accepted_splits", "s3_orphans"]


def paired_delta_metrics(spark, sf_dir):
    """Mean difference from the noiseless run of nine metrics at each noise level; true counts 1."""
    d = paired_deltas(runs(spark, sf_dir, more=("mean_fragment_count", "overlap_best_groups_separate")), "realisation", F.col("sigma_milli") == 0, PAIRED)
    return d.groupBy("sigma_milli").agg(F.count("*").alias("n"), *(f for m in PAIRED for f in (F.count(f"delta_{m}").alias(f"n_{m}"), r(F.avg(f"delta_{m}")).alias(f"delta_{m}"))))


_PAIRED_SQL = f"""WITH q AS (SELECT realisation, sigma_milli, {", ".join(f"CASE WHEN NOT isnan(CAST({m} AS DOUBLE)) THEN CAST({m} AS DOUBLE) END AS {m}" for m in PAIRED)}
  FROM (SELECT *, row_number() OVER (PARTITION BY realisation, sigma_milli ORDER BY loaded_at DESC) AS nth
    FROM (SELECT *, CASE WHEN isfinite(velocity_error_sigma_kms) THEN CAST(round(velocity_error_sigma_kms * 1000) AS BIGINT) END AS sigma_milli FROM s3_runs WHERE realisation IS NOT NULL)) WHERE nth = 1)
  SELECT q.sigma_milli, count(*) AS n, {", ".join(f"count(q.{m} - z.{m}) AS n_{m}, round(avg(q.{m} - z.{m}), 6) AS delta_{m}" for m in PAIRED)}
  FROM q LEFT JOIN (SELECT * FROM q WHERE sigma_milli = 0) z ON z.realisation = q.realisation GROUP BY q.sigma_milli"""


def better_or_worse(spark, sf_dir):
    d = _deltas(spark, sf_dir).where("sigma_milli > 0")
    return better_equal_worse(d, ["delta_mean_jaccard", "delta_mean_purity", "delta_strict_recoveries_of_8"])


_BETTER_SQL = "WITH " + _DELTAS + "\nUNION ALL\n".join(
    f" SELECT 'delta_{n}' AS metric, count(*) FILTER ({c} > 1e-12) AS better, count(*) FILTER (abs({c}) <= 1e-12) AS equal, count(*) FILTER ({c} < -1e-12) AS worse FROM d WHERE sigma_milli > 0 AND {c} IS NOT NULL"
    for n, c in (("mean_jaccard", "dj"), ("mean_purity", "dp"), ("strict_recoveries_of_8", "ds"))
)


def wilson_rates(spark, sf_dir):
    n = runs(spark, sf_dir).where("formal_overlap_resolved is not null").groupBy("sigma_milli").agg(F.count_if("formal_overlap_resolved").alias("resolved"), F.count("*").alias("n"))
    rate, low, high = wilson_interval(F.col("resolved"), F.col("n"))
    return n.select("sigma_milli", "resolved", "n", r(rate).alias("rate"), r(low).alias("low"), r(high).alias("high"))


_WILSON_SQL = f"""WITH {_RUNS}, n AS (SELECT sigma_milli, count(*) FILTER (formal) AS resolved, count(*) AS n FROM q WHERE formal IS NOT NULL GROUP BY sigma_milli), p AS (SELECT *, resolved / n AS p, {Z95!r}::DOUBLE AS z FROM n)
  SELECT sigma_milli, resolved, n, round(p, 6) AS rate, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM p"""


def archive_gaps(spark, sf_dir):
    gaps = max_abs_difference(runs(spark, sf_dir), runs(spark, sf_dir, "s3_runs_archive"), ["realisation", "sigma_milli"], METRICS)
    return gaps.select("metric", "all_close", r("max_abs_difference").alias("max_abs_difference"))


_ARCHIVE_SQL = f"""WITH {_RUNS}, {_RUNS.replace("q AS", "o AS").replace("FROM s3_runs ", "FROM s3_runs_archive ")}, j AS (SELECT q.completeness a1, o.completeness b1, q.purity a2, o.purity b2, q.jaccard a3, o.jaccard b3 FROM q JOIN o ON q.realisation = o.realisation AND q.sigma_milli IS NOT DISTINCT FROM o.sigma_milli)
""" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, bool_and(CASE WHEN a{i} IS NULL OR b{i} IS NULL THEN a{i} IS NULL AND b{i} IS NULL ELSE abs(a{i} - b{i}) <= 1e-12 END) AS all_close, round(max(abs(a{i} - b{i})), 6) AS max_abs_difference FROM j" for i, m in enumerate(METRICS, 1)
)


def purity_qvalues(spark, sf_dir):
    """Benjamini-Hochberg values of 1 - purity, per noise level."""
    q = runs(spark, sf_dir).withColumn("p", 1 - F.col("mean_purity"))
    out = bh_qvalues(q, ["sigma_milli"], "p", "realisation")
    return out.select("sigma_milli", "realisation", r("p").alias("p"), r("q_value").alias("q_value"))


_BH_SQL = f"""WITH {_RUNS}, p AS (SELECT sigma_milli, realisation, 1 - purity AS p FROM q WHERE isfinite(purity)),
  k AS (SELECT *, row_number() OVER (PARTITION BY sigma_milli ORDER BY p, realisation) AS rk, count(*) OVER (PARTITION BY sigma_milli) AS n FROM p)
  SELECT sigma_milli, realisation, round(p, 6) AS p, round(least(min(p * n / rk) OVER (PARTITION BY sigma_milli ORDER BY rk DESC), 1), 6) AS q_value FROM k"""


def bootstrap_deltas(spark, sf_dir):
    """Bootstrap intervals of the mean Jaccard change per noise level."""
    return bootstrap_mean(_deltas(spark, sf_dir).where("sigma_milli > 0"), ["sigma_milli"], "delta_mean_jaccard", "realisation")


def velocity_grid(spark, sf_dir):
    """Velocity separations that the runs were made for, from their JSON lists."""
    latest = table(spark, sf_dir, "run_metadata").where("realisation is not null").groupBy("realisation").agg(F.max(F.struct("registered_at", "velocity_deltas_kms")).alias("b"))
    each = latest.select("realisation", F.explode(F.from_json("b.velocity_deltas_kms", "array<double>")).alias("delta_v"))
    return each.groupBy("delta_v").agg(F.count("*").alias("n_runs"))


_GRID_SQL = """WITH m AS (SELECT realisation, velocity_deltas_kms AS d FROM (SELECT *, row_number() OVER (PARTITION BY realisation ORDER BY registered_at DESC NULLS LAST, velocity_deltas_kms DESC NULLS LAST) AS nth FROM run_metadata WHERE realisation IS NOT NULL) WHERE nth = 1)
  SELECT delta_v, count(*) AS n_runs FROM (SELECT unnest(from_json(d, '["DOUBLE"]')) AS delta_v FROM m) GROUP BY delta_v"""


def unscored_runs(spark, sf_dir):
    """Registered runs without scores: what a resumed experiment has still to do."""
    return unfinished(table(spark, sf_dir, "run_metadata").where("realisation is not null").select("realisation").distinct(), table(spark, sf_dir, "s3_runs").where("realisation is not null"))


def placed_stars(spark, sf_dir):
    """Template stars turned about z by their run's direction angle: mean position per label and run."""
    angle = table(spark, sf_dir, "run_metadata").where("realisation is not null").where(finite(F.col("velocity_direction_angle_rad"))).groupBy("realisation").agg(F.max("velocity_direction_angle_rad").alias("a"))
    s = stars(spark, sf_dir).where("label <> 'background'").where(finite(F.col("x_pc")) & finite(F.col("y_pc"))).join(angle, "realisation")
    x, y = F.cos("a") * F.col("x_pc") - F.sin("a") * F.col("y_pc"), F.sin("a") * F.col("x_pc") + F.cos("a") * F.col("y_pc")
    return s.groupBy("realisation", "label").agg(r(F.avg(x)).alias("x"), r(F.avg(y)).alias("y"))


_PLACED_SQL = f"""WITH {_S}, a AS (SELECT realisation, max(velocity_direction_angle_rad) AS a FROM run_metadata WHERE realisation IS NOT NULL AND isfinite(velocity_direction_angle_rad) GROUP BY realisation)
  SELECT realisation, label, round(avg(cos(a)*x_pc - sin(a)*y_pc), 6) AS x, round(avg(sin(a)*x_pc + cos(a)*y_pc), 6) AS y FROM s JOIN a USING (realisation) WHERE label <> 'background' AND isfinite(x_pc) AND isfinite(y_pc) GROUP BY ALL"""


# --- the staged analysis itself


def stage1_scales(spark, sf_dir):
    """Percolation limit, cut, groups and grouped stars of every realisation."""
    s = spatial_groups(table(spark, sf_dir, "stars"), "row_index", "realisation", AT, forest=False)
    groups = s.members.groupBy("g").agg(F.countDistinct("group_id").alias("n_groups"), F.count("*").alias("n_members"))
    return s.scales.join(groups, "g", "left").select(F.col("g").alias("realisation"), "n", r("limit").alias("limit"), r("cut").alias("cut"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_members", F.lit(0)).alias("n_members"))


def _staged(spark, sf_dir, gates):
    observables = tuple(o for gate in gates for o in gate.observables)
    seen = Scratch(spark, "staged-stars").keep(stars(spark, sf_dir).select("row_index", "realisation", *AT, *observables), "stars")
    s = spatial_groups(seen, "row_index", "realisation", AT, carry=observables, forest=False, distinct=True)
    return s, pipeline(seed_nodes(s.members), s.scales, gates)


def refined_s3_s2(spark, sf_dir):
    """Final groups after the velocity and then the reddening stage."""
    _, (_, last) = _staged(spark, sf_dir, [Gate(("vl_lsr_kms", "vb_lsr_kms")), Gate(("reddening_mag",))])
    return numbered_leaves(last).select(F.col("g").alias("realisation"), F.col("id").alias("row_index"), "group_id", "node")


def refined_s2_s3_passes(spark, sf_dir):
    """What each pass tested and split in the other order."""
    _, done = _staged(spark, sf_dir, [Gate(("reddening_mag",)), Gate(("vl_lsr_kms", "vb_lsr_kms"))])
    return done[0].passes.withColumn("stage", F.lit(2)).unionByName(done[1].passes.withColumn("stage", F.lit(3)))


def _both_orders(spark, sf_dir):
    reddening, velocities = Gate(("reddening_mag",)), Gate(("vl_lsr_kms", "vb_lsr_kms"))
    observables = (*reddening.observables, *velocities.observables)
    # the records are told apart once for all that follows
    seen = Scratch(spark, "orders-stars").keep(stars(spark, sf_dir).select("row_index", "realisation", *AT, *observables, "label"), "stars")
    found = spatial_groups(seen, "row_index", "realisation", AT, carry=observables, forest=False, distinct=True)
    truth = _placed(seen)
    return paired_orders(found, None, truth.select("g", "id"), truth, ("template_01", "template_02"), reddening, velocities)


def order_scores(spark, sf_dir):
    """Scores of every field's labels after both orders of the stages, paired one to one."""
    return _both_orders(spark, sf_dir).labels


def order_summary(spark, sf_dir):
    """Both orders over all fields in one row."""
    return order_aggregate(_both_orders(spark, sf_dir).fields)


def _analysis(spark, sf_dir):
    return analyse(table(spark, sf_dir, "stars"), "row_index", "realisation", AT, [Gate(("reddening_mag",)), Gate(("vl_lsr_kms", "vb_lsr_kms"))])


def final_groups(spark, sf_dir):
    """The groups after all stages, with their observables and boxes."""
    return _analysis(spark, sf_dir).groups


def analysis_counts(spark, sf_dir):
    """Star records of each realisation in the whole analysis, and whether grouped, orphaned, field and unplaced ones add up to them."""
    parts = ("n_field", "n_not_placed", "stage3_members", "stage2_orphans", "stage3_orphans")
    counts = _analysis(spark, sf_dir).fields
    return counts.select(F.col("g").alias("realisation"), "n_points", "n_not_placed", (sum((F.col(c) for c in parts), F.lit(0)) == F.col("n_points")).alias("adds_up"))


# SQL counts the records; that they add up is what the query must show
_ANALYSIS_SQL = f"""WITH {_S} SELECT realisation, count(*) AS n_points, count(*) FILTER (NOT coalesce(isfinite(x_pc) AND isfinite(y_pc) AND isfinite(z_pc), false)) AS n_not_placed, true AS adds_up
  FROM s WHERE realisation IS NOT NULL GROUP BY realisation"""


def level_means(spark, sf_dir):
    """Mean scores of each noise level and their differences from the first level in order."""
    q = runs(spark, sf_dir).where("sigma_milli is not null")
    value = {"completeness": "mean_completeness", "purity": "mean_purity", "jaccard": "mean_jaccard", "strict": "strict_recoveries_of_8", "resolution": "formal_overlap_resolved", "splits": "s3_accepted_splits", "orphans": "s3_orphans"}
    number = {n: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for n, c in value.items()}
    means = q.groupBy("sigma_milli").agg(F.count("*").alias("n"), *(F.avg(v).alias(n) for n, v in number.items()))
    first = means.agg(F.min_by(F.struct(*number), "sigma_milli").alias("first"))
    both = means.join(F.broadcast(first))  # one row
    return both.select("sigma_milli", "n", *(r(n).alias(n) for n in number), *(r(F.col(n) - F.col(f"first.{n}")).alias(f"delta_{n}") for n in number))


_LEVELS = ("completeness", "purity", "jaccard", "strict", "resolution", "splits", "orphans")
_LEVEL_SQL = f"""WITH {_RUNS}, m AS (SELECT sigma_milli, count(*) AS n, avg(completeness) AS completeness, avg(purity) AS purity, avg(jaccard) AS jaccard, avg(strict) AS strict, avg(CAST(formal AS INTEGER)) AS resolution, avg(splits) AS splits, avg(s3_orphans) AS orphans
    FROM q WHERE sigma_milli IS NOT NULL GROUP BY sigma_milli), b AS (SELECT * FROM m ORDER BY sigma_milli LIMIT 1)
  SELECT m.sigma_milli, m.n, {", ".join(f"round(m.{c}, 6) AS {c}, round(m.{c} - b.{c}, 6) AS delta_{c}" for c in _LEVELS)} FROM m, b"""


QUERIES = {
    f.__name__: f
    for f in (
        canonical_ids, kinematic_projection, frame_rotation, kinematics_match, field_stars, linked_stars, components_at_radius, best_match_scores, fragment_counts, fragment_means, overlap_resolution, realisation_summary, retention,
        group_boxes, coverage_gate, jenks_by_label, two_line_by_label, two_line_fits, break_bootstrap_by_label, scatter_by_label, mann_whitney_by_survey, bimodality_by_label, noise_sweep, condition_means, headline, paired_delta_means, paired_delta_metrics, better_or_worse, wilson_rates, archive_gaps,
        purity_qvalues, bootstrap_deltas, velocity_grid, unscored_runs, placed_stars, stage1_scales, refined_s3_s2, refined_s2_s3_passes, gate_reddening, order_scores, order_summary, final_groups, analysis_counts, level_means,
    )
}

SQL = {
    "canonical_ids": f"WITH {_S} SELECT row_index, {_CANONICAL} AS canonical_id FROM s",
    "kinematic_projection": _PROJECTION_SQL,
    "frame_rotation": _ROTATION_SQL,
    "kinematics_match": _KINEMATICS_SQL,
    "field_stars": f"WITH {_S} SELECT realisation, count(*) AS n_field FROM s WHERE label IS NULL OR label NOT IN (SELECT template_label FROM templates) GROUP BY realisation",
    "linked_stars": _LINKED_SQL,
    "components_at_radius": f"{_GROUPS} SELECT g AS realisation, id AS row_index, group_id, group_rows FROM m",
    "best_match_scores": f"{_SCORES} SELECT g, label, true_size, best_group, overlap, best_size, round(completeness, 9) AS completeness, round(purity, 9) AS purity, round(jaccard, 9) AS jaccard, detected, strict FROM fl",
    "fragment_counts": _FRAGMENTS_SQL,
    "fragment_means": f"SELECT g, count(*) AS n_labels, round(avg(fragment_count), 6) AS mean_fragment_count, round(avg(n_merged), 6) AS mean_n_merged FROM ({_FRAGMENTS_SQL}) GROUP BY g",
    "overlap_resolution": _RESOLUTION_SQL,
    "realisation_summary": f"{_SCORES} SELECT g, count(*) AS n_labels, round(avg(completeness), 6) AS mean_completeness, round(avg(purity), 6) AS mean_purity, round(avg(jaccard), 6) AS mean_jaccard, count(*) FILTER (strict) AS strict_recoveries FROM fl GROUP BY g",
    "retention": _RETENTION_SQL,
    "group_boxes": _BOXES_SQL,
    "coverage_gate": _COVERAGE_SQL,
    "jenks_by_label": _JENKS_SQL,
    "two_line_by_label": _TWO_LINE_SQL,
    "two_line_fits": _FITS_SQL,
    "scatter_by_label": _SCATTER_SQL,
    "mann_whitney_by_survey": _MANN_SQL,
    "noise_sweep": _noise_sql(),
    "condition_means": _CONDITION_SQL,
    "headline": f"WITH {_RUNS} SELECT sigma_milli, round(avg(jaccard), 6) AS mean_jaccard, round(avg(strict), 6) AS mean_strict FROM q WHERE sigma_milli IN (500, 1000) GROUP BY sigma_milli",
    "paired_delta_means": f"WITH {_DELTAS} SELECT sigma_milli, count(dj) AS n, round(avg(dc), 6) AS delta_mean_completeness, round(avg(dp), 6) AS delta_mean_purity, round(avg(dj), 6) AS delta_mean_jaccard, round(avg(df), 6) AS delta_formal_overlap_resolved FROM d GROUP BY sigma_milli",
    "paired_delta_metrics": _PAIRED_SQL,
    "better_or_worse": _BETTER_SQL,
    "wilson_rates": _WILSON_SQL,
    "archive_gaps": _ARCHIVE_SQL,
    "purity_qvalues": _BH_SQL,
    "velocity_grid": _GRID_SQL,
    "unscored_runs": "SELECT DISTINCT realisation FROM run_metadata WHERE realisation IS NOT NULL AND realisation NOT IN (SELECT realisation FROM s3_runs WHERE realisation IS NOT NULL)",
    "placed_stars": _PLACED_SQL,
    "gate_reddening": _GATE_SQL,
    "analysis_counts": _ANALYSIS_SQL,
    "level_means": _LEVEL_SQL,
}
