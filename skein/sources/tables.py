"""Catalogues and run archives in, result sets out."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import astro
from skein.functions.ids import canonical_id, safe_double
from skein.operators.near import finite

# Column names that catalogues use, the first that exists wins.
SYNONYMS = {
    "source_id": ("source_id", "gaia_source_id", "id"),
    "x_pc": ("x_pc", "x"),
    "y_pc": ("y_pc", "y"),
    "z_pc": ("z_pc", "z"),
    "reddening_mag": ("reddening_mag", "a_v", "av", "reddening"),
    "distance_pc": ("distance_pc", "distance", "d_pc"),
    "l_deg": ("l_deg", "gal_l_deg", "l", "glon"),
    "b_deg": ("b_deg", "gal_b_deg", "b", "glat"),
    "ra_deg": ("ra_deg", "ra", "ra_icrs"),
    "dec_deg": ("dec_deg", "dec", "de_icrs"),
    "pmra_masyr": ("pmra_masyr", "pmra", "pm_ra"),
    "pmdec_masyr": ("pmdec_masyr", "pmdec", "pm_dec"),
    "vl_lsr_kms": ("v_l_lsr_kms", "vl_lsr_kms", "v_l_lsr", "vl_lsr"),
    "vb_lsr_kms": ("v_b_lsr_kms", "vb_lsr_kms", "v_b_lsr", "vb_lsr"),
}


def find_column(df: DataFrame, name: str, required: bool = True) -> str | None:
    """The column that stands for ``name``, whatever its case and the spaces around it."""
    there = {c.strip().casefold(): c for c in df.columns}
    for candidate in SYNONYMS.get(name, (name,)):
        if candidate.casefold() in there:
            return there[candidate.casefold()]
    if required:
        raise ValueError(f"no column for {name} among {', '.join(df.columns)}")
    return None


def column(df: DataFrame, name: str) -> Column:
    return df[f"`{find_column(df, name)}`"]


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, every column as text, so that ids keep all digits."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and a stated schema (DDL), columns by name, whatever their order and number in the file; cells that don't fit are null."""
    text, wanted = read_catalogue(spark, path), T.StructType.fromDDL(schema)
    return text.select(*(F.trim(text[f"`{find_column(text, f.name)}`"]).try_cast(f.dataType).alias(f.name) for f in wanted))


def load_points(raw: DataFrame, row_index: str | None = None) -> DataFrame:
    """``row_index``, ``source_id``, ``x_pc``, ``y_pc``, ``z_pc``, ``reddening_mag`` and what else is there.

    Text becomes numbers where it can.  Without a ``row_index`` column the
    canonical id, which must then be unique, gives one.  Raises with the first
    ten rows whose coordinates aren't finite.
    """
    out = raw.select(
        *([F.col(row_index).cast("long").alias("row_index")] if row_index else [F.xxhash64(canonical_id(column(raw, "source_id"))).alias("row_index")]),
        canonical_id(column(raw, "source_id")).alias("source_id"),
        *(safe_double(column(raw, c)).alias(c) for c in ("x_pc", "y_pc", "z_pc", "reddening_mag")),
        *(safe_double(column(raw, c)).alias(c) for c in ("distance_pc", "vl_lsr_kms", "vb_lsr_kms") if find_column(raw, c, False)),
    )
    bad = out.where(~(finite(F.col("x_pc")) & finite(F.col("y_pc")) & finite(F.col("z_pc")))).select("row_index").limit(10).collect()
    if bad:
        raise ValueError(f"coordinates aren't finite in rows {[r.row_index for r in bad]}")
    return out


def join_kinematics(base: DataFrame, kinematics: DataFrame, columns: list[str], *, check: bool = True) -> DataFrame:
    """``base`` with ``columns`` of ``kinematics`` by canonical id, and ``matched``.

    Blank or repeated ids in ``kinematics`` are errors (not checked with
    ``check=False``, when blank ids match nothing).  Every base row stays.
    """
    keyed = kinematics.select(canonical_id(column(kinematics, "source_id")).alias("__id"), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__matched"))
    if check:
        wrong = keyed.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1 or __id = ''").limit(10).collect()
        if wrong:
            raise ValueError(f"blank or repeated ids: {[r['__id'] for r in wrong]}")
    joined = base.join(keyed.where("__id <> ''"), canonical_id(column(base, "source_id")) == F.col("__id"), "left")
    kept = [c for c in base.columns if c not in columns]
    return joined.select(*(base[c] for c in kept), *(F.col(f"__{c}").alias(c) for c in columns), F.coalesce("__matched", F.lit(False)).alias("matched"))


def kinematics(raw: DataFrame, base: DataFrame | None = None, frame: str = "lsr") -> DataFrame:
    """``source_id``, ``vl_lsr_kms``, ``vb_lsr_kms`` from whatever the table holds.

    Velocity columns are taken as they are (``lsr``) or freed of the solar
    motion (``heliocentric``, which needs galactic coordinates).  Without them
    they come from ICRS positions, proper motions and the distances in
    ``base``; rows that aren't finite or have no positive distance get null.
    Only one velocity column, or another ``frame``, is an error.
    """
    if frame not in ("lsr", "heliocentric"):
        raise ValueError(f"no frame {frame}")
    vl, vb = (find_column(raw, c, False) for c in ("vl_lsr_kms", "vb_lsr_kms"))
    if (vl is None) != (vb is None):
        raise ValueError(f"only one velocity column: {vl or vb}")
    ident = canonical_id(column(raw, "source_id")).alias("source_id")
    if vl:
        v = [safe_double(F.col(c)) for c in (vl, vb)]
        if frame == "heliocentric":
            solar = astro.solar_projection(safe_double(column(raw, "l_deg")), safe_double(column(raw, "b_deg")))
            v = [a + b for a, b in zip(v, solar)]
        return raw.select(ident, v[0].alias("vl_lsr_kms"), v[1].alias("vb_lsr_kms"))
    if base is None:
        raise ValueError("proper motions need the distances of the base catalogue")
    sky = raw.select(ident, *(safe_double(column(raw, c)).alias(c) for c in ("ra_deg", "dec_deg", "pmra_masyr", "pmdec_masyr")))
    far = base.select(canonical_id(column(base, "source_id")).alias("source_id"), safe_double(column(base, "distance_pc")).alias("d"))
    both = sky.join(far, "source_id")
    l, b = astro.icrs_to_galactic(F.col("ra_deg"), F.col("dec_deg"))
    pm = astro.proper_motion_to_galactic(F.col("ra_deg"), F.col("dec_deg"), F.col("pmra_masyr"), F.col("pmdec_masyr"))
    moved = both.select("source_id", "d", l.alias("l"), b.alias("b"), *(p.alias(n) for p, n in zip(pm, ("pl", "pb"))))
    solar = astro.solar_projection(F.col("l"), F.col("b"))
    return moved.select("source_id", *((astro.proper_motion_velocity(F.col(p), F.col("d")) + s).alias(n) for p, s, n in zip(("pl", "pb"), solar, ("vl_lsr_kms", "vb_lsr_kms"))))


# ---------------------------------------------------------------- run archives

RUN = r"(?i)mc_(\d+)"
UNNUMBERED = 10**9
#: Rows of a run's CSV handed on together.
PIECE_LINES = 10_000


def run_number(path: Column) -> Column:
    """The number in ``mc_<number>`` of a path; 10^9 where there is none."""
    found = F.regexp_extract(path, RUN, 1)
    return F.when(found == "", F.lit(UNNUMBERED)).otherwise(found.try_cast("long"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def run_files(spark: SparkSession, root: str, name: str, start: int = 0, end: int = UNNUMBERED, beside: tuple[str, ...] = ()) -> DataFrame:
    """``realisation``, ``path``, ``content`` of the file ``name`` in each run folder, else in each run zip.

    A run must hold exactly one file of that name.  Folders win over zips.
    Only runs with ``start`` <= number < ``end`` are read.  A folder counts only
    if it holds the files ``beside`` too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    folders = reader.option("pathGlobFilter", name).load(root).select(run_number(F.col("path")).alias("realisation"), "path", "content").where("path rlike '(?i)/mc_[^/]*/'")
    for other in beside:
        # only the listing is read, not the contents
        there = reader.option("pathGlobFilter", other).load(root).select(_folder(F.col("path")).alias("__at"))
        folders = folders.withColumn("__at", _folder(F.col("path"))).join(there, "__at", "left_semi").drop("__at")
    if not folders.take(1):
        zips = reader.option("pathGlobFilter", "mc_*.zip").load(root).select(run_number(F.col("path")).alias("realisation"), "path", "content")

        def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for r in batch.itertuples():
                    with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                        names = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == name]
                        if len(names) != 1:
                            raise ValueError(f"{r.path} holds {len(names)} files {name}")
                        rows.append((r.realisation, f"{r.path}!{names[0]}", z.read(names[0])))
                yield pd.DataFrame(rows, columns=["realisation", "path", "content"])

        folders = zips.where(f"realisation >= {start} and realisation < {end}").mapInPandas(unzip, "realisation long, path string, content binary")
    wanted = folders.where(f"realisation >= {start} and realisation < {end}")
    twice = wanted.groupBy("realisation").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"run {twice[0].realisation} holds several files {name}")
    return wanted


def read_run_json(spark: SparkSession, root: str, name: str, schema: str, **window) -> DataFrame:
    return run_files(spark, root, name, **window).select("realisation", F.from_json(F.col("content").cast("string"), schema).alias("r")).select("realisation", *(f"r.{f}" for f in T.StructType.fromDDL(schema).names if f != "realisation"))


def read_run_csv(spark: SparkSession, root: str, name: str, **window) -> DataFrame:
    """Rows of each run's CSV as ``realisation``, ``line`` (0, 1 ...) and ``cells``, a map from column to text.

    Cells that a short row lacks are empty, those beyond the header are left
    out.  A file is handed on in pieces, never as one table.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                lines = enumerate(csv.DictReader(io.TextIOWrapper(io.BytesIO(r.content), encoding="utf-8-sig", newline=""), restval=""))
                while piece := list(islice(lines, PIECE_LINES)):
                    yield pd.DataFrame({"realisation": r.realisation, "line": [n for n, _ in piece], "cells": [{k: v for k, v in row.items() if k is not None} for _, row in piece]})

    return run_files(spark, root, name, **window).mapInPandas(parse, "realisation long, line int, cells map<string,string>")


def matrix_column(text: Column) -> Column:
    """A 3×3 matrix from its JSON text, null where it is none."""
    return F.from_json(text, "array<array<double>>")


# ---------------------------------------------------------------- sinks


def write_result(df: DataFrame, path: str, *, form: str = "parquet", partition_by: tuple[str, ...] = (), gzip: bool = False, mode: str = "overwrite") -> None:
    """One frame of a result set; CSV has a header and may be gzipped."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if form == "csv":
        writer = writer.option("header", True).option("compression", "gzip" if gzip else "none")
    getattr(writer, form)(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file (configuration, summary, report) through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_config(spark: SparkSession, path: str, config: dict) -> None:
    write_text(spark, path, json.dumps(config | {"spark": spark.version, "pandas": pd.__version__}, indent=2, sort_keys=True) + "\n")


def summary_text(summary: dict, title: str = "Summary") -> str:
    return "\n".join([title, *(f"{re.sub('_', ' ', k)}: {v:.6g}" if isinstance(v, float) else f"{re.sub('_', ' ', k)}: {v}" for k, v in summary.items())]) + "\n"


def markdown_report(title: str, rows: list[dict]) -> str:
    """Headline lines as a table."""
    if not rows:
        return f"# {title}\n\nNothing to report.\n"
    names = list(rows[0])
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)]) + "\n"


def unfinished(requested: DataFrame, done: DataFrame, key: str = "realisation") -> DataFrame:
    """Runs that have no result yet."""
    return requested.join(done.select(key).distinct(), key, "left_anti")
