"""Tables written to the shared folder, to cut lineage between rounds.

A written table survives the loss of executors, is read back with file
statistics, and costs one job.  The folder is the session's
``spark.checkpoint.dir``; only a local session without that setting gets a
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A written table of more file bytes is never broadcast unless a plan asks for it: files of ids are packed many times smaller
#: than the driver's hash table of them, so the session's threshold, held against file bytes, would let it grow without bound.
SMALL_FILE_BYTES = 64 << 10


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set here only in local mode when it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
    if hadoop.isDefined():
        return hadoop.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Written tables of one job; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return the written table."""
        self.count += 1
        path = f"{self.base}/{self.count:04d}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        if table_bytes(kept) > SMALL_FILE_BYTES:
            kept = kept.hint("merge")
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def busy_parts(spark: SparkSession) -> int:
    """Partitions for rows that are few but dear: by a stated number, so they aren't merged by their size into tasks that leave cores idle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def table_bytes(table: DataFrame) -> int:
    """Size by the optimizer's statistics; file sizes for a written table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

