"""A catalogue that grows by files: each new record once, day by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_records(spark: SparkSession, folder: str, schema: str, ident: str, arrived: str, late: str = "7 days") -> DataFrame:
    """The records of files in ``folder`` as a stream, each ``ident`` once within ``late`` of its first arrival."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.where(F.col(ident).isNotNull()).withWatermark(arrived, late).dropDuplicatesWithinWatermark([ident])


def append_available(records: DataFrame, arrived: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to ``target`` by arrival day; a later call goes on where this one ended."""
    day = records.withColumn("day", F.to_date(arrived))
    return day.writeStream.partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
