from pyspark.sql import functions as F

from skein.scratch import SMALL_FILE_BYTES, Scratch, table_bytes


def test_written_tables_are_not_broadcast_for_small_files(spark):
    scratch = Scratch(spark, "t")
    # a threshold well above the file bytes, which hold far more rows than it means
    ids = scratch.keep(spark.range(200_000).select("id", (F.col("id") % 3).alias("parent")), "ids")
    assert SMALL_FILE_BYTES < table_bytes(ids) < 10 << 20
    plan = lambda a, b: a.join(b, "id")._jdf.queryExecution().executedPlan().toString()
    other = scratch.keep(spark.range(300_000), "other")
    assert "Broadcast" not in plan(other, ids) and "SortMergeJoin" in plan(other, ids)
    # what is small in truth still is
    few = scratch.keep(spark.range(10), "few")
    assert "Broadcast" in plan(spark.range(300_000).withColumn("x", F.rand()), few)
    assert other.join(ids, "id").count() == 200_000
