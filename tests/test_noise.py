import pytest
from pyspark.sql import functions as F

from skein.plans.noise import normal_draw, with_levels
from skein.streaming.arrivals import append_available, new_records


def test_noise_levels_share_their_draw(spark):
    points = spark.range(4000).select(F.col("id").alias("member"), F.lit(1.0).alias("av"))
    noisy = with_levels(points, "av", [0.0, 0.5, 1.0], normal_draw("member"))
    spread = {r.sigma: r.s for r in noisy.groupBy("sigma").agg(F.stddev("av").alias("s")).collect()}
    assert spread[0.0] == 0 and spread[0.5] == pytest.approx(0.5, abs=0.03) and spread[1.0] == pytest.approx(2 * spread[0.5])


def test_arrivals_once(spark, tmp_path):
    schema = "i long, at timestamp"
    for n, rows in enumerate(([(1, "2024-01-01"), (2, "2024-01-01"), (1, "2024-01-02")], [(2, "2024-01-03"), (3, "2024-01-03"), (None, "2024-01-03")])):
        spark.createDataFrame(rows, "i long, t string").select("i", F.to_timestamp("t").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        append_available(new_records(spark, str(tmp_path / "in"), schema, "i", "at"), "at", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [[1, 2], [1, 2, 3]][n]
