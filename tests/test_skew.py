from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from lexforge.operators.skew import join_stats


def test_hot_and_cold_keys(spark):
    data = [(i, "hot" if i % 3 else f"k{i % 40}") for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(data, "id bigint, key string")
    stats = df.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    want = rows(df.join(stats, "key").select("id", "key", "n", "low"))
    for slices in (1, 2, 5, 1000):
        assert rows(join_stats(df, stats, "key", "n", "id", slices, 0)) == want
    assert rows(join_stats(df, stats, "key", "n", "id")) == want
    assert join_stats(df.limit(0), stats.limit(0), "key", "n", "id").count() == 0
