"""Values for rows of a hot key."""

import pytest
from pyspark.sql import functions as F

from banfleet.operators.lookup import with_values


@pytest.fixture
def large_values(spark):
    """Joins as they are planned where the values are too large to be sent around."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_with_a_hot_host(spark, n=30_000):
    host = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 400).cast("string")))
    return spark.range(n).select(host.alias("hostname"), F.col("id").alias("seq"))


def test_no_task_gets_the_hot_host(spark, rows, large_values):
    df = rows_with_a_hot_host(spark)
    values = df.select("hostname").distinct().withColumn("v", F.length("hostname"))
    joined = with_values(df, values, ["hostname"], "seq")
    per_task = sorted(r[0] for r in rows(joined.groupBy(F.spark_partition_id().alias("p")).count(), "count"))
    assert len(per_task) == 12 and per_task[-1] <= 2 * per_task[6]
    plain = df.join(values, "hostname")
    assert rows(joined.groupBy("v").count()) == rows(plain.groupBy("v").count())
    assert joined.columns == ["hostname", "seq", "v"] and joined.count() == 30_000


def test_left_and_small(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "hostname string, seq long")
    values = spark.createDataFrame([("a", 7)], "hostname string, v long")
    assert rows(with_values(df, values, ["hostname"], "seq", how="left"), "seq", "v") == [(1, 7), (2, 7), (3, None), (4, None)]
    small = with_values(df, values, ["hostname"], "seq")
    small.collect()
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
