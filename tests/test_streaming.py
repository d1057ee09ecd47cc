"""Keyed running totals over arrivals, restarts and lost batches."""

import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbflow.plans import fixture
from curbflow.session import fresh_path
from curbflow.streaming import incremental

SCHEMA = "pickup_datetime timestamp_ntz, DOLocationID int, VendorID int, total_amount double"


def arrival(spark, path, start, n):
    """One more file of ``n`` trips."""
    spark.range(start, start + n).selectExpr(
        "CAST(timestamp_seconds(1704067200 + id * 3571) AS TIMESTAMP_NTZ) AS pickup_datetime",
        "CAST(if(id % 11 = 0, NULL, id % 3) AS INT) AS DOLocationID", "CAST(if(id % 7 = 0, NULL, 1) AS INT) AS VendorID",
        "if(id % 5 = 0, NULL, CAST(id AS DOUBLE)) AS total_amount",
    ).coalesce(1).write.mode("append").parquet(path)


def settled(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def as_batch(spark, path):
    return settled(incremental.amounts_by_zone_hour(spark.read.schema(SCHEMA).parquet(path)))


def test_totals_go_on_after_a_stop_and_are_folded(spark):
    landing, out, seen = (fresh_path(spark, f"test-{k}") for k in range(3))
    start = 0
    for files in (3, 1, 4):
        for _ in range(files):
            arrival(spark, landing, start, 50)
            start += 50
        stream = incremental.stream_trips(spark, landing, SCHEMA)
        totals = incremental.run_keyed(
            stream, incremental.amounts_by_zone_hour, ["DOLocationID", "hour"], out, seen, fold_every=2
        )
        assert settled(totals) == as_batch(spark, landing)
    held = incremental.KeyedTotals(spark, out, ["DOLocationID", "hour"], totals.schema, 2)
    assert len(held._listed("folded")) == 1 and len(held._listed("sums")) <= 3


@pytest.mark.parametrize("broken", [1, 3, 5])
def test_a_batch_that_was_lost_half_way_counts_once(spark, broken):
    """The driver dies after writing the sums of a batch, before the stream notes it as finished."""
    landing, out, seen = (fresh_path(spark, f"test-{k}") for k in range(3))
    for k in range(6):
        arrival(spark, landing, 100 * k, 100)

    class Died(Exception):
        pass

    class Mortal(incremental.KeyedTotals):
        def merge(self, batch, number):
            super().merge(batch, number)
            if number == broken:
                raise Died

    keys = ["DOLocationID", "hour"]

    def stream():
        return incremental.stream_trips(spark, landing, SCHEMA)

    held = Mortal(spark, out, keys, incremental.amounts_by_zone_hour(stream()).schema, 2)
    query = (
        stream().writeStream.trigger(availableNow=True).option("checkpointLocation", seen)
        .foreachBatch(lambda batch, n: held.merge(incremental.amounts_by_zone_hour(batch), n)).start()
    )
    with pytest.raises(Exception):
        query.awaitTermination()
    totals = incremental.run_keyed(stream(), incremental.amounts_by_zone_hour, keys, out, seen, fold_every=2)
    assert settled(totals) == as_batch(spark, landing)


def test_nothing_has_arrived(spark):
    landing, out, seen = (fresh_path(spark, f"test-{k}") for k in range(3))
    spark.createDataFrame([], SCHEMA).write.parquet(landing)
    totals = incremental.run_keyed(
        incremental.stream_trips(spark, landing, SCHEMA), incremental.amounts_by_zone_hour,
        ["DOLocationID", "hour"], out, seen,
    )
    assert totals.count() == 0


@F.udf(T.IntegerType())
def task_of(_):
    return TaskContext.get().partitionId()


@pytest.mark.parametrize("totals", [incremental.daily_totals, incremental.weekday_hour_totals, incremental.hourly_totals])
def test_running_totals_are_kept_by_many_tasks_and_published_as_one_file(spark, totals):
    landing, out = (fresh_path(spark, f"test-{k}") for k in range(2))
    for k in range(3):
        arrival(spark, landing, 200 * k, 200)
    published = incremental.run_incremental(
        incremental.stream_trips(spark, landing, SCHEMA),
        lambda trips: totals(trips).withColumn("task", task_of(F.lit(0))), out,
    )
    assert settled(published.drop("task")) == settled(totals(spark.read.schema(SCHEMA).parquet(landing)))
    assert published.select("task").distinct().count() > 1
    for batch in range(3):
        assert len([f for f in os.listdir(f"{out}/batch={batch}") if f.startswith("part-")]) == 1


def test_stored_trips_are_dealt_to_their_folders_without_a_sort(spark):
    spark.sql(
        f"CREATE TABLE kinds_dealt (id BIGINT, kind INT) USING parquet PARTITIONED BY (kind) LOCATION '{fresh_path(spark, 'test')}'"
    )

    def plan():
        return spark.sql("EXPLAIN INSERT INTO kinds_dealt SELECT id, CAST(id % 6 AS INT) FROM range(100)").first()[0]

    plans = []

    def derive():
        plans.append(plan())
        return spark.range(100).selectExpr("id", "CAST(id % 6 AS INT) AS kind")

    try:
        stored = fixture._stored_once(spark, fresh_path(spark, "test"), "kinds", derive, "kind")
        # Six kinds, more than the files kept open at a time.
        assert settled(stored) == [(k, k % 6) for k in range(100)]
        assert "Sort" not in plans[0] and "Sort" in plan()
    finally:
        spark.sql("DROP TABLE kinds_dealt")
