"""Running totals over arriving trip files.

Totals without a key of their own are kept as streaming state, bounded by hours, dates or
weekday-hour cells; every batch publishes the whole result under its number. Totals by
zone are kept as tables: every batch leaves its own sums, and from time to time the sums
so far are folded into one table. Either way a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.demand import weekday_dim
from ..session import fresh_path


def stream_trips(
    spark: SparkSession, path: str, schema, files_per_batch: int = 1, pattern: str = "*.parquet"
) -> DataFrame:
    """Trip files below ``path`` as a stream."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(path)
    )


def hourly_totals(trips: DataFrame, counted: str = "VendorID", amount: str = "total_amount") -> DataFrame:
    """Trips, known amounts and their sum per hour of the day."""
    return (
        trips.where(F.col("pickup_datetime").isNotNull())
        .groupBy(F.hour("pickup_datetime").alias("hour"))
        .agg(
            F.count(counted).alias("trips"), F.sum(amount).alias("amount_sum"),
            F.count(amount).alias("amount_n"),
        )
    )


def daily_totals(trips: DataFrame, counted: str = "VendorID") -> DataFrame:
    return (
        trips.where(F.col("pickup_datetime").isNotNull())
        .groupBy(F.to_date("pickup_datetime").alias("date")).agg(F.count(counted).alias("trips"))
    )


def weekday_hour_totals(trips: DataFrame, counted: str = "VendorID") -> DataFrame:
    """Long form of the weekday by hour grid (weekday 0 is Monday)."""
    return (
        trips.where(F.col("pickup_datetime").isNotNull())
        .groupBy(
            F.weekday(F.to_date("pickup_datetime")).alias("weekday_no"),
            F.hour("pickup_datetime").alias("hour"),
        )
        .agg(F.count(counted).alias("trips"))
    )


def amounts_by_zone_hour(trips: DataFrame, amount: str = "total_amount") -> DataFrame:
    """Known amounts and their sum per drop-off zone and hour of the day."""
    return (
        trips.where(F.col("pickup_datetime").isNotNull() & F.col("DOLocationID").isNotNull())
        .groupBy("DOLocationID", F.hour("pickup_datetime").alias("hour"))
        .agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount_sum"), F.count(amount).alias("amount_n"))
    )


def trips_by_zone_weekday_hour(trips: DataFrame, counted: str = "VendorID") -> DataFrame:
    """Trips per drop-off zone, weekday (Monday 0) and hour."""
    return (
        trips.where(F.col("pickup_datetime").isNotNull() & F.col("DOLocationID").isNotNull())
        .groupBy(
            "DOLocationID", F.weekday(F.to_date("pickup_datetime")).alias("weekday_no"),
            F.hour("pickup_datetime").alias("hour"),
        )
        .agg(F.count(counted).alias("trips"))
    )


class KeyedTotals:
    """Sums per key over all batches so far, in a folder that outlives the stream.

    ``batch=<n>`` below ``sums`` holds the sums of one batch, ``upto=<n>`` below ``folded``
    those of all batches up to one. A folded table counts once it is complete; what it
    replaces is removed when the next one is. Readers take the newest complete
    folded table and the batches after it, so they see every finished batch exactly once,
    whatever was lost half-way.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, fold_every: int = 16):
        self.spark, self.path, self.keys, self.schema, self.fold_every = spark, path, keys, schema, fold_every

    def _listed(self, kind: str) -> list[int]:
        """Numbers of the complete tables of one kind."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(place):
            return []
        done = []
        for status in system.listStatus(place):
            if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(int(status.getPath().getName().split("=")[1]))
        return sorted(done)

    def _remove(self, kind: str, number: int) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._table(kind, number))
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _table(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/{'batch' if kind == 'sums' else 'upto'}={number}"

    def merge(self, batch: DataFrame, number: int) -> None:
        """Keep the sums of a batch. The stream numbers batches and repeats one that was lost."""
        folded = self._listed("folded")
        if number - (folded[-1] if folded else -1) > self.fold_every:
            # All batches before this one are finished: the stream has moved on.
            self.totals(number - 1).write.mode("overwrite").parquet(self._table("folded", number - 1))
            for old in folded:
                self._remove("folded", old)
            for old in self._listed("sums"):
                if old < number:
                    self._remove("sums", old)
        batch.write.mode("overwrite").parquet(self._table("sums", number))

    def totals(self, upto: int | None = None) -> DataFrame:
        """Sums per key over all finished batches, or over those up to a number."""
        folded = [n for n in self._listed("folded") if upto is None or n <= upto]
        base = folded[-1] if folded else -1
        later = [n for n in self._listed("sums") if n > base and (upto is None or n <= upto)]
        paths = [self._table("folded", base)] * bool(folded) + [self._table("sums", n) for n in later]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        values = [f.name for f in self.schema.fields if f.name not in self.keys]
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.groupBy(*self.keys).agg(*[F.sum(v).alias(v) for v in values])


def run_keyed(
    stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], keys: list[str], out: str, checkpoint: str,
    fold_every: int = 16,
) -> DataFrame:
    """Process all files that have arrived since the last run and return the totals per key.

    ``aggregate`` makes additive columns. ``out`` and ``checkpoint`` carry the totals and the
    list of files read from one run to the next.
    """
    held = KeyedTotals(stream.sparkSession, out, keys, aggregate(stream).schema, fold_every)
    query = (
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: held.merge(aggregate(batch), number)).start()
    )
    query.awaitTermination()
    return held.totals()


def fares_at_zone(totals: DataFrame, zone: int) -> DataFrame:
    """Average known amount per hour at one drop-off zone; 0 where no amount is known."""
    mean = F.col("amount_sum") / F.nullif(F.col("amount_n"), F.lit(0))
    return totals.where(F.col("DOLocationID") == zone).select("hour", F.coalesce(mean, F.lit(0.0)).alias("avg_fare"))


def grid_at_zone(totals: DataFrame, zone: int) -> DataFrame:
    """Seven weekdays by 24 hours of the trips to one zone, 0 where there is none."""
    names = [f"h{h:02d}" for h in range(24)]
    cells = totals.where(F.col("DOLocationID") == zone).groupBy("weekday_no").agg(
        *[F.sum(F.when(F.col("hour") == h, F.col("trips"))).alias(name) for h, name in enumerate(names)]
    )
    return weekday_dim(totals.sparkSession).join(cells, "weekday_no", "left").select(
        "weekday_no", "weekday", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def run_incremental(
    stream: DataFrame, aggregate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str | None = None
) -> DataFrame:
    """Process all files that have arrived since the last run and return the running totals.

    Keep ``out`` and ``checkpoint`` between runs to continue where the last one ended.
    """
    spark = stream.sparkSession
    totals = aggregate(stream)

    def publish(batch: DataFrame, number: int) -> None:
        # At most a few hundred group rows: one file. They are gathered by a shuffle; a
        # coalesce would pull every partition of the state into the one task that writes.
        batch.repartition(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        totals.writeStream.outputMode("complete").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "stream-state"))
        .foreachBatch(publish).start()
    )
    query.awaitTermination()
    return latest(spark, out, totals.schema)


def latest(spark: SparkSession, out: str, schema) -> DataFrame:
    """The totals of the newest published batch; empty before the first."""
    try:
        published = spark.read.parquet(out)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], schema)
        raise
    newest = published.agg(F.max("batch")).scalar()
    return published.where(F.col("batch") == newest).drop("batch")


def with_average(hourly: DataFrame) -> DataFrame:
    """Average amount per hour from running sums; 0 where no amount is known."""
    mean = F.col("amount_sum") / F.nullif(F.col("amount_n"), F.lit(0))
    return hourly.withColumn("avg_amount", F.coalesce(mean, F.lit(0.0)))
