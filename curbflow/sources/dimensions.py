"""Small reference tables: zones, zone outlines and event schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE_SCHEMA = "LocationID int, Borough string, Zone string, service_zone string"
VERTEX_SCHEMA = "LocationID int, part int, ring int, seq int, x double, y double"
SCHEDULE_SCHEMA = "Date string, `Start Time (EDT)` string, Visitor string"


def read_zone_dim(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup CSV. The text N/A is data here, so no null value is set."""
    return spark.read.schema(ZONE_SCHEMA).csv(path, header=True, quote='"')


def read_zone_vertices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Zone outlines as one row per vertex, in plane feet."""
    reader = spark.read.schema(VERTEX_SCHEMA).format(fmt)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path)


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Event schedule CSV with its start parsed to a local timestamp."""
    return parse_schedule(
        spark.read.schema(SCHEDULE_SCHEMA).csv(path, header=True)
        .withColumnRenamed("Start Time (EDT)", "start_time")
    )


def parse_schedule(schedule: DataFrame) -> DataFrame:
    """Add ``game_datetime`` from the texts ``Date`` and ``start_time``."""
    text = F.concat_ws(" ", "Date", "start_time")
    return schedule.withColumn(
        "game_datetime", F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd h:mm a"))
    )
