"""Zone totals, their distribution, and the zone graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .routes import od_trip_count


def zone_trip_counts(trips: DataFrame) -> DataFrame:
    """Pick-ups, drop-offs and their sum per zone.

    Trips are counted per zone pair first, so only pair counts are unfolded.
    """
    pairs = trips.groupBy("PULocationID", "DOLocationID").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    ends = F.array(
        F.struct(F.col("PULocationID").alias("LocationID"), F.col("n").alias("up"), none.alias("off")),
        F.struct(F.col("DOLocationID").alias("LocationID"), none.alias("up"), F.col("n").alias("off")),
    )
    return (
        pairs.select(F.inline(ends)).where(F.col("LocationID").isNotNull())
        .groupBy("LocationID")
        .agg(F.sum("up").alias("Pickup_Count"), F.sum("off").alias("Dropoff_Count"))
        .withColumn("Total_Trips", F.col("Pickup_Count") + F.col("Dropoff_Count"))
    )


def zone_totals(zones: DataFrame, trips: DataFrame) -> DataFrame:
    """Every zone with its counts; 0 trips for a zone nobody used."""
    counts = zone_trip_counts(trips)
    return zones.join(counts, "LocationID", "left").withColumn(
        "Total_Trips", F.coalesce("Total_Trips", F.lit(0))
    )


# Percentiles reported for zone totals, and those that break classes.
REPORTED = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
BREAKS = (0.05, 0.2, 0.5, 0.75, 0.95)


def zone_total_distribution(totals: DataFrame) -> DataFrame:
    """Summary of zone totals over all zones and over those with trips.

    The input has one row per zone, so plain ``percentile`` is enough.
    """
    value = F.col("Total_Trips").cast("double")
    both = totals.select(
        F.explode(
            F.when(value > 0, F.array(F.lit("all"), F.lit("non_zero"))).otherwise(F.array(F.lit("all")))
        ).alias("scope"),
        value.alias("v"),
    )
    shares = sorted({*REPORTED, *BREAKS})
    points = F.percentile("v", F.array(*[F.lit(p) for p in shares]))
    summary = both.groupBy("scope").agg(
        F.count("v").alias("zones"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"), points.alias("_p"),
    )
    return summary.select(
        "scope", "zones", "mean", "std", "min",
        *[F.col("_p")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(shares)],
        "max",
    )


def class_breaks(totals: DataFrame) -> DataFrame:
    """Seven ordered class limits of the non-zero totals; 0 and 1 when all are zero."""
    used = totals.where("Total_Trips > 0").select(F.col("Total_Trips").cast("double").alias("v"))
    inner = F.percentile("v", F.array(*[F.lit(p) for p in BREAKS]))
    limits = F.concat(F.array(F.min("v")), inner, F.array(F.max("v")))
    return used.agg(
        F.when(F.count("v") > 0, limits).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("limits")
    ).select(F.posexplode("limits").alias("position", "limit"))


def zone_equal_bins(totals: DataFrame, bins: int = 32) -> DataFrame:
    """Bin 1..``bins`` of equal width for zones with trips; NULL for zones without."""
    used = totals.where("Total_Trips > 0")
    low = used.agg(F.min("Total_Trips").cast("double")).scalar()
    high = used.agg(F.max("Total_Trips").cast("double")).scalar()
    value = F.col("Total_Trips").cast("double")
    place = F.floor((value - low) * bins / F.nullif(high - low, F.lit(0.0))) + 1
    clamped = F.least(F.coalesce(place, F.lit(1)), F.lit(bins)).cast("int")
    return totals.select(
        "LocationID", "Total_Trips", F.when(F.col("Total_Trips") > 0, clamped).alias("bin")
    )


def zone_graph(
    totals: DataFrame, trips: DataFrame, threshold_pct: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Nodes (zones with at least the given share of all totals) and edges between them."""
    needed = totals.agg(F.sum("Total_Trips")).scalar() * (threshold_pct / 100)
    nodes = totals.where(F.col("Total_Trips") >= needed)
    ids = nodes.select("LocationID")
    edges = (
        od_trip_count(trips)
        .join(ids.withColumnRenamed("LocationID", "PULocationID"), "PULocationID", "left_semi")
        .join(ids.withColumnRenamed("LocationID", "DOLocationID"), "DOLocationID", "left_semi")
    )
    return nodes, edges
