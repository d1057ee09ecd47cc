"""Demand, fare and journey-time aggregates.

Every operator is one partial-then-final aggregation; what is shuffled is
bounded by the number of groups, not of trips.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import WEEKDAYS, in_period, journey_minutes
from ..functions.ordering import known
from ..functions.tails import tail_probability
from ..schema import require_columns
from .order_stats import exact_quantiles
from .sampling import row_key, sample_order


def daily_trips(trips: DataFrame, counted: str = "VendorID") -> DataFrame:
    """Known values of ``counted`` per pick-up date; days without trips are absent."""
    return (
        trips.where(F.col("pickup_datetime").isNotNull())
        .groupBy(F.to_date("pickup_datetime").alias("date"))
        .agg(F.count(counted).alias("trips")).orderBy("date")
    )


def trips_by_hour(trips: DataFrame, counted: str = "VendorID") -> DataFrame:
    return (
        trips.where(F.col("pickup_datetime").isNotNull())
        .groupBy(F.hour("pickup_datetime").alias("hour"))
        .agg(F.count(counted).alias("trips")).orderBy("hour")
    )


def weekday_dim(spark) -> DataFrame:
    """Seven rows: weekday number (Monday 0) and name."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    number = F.col("id").cast("int")
    return spark.range(7).select(
        number.alias("weekday_no"), F.element_at(names, number + 1).alias("weekday")
    )


def _weekday_no() -> Column:
    return F.weekday(F.to_date("pickup_datetime"))


def trips_by_weekday(trips: DataFrame, counted: str = "VendorID") -> DataFrame:
    """Trips per weekday, Monday first, 0 where a weekday has none."""
    counts = trips.groupBy(_weekday_no().alias("weekday_no")).agg(F.count(counted).alias("n"))
    return (
        weekday_dim(trips.sparkSession).join(counts, "weekday_no", "left")
        .select("weekday_no", "weekday", F.coalesce("n", F.lit(0)).alias("trips"))
        .orderBy("weekday_no")
    )


def at_dropoff(trips: DataFrame, zone: int, start: str, end: str) -> DataFrame:
    """Trips of a half-open period ending in one zone; both tests reach the scan."""
    return trips.where(in_period("pickup_datetime", start, end)).where(F.col("DOLocationID") == zone)


def hourly_demand(
    trips: DataFrame, zone: int = 24, start: str = "2024-01-01", end: str = "2025-01-01",
    counted: str = "VendorID",
) -> DataFrame:
    return trips_by_hour(at_dropoff(trips, zone, start, end), counted)


def hourly_average_fare(
    trips: DataFrame, zone: int = 19, start: str = "2024-01-01", end: str = "2025-01-01",
    amount: str = "total_amount",
) -> DataFrame:
    """Sum over count of known amounts per hour; 0 where no amount is known."""
    return (
        at_dropoff(trips, zone, start, end)
        .groupBy(F.hour("pickup_datetime").alias("hour"))
        .agg(F.coalesce(F.avg(amount), F.lit(0.0)).alias("avg_fare")).orderBy("hour")
    )


def weekday_hour_grid(
    trips: DataFrame, zone: int = 79, start: str = "2024-01-01", end: str = "2025-01-01",
    counted: str = "VendorID",
) -> DataFrame:
    """Seven weekdays by 24 hours (columns ``h00``..``h23``), 0 where there is no trip."""
    hours = [F.count(F.when(F.hour("pickup_datetime") == h, F.col(counted))) for h in range(24)]
    names = [f"h{h:02d}" for h in range(24)]
    grid = at_dropoff(trips, zone, start, end).groupBy(_weekday_no().alias("weekday_no")).agg(
        *[count.alias(name) for count, name in zip(hours, names)]
    )
    return (
        weekday_dim(trips.sparkSession).join(grid, "weekday_no", "left")
        .select("weekday_no", "weekday", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
        .orderBy("weekday_no")
    )


def _mean_by(trips: DataFrame, keys: dict[str, Column], value: Column, name: str) -> DataFrame:
    """Mean of ``value`` per group of known keys."""
    keyed = trips.select(*[c.alias(k) for k, c in keys.items()], value.alias("_value"))
    for key in keys:
        keyed = keyed.where(F.col(key).isNotNull())
    return keyed.groupBy(*keys).agg(F.avg("_value").alias(name))


def _od() -> dict[str, Column]:
    return {c: F.col(c) for c in ("PULocationID", "DOLocationID")}


def _hour() -> dict[str, Column]:
    return {"hour": F.hour("pickup_datetime")}


def avg_journey_by_od(trips: DataFrame) -> DataFrame:
    return _mean_by(trips, _od(), journey_minutes(), "journey_time")


def avg_journey_by_distance(trips: DataFrame, cab_types=("yellow", "green")) -> DataFrame:
    """Mean minutes per exact distance, for the cab types that record one."""
    metered = trips.where(F.col("cab_type").isin(list(cab_types)))
    return _mean_by(
        metered, {"trip_distance": F.col("trip_distance")}, journey_minutes(), "journey_time"
    )


def avg_journey_by_hour(trips: DataFrame) -> DataFrame:
    return _mean_by(trips, _hour(), journey_minutes(), "journey_time")


def avg_fare_by_hour(trips: DataFrame) -> DataFrame:
    """Mean fare per hour; without a fare column the result is empty."""
    if "fare_amount" not in trips.columns:
        return trips.sparkSession.createDataFrame([], "hour int, fare_amount double")
    return _mean_by(trips, _hour(), F.col("fare_amount"), "fare_amount")


def avg_fare_by_zone_hour(trips: DataFrame) -> DataFrame:
    require_columns(trips, ("pickup_datetime", "PULocationID", "fare_amount"))
    keys = {"PULocationID": F.col("PULocationID"), **_hour()}
    return _mean_by(trips, keys, F.col("fare_amount"), "fare_amount")


def fares_at_hour(trips: DataFrame, hour: int) -> DataFrame:
    """Pick-up zone and fare of the trips starting in one hour of the day."""
    return trips.where(F.hour("pickup_datetime") == hour).select("PULocationID", "fare_amount")


def positive_journeys(trips: DataFrame) -> DataFrame:
    """Add ``journey_time`` (minutes) and ``hour``; keep journeys longer than zero."""
    return (
        trips.withColumns({"journey_time": journey_minutes(), "hour": F.hour("pickup_datetime")})
        .where(F.col("journey_time") > 0)
    )


def group_summary(df: DataFrame, value: str = "journey_time", group: str = "hour") -> DataFrame:
    """Mean, median and standard deviation per group."""
    moments = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return moments.join(exact_quantiles(df, [group], value, {"median": 0.5}), group, "left")


def box_stats(
    df: DataFrame, value: str = "journey_time", group: str = "hour", reach: float = 1.5
) -> DataFrame:
    """Quartiles and whiskers per group.

    A whisker ends at the furthest value within ``reach`` interquartile ranges.
    """
    quartiles = exact_quantiles(df, [group], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x = F.col(value)
    span = reach * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - span, F.col("q3") + span)
    return (
        df.select(group, value).join(quartiles, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.count(x).alias("n"),
        )
    )


def mean_interval(
    df: DataFrame, value: str = "journey_time", group: str = "hour", level: float = 0.95
) -> DataFrame:
    """Mean with its t interval per group (no interval for a single value)."""
    sums = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    point = tail_probability("t_point", F.lit(1 - level), F.nullif(F.col("n") - 1, F.lit(0)))
    half = point * F.col("std") / F.sqrt(F.col("n"))
    return (
        sums.withColumn("_half", half)
        .withColumns({"ci_low": F.col("mean") - F.col("_half"), "ci_high": F.col("mean") + F.col("_half")})
        .drop("_half")
    )


# Multipliers and increments that stir a row's hash into a draw; fixed, so that draws repeat.
_PRIME = 2_147_483_647
_STRIDE, _FACTOR, _STEP, _WRAP = 1_000_003, 48_271, 12_345, 65_537
_MOST_DRAWS = 12


def _poisson_weight(draw: str) -> str:
    """SQL for a Poisson(1) weight from a number drawn evenly below ``_PRIME``."""
    total, cases = 0.0, []
    for k in range(_MOST_DRAWS):
        total += math.exp(-1) / math.factorial(k)
        cases.append(f"WHEN {draw} < {math.floor(total * _PRIME)} THEN {k}")
    return f"CASE {' '.join(cases)} ELSE {_MOST_DRAWS} END"


def bootstrap_draw(key: str, replicate: str) -> str:
    """SQL for a number below ``_PRIME`` from a row's number and a replicate's, both non-negative.

    Three squarings modulo a prime; integer arithmetic only, alike in every engine.
    """
    x = f"(({key} + {replicate} * {_STRIDE}) % {_PRIME})"
    for added in (str(_STEP), f"{replicate} + 7", f"{key} % {_WRAP}"):
        x = f"(({x} * {x} % {_PRIME} + {x} * {_FACTOR} + {added}) % {_PRIME})"
    return x


def mean_bootstrap(
    df: DataFrame, key=None, value: str = "journey_time", group: str = "hour", level: float = 0.95,
    replicates: int = 1000, seed: int = 42,
) -> DataFrame:
    """Mean with its bootstrap interval per group.

    Every row takes part in every replicate with a Poisson(1) weight drawn by hash from
    its key, so the draw is one pass, needs no row to travel and is the same after a lost
    task. What is shuffled is one pair of sums per group and replicate and map task.
    The interval runs between the quantiles of the replicates' means; replicates in which
    a small group drew no row are left out. Rows with an unknown value take no part.
    """
    x = F.col(value).cast("double")
    number = F.conv(F.substring(sample_order(row_key(df, key), seed), 1, 12), 16, 10).cast("bigint")
    rows = df.where(known(x) & F.col(group).isNotNull()).select(
        F.col(group), x.alias("_v"), F.pmod(number, F.lit(_PRIME)).alias("_k")
    )
    drawn = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))))
    draw = bootstrap_draw("_k", "_b")
    means = (
        drawn.selectExpr(f"`{group}`", "_b", "_v", f"{draw} AS _d").selectExpr("*", f"{_poisson_weight('_d')} AS _w")
        .groupBy(group, "_b").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_s"))
        .where("_n > 0").select(group, (F.col("_s") / F.col("_n")).alias("_m"))
    )
    tail = (1 - level) / 2
    # As many values per group as there are replicates.
    limits = means.groupBy(group).agg(
        F.percentile("_m", F.lit(tail)).alias("boot_low"), F.percentile("_m", F.lit(1 - tail)).alias("boot_high")
    )
    sums = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    return sums.join(limits, group, "left").select(group, "n", "mean", "boot_low", "boot_high")
