"""Effect of scheduled events on journeys at one zone, end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.events import (
    game_and_other_trips, prepare_stadium_trips, route_game_pivot, valid_stadium_trips,
)
from ..operators.hypothesis import mann_whitney, welch_t
from ..schema import REQUIRED
from ..session import cut


def duration_tests(sides: DataFrame, value: str = "duration_hours") -> DataFrame:
    """Welch t and rank test of event against other journeys, rounded to 4 places."""
    side = F.col("side")
    t = welch_t(sides, value, side, "game", "non_game").select(
        F.round("statistic", 4).alias("t_statistic"), F.round("p_value", 4).alias("p_value_t")
    )
    u = mann_whitney(sides, value, side, "game", "non_game").select(
        F.round("statistic", 4).alias("mw_statistic"), F.round("p_value", 4).alias("p_value_mw")
    )
    return _beside(t, u)


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row tables put side by side by a join on a constant."""
    keyed = [row.withColumn("_row", F.lit(1)) for row in rows]
    out = keyed[0]
    for row in keyed[1:]:
        out = out.join(row, "_row")
    return out.drop("_row")


def game_summary(sides: DataFrame) -> DataFrame:
    """Mean minutes of both sides, their difference and percentage, and trip counts."""

    def of(side: str, value: Column) -> Column:
        return F.when(F.col("side") == side, value)

    hours = F.col("duration_hours")
    row = sides.agg(
        (F.avg(of("game", hours)) * 60).alias("g"), (F.avg(of("non_game", hours)) * 60).alias("o"),
        F.count(of("game", F.lit(1))).alias("game_trip_count"),
        F.count(of("non_game", F.lit(1))).alias("non_game_trip_count"),
    )
    g, o = F.col("g"), F.col("o")
    return row.select(
        F.round(g, 2).alias("game_time_mean_minutes"),
        F.round(o, 2).alias("non_game_time_mean_minutes"),
        F.round(g - o, 2).alias("time_difference_minutes"),
        F.when(o > 0, F.round((g - o) / o * 100, 2)).otherwise(0.0).alias("percent_time_change"),
        "game_trip_count", "non_game_trip_count",
    )


def overall_impact(sides: DataFrame) -> DataFrame:
    return _beside(game_summary(sides), duration_tests(sides))


def valid_trips(
    trips: DataFrame, games: DataFrame, centroids: DataFrame, stadium: int = 247,
    before: float = 2, after: float = 2,
) -> DataFrame:
    """Usable trips at the stadium, written once: every later figure reads this small
    share of the trips instead of scanning and matching all of them again."""
    near = trips.select(*REQUIRED, *[c for c in trips.columns if c == "trip_id"])
    flagged = prepare_stadium_trips(near, games, stadium, before, after)
    return cut(valid_stadium_trips(flagged, centroids, stadium))


def game_impact(
    trips: DataFrame, games: DataFrame, centroids: DataFrame, stadium: int = 247,
    before: float = 2, after: float = 2,
) -> tuple[DataFrame, DataFrame]:
    """One row of overall impact with tests, and the per-route comparison."""
    valid = valid_trips(trips, games, centroids, stadium, before, after)
    sides = game_and_other_trips(valid)
    return overall_impact(sides), route_game_pivot(valid)
