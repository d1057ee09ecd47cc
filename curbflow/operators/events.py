"""Trips around scheduled events: windows, as-of match, flags and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import duration_hours
from ..functions.trip import route_key, speed_mph, stadium_direction, touches
from ..schema import require_columns
from ..session import settle
from .routes import with_centroid_miles

# Windows a schedule may have before it no longer travels to every trip as an array.
ARRAY_WINDOWS = 1_000


def game_windows(games: DataFrame, before: float = 2, after: float = 2) -> DataFrame:
    """Add ``window_start`` and ``window_end``, hours around ``game_datetime``."""

    def hours(h):
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(h * 3600))

    return games.withColumns(
        {
            "window_start": F.col("game_datetime") - hours(before),
            "window_end": F.col("game_datetime") + hours(after),
        }
    )


def stadium_trips(trips: DataFrame, zone: int = 247) -> DataFrame:
    return trips.where(touches([zone]))


def asof_game(
    trips: DataFrame, windows: DataFrame, time: str = "pickup_datetime",
    max_windows: int = ARRAY_WINDOWS, on=(),
) -> DataFrame:
    """Attach the last window that starts at or before the pick-up, else NULLs.

    ``on`` names columns of both sides that must be equal, for schedules of their own
    (say, per zone); a trip with an unknown one has no window. Of windows starting together the one with the later game (then the later
    end) counts. A schedule within ``max_windows`` rows travels to the trips as
    one sorted array, so trips are not shuffled; a larger one, or one with ``on``,
    is merged with the trips by ranges of time, with the same result.
    """
    fields, on = ["window_start", "game_datetime", "window_end"], list(on)
    slim = windows.select(*on, *fields).dropna(subset=[*on, "window_start"])
    if on or slim.limit(max_windows + 1).count() > max_windows:
        return _asof_merged(trips, slim, time, fields, on)
    ordered = slim.agg(F.array_sort(F.collect_list(F.struct(*fields)))).scalar()
    started = F.filter("_all", lambda g: g["window_start"] <= F.col(time))
    return _unpack(
        trips.withColumn("_all", ordered).withColumn("_g", F.try_element_at(started, F.lit(-1))),
        trips, fields,
    )


def _unpack(df: DataFrame, trips: DataFrame, fields) -> DataFrame:
    return df.select(*trips.columns, *[F.col("_g")[f].alias(f) for f in fields])


def _asof_merged(trips: DataFrame, slim: DataFrame, time: str, fields, on: list[str]) -> DataFrame:
    """As-of match for schedules of any size and number.

    The answer depends on the keys and the pick-up time alone, so it is found once per
    distinct pair and joined back. Times and windows are cut into ranges of a minute:
    within one the latest window so far is carried forward. What a range begins
    with is carried from the last earlier range of its day, or else from the last earlier
    day that has one. No window function sees more rows than the clock has ticks in a
    minute, minutes in a day, or the schedule has days.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = (F.col("_at") - epoch).cast("interval second").cast("decimal(18,6)")
    none = F.lit(None).cast(_struct_ddl(slim, fields))
    # Keys under names that no trip column can clash with.
    keys = [f"_on{k}" for k in range(len(on))]
    named = [F.col(c).alias(k) for c, k in zip(on, keys)]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*on, time)])
    instants = trips.where(known).select(*named, F.col(time).alias("_at")).distinct()
    starts = slim.select(*named, F.col("window_start").alias("_at"), F.struct(*fields).alias("_g")).groupBy(
        *keys, "_at"
    ).agg(F.max("_g").alias("_g"))
    rows = instants.select(*keys, "_at", F.lit(1).alias("_asks"), none.alias("_g")).unionByName(
        starts.select(*keys, "_at", F.lit(0).alias("_asks"), "_g")
    ).withColumn("_b", F.floor(seconds / 60).cast("bigint")).withColumn("_day", F.floor(F.col("_b") / 1440))

    def carried(last: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
        """The newest window of all earlier rows; ``_last`` is NULL where a range has none."""
        earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return last.withColumn(name, F.last("_last", ignorenulls=True).over(earlier)).drop("_last")

    minutes = rows.groupBy(*keys, "_day", "_b").agg(F.max("_g").alias("_last"))
    days = minutes.groupBy(*keys, "_day").agg(F.max("_last").alias("_last"))
    # Windows sort before pick-ups of the same instant.
    so_far = (
        Window.partitionBy(*keys, "_b").orderBy("_at", "_asks")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        rows.withColumn("_seen", F.last("_g", ignorenulls=True).over(so_far))
        .where(F.col("_asks") == 1)
        .join(carried(minutes, [*keys, "_day"], "_b", "_today"), [*keys, "_day", "_b"])
        .join(carried(days, keys, "_day", "_before"), [*keys, "_day"])
        .select(*keys, "_at", F.coalesce("_seen", "_today", "_before").alias("_g"))
    )
    same = reduce(lambda a, b: a & b, [F.col(time) == F.col("_at"), *[trips[c] == F.col(k) for c, k in zip(on, keys)]])
    return _unpack(trips.join(answers, same, "left"), trips, fields)


def _struct_ddl(slim: DataFrame, fields) -> str:
    return "struct<" + ",".join(f"{f}:{slim.schema[f].dataType.simpleString()}" for f in fields) + ">"


def game_flags(matched: DataFrame, windows: DataFrame, time: str = "pickup_datetime") -> DataFrame:
    """Add ``during_game`` (inside the matched window, ends included) and ``is_game_day``."""
    days = settle(
        windows.where(F.col("game_datetime").isNotNull())
        .select(F.to_date("game_datetime").alias("date")).distinct()
        .withColumn("_hit", F.lit(True))
    )
    during = F.col(time).between(F.col("window_start"), F.col("window_end"))
    return (
        matched.withColumn("date", F.to_date(time)).join(days, "date", "left")
        .withColumns(
            {
                "during_game": F.coalesce(during, F.lit(False)),
                "is_game_day": F.coalesce("_hit", F.lit(False)),
            }
        )
        .select(*matched.columns, "during_game", "is_game_day")
    )


def prepare_stadium_trips(
    trips: DataFrame, games: DataFrame, zone: int = 247, before: float = 2, after: float = 2
) -> DataFrame:
    """Filter, as-of match and flags in one chain; trips without pick-up time are left out."""
    require_columns(trips)
    windows = game_windows(games, before, after)
    near = stadium_trips(trips, zone).where(F.col("pickup_datetime").isNotNull())
    return game_flags(asof_game(near, windows), windows)


def valid_stadium_trips(flagged: DataFrame, centroids: DataFrame, zone: int = 247) -> DataFrame:
    """Trips with positive duration and centroid distance, plus speed, route and direction."""
    timed = flagged.withColumn("duration_hours", duration_hours()).where("duration_hours > 0")
    return (
        with_centroid_miles(timed, centroids).where("distance_miles > 0")
        .withColumns(
            {
                "speed_mph": speed_mph(F.col("distance_miles"), F.col("duration_hours")),
                "route": route_key(),
                "direction": stadium_direction(zone),
            }
        )
    )


def game_and_other_trips(valid: DataFrame) -> DataFrame:
    """Trips during games and on days without one, on routes that occur in both.

    A trip in a window that runs past midnight belongs to both sets, so it can
    come out twice, once per ``side`` ('game', 'non_game').
    """
    during, other = F.col("during_game"), ~F.col("is_game_day")
    common = settle(
        valid.groupBy("route")
        .agg(F.bool_or(during).alias("a"), F.bool_or(other).alias("b"))
        .where("a and b").select("route")
    )
    sides = F.array_compact(
        F.array(F.when(during, F.lit("game")), F.when(other, F.lit("non_game")))
    )
    return valid.join(common, "route", "left_semi").withColumn("side", F.explode(sides))


def route_game_pivot(valid: DataFrame) -> DataFrame:
    """Mean minutes per route inside and outside event windows; a missing side is 0.

    Outside includes trips on event days, unlike ``game_and_other_trips``.
    """

    def minutes(inside: bool):
        hit = F.when(F.col("during_game") == inside, F.col("duration_hours"))
        return F.coalesce(F.avg(hit), F.lit(0.0)) * 60

    return (
        valid.groupBy("route")
        .agg(minutes(False).alias("non_game_time"), minutes(True).alias("game_time"))
        .withColumn("time_difference", F.col("game_time") - F.col("non_game_time"))
    )


def game_top_routes(valid: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent routes with their pivot columns, ties by route text."""
    counts = valid.groupBy("route").agg(F.count(F.lit(1)).alias("trips"))
    top = counts.orderBy(F.desc("trips"), "route").limit(n)
    return top.join(route_game_pivot(valid), "route")
