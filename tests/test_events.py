import pytest
from pyspark.sql import functions as F

from curbflow.operators import events
from curbflow.plans import impact


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def trips(spark, rows):
    df = spark.createDataFrame(rows, "n int, a string, b string, PULocationID int, DOLocationID int")
    return df.select(
        "n", F.to_timestamp_ntz("a").alias("pickup_datetime"), F.to_timestamp_ntz("b").alias("dropoff_datetime"),
        "PULocationID", "DOLocationID",
    )


@pytest.fixture
def games(spark):
    rows = [("2024-05-01 19:00:00",), ("2024-05-03 23:30:00",)]
    return spark.createDataFrame(rows, "t string").select(F.to_timestamp_ntz("t").alias("game_datetime"))


@pytest.fixture
def sample(spark):
    return trips(
        spark,
        [
            (1, "2024-05-01 16:59:59", "2024-05-01 17:10:00", 247, 10),
            (2, "2024-05-01 17:00:00", "2024-05-01 17:20:00", 10, 247),
            (3, "2024-05-01 21:00:00", "2024-05-01 21:30:00", 247, 10),
            (4, "2024-05-02 12:00:00", "2024-05-02 12:30:00", 247, 10),
            (5, "2024-05-04 00:30:00", "2024-05-04 01:00:00", 247, 10),
            (6, "2024-04-01 00:30:00", "2024-04-01 01:00:00", 247, 10),
            (7, None, "2024-05-01 17:10:00", 247, 10),
            (8, "2024-05-01 17:00:00", "2024-05-01 17:20:00", 10, 11),
        ],
    )


@pytest.mark.parametrize("limit", [1000, 0])
def test_as_of_takes_the_last_started_window(spark, games, sample, limit):
    windows = events.game_windows(games)
    out = events.asof_game(sample, windows, max_windows=limit)
    got = {r.n: r.game_datetime and r.game_datetime.day for r in out.collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 1, 5: 3, 6: None, 7: None, 8: 1}
    assert out.count() == sample.count()


def test_both_as_of_paths_agree_on_dense_windows_and_copies(spark):
    windows = spark.range(400).select(
        (ntz("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id") * 7 % 311, F.lit(0))).alias("window_start"),
    ).withColumns({"game_datetime": F.col("window_start"), "window_end": F.col("window_start")})
    sample = spark.range(3000).select(
        F.col("id").alias("n"),
        (ntz("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id") % 400, F.lit(0))).alias("pickup_datetime"),
    )
    one = events.asof_game(sample, windows)
    two = events.asof_game(sample, windows, max_windows=0)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert one.count() == 3000


def test_flags_include_both_ends_and_cross_midnight(spark, games, sample):
    flagged = events.prepare_stadium_trips(sample, games)
    got = {r.n: (r.during_game, r.is_game_day) for r in flagged.collect()}
    assert got == {
        1: (False, True), 2: (True, True), 3: (True, True), 4: (False, False), 5: (True, False), 6: (False, False),
    }


def test_no_trips_at_the_stadium(spark, games, sample):
    assert events.prepare_stadium_trips(sample, games, zone=99).count() == 0


def test_pivot_and_sides(spark, games, sample):
    centroids = spark.createDataFrame(
        [(247, 0.0, 0.0), (10, 5280.0, 0.0)], "LocationID int, x_ft double, y_ft double"
    )
    valid = events.valid_stadium_trips(events.prepare_stadium_trips(sample, games), centroids)
    sides = events.game_and_other_trips(valid)
    got = sorted((r.n, r.side) for r in sides.collect())
    # Trip 5 is in a window past midnight and on a day without a game: both sides.
    assert got == [(3, "game"), (4, "non_game"), (5, "game"), (5, "non_game"), (6, "non_game")]
    pivot = {r.route: (r.non_game_time, r.game_time) for r in events.route_game_pivot(valid).collect()}
    assert pivot["10-247"] == (0.0, pytest.approx(20.0))
    assert pivot["247-10"] == (pytest.approx((601 / 60 + 30 + 30) / 3), pytest.approx(30.0))
    row, _ = impact.game_impact(sample, games, centroids)
    found = row.first()
    assert (found.game_trip_count, found.non_game_trip_count) == (2, 3)
    assert found.game_time_mean_minutes == 30.0 and found.percent_time_change == 0.0


def test_required_columns(spark, games):
    with pytest.raises(ValueError, match="DOLocationID"):
        events.prepare_stadium_trips(spark.range(1), games)


def test_asof_per_key_equals_a_search_row_by_row(spark):
    """Ties, unknown keys and times, keys without windows, days and weeks between a window and its trips."""
    import random
    from datetime import datetime, timedelta

    from curbflow.operators import events

    chance = random.Random(3)
    start = datetime(2024, 1, 1)

    def moment(days):
        return start + timedelta(days=chance.randrange(days), minutes=chance.choice([0, 1, 719, 1439]), seconds=chance.choice([0, 1, 59]))

    trips = [(k, chance.choice(["a", "b", "c", None]), None if k % 17 == 0 else moment(40)) for k in range(300)]
    windows = [(chance.choice(["a", "b", "d", None]), None if k % 13 == 0 else moment(25), chance.randrange(9)) for k in range(60)]
    left = spark.createDataFrame(trips, "trip_id long, zone string, pickup_datetime timestamp_ntz").repartition(4)
    right = spark.createDataFrame(windows, "zone string, window_start timestamp_ntz, n int").select(
        "zone", "window_start", (F.col("window_start") + F.make_dt_interval(F.lit(0), F.col("n"))).alias("game_datetime"),
        F.col("window_start").alias("window_end"),
    )
    found = {r.trip_id: (r.window_start, r.game_datetime) for r in events.asof_game(left, right, on=["zone"]).collect()}
    assert len(found) == len(trips)
    for trip, zone, at in trips:
        own = [(s, s + timedelta(hours=n)) for z, s, n in windows if z is not None and z == zone and s and at and s <= at]
        assert found[trip] == (max(own) if own else (None, None))
    plain = {r.trip_id: r.window_start for r in events.asof_game(left, right, max_windows=0).collect()}
    for trip, _, at in trips:
        own = [s for _, s, _ in windows if s and at and s <= at]
        assert plain[trip] == (max(own) if own else None)
