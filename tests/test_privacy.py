import pytest
from pyspark.sql import functions as F

from curbflow.operators import privacy


@pytest.fixture
def six(spark):
    """Classes of 3, 2 and 1 rows; the first has an unknown zone."""
    rows = [(None, "10:05")] * 2 + [(None, "10:55")] + [(4, "10:00"), (4, "10:59")] + [(4, "11:00")]
    df = spark.createDataFrame(rows, "PULocationID int, clock string")
    at = F.to_timestamp_ntz(F.concat(F.lit("2024-01-01 "), "clock", F.lit(":00")))
    return df.select(
        "PULocationID", F.lit(9).alias("DOLocationID"), at.alias("pickup_datetime"), at.alias("dropoff_datetime"),
        F.lit("yellow").alias("cab_type"), F.lit(2024).alias("file_year"),
        F.when(F.col("PULocationID").isNull(), 1).otherwise(2).alias("file_month"),
    )


def test_drops_small_classes_within_the_limit(six):
    kept, report = privacy.k_anonymise(six, 2, 20)
    assert kept.count() == 5
    row = report.first()
    assert (row.k_before, row.k_after, row.rows_before, row.rows_after) == (1, 2, 6, 5)
    assert row.dropped_pct == pytest.approx(100 / 6)
    assert {r.pickup_datetime.minute for r in kept.collect()} == {0}
    assert privacy.k_of(kept).first().k >= 2


def test_releases_nothing_beyond_the_limit(six):
    kept, report = privacy.k_anonymise(six, 2, 10)
    assert kept.count() == 0 and kept.columns == six.columns
    row = report.first()
    assert (row.k_after, row.rows_after) == (None, 0)


def test_every_file_is_judged_alone(six):
    kept, report = privacy.k_anonymise(six, 2, 20, by=("cab_type", "file_year", "file_month"))
    # File 2 would lose one of three rows, more than a fifth.
    assert {r.file_month for r in kept.select("file_month").distinct().collect()} == {1}
    assert {r.file_month: r.rows_after for r in report.collect()} == {1: 3, 2: 0}
    assert privacy.k_anonymise_monthly(six)[0].count() == 5


def test_histogram_and_units(six):
    sizes = privacy.class_size_histogram(privacy.generalise(six))
    assert {r.class_size: r.classes for r in sizes.collect()} == {3: 1, 2: 1, 1: 1}
    assert privacy.class_sizes(privacy.generalise(six, "full")).count() == 5
    with pytest.raises(ValueError):
        privacy.generalise(six, "week")


def test_finest_levels_by_hand(spark):
    """Files whose times agree to the second, to the minute, to the hour, on one side, or not at all."""
    base = "2024-01-01 10:"
    files = {
        1: [("00:00", "30:00"), ("00:00", "30:00")],
        2: [("00:10", "30:00"), ("00:20", "30:00")],  # pick-up to the minute
        3: [("01:00", "30:00"), ("02:00", "30:10"), ("03:00", "30:20")],  # hours there, minutes here
        4: [("00:00", "30:00"), ("00:00", "40:00")],  # drop-off to the hour
        5: [("00:00", "30:00")],  # alone at every level
        None: [(None, "30:01"), (None, "30:02")],  # unknown times and file keys are values like others
    }
    rows = [("yellow", 2024, m, p and base + p, d and base + d) for m, own in files.items() for p, d in own]
    df = spark.createDataFrame(rows, "cab_type string, file_year int, file_month int, p string, d string").select(
        "cab_type", "file_year", "file_month", F.to_timestamp_ntz("p").alias("pickup_datetime"),
        F.to_timestamp_ntz("d").alias("dropoff_datetime"), F.lit(1).alias("PULocationID"), F.lit(2).alias("DOLocationID"),
    )
    found = {r.file_month: (r.pickup_level, r.dropoff_level, r["rows"]) for r in privacy.finest_levels(df, 2).collect()}
    assert found == {
        1: ("full", "full", 2), 2: ("minute", "full", 2), 3: ("hour", "minute", 3), 4: ("full", "hour", 2),
        5: (None, None, 1), None: ("full", "minute", 2),
    }
    # A third of file 3 may be dropped at most: nothing finer has a class of two.
    some = {r.file_month: (r.pickup_level, r.dropped_pct) for r in privacy.finest_levels(df, 2, 100).collect()}
    assert some[3] == ("full", 100.0) and some[5] == ("full", 100.0)
