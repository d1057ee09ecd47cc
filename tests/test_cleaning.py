import math

import pytest
from pyspark.sql import functions as F

from curbflow.functions.clock import elapsed_seconds, truncate_time, weekday_name
from curbflow.operators import cleaning
from curbflow.operators.order_stats import exact_quantiles
from curbflow.plans import clean
from curbflow.schema import CANONICAL, normalise, require_columns

KEYS = "cab_type string, file_year int, file_month int"


def rows(spark, data, ddl):
    """Rows of one yellow January file."""
    df = spark.createDataFrame(data, ddl)
    return df.withColumns(
        {"cab_type": F.lit("yellow"), "file_year": F.lit(2024), "file_month": F.lit(1)}
    )


def values(df, column):
    return sorted((r[0] for r in df.select(column).collect()), key=lambda v: (v is None, v))


def test_fence_of_worked_example(spark):
    df = rows(spark, [(1.0,), (2.0,), (3.0,), (10.0,), (None,), (math.nan,)], "x double")
    fence = cleaning.fence_table(df, "x").first()
    assert (fence.q1, fence.q3) == (1.75, 4.75)
    assert (fence.fence_low, fence.fence_high) == (-2.75, 9.25)
    assert values(cleaning.iqr_fence(df, "x"), "x") == [1.0, 2.0, 3.0]


def test_airport_trips_are_neither_measured_nor_filtered(spark):
    data = [(1.0, 5, 6), (2.0, 5, 6), (3.0, None, 6), (10.0, 132, 6), (None, 5, 138), (None, 5, 6)]
    df = rows(spark, data, "x double, PULocationID int, DOLocationID int")
    kept = cleaning.iqr_fence_airport_exempt(df, "x")
    assert values(kept, "x") == [1.0, 2.0, 3.0, 10.0, None]


def test_bucketed_quantiles_equal_percentile(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0))  # one group is a single hot value
        .when(F.col("id") % 11 == 0, None)
        .otherwise((F.col("id") * 7919 % 1013 - 500) / 8).alias("x"),
    )
    wanted = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    points = F.array(*map(F.lit, wanted.values()))
    left = {r.g: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "x", wanted).collect()}
    right = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", points).alias("q")).collect()}
    assert left.keys() == right.keys() == {0, 1, 2}
    for g in left:
        assert left[g] == pytest.approx(right[g], rel=1e-12)
    overall = exact_quantiles(df, [], "x", {"m": 0.5}).first().m
    assert overall == df.agg(F.percentile("x", 0.5)).first()[0]


FARES = (0.09, 0.24, 0.31, 1.34, 1.39, 1.68, 1.69, 1.84, 2.06, 2.45, 2.73, 3.77)


def test_one_fence_whatever_the_plan(spark):
    """The highest fare lies close to the fence, where a last bit of interpolation would decide."""
    once = rows(spark, [(f,) for f in FARES], "x double")
    ordered = sorted(FARES)

    def quartile(p):
        at = p * (len(ordered) - 1)
        low = ordered[math.floor(at)]
        return low + (ordered[math.ceil(at)] - low) * (at - math.floor(at))

    q1, q3 = quartile(0.25), quartile(0.75)
    kept = sum(q1 - 1.5 * (q3 - q1) <= f <= q3 + 1.5 * (q3 - q1) for f in FARES)
    for parts in (1, 7):
        assert cleaning.iqr_fence(once.repartition(parts), "x").count() == kept


def test_infinities_are_ordered(spark):
    inf = math.inf
    df = rows(spark, [(v,) for v in (-inf, 1.0, 2.0, 4.0, inf, inf)], "x double")
    found = exact_quantiles(df, [], "x", {"a": 0.0, "b": 0.2, "c": 0.4, "d": 0.6, "e": 1.0}).first()
    assert tuple(found) == (-inf, 1.0, 2.0, 4.0, inf)


def test_crowded_bucket_is_split(spark):
    """All values lie in one coarse bucket."""
    df = spark.range(20_000).select((1.0 + F.col("id") * 1e-8).alias("x"))
    found = exact_quantiles(df, [], "x", {"q": 0.25, "m": 0.5}).first()
    assert tuple(found) == tuple(df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5)))).first()[0])


def test_order_bucket_never_decreases(spark):
    from curbflow.functions.ordering import order_bucket

    xs = [-1e300, -5.0, -1e-300, -0.0, 0.0, 5e-324, 1e-3, 0.1, 0.1 + 1e-17, 3.0, 3.0000001, 1e9, 1e308]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.b for r in df.orderBy("x").selectExpr("x", f"{order_bucket('x')} AS b").collect()]
    assert got == sorted(got)


def test_zero_length_and_month_rules(spark):
    ddl = "n int, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz"
    df = rows(spark, [], ddl).sparkSession.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-05 10:00:00', TIMESTAMP_NTZ'2024-01-05 10:00:00'),"
        " (2, TIMESTAMP_NTZ'2024-01-05 10:00:00', NULL),"
        " (3, TIMESTAMP_NTZ'2024-01-05 10:00:00', TIMESTAMP_NTZ'2024-01-05 10:10:00'),"
        " (4, TIMESTAMP_NTZ'2023-01-05 10:00:00', TIMESTAMP_NTZ'2024-01-05 10:10:00'),"
        " (5, TIMESTAMP_NTZ'2024-02-01 00:00:00', TIMESTAMP_NTZ'2024-02-01 00:10:00'),"
        " (6, NULL, NULL) AS t(n, pickup_datetime, dropoff_datetime)"
    ).withColumn("file_month", F.lit(1))
    assert values(df.where(cleaning.nonzero_length()), "n") == [2, 3, 4, 5]
    assert values(df.where(cleaning.of_file_month("pickup_datetime")), "n") == [1, 2, 3]
    # The for-hire form takes the year from the drop-off: 2 goes, 4 stays.
    other = cleaning.of_file_month("pickup_datetime", year_of="dropoff_datetime")
    assert values(df.where(other), "n") == [1, 3, 4]


def test_minimums_are_off_unless_asked_for():
    assert not any("minimum" in s.name for s in clean.cleaning_steps("yellow"))
    names = [s.name for s in clean.cleaning_steps("yellow", minimums=True)]
    assert names.index("minimum trip_distance") < names.index("fence trip_distance")
    with pytest.raises(ValueError):
        clean.cleaning_steps("rickshaw")


def test_audit_adds_up(spark):
    from curbflow.plans import fixture

    done = clean.clean_yellow(fixture.trips(spark, "/root/testdata/sf0.001"))
    per_file = {}
    for r in done.audit.collect():
        per_file.setdefault(r.file_month, []).append((r.step_no, r.row_count))
    for steps in per_file.values():
        counts = [n for _, n in sorted(steps)]
        assert counts[0] == sum(counts[1:])
    assert done.trips.count() == sum(max(steps)[1] for steps in per_file.values())


def test_normalise_renames_casts_and_turns_nan_to_null(spark):
    raw = spark.createDataFrame(
        [(10, 20.0, 1, math.nan, 2.0)],
        "PUlocationID bigint, DOlocationID double, trip_time bigint, trip_miles double, driver_pay double",
    ).withColumns(
        {c: F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") for c in ("pickup_datetime", "dropoff_datetime")}
    ).withColumn("bcf", F.lit(1.0))
    out = normalise(raw, "hvfhv", drop_unwanted=True)
    assert "bcf" not in out.columns
    types = dict(out.dtypes)
    for name in ("PULocationID", "DOLocationID", "trip_distance", "total_amount"):
        assert types[name] == CANONICAL[name]
    row = out.first()
    assert row.trip_distance is None and row.total_amount == 2.0
    with pytest.raises(ValueError, match="pickup_datetime"):
        require_columns(raw.drop("pickup_datetime"))


def test_clock_ignores_the_session_zone(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-03-10 01:59:00' AS a, TIMESTAMP_NTZ'2024-03-10 03:01:00.5' AS b,"
        " TIMESTAMP_NTZ'2024-03-10 02:30:45' AS c, CAST(NULL AS TIMESTAMP_NTZ) AS d"
    )
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = df.select(
            elapsed_seconds(F.col("a"), F.col("b")).alias("s"),
            truncate_time(F.col("c"), "hour").cast("string").alias("h"),
            truncate_time(F.col("c"), "minute").cast("string").alias("m"),
            weekday_name("c").alias("w"), weekday_name("d").alias("none"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row.s == 3720.5
    assert (row.h, row.m) == ("2024-03-10 02:00:00", "2024-03-10 02:30:00")
    assert (row.w, row.none) == ("Sunday", None)


def test_quantiles_of_values_that_share_buckets(spark):
    """Values a last bit apart need every round; ranks in one bucket and in two."""
    base = [1.0 + k * 2.0**-52 for k in range(40)] + [5.0 + k * 2.0**-30 for k in range(40)] + [-3.0] * 7
    df = spark.createDataFrame([(g, v * g) for g in (1, 2, -1) for v in base], "g int, x double").repartition(5)
    wanted = {"a": 0.0, "b": 0.2, "c": 0.3001, "d": 0.77, "e": 1.0}
    found = {r.g: r for r in exact_quantiles(df, ["g"], "x", wanted).collect()}
    for g in (1, 2, -1):
        ordered = sorted(v * g for v in base)
        for name, p in wanted.items():
            at = p * (len(ordered) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert found[g][name] == (low if low == high else low + (high - low) * (at - math.floor(at)))


def test_a_round_shuffles_bucket_counts_twice(spark):
    from curbflow.functions.ordering import order_bucket
    from curbflow.operators import order_stats

    rows_ = spark.range(1000).selectExpr("id % 7 AS g", "CAST(id AS DOUBLE) AS _v")
    ranks = ["floor(0.5D * (_total - 1))", "ceil(0.5D * (_total - 1))"]
    narrowed = order_stats._narrowed(rows_, ["g"], ranks, order_bucket("_v", 1 << 16), None)
    plan = narrowed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("partial_count") == 1


def test_runs_cleaned_together_equal_runs_alone(spark):
    """Runs of unlike steps share rounds: a run without fences, one with two, one that loses a file whole."""
    data = [(cab, m, float(k % 23), float(k % 7) - 1) for cab in "ab" for m in (1, 2) for k in range(120)]
    df = spark.createDataFrame(data, "cab_type string, file_month int, x double, y double").withColumns(
        {"file_year": F.lit(2024), "PULocationID": F.lit(1), "DOLocationID": F.lit(2)}
    )
    first = [cleaning.Step("low", "x < 15"), cleaning.Step("fx", fence_on="x"), cleaning.Step("fy", fence_on="y")]
    second = [cleaning.Step("one file", "file_month = 1"), cleaning.Step("fy", fence_on="y"), cleaning.Step("pos", "y > 0")]
    runs = {
        "p": (df.where("cab_type = 'a'"), first), "q": (df.where("cab_type = 'b'"), second),
        "r": (df, [cleaning.Step("pos", "y > 0")]),
    }
    together = cleaning.run_together(runs)
    for name, (table, steps) in runs.items():
        alone = cleaning.run_steps(table, steps)
        assert sorted(together[name].audit.collect()) == sorted(alone.audit.collect())
        assert sorted(together[name].trips.collect()) == sorted(alone.trips.collect())
