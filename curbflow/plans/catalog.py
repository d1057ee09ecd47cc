"""Named queries over the given tables, one or more per operator.

Every entry takes ``(spark, sf_dir)`` and works on all trips derived from the
events table. Double columns are rounded so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock, trip
from ..operators import (
    cleaning, demand, events, geometry, hypothesis, normality, privacy, routes, sampling, zones,
)
from ..schema import CAB_TYPES, FILE_KEYS, normalise
from ..session import fresh_path, settle, shared_dir
from ..sources import dimensions, trips as trip_files
from ..streaming import incremental
from . import clean, fixture, impact

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

PLACES = 6
# Sums of doubles differ in the last bit between engines. A nudge far below the
# last place decides ties at that place, and the sign of zero, alike in both.
NUDGE = 1e-9
SEED = 42
REPLICATES = 200
KEY = ("trip_id",)
BEFORE, AFTER = 2, 2
TRIP = ("trip_id", "cab_type", "file_month")


def rounded(df: DataFrame) -> DataFrame:
    columns = [
        f"round(`{f.name}` + {NUDGE}D, {PLACES}) AS `{f.name}`" if isinstance(f.dataType, T.DoubleType)
        else f"`{f.name}`"
        for f in df.schema.fields
    ]
    return df.selectExpr(*columns)


def query(name: str):
    """Register a query under ``name`` with its doubles rounded."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(spark, sf_dir))

        QUERIES[name] = run
        return build

    return register


def on_trips(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query that needs the trips alone."""
    query(name)(lambda spark, sf_dir: build(fixture.trips(spark, sf_dir)))


def _listed(spark, sf_dir) -> DataFrame:
    return settle(fixture.zones(spark, sf_dir))


# ---- sources and sinks -------------------------------------------------------


def _files(spark, sf_dir, **options) -> DataFrame:
    root = fixture.monthly_files(spark, sf_dir)
    return trip_files.read_trips(spark, root, patterns=fixture.MONTHLY_PATTERN, **options)


@query("scan_trips")
def _(spark, sf_dir):
    return _files(spark, sf_dir).select(
        *TRIP, "file_year", "pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID",
        "trip_distance", "fare_amount", "total_amount",
    )


@query("scan_pruned")
def _(spark, sf_dir):
    columns = ["pickup_datetime", "DOLocationID", "total_amount"]
    return _files(spark, sf_dir, columns=columns)


@query("file_row_counts")
def _(spark, sf_dir):
    """Damaged files among sound ones count nothing."""
    return trip_files.file_row_counts(_manifest(spark, sf_dir))


def _manifest(spark, sf_dir) -> DataFrame:
    root = fixture.spoilt_files(spark, sf_dir)
    files = trip_files.file_manifest(spark, root, patterns=fixture.MONTHLY_PATTERN, deep=True)
    return trip_files.manifest_frame(spark, files)


@query("bad_files")
def _(spark, sf_dir):
    return _manifest(spark, sf_dir).where("error IS NOT NULL").select(
        *FILE_KEYS, "rows", F.substring_index("error", ":", 1).alias("error")
    ).distinct()


@query("file_row_counts_of_trips")
def _(spark, sf_dir):
    return trip_files.file_row_counts(_files(spark, sf_dir))


@query("write_monthly")
def _(spark, sf_dir):
    path = fresh_path(spark, "by-month")
    trip_files.write_monthly(fixture.trips(spark, sf_dir), path, rebalance=True)
    return trip_files.read_monthly(spark, path).select(*TRIP, "file_year", "fare_amount")


@query("precomputed_fares")
def _(spark, sf_dir):
    return _stored_fares(spark, sf_dir)


def _stored_fares(spark, sf_dir) -> DataFrame:
    """Computed once per state of the source table: a changed table has another path."""
    path = f"{shared_dir(spark)}/curbflow/fares-{fixture.signature(spark, sf_dir, 'events')}"
    return trip_files.write_once(demand.avg_fare_by_zone_hour(fixture.trips(spark, sf_dir)), path)


@query("stored_fares_reused")
def _(spark, sf_dir):
    """A second write to the same path must not happen: it would leave nothing."""
    fares = _stored_fares(spark, sf_dir)
    return trip_files.write_once(fares.where("false"), fares.inputFiles()[0].rsplit("/", 1)[0])


@query("game_schedule")
def _(spark, sf_dir):
    path = fresh_path(spark, "schedule")
    listed = fixture.schedule(spark, sf_dir).withColumnRenamed("start_time", "Start Time (EDT)")
    listed.write.csv(path, header=True)
    return dimensions.read_schedule(spark, path)


@query("zone_dim")
def _(spark, sf_dir):
    path = fresh_path(spark, "zones")
    fixture.zones(spark, sf_dir).write.csv(path, header=True, quoteAll=True)
    return dimensions.read_zone_dim(spark, path)


# ---- cleaning ----------------------------------------------------------------


@query("normalise_schema")
def _(spark, sf_dir):
    parts = [
        normalise(fixture.raw_trips(spark, sf_dir, cab), cab, drop_unwanted=True)
        .withColumn("cab_type", F.lit(cab))
        for cab in CAB_TYPES
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _file_month(t: DataFrame) -> DataFrame:
    by_pickup = cleaning.of_file_month("pickup_datetime")
    by_dropoff = cleaning.of_file_month("pickup_datetime", year_of="dropoff_datetime")
    return t.where(f"CASE WHEN cab_type = 'fhv' THEN {by_dropoff} ELSE {by_pickup} END").select(*TRIP)


on_trips("filter_file_month", _file_month)
on_trips(
    "filter_request_scene_month",
    lambda t: t.where(F.col("cab_type") == "hvfhv")
    .where(cleaning.of_file_month("request_datetime"))
    .where(cleaning.of_file_month("on_scene_datetime"))
    .select(*TRIP),
)
on_trips("filter_nonzero_length", lambda t: t.where(cleaning.nonzero_length()).select(*TRIP))
on_trips(
    "filter_required",
    lambda t: t.where(
        "Affiliated_base_number IS NOT NULL AND dispatching_base_num IS NOT NULL"
        " AND (cab_type <> 'hvfhv' OR hvfhs_license_num IS NOT NULL)"
    ).select(*TRIP),
)
on_trips("abs_amounts", lambda t: cleaning.absolute(t).select(*TRIP, *cleaning.AMOUNTS))
on_trips(
    "iqr_fence",
    lambda t: cleaning.iqr_fence(t, "fare_amount").select(*TRIP, "fare_amount"),
)
on_trips(
    "iqr_fence_airport_exempt",
    lambda t: cleaning.iqr_fence_airport_exempt(t, "total_amount")
    .select(*TRIP, "total_amount"),
)
on_trips(
    "filter_allowed_values",
    lambda t: t.where(cleaning.allowed("Airport_fee", clean.AIRPORT_FEES))
    .where(cleaning.allowed("trip_type", clean.TRIP_TYPES)).select(*TRIP, "Airport_fee", "trip_type"),
)
on_trips(
    "filter_ranges",
    lambda t: t.where(cleaning.within("passenger_count", *clean.PASSENGERS))
    .where(cleaning.within("RatecodeID", *clean.RATE_CODES)).select(*TRIP, "passenger_count", "RatecodeID"),
)
on_trips(
    "filter_minimums",
    lambda t: cleaning.absolute(t).where(cleaning.at_least("trip_distance", clean.MIN_DISTANCE))
    .where(cleaning.at_least("fare_amount", clean.MIN_FARE)).select(*TRIP, "trip_distance", "fare_amount"),
)
on_trips(
    "cleaning_audit",
    lambda t: reduce(
        DataFrame.unionByName, [cleaned.audit for cleaned in clean.clean_together(t, CAB_TYPES).values()]
    ),
)
CLEANED = (
    *TRIP, "pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID",
    "trip_distance", "fare_amount", "tip_amount", "total_amount",
)
for _cab in CAB_TYPES:
    on_trips(f"clean_{_cab}", lambda t, cab=_cab: clean.clean(t, cab).trips.select(*CLEANED))
on_trips(
    "clean_yellow_minimums", lambda t: clean.clean(t, "yellow", minimums=True).trips.select(*CLEANED)
)
on_trips(
    "filter_year",
    lambda t: t.where(clock.in_year("pickup_datetime", fixture.YEAR)).select(*TRIP, "pickup_datetime"),
)
on_trips(
    "filter_dropoff_zone",
    lambda t: demand.at_dropoff(t, fixture.DROPOFF, "2024-01-01", "2025-01-01")
    .select(*TRIP, "DOLocationID"),
)


@query("filter_hour")
def _(spark, sf_dir):
    return demand.fares_at_hour(fixture.trips(spark, sf_dir), 12)


@query("fares_of_hour")
def _(spark, sf_dir):
    return _stored_fares(spark, sf_dir).where("hour = 12")


@query("filter_valid_duration")
def _(spark, sf_dir):
    valid = routes.valid_durations(fixture.trips(spark, sf_dir), _listed(spark, sf_dir))
    return valid.select("trip_id", "PULocationID", "DOLocationID", "duration_hours")


on_trips(
    "filter_positive_journey",
    lambda t: demand.positive_journeys(t).select("trip_id", "journey_time", "hour"),
)

# ---- derived columns ---------------------------------------------------------

on_trips("journey_minutes", lambda t: t.select("trip_id", clock.journey_minutes().alias("journey_time")))
on_trips("duration_hours", lambda t: t.select("trip_id", clock.duration_hours().alias("duration_hours")))
on_trips(
    "time_parts",
    lambda t: t.select(
        "trip_id", F.hour("pickup_datetime").alias("hour"), clock.weekday_name().alias("weekday"),
        F.to_date("pickup_datetime").alias("date"), F.month("pickup_datetime").alias("month"),
        F.year("pickup_datetime").alias("year"),
    ),
)
on_trips("route_key", lambda t: t.select("trip_id", trip.route_key().alias("route")))
on_trips(
    "stadium_direction",
    lambda t: events.stadium_trips(t, fixture.STADIUM)
    .select("trip_id", trip.stadium_direction(fixture.STADIUM).alias("direction")),
)
on_trips(
    "speed_mph",
    lambda t: t.select(
        "trip_id", trip.speed_mph(F.col("trip_distance"), clock.duration_hours()).alias("speed_mph")
    ),
)
on_trips(
    "time_generalise",
    lambda t: t.select(
        "trip_id",
        *[clock.truncate_time(F.col("pickup_datetime"), u).alias(f"at_{u}") for u in ("full", "minute", "hour")],
    ),
)

# ---- sampling ----------------------------------------------------------------

on_trips("sample_allocation", lambda t: sampling.sample_allocation(t, 2_000))
on_trips(
    "sample_stratified_exact",
    lambda t: sampling.sample_stratified(t, 2_000, KEY, SEED).select(*TRIP, "fare_amount"),
)
on_trips(
    "sample_all_cabs",
    lambda t: sampling.sample_all_cabs(t, 1_000, KEY, SEED).select(*TRIP, "fare_amount"),
)
on_trips("sample_n", lambda t: sampling.sample_n(t, 100, KEY, SEED).select(*TRIP, "fare_amount"))
on_trips(
    "sample_year",
    lambda t: sampling.sample_year(t, "yellow", fixture.YEAR, 500, KEY, SEED).select(*TRIP, "fare_amount"),
)

# ---- demand ------------------------------------------------------------------


def _this_year(t: DataFrame) -> DataFrame:
    return t.where(clock.in_year("pickup_datetime", fixture.YEAR))


on_trips("daily_trips", lambda t: demand.daily_trips(_this_year(t)))
on_trips("trips_by_hour", lambda t: demand.trips_by_hour(_this_year(t)))
on_trips("trips_by_weekday", lambda t: demand.trips_by_weekday(_this_year(t)))
on_trips("hourly_demand_at_dropoff", lambda t: demand.hourly_demand(t, fixture.DROPOFF))
on_trips("avg_fare_by_hour_at_dropoff", lambda t: demand.hourly_average_fare(t, fixture.DROPOFF))
on_trips("weekday_hour_grid", lambda t: demand.weekday_hour_grid(t, fixture.DROPOFF))
on_trips("avg_journey_by_od", demand.avg_journey_by_od)
on_trips("avg_journey_by_distance", demand.avg_journey_by_distance)
on_trips("od_trip_count", routes.od_trip_count)
on_trips("avg_journey_by_hour", demand.avg_journey_by_hour)
on_trips("avg_fare_by_hour", demand.avg_fare_by_hour)
on_trips("avg_fare_by_zone_hour", demand.avg_fare_by_zone_hour)
on_trips("zone_trip_counts", zones.zone_trip_counts)


def _totals(spark, sf_dir) -> DataFrame:
    return zones.zone_totals(_listed(spark, sf_dir), fixture.trips(spark, sf_dir))


query("zone_totals")(lambda spark, sf_dir: _totals(spark, sf_dir).drop("Borough", "service_zone"))
query("zone_total_distribution")(
    lambda spark, sf_dir: zones.zone_total_distribution(_totals(spark, sf_dir))
)
query("zone_class_breaks")(lambda spark, sf_dir: zones.class_breaks(_totals(spark, sf_dir)))
query("zone_equal_bins")(lambda spark, sf_dir: zones.zone_equal_bins(_totals(spark, sf_dir)))


def _streamed(spark, sf_dir, aggregate) -> DataFrame:
    """The files of all cab types, cut to the year as the batch aggregates are."""
    schema = "pickup_datetime timestamp_ntz, VendorID int, total_amount double"
    stream = incremental.stream_trips(spark, fixture.trips_path(spark, sf_dir), schema, files_per_batch=8)
    return incremental.run_incremental(_this_year(stream), aggregate, fresh_path(spark, "totals"))


query("incremental_hourly")(
    lambda spark, sf_dir: incremental.with_average(_streamed(spark, sf_dir, incremental.hourly_totals))
)
query("incremental_daily")(lambda spark, sf_dir: _streamed(spark, sf_dir, incremental.daily_totals))
query("incremental_weekday_hour")(
    lambda spark, sf_dir: _streamed(spark, sf_dir, incremental.weekday_hour_totals)
)
def _resumed(spark, sf_dir, aggregate, keys) -> DataFrame:
    """Half of the year's files arrive and are summed; the stream stops; the rest arrives and it goes on."""
    landing, out, seen = (fresh_path(spark, label) for label in ("landing", "keyed-totals", "stream-state"))
    schema = "pickup_datetime timestamp_ntz, DOLocationID int, VendorID int, total_amount double"
    for months in ("file_month <= 6", "file_month > 6"):
        arrived = fixture.trips(spark, sf_dir).where(months).repartition(4)
        arrived.select("pickup_datetime", "DOLocationID", "VendorID", "total_amount").write.mode("append").parquet(landing)
        stream = _this_year(incremental.stream_trips(spark, landing, schema))
        totals = incremental.run_keyed(stream, aggregate, keys, out, seen, fold_every=2)
    return totals


@query("incremental_fares_at_dropoff")
def _(spark, sf_dir):
    totals = _resumed(spark, sf_dir, incremental.amounts_by_zone_hour, ["DOLocationID", "hour"])
    return incremental.fares_at_zone(totals, fixture.DROPOFF)


@query("incremental_grid_at_dropoff")
def _(spark, sf_dir):
    keys = ["DOLocationID", "weekday_no", "hour"]
    return incremental.grid_at_zone(
        _resumed(spark, sf_dir, incremental.trips_by_zone_weekday_hour, keys), fixture.DROPOFF
    )


on_trips("group_summary", lambda t: demand.group_summary(demand.positive_journeys(t)))
on_trips("box_stats_by_hour", lambda t: demand.box_stats(demand.positive_journeys(t)))
on_trips("mean_ci_by_hour", lambda t: demand.mean_interval(demand.positive_journeys(t)))
on_trips(
    "mean_ci_by_route",
    lambda t: demand.mean_interval(demand.positive_journeys(t).withColumn("route", trip.route_key()), group="route"),
)
on_trips(
    "mean_bootstrap_by_hour",
    lambda t: demand.mean_bootstrap(demand.positive_journeys(t), KEY, replicates=REPLICATES, seed=SEED),
)

# ---- routes and zone graph ---------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most used two-way routes with zone names."""
    top = routes.top_routes(fixture.trips(spark, sf_dir), 50)
    return routes.with_zone_names(top, _listed(spark, sf_dir))


on_trips("top_routes_bidirectional", lambda t: routes.top_routes(t, 50))
on_trips("route_share", lambda t: routes.route_share(t, 50))
on_trips("route_share_compat", lambda t: routes.route_share(t, 50, compat=True))
query("route_names")(flagship)


def _metric(spark, sf_dir, metric: str, compat: bool = False) -> DataFrame:
    valid = routes.valid_durations(fixture.trips(spark, sf_dir), _listed(spark, sf_dir))
    return routes.route_metric(valid, fixture.centroids(spark, sf_dir), 100, metric, compat)


for _name in routes.METRICS:
    query(f"route_metric_{_name}")(lambda spark, sf_dir, m=_name: _metric(spark, sf_dir, m))
    query(f"percentile_norm_{_name}")(
        lambda spark, sf_dir, m=_name: routes.percentile_norm(_metric(spark, sf_dir, m), m)
    )
query("route_metric_compat")(lambda spark, sf_dir: _metric(spark, sf_dir, "speed", compat=True))
on_trips(
    "scaled_weights", lambda t: routes.scaled_weight(routes.top_routes(t, 50), "Total_Trips", 10.0, 2.0)
)


def _graph(spark, sf_dir):
    totals = settle(_totals(spark, sf_dir).select("LocationID", "Zone", "Total_Trips"))
    return zones.zone_graph(totals, fixture.trips(spark, sf_dir), 4.9)


query("zone_graph_nodes")(
    lambda spark, sf_dir: routes.scaled_weight(_graph(spark, sf_dir)[0], "Total_Trips", 10.5, 0.5)
)
query("zone_graph_edges")(
    lambda spark, sf_dir: routes.scaled_weight(_graph(spark, sf_dir)[1], "Trip_Count", 10.5, 0.5)
)


@query("zones_in_top_routes")
def _(spark, sf_dir):
    top = routes.top_routes(fixture.trips(spark, sf_dir), 5)
    return routes.zones_in_routes(top, _totals(spark, sf_dir).select("LocationID", "Zone", "Total_Trips"))


# ---- geometry ----------------------------------------------------------------

query("zone_centroids")(
    lambda spark, sf_dir: geometry.zone_centroids(fixture.zone_vertices(spark, sf_dir), oriented=True)
)
@query("zone_centroids_any_order")
def _(spark, sf_dir):
    """Rings renumbered, many of them run backwards or left open: the same centroids."""
    vertices = fixture.zone_vertices(spark, sf_dir)
    disturbed = vertices.where("NOT (part % 3 = 0 AND seq = CASE ring WHEN 0 THEN 5 ELSE 4 END)").selectExpr(
        "LocationID", "part", "7 - ring AS ring", "CASE WHEN part % 2 = ring THEN -seq ELSE seq END AS seq", "x", "y"
    )
    return geometry.zone_centroids(disturbed)


query("zone_lonlat")(lambda spark, sf_dir: geometry.with_lonlat(fixture.centroids(spark, sf_dir)))
query("zone_outline_lonlat")(
    lambda spark, sf_dir: geometry.with_lonlat(fixture.zone_vertices(spark, sf_dir), "x", "y")
)
query("centroid_distance")(
    lambda spark, sf_dir: routes.with_centroid_miles(
        fixture.trips(spark, sf_dir).select("trip_id", "PULocationID", "DOLocationID"),
        fixture.centroids(spark, sf_dir),
    )
)

# ---- scheduled events --------------------------------------------------------


def _windows(spark, sf_dir) -> DataFrame:
    return events.game_windows(fixture.games(spark, sf_dir), BEFORE, AFTER)


def _near(spark, sf_dir) -> DataFrame:
    near = events.stadium_trips(fixture.trips(spark, sf_dir), fixture.STADIUM)
    return near.where("pickup_datetime IS NOT NULL").select(
        "trip_id", "pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID"
    )


def _valid(spark, sf_dir) -> DataFrame:
    return impact.valid_trips(
        fixture.trips(spark, sf_dir), fixture.games(spark, sf_dir), fixture.centroids(spark, sf_dir),
        fixture.STADIUM, BEFORE, AFTER,
    )


query("game_windows")(_windows)
query("stadium_trips")(
    lambda spark, sf_dir: events.stadium_trips(fixture.trips(spark, sf_dir), fixture.STADIUM).select(
        "trip_id", "PULocationID", "DOLocationID"
    )
)
query("asof_game")(lambda spark, sf_dir: events.asof_game(_near(spark, sf_dir), _windows(spark, sf_dir)))
query("asof_game_bucketed")(
    lambda spark, sf_dir: events.asof_game(_near(spark, sf_dir), _windows(spark, sf_dir), max_windows=0)
)


@query("asof_game_by_zone")
def _(spark, sf_dir):
    """Every drop-off zone with a schedule of its own."""
    trips = fixture.trips(spark, sf_dir).select("trip_id", "pickup_datetime", "DOLocationID")
    return events.asof_game(
        trips, events.game_windows(fixture.zone_schedule(spark, sf_dir), BEFORE, AFTER), on=["DOLocationID"]
    )


@query("game_flags")
def _(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    flagged = events.game_flags(events.asof_game(_near(spark, sf_dir), windows), windows)
    return flagged.select("trip_id", "game_datetime", "during_game", "is_game_day")


query("valid_stadium_trips")(
    lambda spark, sf_dir: _valid(spark, sf_dir).select(
        "trip_id", "duration_hours", "distance_miles", "speed_mph", "route", "direction"
    )
)
query("game_vs_nongame")(
    lambda spark, sf_dir: events.game_and_other_trips(_valid(spark, sf_dir)).select(
        "trip_id", "side", "route", "duration_hours"
    )
)
query("duration_tests")(
    lambda spark, sf_dir: impact.duration_tests(events.game_and_other_trips(_valid(spark, sf_dir)))
)
query("route_game_pivot")(lambda spark, sf_dir: events.route_game_pivot(_valid(spark, sf_dir)))
query("game_top_routes")(lambda spark, sf_dir: events.game_top_routes(_valid(spark, sf_dir)))


@query("game_impact")
def _(spark, sf_dir):
    sides = events.game_and_other_trips(_valid(spark, sf_dir))
    return impact.overall_impact(sides)


# ---- hypothesis tests --------------------------------------------------------


def on_journeys(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    on_trips(
        name,
        lambda t: build(
            demand.positive_journeys(t).select(
                "journey_time", "hour", "trip_distance", "PULocationID", "DOLocationID"
            )
        ),
    )


on_journeys("anova_by_hour", hypothesis.anova)
on_journeys("kruskal_by_hour", hypothesis.kruskal)
on_journeys("mann_whitney_hours", hypothesis.mann_whitney_hours)


@query("mann_whitney_small")
def _(spark, sf_dir):
    """Eight journeys of either hour: few enough for the exact distribution."""
    journeys = demand.positive_journeys(fixture.trips(spark, sf_dir)).select("trip_id", "hour", "journey_time")
    sizes = spark.createDataFrame([(8, 8), (3, 8)], "hour int, take long")
    drawn = sampling.take_by_hash(journeys, sizes, ["hour"], KEY, SEED)
    return hypothesis.mann_whitney_hours(drawn)


on_journeys("spearman_time_distance", hypothesis.spearman)
on_journeys("levene_by_hour", hypothesis.levene)
on_journeys("shapiro_all", normality.shapiro)
on_journeys("shapiro_route", lambda j: normality.shapiro_route(j, 133, 130))
on_journeys("tukey_hsd_by_hour", lambda j: hypothesis.tukey_hsd(j, always=True))
on_journeys(
    "tukey_q_by_hour",
    lambda j: hypothesis.tukey_hsd(j, always=True).select("group1", "group2", "mean_difference", "q"),
)
on_journeys("ols_by_hour", hypothesis.ols_by_group)
on_journeys(
    "welch_t", lambda j: hypothesis.welch_t(j, "journey_time", F.col("hour"), 8, 3)
)


@query("verdict_labels")
def _(spark, sf_dir):
    journeys = demand.positive_journeys(fixture.trips(spark, sf_dir))
    rho = hypothesis.spearman(journeys).select(
        F.lit("spearman").alias("test"), "verdict", "strength", "sign"
    )
    others = [
        make(journeys).select(
            F.lit(name).alias("test"), "verdict", F.lit(None).cast("string").alias("strength"),
            F.lit(None).cast("string").alias("sign"),
        )
        for name, make in (("anova", hypothesis.anova), ("kruskal", hypothesis.kruskal))
    ]
    return reduce(DataFrame.unionByName, [rho, *others])


# ---- anonymity ---------------------------------------------------------------

RELEASED = ("trip_id", *privacy.QUASI_IDENTIFIERS)


def _coarse_zones(t: DataFrame) -> DataFrame:
    """Trips with enough company for classes of several trips to occur at small scale."""
    return t.select("trip_id", *FILE_KEYS, "pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID")


QI_SMALL = ("pickup_datetime", "DOLocationID")

on_trips("k_of", lambda t: privacy.k_of(privacy.generalise(_coarse_zones(t))))
on_trips(
    "k_anonymise",
    lambda t: privacy.k_anonymise(_coarse_zones(t), 2, 99, QI_SMALL)[0].select("trip_id", *QI_SMALL),
)
on_trips("k_report", lambda t: privacy.k_anonymise(_coarse_zones(t), 2, 99, QI_SMALL)[1])
query("k_report_strict")(
    lambda spark, sf_dir: privacy.k_anonymise(fixture.dense_trips(spark, sf_dir), 2, 1)[1]
)
query("k_report_full_qi")(
    lambda spark, sf_dir: privacy.k_anonymise_monthly(fixture.dense_trips(spark, sf_dir))[1]
)
on_trips(
    "k_anonymise_monthly",
    lambda t: privacy.k_anonymise(_coarse_zones(t), 2, 99, QI_SMALL, by=FILE_KEYS)[0].select(
        "trip_id", *FILE_KEYS, *QI_SMALL
    ),
)


@query("k_finest_levels")
def _(spark, sf_dir):
    return privacy.finest_levels(fixture.timed_trips(spark, sf_dir), 2, 5)


def _release(spark, sf_dir) -> DataFrame:
    return privacy.k_anonymise_monthly(fixture.dense_trips(spark, sf_dir), k=3)[0]


query("k_anonymise_full_qi")(lambda spark, sf_dir: _release(spark, sf_dir).select(*RELEASED))


@query("k_release_files")
def _(spark, sf_dir):
    """The release written per file and read back."""
    path = fresh_path(spark, "release")
    trip_files.write_monthly(_release(spark, sf_dir), path)
    return trip_files.read_monthly(spark, path).select(*FILE_KEYS, *RELEASED)


on_trips(
    "equivalence_class_sizes",
    lambda t: privacy.class_size_histogram(privacy.generalise(_coarse_zones(t)), QI_SMALL),
)
