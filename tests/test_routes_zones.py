import math

import pytest
from pyspark.sql import functions as F

from curbflow.functions.projection import plane_to_lonlat
from curbflow.operators import geometry, routes, zones

A, B, C, D, E = 1, 2, 3, 4, 5


def trips(spark, counts):
    rows = [(pu, do, hours) for (pu, do), (n, hours) in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "PULocationID int, DOLocationID int, duration_hours double")


@pytest.fixture
def sample(spark):
    return trips(
        spark,
        {(A, B): (2, 0.5), (B, A): (3, 1.0), (D, C): (4, 2.0), (E, E): (6, 0.1), (None, A): (5, 1.0)},
    )


def table(df):
    return {(r.PULocationID, r.DOLocationID): (r.Total_Trips, r.Forward_Count, r.Reverse_Count) for r in df.collect()}


def test_two_way_one_way_and_self_routes(sample):
    plain = table(routes.top_routes(sample))
    assert plain == {(B, A): (5, 3, 2), (D, C): (4, 4, 0), (E, E): (6, 6, 6)}
    assert table(routes.route_share(sample)) == plain
    compat = table(routes.route_share(sample, compat=True))
    assert compat == {(A, B): (10, 5, 5), (D, C): (4, 4, 0), (E, E): (12, 6, 6)}


def test_share_counts_rows_with_unknown_ends(sample):
    shares = {r.PULocationID: r.Percentage for r in routes.route_share(sample).collect()}
    assert shares[E] == pytest.approx(6 / 20 * 100)


def test_ties_come_in_pair_order(spark):
    df = trips(spark, {(9, 8): (2, 1.0), (1, 7): (2, 1.0), (3, 2): (2, 1.0)})
    assert [(r.PULocationID, r.DOLocationID) for r in routes.top_routes(df, 2).collect()] == [(1, 7), (3, 2)]


def test_metric_follows_the_leading_direction(spark, sample):
    centroids = spark.createDataFrame(
        [(A, 0.0, 0.0), (B, 5280.0, 0.0), (C, 0.0, 5280.0), (D, 0.0, 0.0), (E, 1.0, 1.0)],
        "LocationID int, x_ft double, y_ft double",
    )

    def metric(name, compat=False):
        out = routes.route_metric(sample, centroids, 10, name, compat)
        return {r.PULocationID: r.Metric_Value for r in out.collect()}

    assert metric("time")[B] == 1.0  # B to A is the busier one
    assert metric("time", True)[A] == 0.5  # compat: always from the lower id
    assert metric("speed") == {B: 1.0, D: 0.5, E: 0.0}
    assert metric("frequency")[E] == 6.0
    with pytest.raises(ValueError):
        routes.route_metric(sample, centroids, 10, "beauty")


def test_percentile_norm_by_hand(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4)], "Metric_Value double")
    norm = {r.Metric_Value: r.norm for r in routes.percentile_norm(df, "speed").collect()}
    assert norm == {0.0: 0.0, 1.0: 0.25, 2.0: 0.5, 3.0: 0.75, 4.0: 1.0}
    back = {r.Metric_Value: r.norm for r in routes.percentile_norm(df, "time").collect()}
    assert back[0.0] == 1.0
    flat = spark.createDataFrame([(2.0,), (2.0,)], "Metric_Value double")
    assert {r.norm for r in routes.percentile_norm(flat, "frequency").collect()} == {0.25}


def test_zone_totals_breaks_and_bins(spark, sample):
    dim = spark.createDataFrame([(i, f"Z{i}") for i in range(1, 9)], "LocationID int, Zone string")
    totals = zones.zone_totals(dim, sample)
    got = {r.LocationID: r.Total_Trips for r in totals.collect()}
    assert got == {A: 10, B: 5, C: 4, D: 4, E: 12, 6: 0, 7: 0, 8: 0}
    bins = {r.LocationID: r.bin for r in zones.zone_equal_bins(totals).collect()}
    assert bins[E] == 32 and bins[C] == 1 and bins[6] is None
    breaks = [r.limit for r in zones.class_breaks(totals).orderBy("position").collect()]
    assert breaks[0] == 4.0 and breaks[-1] == 12.0 and len(breaks) == 7
    none = zones.class_breaks(totals.where("Total_Trips = 0"))
    assert [r.limit for r in none.orderBy("position").collect()] == [0.0, 1.0]
    nodes, edges = zones.zone_graph(totals, sample, 20)
    assert {r.LocationID for r in nodes.collect()} == {A, E}
    assert {(r.PULocationID, r.DOLocationID) for r in edges.collect()} == {(E, E)}


def test_names_fall_back_to_the_id(spark, sample):
    dim = spark.createDataFrame([(A, "Alpha")], "LocationID int, Zone string")
    named = routes.with_zone_names(routes.top_routes(sample), dim)
    names = {r.PULocationID: (r.start_name, r.end_name) for r in named.collect()}
    assert names[B] == ("Zone 2", "Alpha")


def test_centroid_of_a_square_with_a_hole_and_two_parts(spark):
    def ring(part, number, points):
        return [(7, part, number, i, float(x), float(y)) for i, (x, y) in enumerate(points)]

    square = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    hole = [(0, 0), (2, 0), (2, 4), (0, 4), (0, 0)]  # the left half is cut out
    far = [(10, 0), (10, 2), (14, 2), (14, 0), (10, 0)]
    vertices = spark.createDataFrame(
        ring(0, 0, square) + ring(0, 1, hole) + ring(1, 0, far),
        "LocationID int, part int, ring int, seq int, x double, y double",
    )
    row = geometry.zone_centroids(vertices).first()
    assert geometry.zone_centroids(vertices, oriented=True).first() == pytest.approx(row)
    # Right half: area 8 at (3, 2); far part: area 8 at (12, 1).
    assert (row.x_ft, row.y_ft) == pytest.approx((7.5, 1.5))


def test_projection_reference_points(spark):
    df = spark.createDataFrame([(984250.0, 0.0), (988000.0, 211000.0)], "x_ft double, y_ft double")
    points = [(r.lon, r.lat) for r in geometry.with_lonlat(df).collect()]
    assert points[0] == pytest.approx((-74.0, 40.16666666666666), abs=1e-9)
    assert points[1] == pytest.approx((-73.986467, 40.745822), abs=1e-6)
    assert plane_to_lonlat is not None and not math.isnan(points[1][0])


def test_missing_centroid_means_no_distance(spark, sample):
    centroids = spark.createDataFrame([(A, 0.0, 0.0)], "LocationID int, x_ft double, y_ft double")
    out = routes.with_centroid_miles(sample, centroids)
    assert out.count() == sample.count()
    assert {r.distance_miles for r in out.select("distance_miles").distinct().collect()} == {0.0}
    assert out.where(F.col("distance_miles").isNull()).count() == 0


def shapes():
    """Zone -> parts -> rings without their closing vertex, and the centroid by hand."""
    square = [(0, 0), (0, 4), (4, 4), (4, 0)]
    left_half = [(0, 0), (2, 0), (2, 4), (0, 4)]  # shares three sides' worth of border with the square
    island = [(1, 1), (1, 3), (1.5, 3), (1.5, 1)]
    far = [(10, 0), (10, 2), (14, 2), (14, 0)]
    comb = [(0, 0), (9, 0), (9, 5), (7, 1), (5, 5), (3, 1), (1, 5)]
    return {
        1: ([[square, left_half], [far]], (7.5, 1.5)),
        2: ([[square, left_half, island]], ((8 * 3 + 1 * 1.25) / 9, 2.0)),  # an island in a hole
        3: ([[square, far]], ((16 * 2 + 8 * 12) / 24, (16 * 2 + 8 * 1) / 24)),  # two rings side by side
        4: ([[comb]], (4.591194968553459, 1.7169811320754718)),
    }


@pytest.mark.parametrize("seed", range(4))
def test_centroids_whatever_the_order_of_rings_and_vertices(spark, seed):
    import random

    chance = random.Random(seed)
    rows = []
    for zone, (parts, _) in shapes().items():
        for part, rings in enumerate(parts):
            numbers = chance.sample(range(10), len(rings))
            for number, ring in zip(numbers, rings):
                points = ring[chance.randrange(len(ring)) :] + ring
                points = points[: len(ring)][:: chance.choice((1, -1))]
                at = points.index(min(points))
                points = points[at:] + points[:at] + [points[at]] * chance.choice((0, 1))
                start = chance.randrange(-3, 3)
                rows += [(zone, part, number, start + k, float(x), float(y)) for k, (x, y) in enumerate(points)]
    chance.shuffle(rows)
    vertices = spark.createDataFrame(rows, "LocationID int, part int, ring int, seq int, x double, y double")
    found = {r.LocationID: (r.x_ft, r.y_ft) for r in geometry.zone_centroids(vertices).collect()}
    for zone, (_, centroid) in shapes().items():
        assert found[zone] == pytest.approx(centroid), zone


def test_a_gap_in_a_ring_is_refused(spark):
    rows = [(1, 0, 0, k, float(x), float(y)) for k, (x, y) in ((0, (0, 0)), (1, (0, 4)), (3, (4, 0)))]
    vertices = spark.createDataFrame(rows, "LocationID int, part int, ring int, seq int, x double, y double")
    with pytest.raises(Exception, match="without gaps"):
        geometry.zone_centroids(vertices).collect()


def test_outlines_made_from_a_small_table_meet_by_shuffle(spark):
    """Squares of 4 feet, one a zone, which Spark takes for as small as the ids they come from."""
    vertices = spark.range(300).selectExpr(
        "CAST(id AS INT) AS LocationID", "0 AS part", "0 AS ring", "id * 10D AS left",
        "inline(array((0, 0D, 0D), (1, 0D, 4D), (2, 4D, 4D), (3, 4D, 0D))) AS (seq, dx, y)",
    ).selectExpr("LocationID", "part", "ring", "seq", "left + dx AS x", "y")
    edges = geometry._edges(vertices.withColumnsRenamed({"x": "x0", "y": "y0"}))
    centroids = geometry.zone_centroids(vertices, oriented=True)
    for df in (edges, centroids):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert edges.count() == 4 * 300
    found = {r.LocationID: (r.x_ft, r.y_ft) for r in centroids.collect()}
    assert found == {k: pytest.approx((10 * k + 2, 2)) for k in range(300)}
    assert found == {r.LocationID: pytest.approx((r.x_ft, r.y_ft)) for r in geometry.zone_centroids(vertices).collect()}
