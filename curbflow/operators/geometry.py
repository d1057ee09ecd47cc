"""Zone geometry on vertex tables (one row per vertex, plane feet)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projection import plane_to_lonlat
from ..session import cut

_RING = ("LocationID", "part", "ring")
_PART = ("LocationID", "part")
# Feet within which two crossings count as one.
_TOUCH = 1e-6


def _edges(local: DataFrame) -> DataFrame:
    """Every edge of every ring, the one from its last vertex back to its first included.

    A vertex is joined to its successor by ring and ``seq``, hence a zone with a huge
    outline is spread like any other. Outlines are never shipped whole to every task, as
    Spark would when the files they are made from look small. The closing edge of a ring
    that repeats its first vertex has no length. ``n`` is the ring's number of vertices on
    that edge, else NULL.
    """
    successor = local.selectExpr(*_RING, "seq - 1 AS seq", "x0 AS x1", "y0 AS y1")
    inner = local.join(successor.hint("merge"), [*_RING, "seq"]).selectExpr(
        *_RING, "x0", "y0", "x1", "y1", "CAST(NULL AS BIGINT) AS n"
    )
    closing = local.groupBy(*_RING).agg(
        F.max_by("x0", "seq").alias("x0"), F.max_by("y0", "seq").alias("y0"),
        F.min_by("x0", "seq").alias("x1"), F.min_by("y0", "seq").alias("y1"), F.count(F.lit(1)).alias("n"),
    )
    return inner.unionByName(closing)


def _depths(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """How many larger rings of its part hold each ring, for parts of several rings.

    The point asked about lies just right of the ring's leftmost edge, half-way between its
    lowest and next vertex heights, where no vertex of its own is near. A ring holds it
    if an odd number of its edges pass to the right at that height. Edges and points
    meet by bands of height, of which an edge touches two at most.
    """
    several = rings.groupBy(*_PART).agg(
        F.count(F.lit(1)).alias("_rings"), F.max("_tall").alias("_band")
    ).where("_rings > 1 AND _band > 0")
    inside = edges.join(several.select(*_PART, "_band"), [*_PART]).join(
        rings.selectExpr(*_RING, "_low", "abs(_a) AS _size"), [*_RING]
    )
    level = inside.where("y0 > _low").groupBy(*_RING).agg(((F.min("y0") + F.first("_low")) / 2).alias("_y"))
    # Lower end first, so that an edge shared by two rings is crossed at the same place.
    across = (
        "CASE WHEN y0 < y1 THEN x0 + (_y - y0) * (x1 - x0) / (y1 - y0) ELSE x1 + (_y - y1) * (x0 - x1) / (y0 - y1) END"
    )
    points = (
        inside.join(level, [*_RING]).where("(y0 > _y) <> (y1 > _y)")
        .groupBy(*_RING, "_y", "_band", "_size").agg(F.expr(f"min({across})").alias("_x"))
        .selectExpr(*_PART, "ring AS _held", "_x", "_y", "_size AS _held_size", "CAST(floor(_y / _band) AS BIGINT) AS _at")
    )
    banded = inside.selectExpr(
        *_RING, "x0", "y0", "x1", "y1", "_size",
        "explode(sequence(CAST(floor(least(y0, y1) / _band) AS BIGINT), CAST(floor(greatest(y0, y1) / _band) AS BIGINT))) AS _at",
    )
    crossed = banded.join(points, [*_PART, "_at"]).where(
        f"_size > _held_size AND (y0 > _y) <> (y1 > _y) AND {across} > _x + {_TOUCH}D"
    )
    holders = crossed.groupBy(*_PART, "_held", "ring").agg((F.count(F.lit(1)) % 2).alias("_odd"))
    return holders.groupBy(*_PART, "_held").agg(F.sum("_odd").alias("_depth")).withColumnRenamed("_held", "ring")


def zone_centroids(vertices: DataFrame, oriented: bool = False) -> DataFrame:
    """Area-weighted centroid per zone over all parts, whatever the order of the outlines.

    A ring may run either way, be closed or not, and stand anywhere in its part: one that
    lies within an odd number of larger rings of its part is a hole and counts negative.
    ``oriented`` spares the search for outlines known to let holes run against their
    outer ring. ``seq`` must run without gaps, which is checked. Sums combine before the shuffle, and
    coordinates are taken relative to one corner of the map to keep precision.
    """
    left = vertices.agg(F.min("x")).scalar()
    bottom = vertices.agg(F.min("y")).scalar()
    local = vertices.select(
        *_RING, "seq", (F.col("x") - left).alias("x0"), (F.col("y") - bottom).alias("y0")
    )
    edges = _edges(local) if oriented else cut(_edges(local))
    turn = "(x0 * y1 - x1 * y0)"
    rings = edges.groupBy(*_RING).agg(
        F.expr(f"sum{turn}").alias("_a"), F.expr(f"sum((x0 + x1) * {turn})").alias("_mx"),
        F.expr(f"sum((y0 + y1) * {turn})").alias("_my"), F.min("y0").alias("_low"),
        F.max(F.abs(F.col("y1") - F.col("y0"))).alias("_tall"),
        F.count(F.lit(1)).alias("_edges"), F.max("n").alias("_n"),
    )
    gaps = F.raise_error(F.lit("the vertices of a ring are not numbered without gaps"))
    sign = F.lit(1.0)
    if not oriented:
        rings = cut(rings)
        rings = rings.join(_depths(edges, rings), list(_RING), "left")
        sign = F.signum("_a") * F.when(F.col("_depth") % 2 == 1, -1.0).otherwise(1.0)
    signed = rings.withColumn("_sign", F.when(F.col("_edges") == F.col("_n"), sign).otherwise(gaps.cast("double")))
    sums = signed.groupBy("LocationID").agg(
        *[F.sum(F.col("_sign") * F.col(name)).alias(name) for name in ("_a", "_mx", "_my")]
    )
    return sums.where("_a <> 0").select(
        "LocationID",
        (left + F.col("_mx") / (3 * F.col("_a"))).alias("x_ft"),
        (bottom + F.col("_my") / (3 * F.col("_a"))).alias("y_ft"),
    )


def with_lonlat(df: DataFrame, x: str = "x_ft", y: str = "y_ft") -> DataFrame:
    """Add ``lon`` and ``lat`` to any table of plane points, vertices included."""
    lon, lat = plane_to_lonlat(F.col(x), F.col(y))
    return df.withColumns({"lon": lon, "lat": lat})
