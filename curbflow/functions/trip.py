"""Per-trip columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AIRPORT_ZONES = (132, 138)


def touches(zones, start="PULocationID", end="DOLocationID") -> str:
    """SQL: either end lies in ``zones``; an unknown end counts as outside."""
    listed = ", ".join(str(int(zone)) for zone in zones)
    return f"(coalesce({start} IN ({listed}), false) OR coalesce({end} IN ({listed}), false))"


def route_key(start="PULocationID", end="DOLocationID") -> Column:
    """Text ``PU-DO``; NULL if an end is unknown."""
    return F.concat(F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def stadium_direction(zone: int, end="DOLocationID") -> Column:
    return F.when(F.col(end) == zone, "To_Stadium").otherwise("From_Stadium")


def speed_mph(miles: Column, hours: Column) -> Column:
    """Miles per hour, 0 where there is no positive duration or no value."""
    return F.coalesce(F.when(hours > 0, miles / hours), F.lit(0.0))


def significance(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, "Significant").otherwise("Not significant")


def strength(rho: Column) -> Column:
    size = F.abs(rho)
    return F.when(size > 0.7, "Strong").when(size > 0.3, "Moderate").otherwise("Weak")


def sign_label(rho: Column) -> Column:
    return F.when(rho > 0, "positive").otherwise("negative")
