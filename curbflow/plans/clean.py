"""The four cleaning pipelines, all months at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import (
    Cleaned, Step, absolute, allowed, at_least, nonzero_length, of_file_month, run_together, within,
)
from ..schema import UNWANTED

# Accepted airport fees, passenger and rate-code ranges, trip types, minimums.
AIRPORT_FEES = (0.0, 1.25, 1.75)
PASSENGERS = (1, 6)
RATE_CODES = (1, 6)
TRIP_TYPES = (1, 2)
MIN_DISTANCE = 0.1
MIN_FARE = 3.0


def _fence(column: str) -> Step:
    return Step(f"fence {column}", fence_on=column)


def _present(column: str) -> Step:
    return Step(f"{column} present", f"{column} IS NOT NULL")


def _money(minimums: bool) -> list[Step]:
    """Distance, fare and tip steps; the minimums apply only on request."""
    floor = {
        "trip_distance": Step("minimum trip_distance", at_least("trip_distance", MIN_DISTANCE)),
        "fare_amount": Step("minimum fare_amount", at_least("fare_amount", MIN_FARE)),
    }
    steps = []
    for column in ("trip_distance", "fare_amount", "tip_amount"):
        if minimums and column in floor:
            steps.append(floor[column])
        steps.append(_fence(column))
    return steps


def cleaning_steps(cab_type: str, year: int = 2024, minimums: bool = False) -> list[Step]:
    """Ordered steps of one cab type."""
    month = Step("file month", of_file_month("pickup_datetime", year))
    length = Step("nonzero length", nonzero_length())
    fee = Step("airport fee", allowed("Airport_fee", AIRPORT_FEES))
    passengers = Step("passenger count", within("passenger_count", *PASSENGERS))
    rate = Step("rate code", within("RatecodeID", *RATE_CODES))
    if cab_type == "yellow":
        return [
            month, length, *_money(minimums), fee, _fence("total_amount"), passengers, rate,
        ]
    if cab_type == "green":
        return [
            month, length, *_money(minimums), _fence("total_amount"), passengers, rate,
            Step("trip type", allowed("trip_type", TRIP_TYPES)),
        ]
    if cab_type == "fhv":
        # Month of the pick-up but year of the drop-off: a missing drop-off fails here.
        by_dropoff = of_file_month("pickup_datetime", year, year_of="dropoff_datetime")
        return [
            Step("file month", by_dropoff), length,
            _present("Affiliated_base_number"), _present("dispatching_base_num"),
        ]
    if cab_type == "hvfhv":
        return [
            _present("hvfhs_license_num"), _present("Affiliated_base_number"),
            _present("dispatching_base_num"), month, length, fee, *_money(minimums),
            _fence("total_amount"),
            Step("request month", of_file_month("request_datetime", year)),
            Step("scene month", of_file_month("on_scene_datetime", year)),
        ]
    raise ValueError(f"unknown cab type {cab_type!r}")


def clean_together(trips: DataFrame, cab_types, year: int = 2024, minimums: bool = False) -> dict[str, Cleaned]:
    """Clean several cab types, each by its own steps (all files at once, fences per file).

    The cab types share their fence rounds, so four of them take as many jobs as one.
    """
    runs = {}
    for cab_type in cab_types:
        mine = trips.where(F.col("cab_type") == cab_type).drop(*UNWANTED[cab_type])
        runs[cab_type] = (absolute(mine), cleaning_steps(cab_type, year, minimums))
    return run_together(runs)


def clean(trips: DataFrame, cab_type: str, year: int = 2024, minimums: bool = False) -> Cleaned:
    """Clean one cab type's canonical trips."""
    return clean_together(trips, [cab_type], year, minimums)[cab_type]


def clean_yellow(trips, year: int = 2024, minimums: bool = False) -> Cleaned:
    return clean(trips, "yellow", year, minimums)


def clean_green(trips, year: int = 2024, minimums: bool = False) -> Cleaned:
    return clean(trips, "green", year, minimums)


def clean_fhv(trips, year: int = 2024, minimums: bool = False) -> Cleaned:
    return clean(trips, "fhv", year, minimums)


def clean_hvfhv(trips, year: int = 2024, minimums: bool = False) -> Cleaned:
    return clean(trips, "hvfhv", year, minimums)
