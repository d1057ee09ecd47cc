"""Canonical trip schema and the column names each cab type uses for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAB_TYPES = ("yellow", "green", "fhv", "hvfhv")

# Canonical columns and their types, in output order.
CANONICAL = {
    "pickup_datetime": "timestamp_ntz",
    "dropoff_datetime": "timestamp_ntz",
    "PULocationID": "int",
    "DOLocationID": "int",
    "trip_distance": "double",
    "fare_amount": "double",
    "tip_amount": "double",
    "total_amount": "double",
    "Airport_fee": "double",
    "passenger_count": "int",
    "RatecodeID": "int",
    "payment_type": "int",
    "trip_type": "int",
    "VendorID": "int",
    "SR_Flag": "int",
    "trip_time": "bigint",
    "dispatching_base_num": "string",
    "Affiliated_base_number": "string",
    "hvfhs_license_num": "string",
    "request_datetime": "timestamp_ntz",
    "on_scene_datetime": "timestamp_ntz",
}

REQUIRED = ("pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID")
FILE_KEYS = ("cab_type", "file_year", "file_month")

# Published column name -> canonical name, per cab type.
RENAMES = {
    "yellow": {
        "tpep_pickup_datetime": "pickup_datetime",
        "tpep_dropoff_datetime": "dropoff_datetime",
        "airport_fee": "Airport_fee",
    },
    "green": {
        "lpep_pickup_datetime": "pickup_datetime",
        "lpep_dropoff_datetime": "dropoff_datetime",
    },
    "fhv": {
        "dropOff_datetime": "dropoff_datetime",
        "PUlocationID": "PULocationID",
        "DOlocationID": "DOLocationID",
    },
    "hvfhv": {
        "originating_base_num": "Affiliated_base_number",
        "PUlocationID": "PULocationID",
        "DOlocationID": "DOLocationID",
        "airport_fee": "Airport_fee",
        "trip_miles": "trip_distance",
        "base_passenger_fare": "fare_amount",
        "tips": "tip_amount",
        "driver_pay": "total_amount",
    },
}

# Columns that cleaning leaves out, per cab type.
UNWANTED = {
    "yellow": (
        "VendorID", "store_and_fwd_flag", "improvement_surcharge", "mta_tax", "extra",
        "congestion_surcharge", "tolls_amount",
    ),
    "green": (
        "VendorID", "store_and_fwd_flag", "improvement_surcharge", "mta_tax", "extra",
        "congestion_surcharge", "ehail_fee", "tolls_amount",
    ),
    "fhv": (),
    "hvfhv": (
        "bcf", "sales_tax", "wav_request_flag", "wav_match_flag", "shared_request_flag",
        "shared_match_flag", "access_a_ride_flag", "congestion_surcharge", "tolls",
    ),
}


def require_columns(df: DataFrame, columns=REQUIRED) -> DataFrame:
    """Raise on the lazy schema, before any data is read, if a column is missing."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; found {df.columns}")
    return df


def normalise(df: DataFrame, cab_type: str, drop_unwanted: bool = False) -> DataFrame:
    """Bring one cab type's published columns to canonical names and types.

    Unwanted columns go before the renames. NaN in a float column becomes NULL,
    because Spark orders NaN above every number and a range test would keep it.
    """
    if drop_unwanted:
        df = df.drop(*UNWANTED[cab_type])
    present = set(df.columns)
    df = df.withColumnsRenamed(
        {raw: name for raw, name in RENAMES[cab_type].items() if raw in present and name not in present}
    )
    require_columns(df)
    columns = []
    for field in df.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        wanted = CANONICAL.get(field.name)
        if wanted and field.dataType.simpleString() != wanted:
            value = value.cast(wanted)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def empty_trips(spark, columns=None) -> DataFrame:
    """A typed frame without rows, for patterns that match no readable file."""
    names = [n for n in CANONICAL if columns is None or n in columns]
    ddl = ", ".join(f"`{n}` {CANONICAL[n]}" for n in names)
    return spark.createDataFrame([], ddl)
