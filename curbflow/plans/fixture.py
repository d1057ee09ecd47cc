"""Trip, zone and schedule tables derived from the given tables.

Column expressions are SQL text that Spark and DuckDB read alike, apart from the
name of the zoneless timestamp type; ``{ntz}`` stands for it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import zone_centroids as centroids_of
from ..schema import FILE_KEYS, RENAMES
from ..session import files_kept_open, fresh_path, settle
from ..sources.dimensions import parse_schedule, read_zone_vertices

STADIUM = 140
DROPOFF = 133
YEAR = 2024

_PICKUP = (
    "CASE WHEN event_id % 503 = 0 THEN NULL"
    " WHEN event_id % 307 = 0 THEN ts - INTERVAL '365' DAY"
    " ELSE ts + CAST(event_id % 12 AS INT) * INTERVAL '30' DAY END"
)

# Level 0 reads events, level 1 may use level 0.
TRIP_COLUMNS = {
    "trip_id": "event_id",
    "cab_type": (
        "CASE event_type WHEN 'view' THEN 'yellow' WHEN 'click' THEN 'green'"
        " WHEN 'signup' THEN 'fhv' ELSE 'hvfhv' END"
    ),
    "pickup_datetime": f"CAST({_PICKUP} AS {{ntz}})",
    "dropoff_datetime": (
        "CAST(CASE WHEN event_id % 211 = 0 THEN NULL"
        f" ELSE {_PICKUP} + (CAST(floor(value * 20) AS INT) - 5) * INTERVAL '1' SECOND END AS {{ntz}})"
    ),
    "PULocationID": (
        "CASE WHEN event_id % 97 = 0 THEN NULL WHEN user_id % 20 = 19 THEN 160"
        " ELSE CAST(user_id % 20 + 128 AS INT) END"
    ),
    "DOLocationID": (
        "CASE WHEN (event_id * 7 + user_id) % 20 = 19 THEN 160"
        " ELSE CAST((event_id * 7 + user_id) % 20 + 128 AS INT) END"
    ),
    "trip_distance": (
        "CASE WHEN event_type = 'signup' OR event_id % 101 = 0 THEN NULL"
        " WHEN event_id % 50 = 0 THEN -CAST(event_id % 40 AS DOUBLE) / 4"
        " ELSE CAST(event_id % 40 AS DOUBLE) / 4 END"
    ),
    "fare_amount": "CASE WHEN event_id % 61 = 0 THEN -value ELSE value END",
    "tip_amount": "CAST(event_id % 13 AS DOUBLE) / 2",
    "total_amount": "CASE WHEN event_id % 73 = 0 THEN NULL ELSE value * 1.25 END",
    "Airport_fee": (
        "CAST(CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 1.25 WHEN 2 THEN 1.75"
        " WHEN 3 THEN -1.25 ELSE 2.5 END AS DOUBLE)"
    ),
    "passenger_count": "CAST(event_id % 8 AS INT)",
    "RatecodeID": "CAST(event_id % 7 + 1 AS INT)",
    "payment_type": "CAST(event_id % 6 + 1 AS INT)",
    "trip_type": "CAST(event_id % 4 AS INT)",
    "VendorID": "CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(event_id % 2 + 1 AS INT) END",
    "SR_Flag": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE NULL END",
    "trip_time": "CAST(floor(value * 20) AS BIGINT)",
    "dispatching_base_num": (
        "CASE WHEN event_id % 83 = 0 THEN NULL ELSE concat('B', CAST(user_id % 9 AS {text})) END"
    ),
    "Affiliated_base_number": (
        "CASE WHEN event_id % 71 = 0 THEN NULL ELSE concat('B', CAST(user_id % 7 AS {text})) END"
    ),
    "hvfhs_license_num": (
        "CASE WHEN event_id % 79 = 0 THEN NULL ELSE concat('HV', CAST(user_id % 4 AS {text})) END"
    ),
    "request_datetime": f"CAST({_PICKUP} - INTERVAL '300' SECOND AS {{ntz}})",
    "on_scene_datetime": (
        f"CAST(CASE WHEN event_id % 67 = 0 THEN NULL ELSE {_PICKUP} - INTERVAL '100' SECOND END AS {{ntz}})"
    ),
}
# One trip in 53 sits in the following month's file.
FILE_COLUMNS = {
    "file_year": str(YEAR),
    "file_month": (
        "CAST(CASE WHEN trip_id % 53 = 0 THEN coalesce(month(pickup_datetime), 1) % 12 + 1"
        " ELSE coalesce(month(pickup_datetime), 1) END AS INT)"
    ),
}

# Quasi-identifiers of thirty combinations per month, for classes of two, three and more.
DENSE_COLUMNS = {
    "pickup_datetime": (
        "CASE WHEN trip_id % 41 = 0 THEN NULL ELSE CAST('2024-01-01 00:10:00' AS {ntz})"
        " + CAST(file_month - 1 AS INT) * INTERVAL '30' DAY + CAST(trip_id % 5 AS INT) * INTERVAL '1' HOUR END"
    ),
    "dropoff_datetime": (
        "CAST('2024-01-01 00:40:00' AS {ntz})"
        " + CAST(file_month - 1 AS INT) * INTERVAL '30' DAY + CAST(trip_id % 2 AS INT) * INTERVAL '1' HOUR"
    ),
    "PULocationID": "CAST(trip_id % 2 + 128 AS INT)",
    "DOLocationID": "CAST(trip_id % 3 + 130 AS INT)",
}

# Times of which some files need no coarsening, some minutes and some hours, on one or both sides.
TIMED_COLUMNS = {
    "pickup_datetime": (
        "CAST('2024-01-01 00:00:00' AS {ntz}) + CAST(trip_id % 2 AS INT) * INTERVAL '1' HOUR"
        " + CAST(CASE WHEN file_month % 3 = 0 THEN trip_id % 3000 WHEN file_month % 3 = 1 THEN trip_id % 50 ELSE 0 END AS INT)"
        " * INTERVAL '1' SECOND"
    ),
    "dropoff_datetime": (
        "CAST('2024-01-01 02:00:00' AS {ntz})"
        " + CAST(CASE WHEN file_month % 4 = 0 THEN trip_id % 3500 WHEN file_month % 4 = 1 THEN trip_id % 58 ELSE 0 END AS INT)"
        " * INTERVAL '1' SECOND"
    ),
    "PULocationID": "CAST(trip_id % 2 + 128 AS INT)",
    "DOLocationID": "CASE WHEN trip_id % 1000 = 0 THEN CAST(NULL AS INT) ELSE CAST(130 AS INT) END",
}

# Zone 160 has trips but no zone row; 147 to 152 have a row but no trips.
ZONE_COLUMNS = {
    "LocationID": "CAST(n_nationkey + 128 AS INT)",
    "Borough": "r_name",
    "Zone": "n_name",
    "service_zone": "CASE WHEN n_nationkey % 4 = 0 THEN 'N/A' ELSE 'Boro Zone' END",
}

# Every customer is one part of its zone's outline: a five-cornered ring, closed,
# and for every seventh customer a hole of the opposite orientation.
PART_COLUMNS = {
    "LocationID": "CAST(c_nationkey + 128 AS INT)",
    "part": "CAST(c_custkey AS INT)",
    "ox": (
        "CAST(980000 + ((c_nationkey + 128) * 7919) % 60000 + (c_custkey * 37) % 9000 AS DOUBLE)"
    ),
    "oy": (
        "CAST(180000 + ((c_nationkey + 128) * 104729) % 70000 + (c_custkey * 91) % 7000 AS DOUBLE)"
    ),
    "w": "CAST(200 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 300 AS DOUBLE)",
    "hole": "CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END",
}
# Corner offsets as multiples of w: outer ring clockwise, hole counter-clockwise.
RING_CORNERS = {
    0: ((0.0, 0.0), (0.0, 1.0), (0.5, 1.5), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)),
    1: ((0.25, 0.25), (0.5, 0.25), (0.5, 0.75), (0.25, 0.75), (0.25, 0.25)),
}

# A schedule drawn from the trips: dates whose trip count divides by three get an
# event at a time made from that count and the highest trip number.
GAME_COLUMNS = {
    "Date": "CAST(d AS {text})",
    "start_time": (
        "concat(CAST(1 + top % 11 AS {text}), ':', lpad(CAST((n % 12) * 5 AS {text}), 2, '0'), ' PM')"
    ),
    "Visitor": "concat('Visitor ', CAST(n % 7 AS {text}))",
}


def _spark(columns: dict[str, str]) -> list[str]:
    return [
        f"{text.format(ntz='TIMESTAMP_NTZ', text='STRING')} AS `{name}`" for name, text in columns.items()
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical trips with ``trip_id`` and file keys, computed from the events table."""
    base = table(spark, sf_dir, "events").selectExpr(*_spark(TRIP_COLUMNS))
    return base.selectExpr("*", *_spark(FILE_COLUMNS))


_stored: dict[tuple[str, str, str], tuple[str, object]] = {}
# Files a task keeps open at a time; each buffers a row group, together as much as one of the usual size.
OPEN_FILES = 4
ROW_GROUP = 128 * 2**20 // OPEN_FILES


def _stored_once(spark: SparkSession, sf_dir: str, label: str, derive, *partition_by: str) -> DataFrame:
    """``derive()`` as a table, written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _stored:
        with files_kept_open(spark, OPEN_FILES):
            derived, path = derive(), fresh_path(spark, label)
            derived.write.partitionBy(*partition_by).option("parquet.block.size", ROW_GROUP).parquet(path)
        _stored[key] = (path, derived.schema)
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived trips as a stored table, as trip files are in practice.

    Filters and column choices of the queries then reach the Parquet scan.
    """
    return _stored_once(spark, sf_dir, "trips", lambda: derive_trips(spark, sf_dir), "cab_type")


def trips_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the stored trips, for readers of files."""
    trips(spark, sf_dir)
    return _stored[(spark.sparkContext.applicationId, sf_dir, "trips")][0]


def raw_trips(spark: SparkSession, sf_dir: str, cab_type: str) -> DataFrame:
    """One cab type's trips under its published column names, with columns nobody wants."""
    mine = trips(spark, sf_dir).where(F.col("cab_type") == cab_type)
    by_canonical: dict[str, str] = {}
    for raw, canonical in RENAMES[cab_type].items():
        by_canonical.setdefault(canonical, raw)
    kept = {
        "yellow": ("VendorID", "passenger_count", "RatecodeID", "payment_type"),
        "green": ("VendorID", "passenger_count", "RatecodeID", "payment_type", "trip_type"),
        "fhv": ("SR_Flag", "dispatching_base_num", "Affiliated_base_number"),
        "hvfhv": (
            "trip_time", "hvfhs_license_num", "dispatching_base_num", "Affiliated_base_number",
            "request_datetime", "on_scene_datetime",
        ),
    }[cab_type]
    amounts = () if cab_type == "fhv" else (
        "trip_distance", "fare_amount", "tip_amount", "total_amount",
        *(() if cab_type == "green" else ("Airport_fee",)),
    )
    columns = ["pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID", *amounts, *kept]
    extra = {
        "yellow": {"mta_tax": F.lit(0.5), "store_and_fwd_flag": F.lit("N")},
        "green": {"ehail_fee": F.lit(None).cast("double"), "extra": F.lit(0.0)},
        "fhv": {},
        "hvfhv": {"bcf": F.lit(0.0), "tolls": F.lit(0.0), "wav_match_flag": F.lit("N")},
    }[cab_type]
    return mine.select(
        "trip_id", "file_month",
        *[F.col(c).alias(by_canonical.get(c, c)) for c in columns],
        *[value.alias(name) for name, value in extra.items()],
    )


# Patterns of the monthly folders written below.
MONTHLY_PATTERN = {
    cab: f"{cab}/file={cab}_tripdata_{{year}}-{{month:02d}}.parquet"
    for cab in ("yellow", "green", "fhv", "hvfhv")
}


def monthly_files(spark: SparkSession, sf_dir: str) -> str:
    """Root folder of each cab type's raw trips, written as monthly files once."""
    key = (spark.sparkContext.applicationId, sf_dir, "monthly")
    if key not in _stored:
        root = fresh_path(spark, "monthly")
        for cab_type in MONTHLY_PATTERN:
            name = F.format_string(f"{cab_type}_tripdata_{YEAR}-%02d.parquet", "file_month")
            (
                raw_trips(spark, sf_dir, cab_type).withColumn("file", name).drop("file_month")
                .write.partitionBy("file").parquet(f"{root}/{cab_type}")
            )
        _stored[key] = (root, None)
    return _stored[key][0]


# Files spoilt in a second set of monthly files: cab type, month, what is wrong.
SPOILT = (("green", 2, "junk"), ("fhv", 3, "empty"), ("hvfhv", 4, "damaged"), ("yellow", 5, "flipped"))


def _end_of_last_page(content: bytes) -> int:
    """Place of the last byte of a file's last page, which is part of a value."""
    group = pq.ParquetFile(pa.BufferReader(content)).metadata.row_group(0)
    column = group.column(group.num_columns - 1)
    first = min(p for p in (column.dictionary_page_offset, column.data_page_offset) if p)
    return first + column.total_compressed_size - 1


def spoilt_files(spark: SparkSession, sf_dir: str) -> str:
    """As ``monthly_files``, with one file of junk, one empty, one with a page that cannot be
    read and one with a page that still decodes, to another value."""
    key = (spark.sparkContext.applicationId, sf_dir, "spoilt")
    if key not in _stored:
        sound, root = monthly_files(spark, sf_dir), fresh_path(spark, "spoilt")
        place = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        system = place(root).getFileSystem(conf)
        system.mkdirs(place(root))
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(
            place(sound).getFileSystem(conf), place(sound), system, place(root), False, conf
        )
        root = f"{root}/{sound.rsplit('/', 1)[-1]}"
        for cab, month, how in SPOILT:
            folder = place(f"{root}/{cab}/file={cab}_tripdata_{YEAR}-{month:02d}.parquet")
            for status in system.listStatus(folder):
                path = status.getPath()
                content = bytearray(b"not a table")
                if how in ("damaged", "flipped"):
                    source = system.open(path)
                    content = bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
                    source.close()
                    if how == "damaged":
                        content[4:52] = bytes([255]) * 48  # the first page; the footer stays whole
                    else:
                        content[_end_of_last_page(bytes(content))] ^= 1
                out = system.create(path, True)
                if how != "empty":
                    out.write(content)
                out.close()
        _stored[key] = (root, None)
    return _stored[key][0]


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.selectExpr(*_spark(ZONE_COLUMNS))


def zone_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "customer").selectExpr(*_spark(PART_COLUMNS))
    corners = F.array(
        *[
            F.struct(
                F.lit(ring).alias("ring"), F.lit(seq).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")
            )
            for ring, shape in RING_CORNERS.items()
            for seq, (dx, dy) in enumerate(shape)
        ]
    )
    return (
        parts.select("*", F.inline(corners)).where("ring <= hole")
        .selectExpr("LocationID", "part", "ring", "seq", "ox + dx * w AS x", "oy + dy * w AS y")
    )


def dense_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).selectExpr("trip_id", *FILE_KEYS, *_spark(DENSE_COLUMNS))


def timed_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).selectExpr("trip_id", *FILE_KEYS, *_spark(TIMED_COLUMNS))


def stored_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone outlines read from a stored table, as they arrive."""
    _stored_once(spark, sf_dir, "vertices", lambda: zone_vertices(spark, sf_dir))
    return read_zone_vertices(spark, _stored[(spark.sparkContext.applicationId, sf_dir, "vertices")][0])


def signature(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Changes when a table's files do: a hash of their names, sizes and times."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = "|".join(
        f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in system.listStatus(place)
    )
    return hashlib.md5(f"{sf_dir}|{listed}".encode()).hexdigest()


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One centroid per zone row, stored as the dimension table it is in practice."""

    def derive() -> DataFrame:
        listed = zones(spark, sf_dir).select("LocationID")
        return centroids_of(stored_vertices(spark, sf_dir), oriented=True).join(listed, "LocationID", "left_semi")

    return settle(_stored_once(spark, sf_dir, "centroids", derive))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event schedule as texts, the way it arrives."""
    days = (
        trips(spark, sf_dir).where("pickup_datetime IS NOT NULL")
        .groupBy(F.to_date("pickup_datetime").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("trip_id").alias("top"))
        .where("n % 3 = 0")
    )
    return days.selectExpr(*_spark(GAME_COLUMNS))


# One event a zone and day, for days whose trip count there divides by three.
ZONE_GAME = "CAST(d AS {ntz}) + CAST(n % 12 AS INT) * INTERVAL '1' HOUR"


def zone_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per drop-off zone, with their start."""
    days = (
        trips(spark, sf_dir).where("pickup_datetime IS NOT NULL AND DOLocationID IS NOT NULL")
        .groupBy("DOLocationID", F.to_date("pickup_datetime").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n % 3 = 0")
    )
    return days.selectExpr("DOLocationID", *_spark({"game_datetime": ZONE_GAME}))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored schedule with parsed start times, as a settled join side."""
    listed = _stored_once(spark, sf_dir, "schedule", lambda: schedule(spark, sf_dir))
    return settle(parse_schedule(listed))
