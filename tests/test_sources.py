import os

import pytest
from pyspark.sql import functions as F

from curbflow.sources import dimensions, trips as files
from curbflow.streaming import incremental


def month(spark, n, start="2024-01-01 00:00:00", wide=False):
    t = F.lit(start).cast("timestamp_ntz")
    zone = (F.col("id") % 5 + 130).cast("bigint" if wide else "int")
    return spark.range(n).select(
        t.alias("tpep_pickup_datetime"), (t + F.expr("INTERVAL '60' SECOND")).alias("tpep_dropoff_datetime"),
        zone.alias("PULocationID"), zone.alias("DOLocationID"),
        F.col("id").cast("double" if wide else "int").alias("VendorID"), F.lit(3.5).alias("total_amount"),
    )


def test_missing_broken_and_drifting_months(spark, tmp_path):
    root = str(tmp_path)
    month(spark, 3).coalesce(1).write.parquet(f"{root}/yellow_tripdata_2024-01.parquet")
    month(spark, 4, "2024-02-01 00:00:00", wide=True).coalesce(1).write.parquet(
        f"{root}/yellow_tripdata_2024-02.parquet"
    )
    (tmp_path / "yellow_tripdata_2024-03.parquet").write_bytes(b"")
    (tmp_path / "yellow_tripdata_2024-04.parquet").write_bytes(b"not parquet at all")
    with pytest.warns(UserWarning, match="no readable file"):
        trips = files.read_trips(spark, root, ["yellow"], row_ids=True)
    counts = {r.file_month: r.n for r in trips.groupBy("file_month").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 3, 2: 4}
    assert dict(trips.dtypes)["PULocationID"] == "int"
    assert trips.select("source_file", "source_row").distinct().count() == 7
    shares = files.file_row_counts(trips).collect()
    assert {(r.file_month, r.file_rows, r.type_rows, r.type_share) for r in shares} == {(1, 3, 7, 1.0), (2, 4, 7, 1.0)}


def spoil(folder):
    """Overwrite the first page of a file; its footer stays whole."""
    path = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    content = bytearray(open(f"{folder}/{path}", "rb").read())
    content[4:52] = bytes([255]) * 48
    with open(f"{folder}/{path}", "wb") as out:
        out.write(content)
    for crc in [f for f in os.listdir(folder) if f.endswith(".crc")]:
        os.rename(f"{folder}/{crc}", f"{folder}/_{crc}")


def test_damage_fails_or_drops_the_file_whole(spark, tmp_path):
    root = str(tmp_path)
    month(spark, 3).coalesce(1).write.parquet(f"{root}/yellow_tripdata_2024-01.parquet")
    month(spark, 4).coalesce(1).write.parquet(f"{root}/yellow_tripdata_2024-02.parquet")
    spoil(f"{root}/yellow_tripdata_2024-02.parquet")
    with pytest.warns(UserWarning, match="no readable file"):
        trips = files.read_trips(spark, root, ["yellow"])
    with pytest.raises(Exception):  # noqa: B017 the reader's own error type is not ours to name
        trips.collect()
    with pytest.warns(UserWarning, match="left out .*damaged"):
        kept = files.read_trips(spark, root, ["yellow"], on_bad_file="skip")
    assert {r.file_month for r in kept.collect()} == {1} and kept.count() == 3
    listed = files.file_manifest(spark, root, ["yellow"], deep=True)
    assert [(f["file_month"], f["rows"], (f["error"] or "").split(":")[0]) for f in listed] == [(1, 3, ""), (2, 0, "damaged")]


def test_drift_within_one_month_and_empty_tables(spark, tmp_path):
    folder = f"{tmp_path}/yellow_tripdata_2024-01.parquet"
    month(spark, 3).coalesce(1).write.parquet(folder)
    month(spark, 4, wide=True).coalesce(1).write.mode("append").parquet(folder)
    month(spark, 1).where("false").write.mode("append").parquet(folder)
    trips = files.read_trips(spark, str(tmp_path), ["yellow"], months=[1])
    assert trips.count() == 7 and dict(trips.dtypes)["PULocationID"] == "int"
    assert all(f["error"] is None for f in files.file_manifest(spark, str(tmp_path), ["yellow"]))


def test_no_file_gives_an_empty_typed_frame(spark, tmp_path):
    with pytest.warns(UserWarning):
        trips = files.read_trips(spark, str(tmp_path), ["green"])
    assert trips.count() == 0
    assert dict(trips.dtypes)["pickup_datetime"] == "timestamp_ntz"
    assert "cab_type" in trips.columns


def test_pruned_scan_reads_named_columns_only(spark, tmp_path):
    month(spark, 3).write.parquet(f"{tmp_path}/yellow_tripdata_2024-01.parquet")
    trips = files.read_trips(spark, str(tmp_path), ["yellow"], columns=["total_amount"], months=[1])
    assert trips.columns == ["total_amount", "cab_type", "file_year", "file_month"]
    plan = trips._jdf.queryExecution().executedPlan().toString()
    assert "VendorID" not in plan.split("ReadSchema")[1]


def test_monthly_sink_replaces_only_its_partitions(spark, tmp_path):
    root = str(tmp_path / "table")
    trips = spark.range(6).select(
        F.lit("yellow").alias("cab_type"), F.lit(2024).alias("file_year"),
        (F.col("id") % 2 + 1).cast("int").alias("file_month"), "id",
    )
    files.write_monthly(trips, root)
    files.write_monthly(trips.where("file_month = 2 AND id < 3"), root)
    back = files.read_monthly(spark, root)
    counts = {r.file_month: r.n for r in back.groupBy("file_month").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 3, 2: 1}


def test_write_once_keeps_the_first_and_repairs_an_aborted_write(spark, tmp_path):
    path = str(tmp_path / "once")
    os.makedirs(path)  # what an aborted job leaves behind: a folder without marker
    assert files.write_once(spark.range(3).toDF("n"), path).count() == 3
    assert files.write_once(spark.range(9).toDF("n"), path).count() == 3


def test_dimension_files(spark, tmp_path):
    zones = tmp_path / "zones.csv"
    zones.write_text('"LocationID","Borough","Zone","service_zone"\n1,"EWR","Newark, Airport","EWR"\n264,"Unknown","N/A","N/A"\n')
    got = {r.LocationID: r.Zone for r in dimensions.read_zone_dim(spark, str(zones)).collect()}
    assert got == {1: "Newark, Airport", 264: "N/A"}
    games = tmp_path / "games.csv"
    games.write_text("Date,Start Time (EDT),Visitor\n2024-04-05,1:05 PM,A\n2024-04-06,12:35 AM,B\n")
    starts = [str(r.game_datetime) for r in dimensions.read_schedule(spark, str(games)).orderBy("Date").collect()]
    assert starts == ["2024-04-05 13:05:00", "2024-04-06 00:35:00"]


def test_running_totals_continue_and_equal_the_batch(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = "pickup_datetime timestamp_ntz, VendorID int, total_amount double"

    def arrive(hour, n):
        month(spark, n, f"2024-01-01 {hour:02d}:00:00").select(
            F.col("tpep_pickup_datetime").alias("pickup_datetime"), "VendorID", "total_amount"
        ).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = incremental.stream_trips(spark, src, schema)
        return {r.hour: r.trips for r in incremental.run_incremental(stream, incremental.hourly_totals, out, state).collect()}

    arrive(1, 5), arrive(2, 3)
    assert run() == {1: 5, 2: 3}
    arrive(2, 4)
    assert run() == {1: 5, 2: 7}
    assert run() == {1: 5, 2: 7}  # nothing new arrived
    batch = incremental.hourly_totals(spark.read.schema(schema).parquet(src))
    assert {r.hour: r.trips for r in batch.collect()} == {1: 5, 2: 7}


def test_latest_before_the_first_batch(spark, tmp_path):
    assert incremental.latest(spark, str(tmp_path / "none"), "hour int, trips bigint").count() == 0


def test_a_flipped_bit_that_still_decodes_is_found(spark, tmp_path):
    import pyarrow.parquet as pq

    root = str(tmp_path)
    for n in (1, 2):
        month(spark, 50).coalesce(1).write.option("compression", "none").parquet(f"{root}/yellow_tripdata_2024-0{n}.parquet")
    folder = f"{root}/yellow_tripdata_2024-02.parquet"
    name = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    meta = pq.ParquetFile(f"{folder}/{name}").metadata.row_group(0)
    column = next(meta.column(k) for k in range(meta.num_columns) if meta.column(k).path_in_schema == "total_amount")
    start = min(p for p in (column.dictionary_page_offset, column.data_page_offset) if p)
    content = bytearray(open(f"{folder}/{name}", "rb").read())
    content[start + column.total_compressed_size - 1] ^= 1
    with open(f"{folder}/{name}", "wb") as out:
        out.write(content)
    os.remove(f"{folder}/.{name}.crc")
    assert spark.read.parquet(folder).count() == 50
    assert spark.read.parquet(folder).selectExpr("sum(total_amount)").first() is not None  # it decodes
    listed = files.file_manifest(spark, root, ["yellow"], deep=True)
    assert [(f["file_month"], f["rows"], (f["error"] or "").split(":")[0]) for f in listed] == [(1, 50, ""), (2, 0, "damaged")]
    trips = files.read_trips(spark, root, ["yellow"], months=[2])
    with pytest.raises(Exception):  # noqa: B017 wrong values are worse than a failed read
        trips.collect()


def some_trips(spark, months, n, tag):
    return spark.range(n).select(
        F.lit("yellow").alias("cab_type"), F.lit(2024).alias("file_year"),
        (F.col("id") % months + 1).cast("int").alias("file_month"), "id", F.lit(tag).alias("tag"),
    )


@pytest.mark.parametrize("died_at", ["_partitions_of", "_publish", "_remove_unlisted"])
def test_a_write_killed_half_way_leaves_a_whole_version(spark, tmp_path, monkeypatch, died_at):
    root = str(tmp_path / "table")
    files.write_monthly(some_trips(spark, 3, 9, "old"), root)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(files, died_at, dies)
        with pytest.raises(KeyboardInterrupt):
            files.write_monthly(some_trips(spark, 2, 8, "new"), root)
    published = died_at == "_remove_unlisted"
    tags = {(r.file_month, r.tag): r["n"] for r in files.read_monthly(spark, root).groupBy("file_month", "tag").agg(F.count("*").alias("n")).collect()}
    assert tags == ({(1, "new"): 4, (2, "new"): 4, (3, "old"): 3} if published else {(m, "old"): 3 for m in (1, 2, 3)})
    files.write_monthly(some_trips(spark, 1, 5, "newest"), root)
    files.write_monthly(some_trips(spark, 3, 6, "last"), root)
    files.write_monthly(some_trips(spark, 3, 6, "last of all"), root)
    assert {r.tag for r in files.read_monthly(spark, root).collect()} == {"last of all"}
    assert len(os.listdir(f"{root}/data")) == 2  # the newest version and the one before


def test_a_task_that_fails_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "table")
    files.write_monthly(some_trips(spark, 2, 6, "old"), root)
    bad = some_trips(spark, 2, 6, "new").withColumn("id", F.expr("if(id = 5, raise_error('lost'), id)"))
    with pytest.raises(Exception, match="lost"):
        files.write_monthly(bad, root)
    assert {r.tag for r in files.read_monthly(spark, root).collect()} == {"old"}
    files.write_monthly(some_trips(spark, 2, 6, "x").where("id > 99"), root)
    assert files.read_monthly(spark, root).count() == 6


def test_an_empty_table_can_be_published(spark, tmp_path):
    root = str(tmp_path / "table")
    files.write_monthly(some_trips(spark, 2, 6, "x").where("id > 99"), root)
    assert files.read_monthly(spark, root).columns == ["cab_type", "file_year", "file_month", "id", "tag"]
    with pytest.raises(FileNotFoundError):
        files.read_monthly(spark, str(tmp_path / "never"))
