import pytest
from pyspark.sql import functions as F

from curbflow.operators import sampling


def files(spark, sizes):
    """One yellow file per size, months 1, 2, ..."""
    parts = [
        spark.range(n).select(
            F.lit(cab).alias("cab_type"), F.lit(2024).alias("file_year"), F.lit(m).alias("file_month"),
            F.concat(F.lit(f"{cab}{m}-"), F.col("id").cast("string")).alias("trip"),
        )
        for (cab, m), n in sizes.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


SIZES = {("yellow", 1): 700, ("yellow", 2): 300, ("green", 1): 90, ("fhv", 1): 1}


def test_exact_sizes_and_the_same_rows_again(spark):
    trips = files(spark, SIZES)
    first = sampling.sample_stratified(trips, 100, ["trip"])
    got = {(r.cab_type, r.file_month): r.n for r in first.groupBy("cab_type", "file_month").agg(F.count("*").alias("n")).collect()}
    wanted = {
        (r["cab_type"], r["file_month"]): r["take"]
        for r in sampling.sample_allocation(trips, 100).collect() if r["take"] > 0
    }
    assert got == wanted and got[("fhv", 1)] == 1
    again = sampling.sample_stratified(trips.repartition(7), 100, ["trip"])
    assert {r.trip for r in first.collect()} == {r.trip for r in again.collect()}
    other = sampling.sample_stratified(trips, 100, ["trip"], seed=7)
    assert {r.trip for r in first.collect()} != {r.trip for r in other.collect()}


@pytest.mark.parametrize("n", [1, 2, 699, 1091, 5000])
def test_total_is_exact_or_everything(spark, n):
    trips = files(spark, SIZES)
    drawn = sampling.sample_total(trips, n, ["trip"])
    assert drawn.count() == drawn.distinct().count() == min(n, 1091)


def test_hash_order_decides(spark):
    trips = files(spark, SIZES)
    drawn = {r.trip for r in sampling.sample_total(trips, 37, ["trip"]).collect()}
    order = sampling.sample_order(["trip"], 42)
    assert drawn == {r.trip for r in trips.orderBy(order).limit(37).collect()}


@pytest.mark.parametrize("n", [10, 2500, 2999])
def test_copies_are_drawn_to_the_exact_number(spark, n):
    # A third of all rows are copies of one row and there is no key.
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    drawn = sampling.sample_total(df, n)
    assert drawn.count() == n
    assert drawn.where("v <> -1").distinct().count() == drawn.where("v <> -1").count()


def test_a_key_that_is_not_unique_still_gives_exact_sizes(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    drawn = sampling.sample_total(df, 150, ["k"])
    assert drawn.count() == drawn.distinct().count() == 150


def test_rounding_up_is_cut_back_to_the_total(spark):
    trips = files(spark, {("yellow", 1): 1000, ("green", 1): 1, ("fhv", 1): 1})
    assert sampling.sample_all_cabs(trips, 2, ["trip"]).count() == 2


def test_sample_of_one_file(spark):
    trips = files(spark, SIZES)
    drawn = sampling.sample_n(trips, 5, ["trip"])
    assert drawn.select("cab_type", "file_month").distinct().count() == 1
    with pytest.raises(ValueError):
        sampling.sample_n(trips, 5000, ["trip"], strict=True)


def test_unknown_and_empty_text_are_different_keys(spark):
    """Forty NULLs and forty empty texts in one stratum, thirty wanted."""
    df = spark.range(80).select(F.when(F.col("id") < 40, F.lit("")).alias("v"))
    assert sampling.sample_total(df, 30).count() == 30
    pairs = spark.createDataFrame([("a|", "b"), ("a", "|b")] * 20, "x string, y string")
    assert pairs.select(sampling.sample_order(["x", "y"], 1)).distinct().count() == 2
    for n in (7, 20, 33):
        assert sampling.sample_total(pairs, n).count() == n


@pytest.mark.parametrize("n", [1, 10, 59, 90])
def test_rows_that_share_a_key_are_drawn_to_the_exact_number(spark, n):
    df = spark.range(120).select(F.lit(1).alias("k"), (F.col("id") % 60).alias("v"))
    first = sampling.sample_total(df, n, ["k"])
    assert first.count() == n
    again = sampling.sample_total(df.repartition(5), n, ["k"])
    assert sorted(first.collect()) == sorted(again.collect())


def test_a_sample_reads_its_source_twice(spark, tmp_path):
    """Once for the histogram, once for the rows; what follows reads the kept rows."""
    path = str(tmp_path / "trips")
    files(spark, SIZES).coalesce(1).write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    trips = spark.read.parquet(path).coalesce(1)
    trips = trips.mapInArrow(counted, trips.schema)
    drawn = sampling.sample_stratified(trips, 100, ["trip"])
    assert drawn.count() == drawn.distinct().count()
    assert reads.value == 2
    plain = sampling.sample_stratified(spark.read.parquet(path), 100, ["trip"])
    assert sorted(drawn.collect()) == sorted(plain.collect())
