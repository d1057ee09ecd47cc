"""k-anonymity over quasi-identifiers.

Group sizes are counted once per combination (a NULL is a value like any other);
undersized groups are dropped by joining trips to the list of kept combinations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import truncate_time
from ..schema import FILE_KEYS
from ..session import cut, settle

QUASI_IDENTIFIERS = ("pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID")


def generalise(trips: DataFrame, unit: str = "hour") -> DataFrame:
    """Coarsen both trip times in place."""
    return trips.withColumns(
        {c: truncate_time(F.col(c), unit) for c in ("pickup_datetime", "dropoff_datetime")}
    )


def class_sizes(df: DataFrame, qi=QUASI_IDENTIFIERS, by=()) -> DataFrame:
    return df.groupBy(*by, *qi).agg(F.count(F.lit(1)).alias("class_size"))


def k_of(df: DataFrame, qi=QUASI_IDENTIFIERS, by=()) -> DataFrame:
    """Smallest class size, overall or per ``by``."""
    return class_sizes(df, qi, by).groupBy(*by).agg(F.min("class_size").alias("k"))


def class_size_histogram(df: DataFrame, qi=QUASI_IDENTIFIERS) -> DataFrame:
    """How many classes there are of each size, to choose k by."""
    return class_sizes(df, qi).groupBy("class_size").agg(F.count(F.lit(1)).alias("classes"))


def k_report(
    df: DataFrame, k: int, suppression_pct: float, qi=QUASI_IDENTIFIERS, by=()
) -> DataFrame:
    """k and rows before and after, and the percentage below k, from class sizes alone.

    If more than ``suppression_pct`` percent would have to go, nothing is released.
    """
    size = F.col("class_size")
    kept = F.when(size >= k, size)
    report = class_sizes(df, qi, by).groupBy(*by).agg(
        F.min(size).alias("k_before"), F.sum(size).alias("rows_before"),
        F.min(kept).alias("_k"), F.coalesce(F.sum(kept), F.lit(0)).alias("_rows"),
    )
    share = (F.col("rows_before") - F.col("_rows")) / F.col("rows_before") * 100
    released = F.col("dropped_pct") <= suppression_pct
    return report.withColumn("dropped_pct", share).select(
        *by, "k_before", "rows_before", "dropped_pct",
        F.when(released, F.col("_k")).alias("k_after"),
        F.when(released, F.col("_rows")).otherwise(0).alias("rows_after"),
    )


# From fine to coarse.
LEVELS = ("full", "minute", "hour")


def finest_levels(
    trips: DataFrame, k: int = 2, suppression_pct: float = 0, qi=QUASI_IDENTIFIERS, by=FILE_KEYS,
) -> DataFrame:
    """The least coarse pair of time levels at which every part reaches ``k``.

    Trips are counted once, by class at full times; coarser classes are sums of these
    counts. Pairs are tried from fine to coarse, those of one total coarseness together
    in one job: a part that has its answer is left out of the coarser rounds, since
    coarsening can only join classes. At most ``suppression_pct`` percent of a part's rows
    may stand in smaller classes. Of two pairs alike in total coarseness the one with
    the finer pick-up counts. Returns ``by``, ``pickup_level``, ``dropoff_level`` (NULL where no
    pair is enough), ``rows`` and ``dropped_pct`` at that pair.
    """
    by, times = list(by), ("pickup_datetime", "dropoff_datetime")
    rest = [c for c in qi if c not in times]
    base = cut(class_sizes(trips, [*times, *rest], by))
    open_parts, found = base, None
    for coarseness in range(2 * len(LEVELS) - 1):
        pairs = [(p, d) for p in range(len(LEVELS)) for d in range(len(LEVELS)) if p + d == coarseness]
        rolled = open_parts.select(
            *by, *rest, "class_size",
            F.inline(F.array(*[
                F.struct(
                    F.lit(p).alias("_p"), F.lit(d).alias("_d"),
                    truncate_time(F.col(times[0]), LEVELS[p]).alias("_from"),
                    truncate_time(F.col(times[1]), LEVELS[d]).alias("_to"),
                )
                for p, d in pairs
            ])),
        ).groupBy(*by, "_p", "_d", "_from", "_to", *rest).agg(F.sum("class_size").alias("_size"))
        judged = rolled.groupBy(*by, "_p", "_d").agg(
            F.sum("_size").alias("rows"),
            (F.sum(F.when(F.col("_size") < k, F.col("_size")).otherwise(0)) / F.sum("_size") * 100).alias("dropped_pct"),
        )
        enough = settle(
            judged.where(F.col("dropped_pct") <= suppression_pct).groupBy(*by)
            .agg(F.min(F.struct("_p", "_d", "rows", "dropped_pct")).alias("_best"))
        )
        found = enough if found is None else found.unionByName(enough)
        reached = enough.select(*[F.col(c).alias(f"_done_{c}") for c in by])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_done_{c}")) for c in by])
        open_parts = open_parts.join(reached, same, "left_anti")
        if open_parts.isEmpty():
            break
    name = F.array(*[F.lit(level) for level in LEVELS])
    parts = base.groupBy(*by).agg(F.sum("class_size").alias("rows"))
    best = found.select(
        *[F.col(c).alias(f"_done_{c}") for c in by],
        F.element_at(name, F.col("_best._p") + 1).alias("pickup_level"),
        F.element_at(name, F.col("_best._d") + 1).alias("dropoff_level"), F.col("_best.dropped_pct").alias("dropped_pct"),
    )
    return parts.join(best, same, "left").select(*by, "pickup_level", "dropoff_level", "rows", "dropped_pct")


def k_anonymise(
    trips: DataFrame, k: int = 2, suppression_pct: float = 99, qi=QUASI_IDENTIFIERS,
    unit: str = "hour", by=(),
) -> tuple[DataFrame, DataFrame]:
    """Released trips with coarsened times, and the report.

    With ``by`` (for example the file keys) every part is judged on its own, in
    one job. The join on the class list, rather than a window over each class,
    lets adaptive execution split a class that holds much of the data.
    """
    by, qi = list(by), list(qi)
    coarse = generalise(trips, unit)
    report = k_report(coarse, k, suppression_pct, qi, by)
    keys = [*by, *qi]
    classes = class_sizes(coarse, qi, by).where(F.col("class_size") >= k)
    if by:
        open_parts = report.where(F.col("rows_after") > 0).select(*by)
        classes = classes.join(open_parts, by, "left_semi")
    else:
        classes = classes.where(report.select(F.col("rows_after") > 0).scalar())
    kept = classes.select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    same = [coarse[c].eqNullSafe(kept[f"_k_{c}"]) for c in keys]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    return coarse.join(kept, condition, "left_semi"), report


def k_anonymise_monthly(
    trips: DataFrame, k: int = 2, suppression_pct: float = 99
) -> tuple[DataFrame, DataFrame]:
    """Every monthly file on its own."""
    return k_anonymise(trips, k, suppression_pct, by=FILE_KEYS)
