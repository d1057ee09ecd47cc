"""Exact quantiles and average ranks without gathering a group in one task.

Counts per order-preserving bucket, combined before they travel, locate the wanted
ranks; what lies in a located bucket is looked into by finer buckets, down to single
values. Ranks of all rows work on distinct values the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import fine_bucket, known, order_bucket
from ..session import settle

# Buckets per doubling in the rounds before values are counted themselves.
ROUNDS = (1 << 16, 1 << 32)

_UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def exact_quantiles(df: DataFrame, by, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group.

    ``quantiles`` maps output name to probability. NULL and NaN values are
    skipped, as are groups with a NULL key; infinities are ordered like other
    values. Returns ``by`` plus one column each, settled.

    The ranks wanted are narrowed down bucket by bucket: counts per bucket are
    combined before they travel, a running sum over a group's buckets finds those
    that hold the ranks, and a finer round looks into these until each holds one
    value only. A round reads ``df`` once and shuffles bucket counts twice.
    Most values need one round; the last of the three counts the values themselves.
    """
    keys = list(by) or ["_all"]
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(known(F.col("_v")))
    rows = rows.dropna(subset=list(by)) if by else rows.withColumn("_all", F.lit(0))
    # 0-based ranks per quantile; a value is interpolated between the two.
    position = {name: f"({p}D * (_total - 1))" for name, p in quantiles.items()}
    ranks = [f"{f}({pos})" for pos in position.values() for f in ("floor", "ceil")]
    found = None
    for bucket in (*[order_bucket("_v", width) for width in ROUNDS], "_v"):
        found = settle(_narrowed(rows, keys, ranks, bucket, found))
        if found.where(" OR ".join(f"_low{i} < _high{i}" for i in range(len(ranks)))).isEmpty():
            break
    return found.selectExpr(
        *[f"`{k}`" for k in by],
        *[
            f"CASE WHEN _low{i} = _low{i + 1} THEN _low{i} "
            f"ELSE _low{i} + (_low{i + 1} - _low{i}) * ({pos} - floor({pos})) END AS `{name}`"
            for i, (name, pos) in zip(range(0, len(ranks), 2), position.items())
        ],
    )


def _narrowed(rows: DataFrame, keys: list[str], ranks: list[str], bucket: str, found: DataFrame | None) -> DataFrame:
    """Per group its ``_total`` and, for every rank i, the smallest (``_low<i>``) and largest
    (``_high<i>``) value of the bucket that holds it, and the rows before that bucket (``_before<i>``).

    ``found`` is the result of a coarser round. Only rows between the two values of an
    undecided rank are looked at again, each range of its own.
    """
    key_list = ", ".join(f"`{k}`" for k in keys)
    if found is None:
        looked, groups, part, base = rows, keys, key_list, "0L"
        total = f"sum(_m) OVER (PARTITION BY {key_list})"
    else:
        inside = [f"(_low{i} < _high{i} AND _v BETWEEN _low{i} AND _high{i})" for i in range(len(ranks))]
        # The rows before a range tell the ranges of a group apart.
        start = "CASE " + " ".join(f"WHEN {test} THEN _before{i}" for i, test in enumerate(inside)) + " END"
        looked = rows.join(found, keys).where(" OR ".join(inside)).selectExpr(
            *[f"`{k}`" for k in keys], "_v", "_total", f"{start} AS _base"
        )
        groups, part, base, total = [*keys, "_base", "_total"], f"{key_list}, _base", "_base", "_total"
    counts = looked.selectExpr("*", f"{bucket} AS _b").groupBy(*groups, "_b").agg(
        F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    running = counts.selectExpr(
        *[f"`{k}`" for k in keys], "_m", "_least", "_most", f"{total} AS _total",
        f"{base} + sum(_m) OVER (PARTITION BY {part} ORDER BY _b {_UPTO}) AS _upto",
    )
    picks = []
    for i, rank in enumerate(ranks):
        hit = f"_upto - _m <= {rank} AND {rank} < _upto"
        picks += [
            F.expr(f"max(CASE WHEN {hit} THEN {text} END)").alias(f"_{name}{i}")
            for name, text in (("low", "_least"), ("high", "_most"), ("before", "_upto - _m"))
        ]
    picked = running.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    if found is None:
        return picked
    # Ranks decided before stay as they are.
    old = found.select(*keys, *[F.col(c).alias(f"_old{c}") for c in found.columns if c not in keys])
    names = [f"_{name}{i}" for i in range(len(ranks)) for name in ("low", "high", "before")]
    return old.join(picked.drop("_total"), keys, "left").select(
        *keys, F.col("_old_total").alias("_total"), *[F.coalesce(c, f"_old{c}").alias(c) for c in names]
    )


def rank_distinct(per_value: DataFrame, value: str, freq: DataFrame, weight: str) -> DataFrame:
    """Add ``below`` (rows with a smaller value) and ``avg_rank`` (1-based, ties averaged).

    ``per_value`` has one row per distinct ``value`` with its ``copies``; ``freq``
    holds the same counts, possibly split over further columns, in ``weight``.
    """
    name = f"`{value}`"
    # One row per finer bucket; running sums are taken within a bucket and, over the
    # buckets, whose number the range of a double bounds, once more.
    fine = freq.groupBy(F.expr(order_bucket(name)).alias("_b"), F.expr(fine_bucket(name)).alias("_s")).agg(
        F.sum(weight).alias("_m")
    )
    coarse = fine.groupBy("_b").agg(F.sum("_m").alias("_m")).selectExpr(
        "_b", f"sum(_m) OVER (PARTITION BY 0 ORDER BY _b {_UPTO}) - _m AS _base"
    )
    offsets = fine.join(coarse, "_b").selectExpr(
        "_s", f"_base + sum(_m) OVER (PARTITION BY _b ORDER BY _s {_UPTO}) - _m AS _offset"
    )
    inside = f"sum(copies) OVER (PARTITION BY _s ORDER BY {name} {_UPTO})"
    return (
        per_value.withColumn("_s", F.expr(fine_bucket(name))).join(offsets, "_s")
        .selectExpr(*per_value.columns, f"_offset + {inside} - copies AS below")
        .selectExpr("*", "below + (copies + 1) / 2 AS avg_rank")
    )
