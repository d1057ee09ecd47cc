"""Order-preserving buckets for exact order statistics.

A bucket number never decreases when the value grows, so counts per bucket say
in which bucket the k-th smallest value lies and only that bucket has to be
looked into. Bucket width is relative (1024 per doubling, each cut into 65,536
finer ones), hence the number of buckets is bounded by the range of a double and
not by the data. Infinities have end buckets of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 1024
FINER = 65_536
# Above the largest |log2| of a double, so buckets of positive values stay positive.
_DOUBLINGS = 1100


def _bucket(value: str, per_doubling: int) -> str:
    offset = _DOUBLINGS * per_doubling
    size = (
        f"CASE WHEN abs({value}) = CAST('Infinity' AS DOUBLE) THEN {2 * offset}L "
        f"ELSE floor(log2(abs({value})) * {per_doubling}) + {offset} END"
    )
    return f"CASE WHEN {value} > 0 THEN {size} WHEN {value} < 0 THEN -({size}) ELSE 0L END"


def order_bucket(value: str, per_doubling: int = BUCKETS_PER_DOUBLING) -> str:
    """SQL for the bucket of a non-null, non-NaN double column."""
    return _bucket(value, per_doubling)


def fine_bucket(value: str) -> str:
    """SQL for the finer bucket; it lies within the bucket of the same value."""
    return _bucket(value, BUCKETS_PER_DOUBLING * FINER)


def known(value: Column) -> Column:
    """True for a value that can be ordered."""
    return value.isNotNull() & ~F.isnan(value)
