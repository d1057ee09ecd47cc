"""Cleaning predicates, quartile fences and the step-by-step cleaning engine.

Predicates are SQL text for ``where``. A condition on an unknown value is unknown
and so does not hold; it stays bare, because a wrapped one would not reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import in_year
from ..functions.trip import AIRPORT_ZONES, touches
from ..schema import FILE_KEYS
from .order_stats import exact_quantiles

AMOUNTS = ("trip_distance", "fare_amount", "tip_amount", "total_amount", "Airport_fee")


def of_file_month(column: str, year: int = 2024, year_of: str | None = None) -> str:
    """``column`` lies in its file's month, and ``year_of`` (default: itself) in ``year``.

    The year test is a range on the column, which Parquet can skip row groups by.
    """
    return f"(month({column}) = file_month AND {in_year(year_of or column, year)})"


def nonzero_length() -> str:
    """Ends differ; a missing drop-off counts as different."""
    return "NOT (pickup_datetime <=> dropoff_datetime)"


def allowed(column: str, values) -> str:
    return f"{column} IN ({', '.join(map(repr, values))})"


def within(column: str, low, high) -> str:
    return f"({column} BETWEEN {low} AND {high})"


def at_least(column: str, low) -> str:
    return f"{column} >= {low}"


def absolute(df: DataFrame, columns=AMOUNTS) -> DataFrame:
    return df.withColumns({c: F.abs(c) for c in columns if c in df.columns})


def fence_table(
    df: DataFrame, column: str, by=FILE_KEYS, k: float = 1.5
) -> DataFrame:
    """Quartiles and the fence ``Q1 - k IQR .. Q3 + k IQR`` per group, settled."""
    quartiles = exact_quantiles(df, by, column, {"q1": 0.25, "q3": 0.75})
    return quartiles.selectExpr(
        "*", f"q1 - {k}D * (q3 - q1) AS fence_low", f"q3 + {k}D * (q3 - q1) AS fence_high"
    )


def attach_fence(df: DataFrame, fences: DataFrame, by, name: str) -> DataFrame:
    """Left join settled fences as columns ``_low_<name>`` and ``_high_<name>``."""
    side = fences.selectExpr(*by, f"fence_low AS _low_{name}", f"fence_high AS _high_{name}")
    return df.join(side, list(by), "left")


def iqr_fence(
    df: DataFrame, column: str, by=FILE_KEYS, k: float = 1.5
) -> DataFrame:
    """Keep rows inside their group's fence, bounds included; unknown values go."""
    by = list(by)
    fenced = attach_fence(df, fence_table(df, column, by, k), by, "f")
    return fenced.where(within(column, "_low_f", "_high_f")).select(df.columns)


def iqr_fence_airport_exempt(
    df: DataFrame, column: str, airports=AIRPORT_ZONES, by=FILE_KEYS, k: float = 1.5,
) -> DataFrame:
    """As ``iqr_fence``, with airport trips neither measured nor filtered."""
    by = list(by)
    exempt = touches(airports)
    fences = fence_table(df.where(f"NOT {exempt}"), column, by, k)
    fenced = attach_fence(df, fences, by, "f")
    return fenced.where(f"{exempt} OR {within(column, '_low_f', '_high_f')}").select(df.columns)


@dataclass(frozen=True)
class Step:
    """One cleaning step: a predicate, or an airport-exempt fence on a column."""

    name: str
    keep: str | None = None
    fence_on: str | None = None


@dataclass(frozen=True)
class Cleaned:
    """Result of a run of steps: trips with fences attached, and one test per step."""

    fenced: DataFrame
    columns: list[str]
    names: list[str]
    tests: list[str]
    by: list[str]

    @property
    def trips(self) -> DataFrame:
        """Rows that pass every step. The tests are a plain conjunction, so those on
        stored columns alone are decided by the scan, before any fence is looked up."""
        return self.fenced.where(" AND ".join(self.tests)).select(self.columns)

    @property
    def flagged(self) -> DataFrame:
        """All rows with ``failed_step``: the first step a row fails, NULL if none."""
        cases = " ".join(
            f"WHEN NOT coalesce({test}, false) THEN {i}" for i, test in enumerate(self.tests, start=1)
        )
        return self.fenced.selectExpr(*self.columns, f"CASE {cases} END AS failed_step")

    @property
    def audit(self) -> DataFrame:
        """Rows removed per file and step, with input (step 0) and final (last) counts.

        One grouped count over the flags; the per-step rows are unfolded from it.
        """
        last = len(self.tests) + 1
        counts = ["count(1) AS n0", *[f"count_if(failed_step = {i}) AS n{i}" for i in range(1, last)]]
        counts.append(f"count_if(failed_step IS NULL) AS n{last}")
        lines = ", ".join(
            f"struct({i} AS step_no, '{name}' AS step, n{i} AS row_count)"
            for i, name in enumerate(["input", *self.names, "final"])
        )
        grouped = self.flagged.groupBy(*self.by).agg(*[F.expr(c) for c in counts])
        return grouped.selectExpr(*self.by, f"inline(array({lines}))")


def run_steps(df: DataFrame, steps: list[Step], airports=AIRPORT_ZONES, by=FILE_KEYS) -> Cleaned:
    """Apply steps in order to one table. See ``run_together``."""
    return run_together({"": (df, steps)}, airports, by)[""]


def run_together(
    runs: dict[str, tuple[DataFrame, list[Step]]], airports=AIRPORT_ZONES, by=FILE_KEYS
) -> dict[str, Cleaned]:
    """Apply the steps of several tables, each in its own order, with their fences measured together.

    A fence is measured on the survivors of the steps before it, so fences take
    as many rounds as the longest run has fences. Round k measures the k-th fence of
    every run in one job; each table is read with only the columns its steps need.
    Fences arrive settled, a row per file, which keeps the plan linear in the steps.
    """
    by = list(by)
    exempt = touches(airports)
    fenced = {name: df for name, (df, _) in runs.items()}
    tests: dict[str, list[str]] = {name: [] for name in runs}
    while True:
        due = {}
        for name, (_, steps) in runs.items():
            while len(tests[name]) < len(steps) and not steps[len(tests[name])].fence_on:
                tests[name].append(steps[len(tests[name])].keep)
            if len(tests[name]) < len(steps):
                due[name] = steps[len(tests[name])].fence_on
        if not due:
            break
        measured = [
            fenced[name].where(" AND ".join([*tests[name], f"NOT {exempt}"]))
            .selectExpr(*by, f"CAST(`{column}` AS DOUBLE) AS _value", f"'{name}' AS _run")
            for name, column in due.items()
        ]
        fences = fence_table(reduce(DataFrame.unionByName, measured), "_value", ["_run", *by])
        for name, column in due.items():
            number = len(tests[name]) + 1
            own = fences.where(F.col("_run") == name)
            fenced[name] = attach_fence(fenced[name], own, by, str(number))
            tests[name].append(f"({exempt} OR {within(column, f'_low_{number}', f'_high_{number}')})")
    return {
        name: Cleaned(fenced[name], df.columns, [step.name for step in steps], tests[name], by)
        for name, (df, steps) in runs.items()
    }
