"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every rule rejects a document whose measure exceeds a cutoff. Cutoffs are tried in one
fixed order, loosest first and rule after rule, so that each step rejects at least what
the steps before it reject. In a stratum (a language) a step holds if the labelled
documents prove, by an exact binomial bound, that all rules together reject at most
their share of the good documents there; the last step that holds gives the cutoffs.
Steps are tested in their fixed order up to the first that fails, which needs no
correction within a stratum; the error level is split over the strata (Bonferroni), so
with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good
documents. A step without any false rejection holds from
``log(delta / strata) / log(1 - alpha)`` good documents on: 59 for one stratum, 86 for four.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SPACE, text

# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Share of good documents a stratum may lose, and the chance that any loses more.
ALPHA = 0.05
DELTA = 0.05
# Cutoffs up to this size are broadcast; larger sets are joined over this many salts.
LIMIT_BYTES = 8 << 20
SALTS = 64

# Cutoffs tried per rule: the same at every size and for every corpus. Order of the rules
# matters where a step fails: what follows it is not tried.
GRID = {
    "symbol_share": (0.02, 0.05, 0.1, 0.2, 0.3),
    "capital_share": (0.15, 0.2, 0.3, 0.5),
    "repeat_share": (0.1, 0.15, 0.2, 0.3, 0.4),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5),
    "word_length": (8.0, 9.0, 10.0, 12.0, 15.0),
}


def _without(column: Column, characters: str) -> Column:
    return F.char_length(column) - F.char_length(F.translate(column, characters, ""))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts, the rule measures and ``base_failed``; column names get no prefix.

    Windows of three words are sorted within a document that repeats any of them; a
    repeated window sits beside its equal, and the positions they cover are merged.
    """
    whole = text(text_col)
    spaced = docs.withColumn("_words", F.filter(F.split(whole, SPACE), lambda w: w != ""))
    window = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.concat_ws(" ", w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    windows = spaced.withColumn("_windows", window)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    paired = F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    ordered = windows.withColumn("_sorted", F.when(repeats, F.sort_array(paired)))
    twice = F.filter(
        "_sorted",
        lambda x, k: (F.get("_sorted", k + 1)["w"] == x["w"])
        | ((k > 0) & (F.get("_sorted", F.greatest(k - 1, F.lit(0)))["w"] == x["w"])),
    )
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(whole, "\n"), lambda line: F.translate(line, " \t\n\x0b\x0c\r", "") != "")
    counted = ordered.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _without(whole, SYMBOLS).cast("long"),
            "_capitals": _without(whole, CAPITALS).cast("long"),
            "_lines": lines,
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    counted = counted.withColumn(
        "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    )
    characters = F.greatest(F.col("word_chars"), F.lit(1))
    shares = {
        "symbol_share": F.col("n_symbols") / characters,
        "capital_share": F.col("_capitals") / characters,
        "repeat_share": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }
    return counted.withColumns(shares).drop("_words", "_windows", "_sorted", "_capitals", "_lines")


def ladder(grid: dict[str, tuple[float, ...]]) -> list[tuple[str, float]]:
    """The steps: the loosest cutoff of every rule, then the next looser one of each, and so on."""
    loosest_first = {rule: sorted(tried, reverse=True) for rule, tried in grid.items()}
    rounds = range(max(map(len, grid.values())))
    return [(rule, tried[k]) for k in rounds for rule, tried in loosest_first.items() if k < len(tried)]


def _log_factorial(x: Column) -> Column:
    """log(x!), exact up to 20 and by Stirling's series beyond, to the last digits of a double."""
    y = F.greatest(x, F.lit(1)).cast("double")
    series = (
        (y + 0.5) * F.log(y) - y + math.log(2 * math.pi) / 2
        + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    )
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")))).otherwise(series)


def binomial_tail(rejected: Column, total: Column, risk: float) -> Column:
    """P(X <= rejected) for X ~ Bin(total, risk): the largest term, then the smaller ones.

    Below the mean a term ``d`` steps away is smaller by ``exp(d * d / (2 * total * risk))``
    at least; terms beyond ten such deviations are below the precision of a double.
    """
    largest = F.exp(
        _log_factorial(total) - _log_factorial(rejected) - _log_factorial(total - rejected)
        + rejected * math.log(risk) + (total - rejected) * math.log(1 - risk)
    )
    reach = F.least(rejected.cast("long"), F.ceil(10 * F.sqrt(total * F.lit(risk)) + 60))
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), reach),
        F.struct(largest.alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (rejected - i) * ((1 - risk) / risk) / (total - rejected + i + 1)).alias("term"),
            (a["sum"] + a["term"]).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    # Above the mean the tail is near a half or more; it need not be summed.
    return F.when(rejected >= total * risk, F.lit(1.0)).otherwise(terms)


def cutoffs(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
    grid: dict[str, tuple[float, ...]] | None = None, id_col: str = "doc_id",
) -> DataFrame:
    """One row per stratum with a proven step: the cutoff of each rule, null where none is proven.

    Good documents are those whose labels (``quality``) are all 1 and that pass the
    base rule. A null stratum counts as the stratum ''. One aggregation, combined
    before its shuffle, counts for every step the good documents rejected up to it.
    """
    grid = grid or GRID
    steps = ladder(grid)
    verdicts = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_quality"))
    good = measured.join(verdicts, F.col(id_col) == F.col("_id")).where("_quality = 1 AND NOT base_failed")
    never = F.lit(len(steps))
    first = F.least(never, *[F.when(F.col(rule) > c, F.lit(k)).otherwise(never) for k, (rule, c) in enumerate(steps)])
    counts = good.select(F.coalesce(F.col(stratum), F.lit("")).alias("_stratum"), first.alias("_first"))
    counts = counts.groupBy("_stratum").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(
            *[
                F.struct(
                    F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"),
                    F.sum(F.when(F.col("_first") <= k, 1).otherwise(0)).alias("rejected"),
                )
                for k, (rule, c) in enumerate(steps)
            ]
        ).alias("_tried"),
    )
    level = delta / counts.agg(F.count(F.lit(1))).scalar()
    tail = binomial_tail(F.col("_t.rejected"), F.col("_n"), alpha)
    # Rejections only grow along the steps, so those that hold come before the first that fails.
    proven = (
        counts.withColumn("_level", level).select("_stratum", "_n", "_level", F.explode("_tried").alias("_t"))
        .where(tail <= F.col("_level"))
    )
    return proven.groupBy("_stratum").agg(
        *[F.min(F.when(F.col("_t.rule") == rule, F.col("_t.cutoff"))).alias(f"_max_{rule}") for rule in grid]
    )


def judge(measured: DataFrame, limits: DataFrame, stratum: str = "lang", grid=None) -> DataFrame:
    """Add ``kept``: the base rule passed and no proven cutoff of the stratum exceeded.

    Cutoffs of measured size are broadcast, so that no row moves. Beyond that bound they
    are copied to ``SALTS`` salts, over which the rows of one stratum spread.
    """
    rules = list(grid or GRID)
    limits = cut(limits)
    size = limits.agg(F.coalesce(F.sum(F.octet_length("_stratum") + 8 * len(rules)), F.lit(0))).first()[0]
    same = F.coalesce(F.col(stratum), F.lit("")) == F.col("_stratum")
    if size <= LIMIT_BYTES:
        joined = measured.join(F.broadcast(limits), same, "left")
    else:
        salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.join(salted, same & (F.pmod(F.xxhash64(*rules), F.lit(SALTS)) == F.col("_salt")), "left")
        joined = joined.drop("_salt")
    failed = F.col("base_failed")
    for rule in rules:
        failed = failed | F.coalesce(F.col(rule) > F.col(f"_max_{rule}"), F.lit(False))
    return joined.withColumn("kept", ~failed).drop("_stratum", *[f"_max_{rule}" for rule in rules])


def apply_rules(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """Counts, measures and verdict of every document; texts are read once.

    Returns ``doc_id``, the five counts, the rule measures, ``base_failed`` and
    ``kept``. A null text has no words and fails the base rule. Repeated rows are
    judged each for itself, null ids are judged but never labelled, other columns are
    not read. Labels without a document or with a null quality are ignored; a stratum
    with too few labels proves no cutoff and is judged by the base rule alone.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum).alias("lang")
    )
    measured = cut(measures(rows).drop("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), "quality")
    return judge(measured, cutoffs(measured, known, alpha=alpha, delta=delta))


def oracle_sql() -> str:
    """The whole operator in DuckDB SQL."""
    words = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    tried = ", ".join(f"({k}, '{r}', CAST({c} AS DOUBLE))" for k, (r, c) in enumerate(ladder(GRID)))
    risk = ALPHA
    columns = " ".join(f"WHEN '{r}' THEN {r}" for r in GRID)
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
    {words} AS words FROM documents),
grams AS (
  SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs)),
twice AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n FROM grams),
repeated AS (
  SELECT row_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY row_id),
counts AS (
  SELECT row_id, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN repeated USING (row_id)),
measured AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    n_symbols / greatest(word_chars, 1) AS symbol_share, n_capitals / greatest(word_chars, 1) AS capital_share,
    n_repeat_words / greatest(n_words, 1) AS repeat_share,
    (len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1) AS dup_line_share,
    word_chars / greatest(n_words, 1) AS word_length,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts),
good AS (
  SELECT m.* FROM measured m JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id) l
    ON m.doc_id = l.doc_id WHERE q = 1 AND NOT base_failed),
grid(step, rule, cutoff) AS (VALUES {tried}),
firsts AS (
  SELECT row_id, lang, min(step) FILTER (WHERE CASE rule {columns} END > cutoff) AS step
  FROM good, grid GROUP BY row_id, lang),
tests AS (
  SELECT lang, grid.step, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE firsts.step <= grid.step) AS k
  FROM firsts, grid GROUP BY lang, grid.step, rule, cutoff),
proven AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM tests
  WHERE k < n * {risk} AND list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))
    <= {DELTA} / (SELECT count(DISTINCT lang) FROM tests)
  GROUP BY lang, rule),
verdicts AS (
  SELECT row_id, bool_or(CASE rule {columns} END > cutoff) AS rejected
  FROM measured JOIN proven USING (lang) GROUP BY row_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM measured LEFT JOIN verdicts USING (row_id)"""
