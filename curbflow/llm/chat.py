"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

Every participant becomes the assistant once: the dialogue is rendered with that
speaker's turns as the assistant's and all others as named users, and the mask covers
what the speaker says. Turns are numbered by running counts in two levels and cut into
segments of equal length, so a very long dialogue is spread over tasks; where a segment
begins in the whole dialogue comes from sums of lengths. Both travel without the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEGMENT_TURNS = 64
# Segments summed in one step before the sums themselves are summed.
STRETCH = 1024

# The marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNKNOWN = "unknown"


def _marked(role: Column, body: Column) -> Column:
    """A rendered turn. Marks written by a speaker lose their meaning through a blank."""
    return F.concat(F.lit(OPEN), role, F.lit("\n"), F.replace(body, F.lit("<|im_"), F.lit("<| im_")), F.lit(CLOSE))


def _role(speaker: Column) -> Column:
    """Role of a turn whose speaker is not the assistant."""
    named = F.concat(F.lit("user name="), F.coalesce(speaker, F.lit(UNKNOWN)))
    return F.when(speaker == SYSTEM, F.lit(SYSTEM)).otherwise(named)


def _offsets(lengths: DataFrame) -> DataFrame:
    """Characters before each segment of a rendering, summed in two levels."""
    stretched = lengths.withColumn("stretch", F.floor(F.col("segment") / STRETCH))
    inner = Window.partitionBy("conv_id", "speaker", "stretch").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    outer = Window.partitionBy("conv_id", "speaker").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = (
        stretched.groupBy("conv_id", "speaker", "stretch").agg(F.sum("chars").alias("chars"))
        .withColumn("before", F.coalesce(F.sum("chars").over(outer), F.lit(0)))
        .select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("stretch").alias("t"), "before")
    )
    inside = stretched.withColumn("inside", F.coalesce(F.sum("chars").over(inner), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s"))
    return inside.join(whole, same & F.col("stretch").eqNullSafe(F.col("t"))).select(
        "conv_id", "segment", "speaker", (F.col("before") + F.col("inside")).alias("start")
    )


def _places(rows: DataFrame) -> DataFrame:
    """Which copies of every distinct turn stand in which segment, without the texts.

    Distinct turns are dealt by ranges of dialogue and order, so a dialogue of any size
    is spread; running sums within a range and over the ranges of a dialogue number them.
    A turn that repeats is one row with a count until it is cut into segments.
    """
    slim = rows.groupBy("key", "conv_id", "turn", "who", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("user_chars").alias("user_chars"), F.max("change").alias("change")
    )
    dealt = slim.repartitionByRange("conv_id", "turn", "who", "digest").withColumn("range", F.spark_partition_id())
    # Written once: both uses below must see the same ranges.
    dealt = stored(dealt, "turns")
    inner = Window.partitionBy("conv_id", "range").orderBy("turn", "who", "digest").rowsBetween(
        Window.unboundedPreceding, -1
    )
    outer = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("conv_id", "range").agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(outer), F.lit(0)))
        .select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "before")
    )
    inside = dealt.withColumn("inside", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return inside.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))).select(
        "key", "conv_id", "who", "n", "user_chars", "change", (F.col("before") + F.col("inside")).alias("at")
    )


def _cut(places: DataFrame, segment_turns: int) -> DataFrame:
    """One row per distinct turn and segment: its place there and its copies there.

    Segments of a turn are laid out in two steps, so that no array grows with its copies.
    """
    first, last = (F.floor(F.col("at") / segment_turns), F.floor((F.col("at") + F.col("n") - 1) / segment_turns))
    spread = places.withColumn("last", last).withColumn(
        "run", F.explode(F.sequence(first, F.col("last"), F.lit(STRETCH).cast("long")))
    )
    spread = spread.withColumn(
        "segment", F.explode(F.sequence("run", F.least(F.col("run") + (STRETCH - 1), F.col("last"))))
    )
    start = F.col("segment") * segment_turns
    begin = F.greatest(F.col("at"), start)
    return spread.withColumns(
        {"place": begin - start, "copies": F.least(F.col("at") + F.col("n"), start + segment_turns) - begin}
    ).select("key", "conv_id", "who", "segment", "place", "copies", "user_chars", "change")


def rotate(
    turns: DataFrame, segment_turns: int = SEGMENT_TURNS, conv_col: str = "conv_id", turn_col: str = "turn",
    speaker_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Each dialogue from the view of each of its participants, one row per segment.

    Returns ``conv_id``, ``speaker``, ``segment``, ``n_turns``, ``start`` (characters
    of the rendered dialogue before this segment), ``rendered`` and ``mask``: start and
    length, within ``rendered``, of the speaker's own words with their closing mark.
    Segments of one dialogue and speaker, put together by ``segment``, are the whole
    rendering. Turns run by number, then speaker, then digest of the text; unknown numbers
    and speakers first. Every segment but a dialogue's last has ``segment_turns`` turns,
    whatever their numbers. System turns keep their role and an
    unknown speaker is a named user; neither is a participant, so a dialogue with no
    other speaker gives no rows. A null text is empty, repeated turns are rendered
    repeatedly, rows with a null dialogue id form one dialogue, other columns are not
    read. Participants are a dialogue's distinct speakers, whatever their number.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(speaker_col).alias("who"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("digest", F.md5("text"))
    rows = rows.withColumn("key", F.md5(F.to_json(F.struct("conv_id", "turn", "who", "digest"))))
    as_user = F.char_length(_marked(_role(F.col("who")), F.col("text")))
    as_self = F.char_length(_marked(F.lit("assistant"), F.col("text")))
    places = _places(rows.withColumns({"user_chars": as_user.cast("long"), "change": as_self - as_user}))
    placed = _cut(stored(places, "places"), segment_turns)
    sizes = placed.groupBy("conv_id", "segment", "who").agg(
        F.sum(F.col("user_chars") * F.col("copies")).alias("user_chars"),
        F.sum(F.col("change") * F.col("copies")).alias("change"),
    )
    segments = sizes.groupBy("conv_id", "segment").agg(F.sum("user_chars").alias("user_chars"))
    people = sizes.where(F.col("who").isNotNull() & (F.col("who") != SYSTEM)).select(
        F.col("conv_id").alias("c"), F.col("who").alias("speaker")
    ).distinct()
    own = sizes.select(
        F.col("conv_id").alias("oc"), F.col("segment").alias("os"), F.col("who").alias("ow"), "change"
    )
    views = segments.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    matching = (
        F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("segment") == F.col("os")) & (F.col("speaker") == F.col("ow"))
    )
    lengths = views.join(own, matching, "left").select(
        "conv_id", "segment", "speaker",
        (F.col("user_chars") + F.coalesce("change", F.lit(0))).alias("chars"),
    )
    starts = _offsets(lengths).select(
        F.col("conv_id").alias("c"), F.col("segment").alias("g"), "speaker", "start"
    )
    # Copies of a turn meet as one row before and after the shuffle that joins texts and places.
    texts = rows.groupBy("key").agg(F.max("text").alias("text"))
    gathered = placed.join(texts, "key").groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("place", "who", "text", "copies"))).alias("placed")
    ).select(
        "conv_id", "segment",
        F.flatten(
            F.transform(
                "placed",
                lambda t: F.array_repeat(F.struct(t["who"].alias("who"), t["text"].alias("text")), t["copies"].cast("int")),
            )
        ).alias("said"),
    )
    joined = gathered.join(
        starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("g"))
    )
    speaks = lambda t: F.coalesce(t["who"] == F.col("speaker"), F.lit(False))
    pieces = F.transform(
        "said",
        lambda t: _marked(F.when(speaks(t), F.lit("assistant")).otherwise(_role(t["who"])), t["text"]),
    )
    head = len(OPEN) + len("assistant") + 1
    rendered = joined.withColumn("pieces", pieces).withColumn("own", F.transform("said", speaks))
    spans = F.aggregate(
        F.zip_with("pieces", "own", lambda p, o: F.struct(F.char_length(p).alias("n"), o.alias("own"))),
        F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
        ),
        lambda a, p: F.struct(
            (a["at"] + p["n"]).alias("at"),
            F.when(
                p["own"],
                F.array_append(
                    a["spans"], F.struct((a["at"] + head).alias("start"), (p["n"] - head).alias("length"))
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return rendered.select(
        "conv_id", "speaker", "segment", F.size("said").alias("n_turns"), "start",
        F.array_join("pieces", "").alias("rendered"), spans.alias("mask"),
    )


def oracle_sql() -> str:
    """The whole operator in DuckDB SQL."""
    user = f"'{OPEN}' || CASE WHEN {{w}} = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || coalesce({{w}}, '{UNKNOWN}') END"
    body = f"chr(10) || replace(coalesce(t.text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10)"
    head = len(OPEN) + len("assistant") + 1
    return f"""
WITH people AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL AND role <> '{SYSTEM}'),
pieces AS (
  SELECT t.conv_id, p.speaker, t.turn, t.role, coalesce(t.text, '') AS text,
    coalesce(t.role = p.speaker, false) AS own,
    CASE WHEN t.role = p.speaker THEN '{OPEN}assistant' ELSE {user.format(w="t.role")} END || {body} AS piece
  FROM conversations t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, (row_number() OVER said - 1) // {SEGMENT_TURNS} AS segment,
    sum(length(piece)) OVER said - length(piece) AS pos FROM pieces
  WINDOW said AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text)
    ROWS UNBOUNDED PRECEDING)),
grouped AS (
  SELECT conv_id, speaker, segment, CAST(count(*) AS INTEGER) AS n_turns, CAST(min(pos) AS BIGINT) AS start,
    string_agg(piece, '' ORDER BY pos) AS rendered,
    list({{'s': pos, 'n': length(piece)}} ORDER BY pos) FILTER (WHERE own) AS own
  FROM placed GROUP BY conv_id, speaker, segment)
SELECT conv_id, speaker, segment, n_turns, start, rendered,
  coalesce(array_to_string(list_transform(own, lambda x:
    CAST(CAST(x.s - start AS BIGINT) + {head} AS VARCHAR) || '+' || CAST(x.n - {head} AS VARCHAR)), ' '), '') AS mask
FROM grouped"""
