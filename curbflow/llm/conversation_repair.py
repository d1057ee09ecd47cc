"""Least-cost repair of role sequences by a generalised LR parser with weighted edits.

The role grammar is compiled to an LR automaton. A graph-structured stack holds all
readings of a conversation at once: every row may be kept, given another role or deleted,
and rows may be inserted; stack tops in one state merge into the cheapest (cost, audit).

Conversations of any length are parsed in segments. A segment that does not begin its
conversation is parsed from every stack the grammar allows, and a pass over the segments
joins them: what a task holds of a conversation is its audit, one letter per row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Costs of the edits; a truncated row that stays adds one.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Roles that an edit may write, by initial.
WRITTEN = {"u": "user", "a": "assistant"}
# D: the dialogue, an optional system row and turns; P: turns, each a user and an assistant row.
GRAMMAR = (("D", ""), ("D", "P"), ("D", "sP"), ("P", "ua"), ("P", "Pua"))
END = "$"

SEGMENT_ROWS = 256
SEGMENT_BYTES = 1 << 20

BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


class Automaton:
    """LR(0) states of a grammar with one token of lookahead where a state could do both.

    ``shift[state][symbol]`` is the next state. ``complete[state]`` is a rule reduced
    whatever follows; ``at_end[state]`` one reduced only at the end of the input.
    """

    def __init__(self, grammar=GRAMMAR, start: str = "D"):
        self.grammar = grammar
        heads = {head for head, _ in grammar}
        top = (("", start), *grammar)

        def closure(items: frozenset) -> frozenset:
            items, todo = set(items), list(items)
            while todo:
                rule, dot = todo.pop()
                body = top[rule][1]
                if dot < len(body) and body[dot] in heads:
                    for k, (head, _) in enumerate(top):
                        if head == body[dot] and (k, 0) not in items:
                            items.add((k, 0))
                            todo.append((k, 0))
            return frozenset(items)

        states, self.shift = [closure(frozenset([(0, 0)]))], []
        for state in states:
            moves = {}
            for symbol in sorted({top[r][1][d] for r, d in state if d < len(top[r][1])}):
                after = closure(frozenset((r, d + 1) for r, d in state if top[r][1][d : d + 1] == symbol))
                if after not in states:
                    states.append(after)
                moves[symbol] = states.index(after)
            self.shift.append(moves)
        self.complete: dict[int, tuple[str, int]] = {}
        self.at_end: dict[int, tuple[str, int]] = {}
        self.accepting = {n for n, s in enumerate(states) if (0, 1) in s}
        for number, state in enumerate(states):
            done = [r for r, d in state if d == len(top[r][1]) and r]
            if len(done) > 1:
                raise ValueError("two rules end in one state: the grammar needs more lookahead")
            if done:
                head, body = top[done[0]]
                # The start symbol is followed by the end alone.
                (self.at_end if head == start else self.complete)[number] = (head, len(body))

    def reduced(self, stack: tuple[int, ...], rules: dict[int, tuple[str, int]]) -> tuple[int, ...]:
        """The stack after all reductions that ``rules`` call for."""
        while stack[-1] in rules:
            head, size = rules[stack[-1]]
            stack = stack[: len(stack) - size]
            if head not in self.shift[stack[-1]]:
                break
            stack += (self.shift[stack[-1]][head],)
        return stack

    def push(self, stack: tuple[int, ...], initial: str) -> tuple[int, ...] | None:
        """The stack after reading a role's initial, None where the grammar forbids it."""
        state = self.shift[stack[-1]].get(initial)
        return None if state is None else self.reduced((*stack, state), self.complete)

    def accepts(self, stack: tuple[int, ...]) -> bool:
        return self.reduced(stack, self.at_end)[-1] in self.accepting

    def stacks(self) -> list[tuple[int, ...]]:
        """Every stack that some row sequence leads to. This grammar has eight."""
        found, todo = [(0,)], [(0,)]
        while todo:
            stack = todo.pop()
            for initial in "sua":
                after = self.push(stack, initial)
                if after and after not in found:
                    found.append(after)
                    todo.append(after)
        return sorted(found)


MACHINE = Automaton()
STACKS = MACHINE.stacks()
NUMBER = {stack: k for k, stack in enumerate(STACKS)}
# What each stack becomes on each initial, as stack numbers: the arcs of the graph.
ARCS = [{c: NUMBER[s] for c in "sua" if (s := MACHINE.push(stack, c))} for stack in STACKS]
TOPS = [stack[-1] for stack in STACKS]
ENDS = {k for k, stack in enumerate(STACKS) if MACHINE.accepts(stack)}

# Live readings: for every stack top the cheapest (cost, audit, stack).
Front = dict[int, tuple[int, str, int]]


def offer(front: Front, cost: int, audit: str, stack: int) -> bool:
    """Merge a reading into the top it shares; true if it is the cheapest there.

    Rows read so far are equal, so an audit that begins another one of the same cost is
    that audit: an insert more costs more. Audits therefore stay ordered whatever follows,
    and tops in one state have the same future whatever lies below them in this grammar.
    """
    top = TOPS[stack]
    if top in front and front[top][:2] <= (cost, audit):
        return False
    front[top] = (cost, audit, stack)
    return True


def with_inserts(front: Front) -> Front:
    """All readings reached by inserting rows, cheapest first."""
    todo = sorted(front.values())
    while todo:
        cost, audit, stack = todo.pop(0)
        if front[TOPS[stack]] != (cost, audit, stack):
            continue
        for initial in WRITTEN:
            after = ARCS[stack].get(initial)
            if after is not None and offer(front, cost + INSERT, audit + "I", after):
                todo.append((cost + INSERT, audit + "I", after))
                todo.sort()
    return front


@dataclass(frozen=True)
class Row:
    """What a parser sees of a row: its role's initial, its fault, and copies that must go."""

    initial: str
    fault: str  # "blank", "duplicate", "truncated" or ""
    copies: int = 1


def read_row(front: Front, row: Row) -> Front:
    """All readings after one row and its further copies, inserts included."""
    after: Front = {}
    must_go = row.fault in ("blank", "duplicate")
    extra = TRUNCATED if row.fault == "truncated" else 0
    for cost, audit, stack in front.values():
        offer(after, cost + DELETE, audit + "D", stack)
        if must_go:
            continue
        kept = ARCS[stack].get(row.initial)
        if kept is not None:
            offer(after, cost + extra, audit + "K", kept)
        for initial in WRITTEN:
            written = ARCS[stack].get(initial)
            if written is not None:
                offer(after, cost + extra + RENAME, audit + "R", written)
    if row.copies > 1:
        more = row.copies - 1
        after = {t: (c + DELETE * more, a + "D" * more, s) for t, (c, a, s) in with_inserts(after).items()}
    return with_inserts(after)


def parse(rows: list[Row], stack: int = NUMBER[(0,)]) -> Front:
    """Cheapest reading of the rows per stack top, begun with one stack."""
    front = with_inserts({TOPS[stack]: (0, "", stack)})
    for row in rows:
        front = read_row(front, row)
    return front


def cheapest(front: Front) -> tuple[int, str, bool]:
    """Cost and audit of the best complete reading, and whether it begins with a system row.

    Deleting every row always is a complete reading.
    """
    cost, audit, stack = min(reading for reading in front.values() if reading[2] in ENDS)
    return cost, audit, MACHINE.shift[0]["s"] in STACKS[stack]


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The rows that a fixed rule of damage leaves, ``copies`` of each.

    By the crc of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes away
    its full stops, exclamation and question marks, 3 repeats it and 4 makes it the user's.
    Nulls read as one space, a null conversation or turn in that text as well.
    """
    conv, turn = F.col(conv_col), F.col(turn_col)
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), space), F.coalesce(turn.cast("string"), space))
    code = F.crc32(key) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.where(code != 0).select(
        conv.alias("conv"), turn.alias("turn"),
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def with_first(rows: DataFrame) -> DataFrame:
    """Equal rows counted, and whether their role and text came up in an earlier turn.

    Copies are summed before the shuffle. The first turn of every role and text is an
    aggregate joined back, not a window: a pair that holds most rows may be split.
    """
    digest = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    counted = stored(
        rows.withColumn("said", F.unhex(digest)).groupBy("conv", "turn", "said").agg(
            F.any_value("role").alias("role"), F.any_value("text").alias("text"), F.sum("copies").alias("copies")
        ),
        "turns",
    )
    keys = counted.select(F.struct("conv", "said").alias("key"), place.alias("place"))
    first = keys.groupBy(F.col("key").alias("_key")).agg(F.min("place").alias("_place"), F.count(F.lit(1)).alias("_turns"))
    again = first.where("_turns > 1")
    same = F.struct("conv", "said") == F.col("_key")
    return counted.join(again, same, "left").select(
        "conv", "turn", "role", "text", "copies", "said",
        F.coalesce(place > F.col("_place"), F.lit(False)).alias("seen"),
    )


def fault_of(text: str, seen: bool) -> str:
    if BLANK.match(text):
        return "blank"
    if seen:
        return "duplicate"
    return "" if LAST.search(text).group(1) in ".!?" else "truncated"


READING = "struct<begun:int,stack:int,cost:bigint,audit:string>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
SEGMENT = (
    "part int, number long, first_role string, last_role string, first_turn long, last_turn long, low long, high long, "
    f"turns long, {', '.join(f'{c} long' for c in COUNTS)}, rows long, readings array<{READING}>, "
    "said array<struct<role:string,text:string>>, copies array<bigint>"
)
LEGAL = {"su", "ua", "au"}


class _Segment:
    """Rows of one conversation that lie together, up to a limit."""

    def __init__(self, conv, begins: bool):
        self.conv, self.begins = conv, begins
        self.rows: list[Row] = []
        self.said: list[dict] = []
        self.turns: list[int | None] = []
        self.bytes = 0

    def add(self, turn, role: str, text: str, copies: int, seen: bool) -> None:
        fault = fault_of(text, seen)
        self.rows.append(Row(role[:1], fault, copies))
        gone = fault in ("blank", "duplicate")
        self.said.append({"role": None if gone else role, "text": None if gone else text})
        self.turns.append(turn)
        self.bytes += len(text)

    def full(self, most_rows: int) -> bool:
        return len(self.rows) >= most_rows or self.bytes >= SEGMENT_BYTES

    def record(self, part: int, number: int) -> dict:
        found = dict.fromkeys(COUNTS, 0)
        before = None
        for row in self.rows:
            if row.fault:
                found[row.fault] += 1
            again = row.copies - 1
            # A second copy has been seen, unless it is blank.
            found["blank" if row.fault == "blank" else "duplicate"] += again
            found["illegal"] += again + (before is not None and before + row.initial not in LEGAL)
            before = row.initial
        numbers = [t for t in self.turns if t is not None]
        begun = [NUMBER[(0,)]] if self.begins else range(len(STACKS))
        readings = [
            {"begun": b, "stack": stack, "cost": cost, "audit": audit}
            for b in begun for cost, audit, stack in parse(self.rows, b).values()
        ]
        return {
            "conv": self.conv, "part": part, "number": number, **found,
            "first_role": self.rows[0].initial, "last_role": before,
            "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None,
            "low": min(numbers, default=None), "high": max(numbers, default=None), "turns": len(set(numbers)),
            "rows": sum(r.copies for r in self.rows), "readings": readings,
            "said": self.said, "copies": [r.copies for r in self.rows],
        }


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows of ``with_first`` in order, parsed segment by segment.

    Rows are range-partitioned by conversation, turn, role and text, so a long
    conversation spreads over many tasks; ``part`` and ``number`` keep their order.
    """
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "said"]
    placed = (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", "turn", "role", "text", "copies", "seen", F.spark_partition_id().alias("part"))
    )
    kind = rows.schema["conv"].dataType.simpleString()
    schema = pa_schema(placed, f"conv {kind}, {SEGMENT}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, part, out = None, 0, 0, []
        for batch in batches:
            for conv, turn, role, text, copies, seen, part in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and (now.conv != conv or now.full(segment_rows)):
                    out.append(now.record(part, number))
                    number += 1
                    # The first conversation of a part may have begun in the part before.
                    now = _Segment(conv, now.conv != conv)
                elif now is None:
                    now = _Segment(conv, False)
                now.add(turn, role, text, copies, seen)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if now is not None:
            out.append(now.record(part, number))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return placed.mapInArrow(run, f"conv {kind}, {SEGMENT}")


def pa_schema(df: DataFrame, ddl: str) -> pa.Schema:
    """The Arrow form of a schema in text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def _in_order(df: DataFrame) -> DataFrame:
    """All segments of a conversation in one partition, one after another."""
    return df.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "number")


def consume(audit: str, at: int, rows: int) -> int:
    """Where the edits of the next ``rows`` rows end, inserts before each of them included."""
    for _ in range(rows):
        while audit[at] == "I":
            at += 1
        at += 1
    return at


JOINED = (
    "part int, number long, edits string, outputs long, system boolean, last boolean, gaps long, blank long, "
    "duplicate long, truncated long, illegal long, cost long, audit string"
)


def joined(parsed: DataFrame) -> DataFrame:
    """Edits of every segment, and the whole result at the last segment of a conversation."""
    slim = _in_order(parsed.drop("said", "copies"))
    kind = parsed.schema["conv"].dataType.simpleString()
    schema = pa_schema(parsed, f"conv {kind}, {JOINED}")
    names = [f.name for f in slim.schema.fields]

    def finish(conv, held: list[dict], front: Front, sums: dict) -> Iterator[dict]:
        cost, audit, system = cheapest(front)
        turns = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
        at, outputs = 0, 0
        for k, segment in enumerate(held):
            last = k == len(held) - 1
            to = len(audit) if last else consume(audit, at, segment["rows"])
            line = {
                "conv": conv, "part": segment["part"], "number": segment["number"], "edits": audit[at:to],
                "outputs": outputs, "system": system, "last": last,
            }
            outputs += to - at - audit.count("D", at, to)
            at = to
            if last:
                line |= {"gaps": turns, **{c: sums[c] for c in COUNTS}, "cost": cost, "audit": audit}
            yield line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, front, sums = [], [], {}, {}
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                s = dict(zip(names, values))
                if held and held[0]["conv"] != s["conv"]:
                    out += finish(held[0]["conv"], held, front, sums)
                    held = []
                    if len(out) >= 500:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if not held:
                    front = {TOPS[NUMBER[(0,)]]: (0, "", NUMBER[(0,)])}
                    sums = dict.fromkeys(("turns", *COUNTS), 0) | {"low": None, "high": None, "turn": None, "role": None}
                else:
                    sums["illegal"] += sums["role"] + s["first_role"] not in LEGAL
                after: Front = {}
                for r in s["readings"]:
                    for cost, audit, stack in front.values():
                        if stack == r["begun"]:
                            offer(after, cost + r["cost"], audit + r["audit"], r["stack"])
                front = after
                for c in COUNTS:
                    sums[c] += s[c]
                if s["low"] is not None:
                    sums["turns"] += s["turns"] - (sums["turn"] == s["first_turn"])
                    sums["low"] = s["low"] if sums["low"] is None else min(sums["low"], s["low"])
                    sums["high"] = s["high"] if sums["high"] is None else max(sums["high"], s["high"])
                    sums["turn"] = s["last_turn"]
                sums["role"] = s["last_role"]
                held.append({k: s[k] for k in ("conv", "part", "number", "rows")})
        if held:
            out += finish(held[0]["conv"], held, front, sums)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return slim.mapInArrow(run, f"conv {kind}, {JOINED}")


def rendered(edits: str, outputs: int, system: bool, said: list[dict], copies: list[int]) -> list[tuple[str, str]]:
    """Role and text of what the edits of a segment leave, after ``outputs`` rows before it."""
    found, at, left = [], -1, 0
    for edit in edits:
        if edit != "I":
            if not left:
                at += 1
                left = copies[at]
            left -= 1
        if edit == "D":
            continue
        written = WRITTEN["ua"[(outputs + len(found) - system) % 2]]
        if edit == "I":
            found.append((written, ""))
        else:
            row = said[at]
            found.append((row["role"] if edit == "K" else written, row["text"]))
    return found


def repaired_rows(parsed: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv``, ``part``, ``number`` and ``rows`` (role and text) of every segment after repair."""
    kind = parsed.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, part int, number long, rows array<struct<role:string,text:string>>"
    schema = pa_schema(parsed, ddl)
    both = parsed.select("conv", "part", "number", "said", "copies").join(
        edits.select("part", "number", "edits", "outputs", "system"), ["part", "number"]
    ).select("conv", "part", "number", "edits", "outputs", "system", "said", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                lines = [
                    {"conv": c, "part": p, "number": n, "rows": [{"role": r, "text": t} for r, t in rendered(*rest)]}
                    for c, p, n, *rest in zip(*(x.to_pylist() for x in batch.slice(at, 200).columns))
                ]
                yield pa.RecordBatch.from_pylist(lines, schema)

    return both.mapInArrow(run, ddl)


def hashed(repaired: DataFrame) -> DataFrame:
    """``conv`` and the SHA-256 of its ``role:text`` lines, read in order and never gathered.

    A chained hash cannot be split: one task reads the lines of one conversation.
    """
    kind = repaired.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, repaired_sha256 string"
    schema = pa_schema(repaired, ddl)
    lines = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    slim = _in_order(repaired.select("conv", "part", "number", lines.alias("lines"), F.size("rows").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, any_line, out = None, None, False, []
        for batch in batches:
            for conv, lines, n in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if digest is None or now != conv:
                    if digest is not None:
                        out.append({"conv": now, "repaired_sha256": digest.hexdigest()})
                    now, digest, any_line = conv, hashlib.sha256(), False
                if n:
                    digest.update(("\n" if any_line else "").encode() + lines.encode("utf-8", "surrogatepass"))
                    any_line = True
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if digest is not None:
            out.append({"conv": now, "repaired_sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema)

    return slim.mapInArrow(run, ddl)


def repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", segment_rows: int = SEGMENT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Repaired rows and a report, from rows ``conv``, ``turn``, ``role``, ``text`` and ``copies``.

    ``conversations`` must have the two named columns, ``role`` and ``text``; it is taken as
    it stands. See ``report`` for the meaning of every case.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        F.lit(1).cast("long").alias("copies"),
    )
    return _repair(rows, segment_rows)


def _repair(rows: DataFrame, segment_rows: int) -> tuple[DataFrame, DataFrame]:
    parsed = stored(segments(with_first(rows), segment_rows), "segments")
    edits = stored(joined(parsed), "edits")
    return repaired_rows(parsed, edits), edits.where("last")


def report(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Faults, least cost, audit and digest of every conversation after the fixed damage.

    Null roles and texts read as one space; such a role has no place in the grammar and is
    rewritten or deleted, an empty role likewise. A null conversation id is a conversation
    of its own. Rows are taken by turn, null turns first, rows of one turn by role and then
    by a digest of role and text; equal rows of one turn are adjacent copies. Rows that repeat
    in the table are such copies before the damage. A conversation without rows after the
    damage is reported with zeros, an empty audit and the digest of nothing. Other columns are
    not read; a table without rows gives no report. Every step reads stored rows, so a lost
    executor costs the tasks it held.
    """
    damage = damaged(conversations, conv_col, turn_col).withColumn("turn", F.col("turn").cast("long"))
    rows, found = _repair(damage, segment_rows)
    zero = F.lit(0).cast("long")
    every = conversations.select(F.col(conv_col).alias("conv_id")).distinct()
    found = found.select(F.col("conv").alias("_found"), "gaps", *COUNTS, "cost", "audit")
    digests = hashed(rows).withColumnRenamed("conv", "_hashed")
    return (
        every.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, zero).alias(c) for c in ("gaps", *COUNTS, "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
