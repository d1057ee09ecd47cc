"""Repair of conversations against an exhaustive search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from curbflow.llm import conversation_repair as repair

LEGAL = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"s?(ua)*u?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def search(rows):
    """Cheapest (cost, audit, output) of rows (role, text, fault): every sequence of edits within the cost of deleting all."""
    best = [(3 * len(rows), "D" * len(rows), [])]

    def go(at, out, cost, audit):
        if cost > best[0][0] or not PREFIX.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            return
        if at == len(rows):
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (cost, audit) < best[0][:2]:
                best[0] = (cost, audit, out)
        else:
            role, text, fault = rows[at]
            go(at + 1, out, cost + 3, audit + "D")
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                go(at + 1, [*out, (role, text)], cost + extra, audit + "K")
                for new in ("user", "assistant"):
                    go(at + 1, [*out, (new, text)], cost + 2 + extra, audit + "R")
        for new in ("user", "assistant"):
            go(at, [*out, (new, "")], cost + 2, audit + "I")

    go(0, [], 0, "")
    return best[0]


def steps(rows):
    """The same by a table over the positions of the pattern, for long conversations."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserts(table):
        todo = list(table)
        while todo:
            at = todo.pop()
            for c, new in (("u", "user"), ("a", "assistant")):
                if c in moves[at]:
                    cost, audit, out = table[at]
                    line = (cost + 2, audit + "I", [*out, (new, "")])
                    to = moves[at][c]
                    if to not in table or line[:2] < table[to][:2]:
                        table[to] = line
                        todo.append(to)
        return table

    table = inserts({0: (0, "", [])})
    for role, text, fault in rows:
        lines = []
        for at, (cost, audit, out) in table.items():
            lines.append((at, (cost + 3, audit + "D", out)))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] in moves[at]:
                lines.append((moves[at][role[:1]], (cost + extra, audit + "K", [*out, (role, text)])))
            for c, new in (("u", "user"), ("a", "assistant")):
                if c in moves[at]:
                    lines.append((moves[at][c], (cost + 2 + extra, audit + "R", [*out, (new, text)])))
        table = {}
        for at, line in lines:
            if at not in table or line[:2] < table[at][:2]:
                table[at] = line
        table = inserts(table)
    return min((v for k, v in table.items() if k in (0, 3)), key=lambda v: v[:2])


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def brute(rows, solve):
    found = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == conv]
        place = lambda r: (
            r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest()
        )
        mine.sort(key=place)
        counts, seen, lines = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, _, role, text in mine:
            chars = WORD.findall(text)
            fault = (
                "blank" if not chars else "duplicate" if (role, text) in seen
                else "" if chars[-1] in ".!?" else "truncated"
            )
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            lines.append((role, text, fault))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, out = solve(lines)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return found


def collected(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    found = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def conversations(spark, rows):
    schema = "conv_id long, turn long, role string, text string, part int, number long, copies string, conv string"
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], schema).repartition(5)


def random_rows(seed, convs, longest, spoilt):
    chance = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(chance.randint(1, longest)):
            role = ["user", "assistant"][turn % 2]
            text = f"says {chance.randint(0, 9)}."
            if chance.random() < spoilt:
                role = chance.choice(["system", "user", "assistant", "tool", "", None])
                text = chance.choice(["", " \t", "no stop", "Yes.", "Yes. \n", "Hm!", "\xa0", "\x1f", None])
            rows.append((conv, None if chance.random() < spoilt / 8 else turn, role, text))
    return rows


def test_automaton_reads_the_grammar():
    for n in range(7):
        for k in range(3**n):
            word = "".join("sua"[k // 3**j % 3] for j in range(n))
            stack = (0,)
            for c in word:
                stack = stack and repair.MACHINE.push(stack, c)
            assert bool(stack and repair.MACHINE.accepts(stack)) == bool(LEGAL.fullmatch(word)), word
    assert len(repair.STACKS) == 8


def test_both_references_agree():
    chance = random.Random(5)
    for _ in range(300):
        rows = [
            (chance.choice(["system", "user", "assistant", "tool", ""]), f"t{k}", chance.choice(["", "", "truncated", "blank"]))
            for k in range(chance.randint(0, 5))
        ]
        assert search(rows) == steps(rows)


def test_parser_as_the_search():
    chance = random.Random(6)
    for _ in range(300):
        rows = [
            (chance.choice(["system", "user", "assistant", "tool", ""]), f"t{k}", chance.choice(["", "", "truncated", "blank"]))
            for k in range(chance.randint(0, 5))
        ]
        front = repair.parse([repair.Row(r[:1], fault) for r, _, fault in rows])
        assert repair.cheapest(front)[:2] == search(rows)[:2]


@pytest.mark.parametrize("segment_rows", [1, 3, 256])
def test_report_as_the_search(spark, segment_rows):
    rows = random_rows(7, [*range(60), None], 5, 0.3)
    rows += [(900, 3, "user", "same."), (900, 3, "user", "same."), (900, 3, "assistant", "b."), (901, None, "user", "x.")]
    rows += [(902, 2**40, "user", "far."), (902, 1, "assistant", "near.")]
    assert collected(repair.report(conversations(spark, rows), segment_rows=segment_rows)) == brute(rows, search)


@pytest.mark.parametrize("segment_rows", [7, 256])
def test_long_conversations(spark, segment_rows):
    rows = random_rows(8, [1, 2, 3], 700, 0.2) + [(4, 5, "user", "again.")] * 300 + random_rows(9, range(5, 30), 9, 0.5)
    assert collected(repair.report(conversations(spark, rows), segment_rows=segment_rows)) == brute(rows, steps)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert collected(repair.report(table)) == brute(rows, steps)


def test_repaired_rows_without_damage(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")]
    fixed, found = repair.repair(conversations(spark, rows))
    lines = [(r.role, r.text) for s in fixed.orderBy("part", "number").collect() for r in s.rows]
    assert lines == steps([("assistant", "Hello.", ""), ("user", "Why?", ""), ("user", "Why?", "duplicate"), ("assistant", "So.", "")])[2]
    assert found.first().cost == 5


def test_table_without_rows(spark):
    assert repair.report(conversations(spark, [])).count() == 0
