"""op12 against every path in order of its weight, on given and on odd conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from foliant.llm import fst_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = WORD.findall(text)
        out.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """The least (cost, labels) of all edits, found by trying them in order of weight; and the repaired lines."""
    bad = faults(rows)
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, labels, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, labels, lines
        if not any(GRAMMAR.fullmatch(initials + end) for end in ("", "a", "ua")):
            continue
        for x, role in (("u", "user"), ("a", "assistant")):
            heapq.heappush(heap, (cost + 5, labels + "I", at, initials + x, (*lines, f"{role}:")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 2, labels + "D", at + 1, initials, lines))
            if bad[at] not in ("b", "d"):
                more = 5 if bad[at] == "t" else 0
                heapq.heappush(heap, (cost + more, labels + "K", at + 1, initials + (role[:1] or "-"), (*lines, f"{role}:{text}")))
                for x, new in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (cost + more + 1, labels + "R", at + 1, initials + x, (*lines, f"{new}:{text}")))


def expected(rows):
    """rows: (turn, role, text) after damage, in order."""
    bad, initials = faults([r[1:] for r in rows]), [r[1][:1] for r in rows]
    cost, labels, lines = brute([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": bad.count("b"), "duplicate": bad.count("d"), "truncated": bad.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": labels, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damage(rows):
    """The contract's damage, row by row."""
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        fate = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def in_order(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held = {}
    for conv, *row in damage(rows):
        held.setdefault(conv, []).append(tuple(row))
    want = {conv: expected(in_order(held.get(conv, []))) for conv in {r[0] for r in rows}}
    got = {r.conv_id: r.asDict() for r in fst_repair.query(spark, sf).collect()}
    assert {k: {c: v for c, v in r.items() if c != "conv_id"} for k, r in got.items()} == want


@pytest.mark.parametrize("parts", ["1", "7"])
def test_odd_rows_in_any_number_of_pieces(spark, parts):
    """Long and short conversations of odd rows; with many partitions the long ones are cut into pieces."""
    rng = random.Random(5)
    rows = []
    for conv in (*range(20), None):
        for turn in range(rng.choice((1, 2, 3, 5))):
            rows.append((conv, rng.choice((turn, turn, None, 2)), rng.choice(("user", "assistant", "system", "tool", "", None)), rng.choice(("Yes.", "No", "", None, "Why?  \n", f"Turn {turn}!"))))
    long = [(77, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(300)]
    rows += long + long[:1] + [(88, None, "system", " ")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, kind string")
        got = {r.conv_id: r.asDict() for r in fst_repair.repair(df, df.select("conv_id").distinct()).collect()}
        turns = fst_repair.repair(df, turns_out=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    space = lambda x: " " if x is None else x
    for conv in {r[0] for r in rows} - {77}:
        own = in_order([(t, space(role), space(text)) for c, t, role, text in rows if c == conv])
        assert {c: v for c, v in got[conv].items() if c != "conv_id"} == expected(own), conv
        lines = [f"{r.role}:{r.text}" for r in sorted(turns, key=lambda r: r.place) if r.conv_id == conv]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[conv]["repaired_sha256"]
    assert got[77]["audit"] == "KD" + "K" * 299 and got[77]["duplicate"] == 1 and got[77]["cost"] == 2


def test_dropped_and_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert fst_repair.repair(none).count() == 0
    ids = spark.createDataFrame([(5,)], "conv_id long")
    row = fst_repair.repair(none, ids).first()
    assert (row.conv_id, row.gaps, row.cost, row.audit, row.repaired_sha256) == (5, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_many_equal_rows(spark):
    """A row repeated often is counted before it moves; every copy but the first is deleted."""
    df = spark.range(30_000).selectExpr("CAST(NULL AS BIGINT) AS conv_id", "1 AS turn", "'user' AS role", "'Same.' AS text")
    row = fst_repair.repair(df).first()
    assert row.duplicate == 29_999 and row.cost == 2 * 30_000 and row.audit == "D" * 30_000
