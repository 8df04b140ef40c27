"""Conversation repair against trying every edit."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from finstat.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def tried(kinds):
    """The least (cost, audit) of all edits with at most two insertions in a place."""
    gaps = [("", 0, "")] + [(r, 2, "I") for r in "ua"] + [(a + b, 4, "II") for a in "ua" for b in "ua"]
    choices = []
    for kind in kinds:
        own, worse = {"S": "s", "U": "u", "A": "a", "!": "?"}.get(kind, kind), int(kind in "SUA!")
        edits = [("", 3, "D")]
        if kind != "-":
            edits += [(own, worse, "K"), ("u", 2 + worse, "R"), ("a", 2 + worse, "R")]
        choices.append([(g[0] + e[0], g[1] + e[1], g[2] + e[2]) for g in gaps for e in edits])
    best = None
    for parts in product(*choices, gaps):
        if re.fullmatch("(s?(ua)+)?", "".join(p[0] for p in parts)):
            found = (sum(p[1] for p in parts), "".join(p[2] for p in parts))
            best = found if best is None else min(best, found)
    return best


def by_blocks(kinds, size):
    return R.repair([{p: R.block_items(kinds[i : i + size], p) for p in R.STATES} for i in range(0, len(kinds), size)])


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_short_conversations(n):
    for kinds in product("suaSUA?!-", repeat=n):
        assert by_blocks("".join(kinds), 256) == tried(kinds)


@settings(max_examples=40, deadline=None)
@given(st.text("suaSUA?!-", min_size=3, max_size=3))
def test_three_rows(kinds):
    assert by_blocks(kinds, 256) == by_blocks(kinds, 1) == tried(kinds)


@settings(max_examples=60, deadline=None)
@given(st.text("suaSUA?!-", max_size=40), st.integers(1, 12))
def test_blocks_do_not_matter(kinds, size):
    assert by_blocks(kinds, size) == by_blocks(kinds, 1000)


def test_an_item_is_final_when_popped_though_a_longer_way_is_cheaper():
    edges = {"a": [("b", (5, "x")), ("c", (1, "z"))], "c": [("b", (4, "a")), ("d", (0, ""))], "d": [("b", (4, "a"))], "b": []}
    found = R.lightest([("a", (0, ""))], edges.__getitem__)
    assert found["b"] == (5, "x") and found["d"] == (1, "z")


def by_hand(rows):
    """The contract, row by row: conv_id -> its row of the result."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role = "user" if lot == 4 else role
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        convs.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(lot, 1))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "none" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        initials = [role[:1] if role[:1] in tuple("sua") else "?" for _, role, _ in own]
        kinds = "".join("-" if f in ("blank", "duplicate") else R.CUT_OFF[i] if f == "truncated" else i for i, f in zip(initials, faults, strict=True))
        cost, audit = by_blocks(kinds, 10_000)
        done = [f"{role}:{text}" for role, text in R.repaired_rows(audit, iter([(role, text) for _, role, text in own]))]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(done).encode()).hexdigest(),
        )
    return out


def found(frame):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = frame.select("conv_id", *columns).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def talk(conv, n, seed):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "  ", "", "x" * 50, "Why?", "ok.\n\t"]
    roles = ["system", "user", "assistant", "tool", "User", ""]
    return [
        (conv, draw.randrange(2 * n), draw.choices(roles, [1, 5, 5, 1, 1, 1])[0], draw.choice(texts) + draw.choice(["", str(draw.randrange(3 * n)) + "."]))
        for _ in range(n)
    ]


def test_messy_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, None, None, None), (2, None, "user", "a"), (None, 3, "user", "Hm."), (None, None, None, "x.")]
    rows += [(3, 5, "user", "same."), (3, 5, "user", "same."), (3, 9, "user", "same."), (4, -4, "system", "Be kind."), (4, 7, "assistant", None)]
    rows += [(5, 1, "user", "long " * 100_000), (6, 1, "assistant", " \t\r\n")]
    for conv in range(10, 40):
        rows += talk(conv, 1 + conv % 9, conv)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS task", "'d' AS digest", "2 AS n", "0 AS part", "'z' AS audit", "1 AS cost")
    want = by_hand(rows)
    assert found(R.op13(frame)) == want
    assert found(R.op13(frame.repartition(5))) == want


def test_a_conversation_with_most_rows_is_dealt_over_tasks(spark):
    rows = talk(7, 1500, 1) + [row for conv in range(8, 60) for row in talk(conv, 5, conv)]
    rows += [(7, 10_000 + n, "user", "again.") for n in range(400)]  # duplicates, in blocks of their own
    rows += [(7, 3, "assistant", "a third of a turn")] * 600
    frame = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(R.op13(frame)) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_conversations_without_rows(spark):
    gone = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:5]
    frame = spark.createDataFrame([(c, t, "user", "Hi.") for c, t in gone], SCHEMA)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(R.op13(frame)) == {c: empty for c, _ in gone}
    assert R.op13(frame.limit(0)).count() == 0


def test_undamaged_rows_can_be_repaired_too(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Well."), (1, 4, "user", "Bye.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = "system:Be kind.\nuser:Hi.\nassistant:Well.\nuser:Bye.\nassistant:"
    assert found(R.repair_conversations(frame, frame)) == {1: (0, 0, 1, 0, 3, 7, "KKDRKI", hashlib.sha256(want.encode()).hexdigest())}
