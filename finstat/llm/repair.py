"""Conversation structure repair: the cheapest edits, by Knuth's lightest-derivation agenda over repair items."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstat.llm.common import staged

# Costs of the edits. A row that is kept or given another role costs TRUNCATED more if it is cut off.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# What role initials may follow each other: (s?(ua)+)? as an automaton. A state is what was read last, "" nothing yet.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FINAL = ("", "a")
STATES = tuple(NEXT)
# What a role initial written or inserted stands for.
ROLE = {"u": "user", "a": "assistant"}
CUT_OFF = {"s": "S", "u": "U", "a": "A", "?": "!"}
BLOCK = 256  # rows of a conversation that one agenda looks at

Weight = tuple[int, str]


def lightest(
    axioms: Iterable[tuple[Hashable, Weight]],
    rules: Callable[[Hashable], Iterable[tuple[Hashable, Weight]]],
    goals: set | None = None,
) -> dict:
    """The least weight of each item that can be derived, by Knuth's generalisation of Dijkstra's algorithm.

    ``rules`` gives what follows from an item and the weight that the deduction adds. A weight is (cost, audit): costs
    add up and audits are joined, so a conclusion weighs no less than its premise, and no lighter premise
    of an item gives a heavier conclusion. Hence an item is final when it is popped. Stops when all ``goals`` are final.
    """
    agenda = [(weight, item) for item, weight in axioms]
    heapq.heapify(agenda)
    final: dict = {}
    open_goals = set(goals or ())
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        open_goals.discard(item)
        if goals is not None and not open_goals:
            break
        cost, audit = weight
        for conclusion, (more, letters) in rules(item):
            if conclusion not in final:
                heapq.heappush(agenda, ((cost + more, audit + letters), conclusion))
    return final


def edits(kind: str, state: str) -> Iterator[tuple[str, Weight]]:
    """The edits of one row in a state: the state after it, and their weight.

    A kind is the row's role initial, ``?`` for another than s, u and a, or what CUT_OFF gives for it; ``-`` is a row that has to go.
    """
    yield state, (DELETE, "D")
    if kind != "-":
        worse = TRUNCATED if kind in CUT_OFF.values() else 0
        for role in NEXT[state]:
            if role == kind.lower():
                yield role, (KEEP + worse, "K")
            elif role != "s":
                yield role, (REROLE + worse, "R")


def insertions(state: str) -> Iterator[tuple[str, Weight]]:
    for role in NEXT[state]:
        if role != "s":
            yield role, (INSERT, "I")


@lru_cache(maxsize=100_000)
def block_items(kinds: str, start: str) -> dict[str, Weight]:
    """The lightest repair of a block of rows from one state to each state.

    Items are (rows done, state). Insertions stand before a row, so a block's audit ends with the edit of a row and no
    audit of a block is the beginning of another one.
    """

    def rules(item: tuple[int, str]) -> Iterator[tuple[tuple[int, str], Weight]]:
        done, state = item
        if done < len(kinds):
            for after, weight in insertions(state):
                yield (done, after), weight
            for after, weight in edits(kinds[done], state):
                yield (done + 1, after), weight

    found = lightest([((0, start), (0, ""))], rules)
    return {state: found[len(kinds), state] for state in STATES if (len(kinds), state) in found}


def repair(blocks: list[dict[str, dict[str, Weight]]]) -> Weight:
    """(cost, audit) of the cheapest repair of a conversation, of equally cheap ones the least audit.

    ``blocks`` gives, of each block of rows in order, the lightest repair between any two states. An item (blocks done, state)
    and a block's repair from that state are the two premises of the next item: one hyperedge.
    The goal follows from a final state after the last block and its insertions.
    """
    n, goal = len(blocks), "goal"

    def rules(item: Hashable) -> Iterator[tuple[Hashable, Weight]]:
        done, state = item
        if done < n:
            yield from (((done + 1, after), weight) for after, weight in blocks[done].get(state, {}).items())
        else:
            yield from (((n, after), weight) for after, weight in insertions(state))
            if state in FINAL:
                yield (n + 1, goal), (0, "")

    return lightest([((0, ""), (0, ""))], rules, {(n + 1, goal)})[n + 1, goal]


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) rows after the edits, from those before; one row is held at a time."""
    state = ""
    for edit in audit:
        if edit == "I":
            state = {"u": "a"}.get(state, "u")
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = role[0]
            yield role, text
        elif edit == "R":
            state = {"u": "a"}.get(state, "u")
            yield ROLE[state], text


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of ``conv_id:turn`` chooses. Nulls count as one space.

    Remainder 0 of 20 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's.
    """

    def spelled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn"))) % 20
    text = spelled("text")
    return rows.select(
        "conv_id",
        "turn",
        F.when(lot == 4, "user").otherwise(spelled("role")).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(lot == 0, F.array().cast("array<int>")).when(lot == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def narrow(rows: DataFrame) -> DataFrame:
    """One row for each (conversation, turn, role, text), with how often it is there, in place of the texts.

    Also the role's initial, and whether the text is blank or cut off.
    """
    solid = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    first = F.substring("role", 1, 1)
    compact = rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.when(first.isin("s", "u", "a"), first).otherwise("?").alias("initial"),
        (solid == "").alias("blank"),
        (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut_off"),
    )
    once = [F.first(c).alias(c) for c in ("initial", "blank", "cut_off")]
    return compact.groupBy("conv_id", "turn", "role", "digest").agg(*once, F.count(F.lit(1)).alias("n"))


BLOCK_SCHEMA = (
    "conv_id long, task int, number long, opens string, closes string, illegal long, blank long, duplicate long, truncated long, "
    "least long, most long, turns long, items map<string, map<string, struct<cost: long, audit: string>>>"
)


class Block:
    """Some rows of a conversation in a row, and what is counted of them."""

    def __init__(self, task: int, number: int) -> None:
        self.place = {"task": task, "number": number}
        self.kinds: list[str] = []
        self.initials: list[str] = []
        self.turns: list[int] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, initial: str, blank: bool, cut_off: bool, again: bool) -> None:
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut_off else None
        if fault:
            self.faults[fault] += 1
        self.initials.append(initial)
        self.kinds.append("-" if blank or again else CUT_OFF[initial] if cut_off else initial)
        if turn is not None and self.turns[-1:] != [turn]:
            self.turns.append(turn)

    def row(self, conv_id: int | None, starts: Iterable[str]) -> dict:
        kinds = "".join(self.kinds)
        pairs = zip(self.initials, self.initials[1:], strict=False)
        return {
            "conv_id": conv_id,
            **self.place,
            "opens": self.initials[0],
            "closes": self.initials[-1],
            "illegal": sum(a + b not in LEGAL for a, b in pairs),
            **self.faults,
            "least": self.turns[0] if self.turns else None,
            "most": self.turns[-1] if self.turns else None,
            "turns": len(self.turns),
            "items": [
                (p, [(q, {"cost": cost, "audit": audit}) for q, (cost, audit) in block_items(kinds, p).items()]) for p in starts
            ],
        }


LEGAL = ("su", "ua", "au")


def joined(blocks: list[dict]) -> dict:
    """The counts of a conversation from those of its blocks, in order, and its cheapest repair."""
    found = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    turns, least, most, closes = 0, None, None, None
    for block in blocks:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            found[name] += block[name]
        if closes is not None and closes + block["opens"] not in LEGAL:
            found["illegal"] += 1
        closes = block["closes"]
        if block["turns"]:
            turns += block["turns"] - (most == block["least"])
            least, most = block["least"] if least is None else least, block["most"]
    if least is not None:
        found["gaps"] = most - least + 1 - turns
    items = [{p: {q: (w["cost"], w["audit"]) for q, w in ends} for p, ends in block["items"]} for block in blocks]
    found["cost"], found["audit"] = repair(items)
    return found


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
HEAD_SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
ROWS_AT_ONCE = 1000


def repair_conversations(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_ids``: its faults, the cheapest repair and a digest of the repaired rows.

    ``rows`` has conv_id, turn, role and text, the last two without nulls; ``conv_ids`` has a conv_id.
    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows go by turn, nulls first; those of one turn by role and then by the SHA-256 of their text. The first
    fault of a row counts. The repair is the cheapest one whose roles read system?, (user, assistant)+ or
    nothing; audit has a letter per edit (Keep, Rerole, Delete, Insert), the least one of equally cheap repairs.

    A long conversation is dealt over tasks by ranges of turns. Each range is cut into blocks of rows; the agenda runs over
    the rows of a block, and then over the blocks. The digest of the repaired rows is a chain over all of
    them, so the texts of one conversation do pass through one task, a batch of rows at a time.

    - Null conversation ids are one conversation. Null turns count to no gap.
    - Repeated rows are duplicates. Texts of any length are read whole.
    - A conversation without rows has zeros, an empty audit and the digest of an empty text.
    - An empty table gives no rows. Other columns are not read.
    """
    blocks_as, heads_as = _arrow(BLOCK_SCHEMA), _arrow(HEAD_SCHEMA)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block | None = None
        conv: int | None = None
        first, number, out = True, 0, []

        def close() -> None:
            # Only the first conversation of a range may have rows in the range before, and only later blocks have rows before them.
            out.append(held.row(conv, STATES if first or number else STATES[:1]))

        for batch in batches:
            for task, at, turn, n, *marks, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and at != conv:
                    close()
                    held, first, number = None, False, 0
                elif held is None and number and at != conv:
                    first, number = False, 0
                conv = at
                for _ in range(n):
                    held = held or Block(task, number)
                    held.add(turn, *marks, again)
                    again = True
                    if len(held.kinds) == BLOCK:
                        close()
                        held, number = None, number + 1
                if len(out) >= ROWS_AT_ONCE:
                    yield _batch(out, blocks_as)
                    out.clear()
        if held:
            close()
        if out:
            yield _batch(out, blocks_as)

    compact = staged(narrow(rows), "turns")
    # Of equal (role, text) rows the one of the least turn stays, and of its copies one. The least turn is met by all
    # that tells rows apart, so a text that a third of the rows repeat stays spread.
    least = compact.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("least"))
    same = [F.col(f"c.{name}").eqNullSafe(F.col(f"f.{name}")) for name in ("conv_id", "role", "digest")]
    met = compact.alias("c").join(least.alias("f"), [*same, F.col("c.turn").eqNullSafe(F.col("f.least.turn"))], "left")
    placed = (
        met.select("c.*", F.col("f.digest").isNull().alias("again"))
        .repartitionByRange("conv_id", "turn", "role", "digest")
        .sortWithinPartitions("conv_id", "turn", "role", "digest")
        .select(F.spark_partition_id().alias("task"), "conv_id", "turn", "n", "initial", "blank", "cut_off", "again")
    )
    blocks = placed.mapInArrow(cut, BLOCK_SCHEMA)

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append({"conv_id": conv_id, **joined(sorted(parts, key=lambda b: (b["task"], b["number"])))})
            yield _batch(out, heads_as)

    every = conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parts = blocks.select("conv_id", F.struct(*[c for c in blocks.columns if c != "conv_id"]).alias("block"))
    none = every.select("conv_id", F.lit(None).cast(parts.schema["block"].dataType).alias("block"))
    found = parts.unionByName(none).groupBy("conv_id").agg(F.collect_list("block").alias("blocks"))
    repaired = staged(found.mapInArrow(heads, HEAD_SCHEMA), "repairs")

    # Each conversation's head comes before its rows, so that one pass over them makes the digest.
    names = [*COUNTS, "audit"]
    head = repaired.select(
        "conv_id", F.lit(0).alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"))], *names
    )
    body = rows.select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), *[F.lit(None).cast(repaired.schema[c].dataType).alias(c) for c in names]
    )
    streamed = (
        head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest").drop("digest", "turn", "part")
    )

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = heads_as.append(pa.field("repaired_sha256", pa.string()))
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for conv_id, group in groupby(flat, key=lambda row: row[0]):
            _, _, _, *counts, audit = next(group)
            chain = hashlib.sha256()
            between = b""
            for role, text in repaired_rows(audit, ((row[1], row[2]) for row in group)):
                chain.update(between + f"{role}:{text}".encode())
                between = b"\n"
            out.append({"conv_id": conv_id, **dict(zip(COUNTS, counts, strict=True)), "audit": audit, "repaired_sha256": chain.hexdigest()})
            if len(out) >= ROWS_AT_ONCE:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return streamed.mapInArrow(digest, HEAD_SCHEMA + ", repaired_sha256 string")


def op13(conversations: DataFrame) -> DataFrame:
    """Damage the conversations, then repair them."""
    return repair_conversations(damaged(conversations), conversations.select("conv_id"))


SQL = r"""
WITH RECURSIVE bits AS (
    SELECT i, 0 AS k, i AS v FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc AS (
    SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), drawn AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
    FROM conversations
), lots AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT)),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS lot
    FROM drawn, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
           CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM lots, LATERAL (SELECT unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS initial,
           regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS solid
    FROM damaged
), faults AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
           CASE WHEN solid = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
    FROM placed
), follows AS (
    SELECT unnest(['', '', 's', 'u', 'a']) AS p, unnest(['s', 'u', 'u', 'a', 'u']) AS q
), inserted AS (
    SELECT unnest(['', '', '', 's', 's', 's', 'u', 'u', 'a', 'a']) AS p, unnest(['', 'u', 'a', 's', 'u', 'a', 'u', 'a', 'a', 'u']) AS q,
           unnest([0, 2, 4, 0, 2, 4, 0, 2, 0, 2]) AS cost, unnest(['', 'I', 'II', '', 'I', 'II', '', 'I', '', 'I']) AS letters
), edits AS (
    SELECT initial, fault, p, q, cost, letter
    FROM (SELECT unnest(['s', 'u', 'a', '?']) AS initial), (SELECT unnest(['blank', 'duplicate', 'truncated', 'none']) AS fault),
         (SELECT p, p AS q, 3 AS cost, 'D' AS letter, '' AS own FROM (SELECT DISTINCT p FROM follows)
          UNION ALL SELECT p, q, 0, 'K', q FROM follows
          UNION ALL SELECT p, q, 2, 'R', '' FROM follows WHERE q <> 's')
    WHERE letter = 'D' OR (fault IN ('truncated', 'none') AND own IN ('', initial))
), steps AS (
    SELECT e.initial, e.fault, i.p, e.q, i.cost + e.cost + CASE WHEN e.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END AS cost,
           i.letters || e.letter AS letters
    FROM inserted i JOIN edits e ON i.q = e.p
), derived AS (
    SELECT conv_id, 0::BIGINT AS done, '' AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT d.conv_id, d.done + 1, s.q, min({'cost': d.best.cost + s.cost, 'audit': d.best.audit || s.letters})
    FROM derived d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.done + 1
    JOIN steps s ON s.initial = f.initial AND s.fault = f.fault AND s.p = d.state
    GROUP BY d.conv_id, d.done, s.q
), sizes AS (
    SELECT c.conv_id, count(f.pos) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
    GROUP BY c.conv_id
), best AS (
    SELECT z.conv_id, min({'cost': d.best.cost + i.cost, 'audit': d.best.audit || i.letters}) AS best
    FROM sizes z JOIN derived d ON d.conv_id IS NOT DISTINCT FROM z.conv_id AND d.done = z.n
    JOIN inserted i ON i.p = d.state AND i.q IN ('', 'a') GROUP BY z.conv_id
), letters AS (
    SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS place, unnest(string_split(best.audit, '')) AS letter FROM best WHERE best.audit <> ''
), applied AS (
    SELECT l.*, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY place) AS pos,
           sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY place) AS nth
    FROM letters l
), kept AS (
    SELECT a.*, f.role, f.text, f.initial FROM applied a LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.pos = a.pos AND a.letter <> 'I'
    WHERE a.letter <> 'D'
), opened AS (
    SELECT *, max(CASE WHEN nth = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM kept
), texts AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS repaired
    FROM opened GROUP BY conv_id
)
SELECT z.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, b.best.cost AS cost, b.best.audit AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM sizes z JOIN best b ON b.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM z.conv_id
"""
