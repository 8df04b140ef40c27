"""Sharding by histogram sort: equal bytes per shard. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstat.llm.common import or_empty, staged

PROBE = 2  # hex digits that a round adds to a probe: 256 candidate boundaries an interval
END = "~"  # sorts after every hex digit: the end of an interval


def sort_key(columns: Sequence[str | Column]) -> Column:
    """64 hashed bits of each column as hex, in order: rows with equal first columns lie together."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0")) for c in columns])


def splitters(keyed: DataFrame, n_shards: int, tolerance: float = 0.01) -> list[str]:
    """Keys that cut the rows (key, size) into shards of nearly equal bytes.

    Every round counts the exact bytes below the candidate boundaries inside each open
    interval, over all rows, and narrows the interval around each splitter's target.
    A splitter is settled once a boundary lies within ``tolerance`` of a shard's mean,
    or its interval holds one row or one key; it is the nearer end of the interval. So
    rows whose first key column is equal are parted only where the tolerance needs it.
    The driver gets at most 256 counts per open splitter and round.
    """
    digits = len(keyed.select("key").first()["key"]) if not keyed.isEmpty() else 0
    if not digits or n_shards < 2:
        return []
    total = keyed.agg(F.sum("size")).first()[0]
    slack = tolerance * total / n_shards
    found: dict[int, str] = {}
    pending = {shard: ("", 0) for shard in range(1, n_shards)}  # splitter -> interval, bytes below it
    depth = 0
    while pending:
        depth += PROBE
        rows = keyed.filter(F.substring("key", 1, depth - PROBE).isin(sorted({p for p, _ in pending.values()})))
        counts = rows.groupBy(F.substring("key", 1, depth).alias("probe")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
        )
        bins = sorted(tuple(row) for row in counts.collect())
        still = {}
        for shard, (prefix, below) in pending.items():
            target = total * shard / n_shards
            inside = [b for b in bins if b[0].startswith(prefix)]
            for probe, size, n in inside:
                if below + size >= target or probe == inside[-1][0]:
                    near = min(abs(target - below), abs(below + size - target))
                    if near <= slack or n == 1 or depth >= digits:
                        found[shard] = probe if target - below <= below + size - target else probe + END
                    else:
                        still[shard] = (probe, below)
                    break
                below += size
        pending = still
    return sorted(found.values())


def histogram_shards(
    rows: DataFrame, n_shards: int, size: Column, key: Sequence[str | Column], tolerance: float = 0.01
) -> DataFrame:
    """The rows with shard, slot and shard_bytes columns, dealt out in one exchange by (shard, key).

    ``shard`` runs from 0 to n_shards - 1, ``slot`` from 0 without gaps in each shard. The
    rows cross the network once, by range, and are written sorted to the shared folder; a slot
    is a row's place in its sorted part plus the rows of the parts before, so no task
    holds a shard. Pass only the columns that are to be moved.

    - Rows equal in every key column stay in one shard and may swap slots among themselves.
    - Null key columns hash alike; a null size counts as 0.
    - An empty table gives no rows. Columns named like a result are replaced.
    """
    own = {"shard", "slot"}
    kept = [c for c in rows.columns if c not in own]
    keyed = rows.select(sort_key(key).alias("key"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    cuts = splitters(staged(keyed, "keys"), n_shards, tolerance)
    place = sort_key(key)
    shard = sum((F.when(place >= cut, 1).otherwise(0) for cut in cuts), F.lit(0)) if cuts else F.lit(0)
    dealt = (
        rows.select(F.struct(*kept).alias("row"), place.alias("key"), shard.alias("shard"))
        .repartitionByRange("shard", "key")
        .sortWithinPartitions("shard", "key")
        .select(
            "row",
            "shard",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
        )
    )
    dealt = staged(dealt, "shards")
    parts = dealt.groupBy("part", "shard").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return dealt.join(starts, ["part", "shard"]).select(
        "row.*", F.col("shard").cast("int").alias("shard"), (F.col("place") + F.col("shift")).cast("long").alias("slot")
    )


def op4(documents: DataFrame, n_shards: int = 24) -> DataFrame:
    """Documents in 24 shards of nearly equal bytes; copies of a text lie together."""
    text = or_empty("text")
    narrow = documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    sharded = histogram_shards(staged(narrow, "sizes"), n_shards, F.col("size"), ["text_hash", "doc_id"])
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
