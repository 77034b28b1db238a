"""Sharding by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table; shards take turns claiming their
next free slot until the table is full. A row's key hashes to a slot, and the broadcast table gives its
shard in constant time. Adding or removing a shard moves little more than its own share of the rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A prime; the table has this many slots, whatever the input.
SLOTS = 65_537


def _two(name: str) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot. ``slots`` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not prime")
    starts = [(a % slots, b % (slots - 1) + 1) for a, b in map(_two, shards)]
    owner, step, left = [-1] * slots, [0] * len(shards), slots
    while True:
        for i, (offset, skip) in enumerate(starts):
            while owner[at := (offset + step[i] * skip) % slots] >= 0:
                step[i] += 1
            owner[at] = i
            step[i] += 1
            left -= 1
            if left == 0:
                return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as ``slot, shard``; its size is ``slots``, whatever the input."""
    owner = lookup_table(shards, slots)
    names = F.array(*[F.lit(s) for s in shards])
    packed = F.array_repeat(F.lit(0), 0) if not owner else F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(packed).alias("slot", "i")).select("slot", F.element_at(names, F.col("i").cast("int") + 1).alias("shard"))


def place(rows: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` (int) and ``shard`` (string): one broadcast join, no shuffle of the rows.

    Rows with equal keys land in one shard; null keys hash to one slot like any other value. A key that may
    hold a large share of the rows should be widened by another column (such as the row's own id). Columns
    named slot or shard are replaced. An empty table stays empty; repeated rows all stay.
    """
    kept = rows.drop("slot", "shard")
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])
    slot = F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")
    return kept.withColumn("slot", slot).join(F.broadcast(table_frame(rows.sparkSession, shards, slots)), "slot", "left").select(*kept.columns, "slot", "shard")
