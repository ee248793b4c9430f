"""Placing documents on shards through a permutation-filled lookup table, in DataFrame functions alone.

Each shard has a preference order over the slots of a table of prime size: a start and a step, both hashed from its
number (a prime size makes any step visit every slot). The shards take turns, each claiming its next free slot, until
the table is full; so shards hold equal numbers of slots within one, and a change of the number of shards moves few
slots beyond those it must. A document's slot is the hash of its id modulo the table size.

The table has ``SLOTS`` rows whatever the input, so it is broadcast; placing is a lookup in constant time without a
shuffle, and no hot key exists, since a slot's documents never meet.

Defined results: a null id hashes like the empty string; repeated rows go to the same shard; other columns don't matter
and stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@lru_cache(8)
def lookup_table(shards: int = SHARDS, slots: int = SLOTS) -> tuple[int, ...]:
    """The shard of each slot. ``slots`` must be prime."""
    if slots < shards or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime that is no less than the number of shards")
    at = [_hash(f"start {s}") % slots for s in range(shards)]
    step = [_hash(f"step {s}") % (slots - 1) + 1 for s in range(shards)]
    table, free = [-1] * slots, slots
    while True:
        for s in range(shards):
            while table[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % slots
            table[at[s]] = s
            free -= 1
            if not free:
                return tuple(table)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's MD5, modulo the table size."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def placed(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """``docs`` with its shard as column ``name`` (replacing one of that name)."""
    listed = F.split(F.lit(",".join(map(str, lookup_table(shards)))), ",")
    table = docs.sparkSession.range(1).select(F.posexplode(listed).alias("__vg_slot", "__vg_s")).select(F.col("__vg_slot").cast("long"), F.col("__vg_s").cast("int"))
    own = docs.withColumn("__vg_at", slot_of(F.col(f"`{id_col}`")))
    out = own.join(F.broadcast(table), F.col("__vg_at") == F.col("__vg_slot"), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()], F.col("__vg_s").alias(name))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", shards: int = SHARDS) -> None:
    """Write the documents below ``path``, one folder per shard."""
    placed(docs, id_col, shards).write.partitionBy("shard").parquet(path)
