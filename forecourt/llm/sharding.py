"""Placement of keys on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table; a prime, so that every step visits all slots.
SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of each slot.

    Each shard prefers the slots in an order of its own, a step and an offset
    from its name. Shards take turns; whoever's turn it is claims its next
    preferred slot that is free. Shares differ by one slot at most, and a shard
    more or less moves few others.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be different names, at most as many as slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        owner[at[k]] = k
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard)."""
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    return (
        spark.range(1)
        .select(F.posexplode(owners).alias("slot", "owner"))
        .select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))
    )


def slot_of(key, slots: int = SLOTS) -> F.Column:
    """Slot of a key: 60 bits of its MD5, the same in every engine. A null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with its slot and shard.

    The table has ``slots`` rows whatever the size of ``df``, so it is broadcast;
    rows are neither shuffled nor grouped, and equal keys go to one shard.
    Columns named slot or shard are replaced.
    """
    table = F.broadcast(lookup(df.sparkSession, shards, slots))
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(table, "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")
