"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference of all slots of a table of prime size. In turns, each claims the
first slot in its order that is free, until the table is full: shares differ by at most one slot, and when a
shard comes or goes few other slots change hands. A row's slot is a hash of its key; the table has a fixed
size and is broadcast, so placing a row takes constant time and no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Slots of the table, a prime; about a hundred slots or more for each shard keep shares even.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n ** 0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order of preference, from its name alone."""
    raw = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(raw[:8]) % slots, int.from_bytes(raw[8:16]) % (slots - 1) + 1


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The position in ``shards`` of the owner of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime and not below the number of shards")
    owner = [-1] * slots
    at, step = map(list, zip(*(preference(x, slots) for x in shards), strict=True))
    left = slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A hash of the key's text modulo the number of slots; a null key is placed like the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots).cast("long"))


def free(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores behind it until no column is called so (Spark's names differ by more than case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def assign(docs: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, slot_column: str = "slot",
           shard_column: str = "shard") -> DataFrame:
    """All rows and columns of ``docs`` with ``slot_column`` and ``shard_column`` added.

    Where ``docs`` has a column of such a name it stays, and the new one gets underscores behind its name. Rows with
    equal keys, so rows that repeat an id, share a shard; a null key is placed like an empty text. Placement depends on
    the key and the set of names only, not on the text, so copies, busy sources and very long texts spread like all
    other rows. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    slot_column = free(slot_column, docs.columns)
    shard_column = free(shard_column, [*docs.columns, slot_column])
    table = spark.createDataFrame([(i, shards[x]) for i, x in enumerate(fill(shards, slots))],
                                  f"`{slot_column}` long, `{shard_column}` string")
    placed = docs.withColumn(slot_column, slot(F.col(f"`{key}`"), slots))
    # ``slots`` rows, whatever the size of ``docs``.
    return placed.join(F.broadcast(table), slot_column, "left").select(*(f"`{c}`" for c in docs.columns), slot_column, shard_column)


def write_shards(docs: DataFrame, path: str, key: str, shards: Sequence[str], slots: int = SLOTS) -> None:
    """Write a folder of parquet files for each shard, named by the column that ``assign`` adds. Rows go straight to their
    shards' tasks; Spark may split a shard over several tasks, and no shard depends on another."""
    placed = assign(docs, key, shards, slots)
    shard = placed.columns[-1]
    placed.hint("rebalance", shard).write.mode("errorifexists").partitionBy(shard).parquet(path)


def moved(before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> float:
    """Share of slots that change hands from one set of shards to another."""
    old, new = fill(before, slots), fill(after, slots)
    return sum(before[a] != after[b] for a, b in zip(old, new, strict=True)) / slots
