"""Placement of keys on shards by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in an order of its own: an offset and a step,
both from a digest of its name. Shards take turns, each claiming the first slot of its order that
is free, until the table is full. So shards get equally many slots (in proportion to their turns,
where weights are given), and when a shard comes or goes most slots keep their owner.

A key's slot is a digest modulo the size, so placing it is one lookup. The table's size is fixed
by a parameter, whatever the data, so it is broadcast; rows are not shuffled.

Defined cases: a null key is placed by a digest of its whole row, so null keys spread; rows that
repeat a key go to one shard; an empty table gives an empty table; columns are kept, and the added
``slot`` and ``shard`` replace columns of these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
DIGITS = 15


def digest(text: str, part: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[part * DIGITS : (part + 1) * DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Mapping[str, int] | None = None) -> list[int]:
    """The number of the shard that owns each slot; a shard takes as many turns in a round as it weighs."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named and their names differ")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table needs a prime size of at least the number of shards")
    turns = [s for s, name in enumerate(shards) for _ in range((weights or {}).get(name, 1))]
    if not turns:
        raise ValueError("no shard has any weight")
    steps = [(digest(name, 0) % size, digest(name, 1) % (size - 1) + 1) for name in shards]
    owner, tried, filled = [-1] * size, [0] * len(shards), 0
    while True:
        for s in turns:
            offset, step = steps[s]
            slot = (offset + tried[s] * step) % size
            while owner[slot] >= 0:
                tried[s] += 1
                slot = (offset + tried[s] * step) % size
            owner[slot] = s
            tried[s] += 1
            filled += 1
            if filled == size:
                return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot, from the first 60 bits of its digest."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, DIGITS), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, shards: Sequence[str], key_col: str = "doc_id", size: int = TABLE_SIZE, weights: Mapping[str, int] | None = None) -> DataFrame:
    """``docs`` with the ``slot`` of each row's key and the name of its ``shard``."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, size, weights))], "slot int, shard string")
    row = docs.drop("slot", "shard") if key_col not in ("slot", "shard") else docs.withColumnRenamed(key_col, f"{key_col}_key")
    key = row[key_col] if key_col in row.columns else row[f"{key_col}_key"]
    known = F.coalesce(key.cast("string"), F.to_json(F.struct(*(row[c] for c in row.columns))))
    return row.withColumn("slot", slot_of(known, size)).join(F.broadcast(table), "slot").select(*(row.columns), "slot", "shard")
