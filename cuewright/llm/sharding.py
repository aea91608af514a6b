"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (offset and
stride from two hashes of its name). Shards take turns, each claiming the first slot in
its order that is free, until the table is full: all shards get nearly equal shares, and
a shard that goes moves few slots of the others. A document's slot is a hash of its id,
so placement is one lookup in a broadcast table whose size is a parameter, not data."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

TABLE = 65_537  # prime
MAX_TABLE = 1 << 20


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = TABLE, weights: dict[str, int] | None = None) -> list[int]:
    """The shard (its place in ``shards``) of each slot. A shard of weight w takes w turns a round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and once each")
    if not _prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table's size must be a prime from the number of shards to {MAX_TABLE}")
    turns = [int((weights or {}).get(s, 1)) for s in shards]
    if min(turns) < 0 or max(turns) < 1:
        raise ValueError("weights must be whole numbers, some of them positive")
    order = []
    for s in shards:
        h = hashlib.blake2b(s.encode(), digest_size=16).digest()
        order.append((int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:], "big") % (size - 1) + 1))
    table, step, left = [-1] * size, [0] * len(shards), size
    while left:
        for i, (offset, stride) in enumerate(order):
            for _ in range(turns[i]):
                while left and table[slot := (offset + step[i] * stride) % size] >= 0:
                    step[i] += 1
                if not left:
                    break
                table[slot] = i
                step[i] += 1
                left -= 1
    return table


def slot_of(doc_id: Column, size: int = TABLE) -> Column:
    """The slot of an id: the first 15 hexadecimal digits of the MD5 of its decimal text (null: the empty text), modulo the size."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: list[str], size: int = TABLE, weights: dict[str, int] | None = None) -> DataFrame:
    """docs with ``slot`` and ``shard``. Every row is placed: null ids by the empty text, repeated rows alike.

    Texts are not read, so null, empty and very long ones make no difference; an empty table gives no rows. Columns of docs named slot or shard, in whatever case, are replaced. The table is broadcast; its size is checked against MAX_TABLE."""
    require(docs, "doc_id")
    rows = [(slot, shards[i]) for slot, i in enumerate(fill(shards, size, weights))]
    table = docs.sparkSession.createDataFrame(rows, "slot int, shard string")
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    return docs.select(*kept, slot_of(F.col("doc_id"), size).alias("slot")).join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str], size: int = TABLE, parts: int = 1) -> None:
    """Write docs below ``path`` in a folder for each shard. ``parts`` tasks share a shard's rows, dealt by
    their ids, so a large one is not one task's."""
    placed = place(docs, shards, size)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
