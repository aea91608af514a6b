"""Content-addressed store of token ids.

A rolling hash over the last 16 ids cuts each document's id stream where it meets a
mask, so equal passages give equal chunks wherever they stand. A chunk is named by
the BLAKE2b digest of its bytes and stored once.

Files (all written by Spark, so any file system will do), under the store's path:
- ``chunks``: chunk_id, n, payload (little-endian ids, two bytes each if the
  vocabulary allows, else four). One row per distinct chunk has the payload; the
  further uses of it (row, k, chunk_id, n) are rows without one.
- ``recipes``: in ascending doc_id order (nulls first), in blocks: doc_id, row, the
  chunk ids in order, n_tokens, the Merkle root over the chunk ids.
- ``manifest``: per block, its documents, its ids and the Merkle root over the
  documents' roots.

Reading verifies every payload against its name, every document against its root and
every block against the manifest. Documents' checksums come from the chunks' by
combining CRCs, so payloads are not shuffled again; ``read_documents`` joins them for
those who want the ids."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import block_offsets, require
from .hashing import mix

WINDOW, LEAST, MOST, MASK_BITS = 16, 64, 1024, 8
#: Documents of a manifest block, about; more of them make more blocks.
BLOCK_DOCUMENTS = 250_000
_M = 0x9E3779B97F4A7C15
_F = 0xFFFFFFFF
_ZEROS = memoryview(bytes(4 * MOST))


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream: content-defined, LEAST to MOST ids but for the last."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    s, power, width = mix(ids.astype(np.uint64) + np.uint64(1)), _M, 1
    while width < WINDOW:  # sums over 2, 4, 8, 16 ids
        s = s[:-width] * np.uint64(power) + s[width:]
        power, width = power * power & (1 << 64) - 1, 2 * width
    marks = np.flatnonzero((mix(s) >> np.uint64(64 - MASK_BITS)) == 0) + WINDOW
    out, last = [], 0
    for at in [*marks.tolist(), n]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST or (at == n and at > last):
            last = at
            out.append(at)
    return out


def merkle(hashes: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd last node moves up as it is. No leaves: the digest of nothing."""
    level = list(hashes) or [digest(b"")]
    while len(level) > 1:
        level = [digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, width: int = 2) -> None:
    """Encode every whole text (null: empty), append the end id, and write the store to an empty path.

    Repeated rows and null ids are documents of their own; very long texts are cut into chunks
    as any other; an empty table gives an empty store; other columns are ignored."""
    require(docs, "doc_id", "text")
    spark, vocabulary = docs.sparkSession, vocabulary or tokens.vocabulary_path()
    kind = "<u2" if width == 2 else "<u4"

    def chunked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 33
        sent: set[bytes] = set()  # chunks whose payload this task has sent; emptied when large, which costs a few copies
        for f in frames:
            names, sizes, data, row, k, take = [], [], [], [], [], []
            held = 0
            for i, ids in enumerate(tokens.encoder(vocabulary).documents(f["text"].tolist())):
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                raw, last = ids.astype(kind).tobytes(), 0
                for j, end in enumerate(cuts(ids)):
                    part = raw[width * last : width * end]
                    name = digest(part)
                    names.append(name)
                    data.append(None if name in sent else part)
                    sent.add(name)
                    sizes.append(end - last)
                    row.append(at)
                    k.append(j)
                    take.append(i)
                    last = end
                at += 1
                if len(sent) > 200_000:
                    sent.clear()
                held += len(raw)
                if held > 8 << 20:
                    yield frame(f, names, sizes, data, row, k, take)
                    names, sizes, data, row, k, take = [], [], [], [], [], []
                    held = 0
            if names:
                yield frame(f, names, sizes, data, row, k, take)

    def frame(f, names, sizes, data, row, k, take) -> pd.DataFrame:
        return pd.DataFrame({"chunk_id": names, "n": sizes, "payload": data, "row": row, "k": k, "doc_id": f["doc_id"].astype("Int64").array.take(take)})

    def once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by chunk_id, payloads first: the payload stays with the first of each."""
        last = None
        for f in frames:
            first = f["chunk_id"] != f["chunk_id"].shift(fill_value=last if last is not None else b"")
            if len(f):
                last = f["chunk_id"].iloc[-1]
            yield f.assign(payload=f["payload"].where(first, None))

    schema = "chunk_id binary, n int, payload binary, row long, k int, doc_id long"
    uses = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(chunked, schema)
    # payloads meet by name, at most one from each task or so; mere uses are dealt anyhow, so a very common chunk makes no hot task
    key = F.when(F.col("payload").isNotNull(), F.xxhash64("chunk_id")).otherwise(F.xxhash64("row", "k"))
    dealt = uses.repartition(key).sortWithinPartitions("chunk_id", F.col("payload").isNull(), "row", "k").mapInPandas(once, schema)
    dealt.write.option("compression", "zstd").parquet(f"{path}/chunks")
    uses = spark.read.schema(schema).parquet(f"{path}/chunks")

    @F.pandas_udf("binary")
    def root(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: merkle(list(x)))

    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-uses.where("k = 0").count() // BLOCK_DOCUMENTS))
    recipes = (
        uses.groupBy("row")
        .agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "chunk_id"))).alias("c"), F.sum("n").cast("long").alias("n_tokens"))
        .select("doc_id", "row", F.col("c.chunk_id").alias("chunks"), "n_tokens")
        .withColumn("root", root("chunks"))
        .repartitionByRange(ranges, F.col("doc_id"), F.col("root"), F.col("row"))
        .sortWithinPartitions("doc_id", "root", "row")
        .withColumn("block", F.spark_partition_id())
    )
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _blocks(_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, row long, chunks array<binary>, n_tokens long, root binary, block int").parquet(f"{path}/recipes")


def _blocks(recipes: DataFrame) -> DataFrame:
    """Per block: documents, ids, and the digest chain over its documents' roots in order.

    A block is a range partition of recipes of about BLOCK_DOCUMENTS documents at most, so its list of roots is bounded whatever the table's size."""

    @F.pandas_udf("binary")
    def root(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: merkle(list(x)))

    return (
        recipes.groupBy("block")
        .agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("ids"), F.array_sort(F.collect_list(F.struct("doc_id", "root", "row"))).alias("r"))
        .select("block", "documents", "ids", root("r.root").alias("root"))
    )


def combine(crc: int, more: int, size: int) -> int:
    """CRC-32 of two byte strings joined, from theirs and the second's size."""
    while size > len(_ZEROS):
        crc = zlib.crc32(_ZEROS, crc ^ _F) ^ _F
        size -= len(_ZEROS)
    return zlib.crc32(_ZEROS[:size], crc ^ _F) ^ _F ^ more


def read_index(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) of all documents, from the files, verified.

    start: the ids of all documents before it by doc_id, those of one id by their Merkle root, so the order does not depend on the partitioning of the input. ids_crc32: of the ids as little-endian unsigned 32-bit integers."""
    if not verify(spark, path):
        raise ValueError("the recipes do not match the manifest")
    kind = "<u2" if width == 2 else "<u4"
    chunks = spark.read.schema("chunk_id binary, n int, payload binary").parquet(f"{path}/chunks").where("payload is not null")

    @F.pandas_udf("long")
    def sums(names: pd.Series, payload: pd.Series) -> pd.Series:
        out = []
        for name, raw in zip(names, payload, strict=True):
            if digest(raw) != name:
                raise ValueError("a chunk does not match its name")
            out.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()))
        return pd.Series(out, dtype="int64")

    @F.pandas_udf("long")
    def joined(parts: pd.Series, root: pd.Series) -> pd.Series:
        out = []
        for some, whole in zip(parts, root, strict=True):
            crc = 0
            if merkle([p["chunk_id"] for p in some]) != whole:
                raise ValueError("a document does not match its Merkle root")
            for p in some:
                crc = combine(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    recipes = _recipes(spark, path)
    stored = chunks.select("chunk_id", "n", sums("chunk_id", "payload").alias("crc"))
    each = recipes.select("row", "block", F.posexplode("chunks").alias("k", "chunk_id"))
    rows = (
        each.join(stored, "chunk_id")
        .groupBy("row", "block")
        .agg(F.array_sort(F.collect_list(F.struct("k", "chunk_id", "n", "crc"))).alias("parts"), F.sum("n").alias("found"))
    )
    of_block = block_offsets(recipes.groupBy("block").agg(F.sum("n_tokens").alias("ids")).withColumn("all", F.lit(1)), ["all"], "ids", "before")
    inside = Window.partitionBy("block").orderBy("doc_id", "root", "row").rowsBetween(Window.unboundedPreceding, -1)
    starts = recipes.select("doc_id", "row", "block", "n_tokens", "root", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    out = starts.join(of_block.select("block", "before"), "block").join(rows, ["row", "block"], "left")
    checked = F.when(F.col("found") == F.col("n_tokens"), joined("parts", "root")).otherwise(F.raise_error("a chunk is missing"))
    return out.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", checked.alias("ids_crc32"), F.size("parts").alias("n_chunks"))


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the recipes match the manifest."""
    now, then = _blocks(_recipes(spark, path)), spark.read.parquet(f"{path}/manifest")
    return now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, row, ids): the id streams rebuilt from recipes and chunks."""
    kind = "<u2" if width == 2 else "<u4"
    chunks = spark.read.schema("chunk_id binary, payload binary").parquet(f"{path}/chunks").where("payload is not null")
    each = _recipes(spark, path).select("doc_id", "row", F.posexplode("chunks").alias("k", "chunk_id")).join(chunks, "chunk_id")
    rows = each.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("k", "payload"))).alias("parts"))

    @F.pandas_udf("array<int>")
    def ids(parts: pd.Series) -> pd.Series:
        return parts.map(lambda some: np.frombuffer(b"".join(p["payload"] for p in some), kind).astype(np.int32))

    return rows.select("doc_id", "row", ids("parts").alias("ids"))
