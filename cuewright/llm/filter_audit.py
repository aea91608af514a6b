"""Filter interaction audit: what each filter removes, alone and after the others, in every order.

1. Texts are routed by fingerprint (xxhash). A task keeps, per fingerprint, a collision chain
   of full texts, each with the smallest id seen. Of two rows with one text the larger id is
   emitted as non-minimum at once, so a task sends on one row per distinct text, however often
   it is copied; the owners of the fingerprints merge the chains in the same way.
2. The filters that look at one text alone are judged once per chain link, before routing; what
   a task sends is written, so a lost executor costs no second look at the texts. Every row
   becomes a mask of the filters it fails.
3. ``combineByKey`` adds vectors of counts by mask; all orders are read from one vector a part.

Filters: A under ``min_words`` words, B under ``distinct_pct`` percent distinct words, C over
``capitals_pct`` percent ASCII capitals, D any of ``signs``, E the text of a smaller id. Words are
maximal runs without ASCII white space.

Memory: a task holds the distinct texts of its split, at most ``held_bytes`` of them before the
shuffle (what is over is sent on and starts anew), and those of its fingerprints after it.

Defined cases: a null text is empty and a null part the empty string; null ids count as larger
than all others, so they fail E where another id has their text and never by each other; rows
with one id are never copies of each other, all count; ids repeated in ``labels`` count once, as
good or toxic if any of their rows says so, null ids have no labels; very long texts count
whole; an empty table gives no rows; columns other than those named are ignored."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, release, require

FILTERS = "ABCDE"
#: Bytes of text in a batch that a task passes on.
_BATCH = 8 << 20
_COPY = 1 << FILTERS.index("E")
_MASKS = 1 << len(FILTERS)
_CAPITALS = bytes(range(65, 91))
#: Bytes that continue a character of UTF-8; all others begin a code point.
_CONTINUED = bytes(range(0x80, 0xC0))
#: Columns of a count vector: documents, good ones, toxic ones.
_WIDTH = 3
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@dataclass(frozen=True)
class AuditParams:
    min_words: int = 200
    distinct_pct: int = 50
    capitals_pct: int = 3
    signs: str = "#$%&*|"
    #: Bytes of text a task holds before it sends its chains on.
    held_bytes: int = 64 << 20
    fingerprint: Callable[[bytes], int] = xxhash.xxh64_intdigest


def text_mask(raw: bytes, p: AuditParams) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    found = raw.split()  # bytes are split at ASCII white space alone
    points = len(raw.translate(None, _CONTINUED))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    signs = len(raw) != len(raw.translate(None, p.signs.encode()))
    return (
        (len(found) < p.min_words)
        | (100 * len(set(found)) < p.distinct_pct * len(found)) << 1
        | (100 * capitals > p.capitals_pct * points) << 2
        | signs << 3
    )


class _Chains:
    """Texts by fingerprint, each with its mask, the smallest id so far and that id's rows by part."""

    def __init__(self, fingerprint: Callable[[bytes], int]):
        self.fingerprint, self.chains, self.size = fingerprint, {}, 0

    def add(self, raw: bytes, doc_id, parts: dict[str, int], judge: Callable[[], int]) -> tuple | None:
        """Takes a text in; returns (mask, id, parts) of the rows that turned out not to be the smallest."""
        chain = self.chains.setdefault(self.fingerprint(raw), [])
        link = next((x for x in chain if x[0] == raw), None)
        if link is None:
            chain.append([raw, judge(), doc_id, parts])
            self.size += len(raw)
            return None
        _, mask, least, own = link
        if doc_id == least:
            for part, n in parts.items():
                own[part] = own.get(part, 0) + n
            return None
        if doc_id is not None and (least is None or doc_id < least):
            link[2:] = [doc_id, parts]
            return mask, least, own
        return mask, doc_id, parts

    def drain(self) -> Iterator[tuple]:
        for fp, chain in self.chains.items():
            for link in chain:
                yield fp, tuple(link)
        self.chains, self.size = {}, 0


def _send(batches: Iterator[pa.RecordBatch], schema: pa.Schema, p: AuditParams) -> Iterator[pa.RecordBatch]:
    """What a task passes on: the smallest id of each text with the text, and non-minimum ids without."""
    chains, rows, size = _Chains(p.fingerprint), [], 0

    def lost(mask: int, doc_id, parts: dict[str, int]) -> tuple:
        return xxhash.xxh64_intdigest(repr(doc_id)), None, mask | _COPY, doc_id, parts

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        key, raw, mask, doc_id, parts = zip(*rows, strict=True)
        signed = [k - (1 << 64) if k >> 63 else k for k in key]
        columns = [signed, raw, mask, doc_id, [list(x.items()) for x in parts]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, raw, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = chains.add(raw, doc_id, {part: 1}, lambda raw=raw: text_mask(raw, p))
            if found:
                rows.append(lost(*found))
        full = chains.size > p.held_bytes
        for fp, link in chains.drain() if full else ():
            rows.append((fp, *link))
            size += len(link[0])
            if size > _BATCH:
                yield packed(rows)
                rows, size = [], 0
    for fp, link in chains.drain():
        rows.append((fp, *link))
        size += len(link[0])
        if size > _BATCH:
            yield packed(rows)
            rows, size = [], 0
    if rows:
        yield packed(rows)


def _settle(rows: Iterable, p: AuditParams) -> Iterator[tuple]:
    """(id, part, mask, rows) of all documents whose texts, or lost ids, came to this task."""
    chains = _Chains(p.fingerprint)
    for _, (raw, mask, doc_id, parts) in rows:
        found = (mask, doc_id, dict(parts))
        if raw is not None:
            found = chains.add(bytes(raw), doc_id, dict(parts), lambda mask=mask: mask)
        if found:
            mask, doc_id, parts = found
            yield from ((doc_id, part, mask | _COPY, n) for part, n in parts.items())
    for _, (_, mask, doc_id, parts) in chains.drain():
        yield from ((doc_id, part, mask, n) for part, n in parts.items())


def masks(docs: DataFrame, part: str = "lang", p: AuditParams = AuditParams()) -> DataFrame:
    """(doc_id, part, mask, rows): the filters each document fails, bit i for the i-th of ``FILTERS``.

    Rows of one id and text are one row of the result per part and task; bit E marks the
    non-minimum ids of a text. Written to the shared folder, as are the judged texts on their way."""
    require(docs, "doc_id", "text", part)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    fields = T.StructType().add("key", T.LongType()).add("text", T.BinaryType()).add("mask", T.IntegerType()).add("doc_id", kind)
    fields = fields.add("parts", T.MapType(T.StringType(), T.LongType()))
    schema = to_arrow_schema(fields)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary"), F.coalesce(F.col(part).cast("string"), F.lit("")))
    sent = materialize(rows.mapInArrow(lambda x: _send(x, schema, p), fields), "audit-sent")
    routed = sent.rdd.map(lambda r: (r[0], tuple(r[1:])))
    parts = max(routed.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    settled = routed.partitionBy(parts, int).mapPartitions(lambda x: _settle(x, p))
    out = T.StructType().add("doc_id", kind).add("part", T.StringType()).add("mask", T.IntegerType()).add("rows", T.LongType())
    out = materialize(spark.createDataFrame(settled, out), "audit-masks")
    release(sent)
    return out


def _grow(vector: list[int], value: tuple) -> list[int]:
    mask, *counts = value
    for k, n in enumerate(counts):
        vector[_WIDTH * mask + k] += n
    return vector


def _join(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def orders(part: str, vector: list[int]) -> Iterator[tuple]:
    """One row per order of the filters and step, from the counts by mask of a part."""
    n, good, toxic = (vector[k::_WIDTH] for k in range(_WIDTH))
    ways = [len(list(itertools.permutations(FILTERS))) // max(m.bit_count(), 1) for m in range(_MASKS)]
    shapley = [sum(n[m] * ways[m] for m in range(_MASKS) if m >> i & 1) for i in range(len(FILTERS))]
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            bit = 1 << i
            gone = [m for m in range(_MASKS) if m & bit and not m & before]
            yield (
                part,
                "".join(FILTERS[k] for k in order),
                step,
                sum(n[m] for m in range(_MASKS) if not m & (before | bit)),
                sum(n[m] for m in gone),
                sum(n[m] for m in range(_MASKS) if m & bit and m & before),
                n[bit],
                sum(good[m] for m in gone),
                sum(toxic[m] for m in gone),
                shapley[i],
            )
            before |= bit


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", p: AuditParams = AuditParams()) -> DataFrame:
    """Per part, order of the filters and step: documents kept after the step, removed in it, redundant
    (failing the filter, removed before), failing this filter alone, good and toxic ones removed,
    and the removals of the filter summed over all orders (``AUDIT``)."""
    require(labels, "doc_id", "quality", "toxic")
    spark = docs.sparkSession
    judged = masks(docs, part, p)
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic")))
    known = judged.where("doc_id IS NOT NULL").join(flags, "doc_id", "left").select("part", "mask", "rows", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))
    # null ids have no labels and would all meet under one key of the join
    both = known.unionByName(judged.where("doc_id IS NULL").select("part", "mask", "rows", F.lit(0).alias("quality"), F.lit(0).alias("toxic")))
    counted = both.select("part", "mask", "rows", F.expr("rows * quality"), F.expr("rows * toxic")).rdd.map(lambda r: (r[0], tuple(r[1:])))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = counted.combineByKey(lambda v: _grow([0] * (_MASKS * _WIDTH), v), _grow, _join, parts)
    out = materialize(spark.createDataFrame(vectors.flatMap(lambda x: orders(*x)), AUDIT), "audit")
    release(judged)
    return out
