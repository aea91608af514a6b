"""SimHash near-duplicates by pigeonring filtering.

Fingerprints: words between ASCII white space, 3-word shingles with repeats, XXH64
(seed 42); a bit is set when it is set in over half of the hashes.

Search: the 64 bits are a ring of eight segments of eight bits. If two fingerprints
differ in at most three bits, some segment starts a chain all of whose prefixes of
l segments differ in at most floor(3 l / 8) bits. Hence for that start the first two
segments are equal (l = 2 allows none) and of the next three at least two are equal
(l = 5 allows one): 8 starts x 3 choices give 24 keys of 32 equal bits. Equal keys
make candidates; the whole chain condition prunes them before the full Hamming check.

Every distinct fingerprint is one node, so exact copies cost nothing. A key's
candidates are compared in blocks inside a task and only a spanning forest of the
links leaves it. A key with more than ``bucket`` fingerprints is not compared: its
fingerprints are dealt again by one more equal piece of the free bits (three
differences leave one of four pieces equal), until the free bits themselves bound
the bucket. No link is lost and no task holds an unbounded group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, require, spare
from .components import components

BITS = 3
RING = 8
_CHAIN = np.array([(BITS * n) // RING for n in range(1, RING + 1)], np.uint8)
#: (start, the two further segments) of the 24 keys
KEYS = [(i, (i + 1) % 8, (i + a) % 8, (i + b) % 8) for i in range(8) for a, b in ((2, 3), (2, 4), (3, 4))]
_FULL = (1 << 64) - 1


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of one text; 0 for null and wordless texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    total = np.zeros(64, np.int64)
    n = max(1, len(words) - width + 1)
    for at in range(0, n, 1 << 17):  # long texts in slices
        some = words[at : at + (1 << 17) + width - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, out: str = "fp", width: int = 3) -> DataFrame:
    """docs with the fingerprint of their shingles of ``width`` words as a signed long."""

    @F.pandas_udf("long")
    def fps(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.withColumn(out, fps("text"))


def _key_rows(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mask (equal bits), key and fingerprint: 24 rows for each fingerprint."""
    masks = np.array([sum(0xFF << (8 * s) for s in key) for key in KEYS], np.uint64)
    mask = np.tile(masks, len(fp))
    f = np.repeat(fp.view(np.uint64), len(masks))
    return mask, f & mask, f


def _refine(mask: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four larger masks for one crowded key: its free bits in four pieces, one of which has no difference."""
    free = [b for b in range(64) if not mask >> b & 1]
    q = len(free) // 4
    pieces = [free[i * q : (i + 1) * q if i < 3 else len(free)] for i in range(4)]
    masks = np.array([mask | sum(1 << b for b in piece) for piece in pieces], np.uint64)
    return np.tile(masks, len(fp)), np.repeat(fp, 4) & np.tile(masks, len(fp)), np.repeat(fp, 4)


def chain_ok(d: np.ndarray) -> np.ndarray:
    """Whether some start's cumulative differences stay within floor(3 l / 8) for every l: pigeonring's strong form."""
    per = np.bitwise_count(d.view(np.uint8).reshape(-1, RING))
    ok = np.zeros(len(d), bool)
    for start in range(RING):
        live = np.flatnonzero(~ok & (per[:, start] == 0))
        run = np.zeros(len(live), np.uint8)
        for n in range(RING):
            run = run + per[live, (start + n) % RING]
            good = run <= _CHAIN[n]
            live, run = live[good], run[good]
        ok[live] = True
    return ok


def _forest(fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the same fingerprints as all pairs within BITS differences, at most len(fp) - 1 of them."""
    if len(fp) == 2:
        d = fp[:1] ^ fp[1:]
        if int(d[0]).bit_count() <= BITS and chain_ok(d)[0]:
            yield int(fp[0]), int(fp[1])
        return
    label = np.arange(len(fp))
    for i in range(len(fp) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])  # those joined already need no comparison
        d = fp[rest] ^ fp[i]
        pruned = np.flatnonzero(chain_ok(d))
        near = rest[pruned[np.bitwise_count(d[pruned]) <= BITS]]
        for old, at in zip(*np.unique(label[near], return_index=True), strict=True):
            yield int(fp[i]), int(fp[near[at]])
            label[label == old] = label[i]


_OUT = "a long, b long, mask long, key long, fp long"


def _frame(a=(), b=(), mask=(), key=(), fp=()) -> pd.DataFrame:
    """Rows of links (a, b) or of crowded keys (mask, key, fp); the others are null."""
    links, deals = len(a), len(fp)
    none = lambda n: pd.array([None] * n, dtype="Int64")
    signed = lambda x: pd.array(np.asarray(x, np.uint64).view(np.int64), dtype="Int64")
    both = lambda x, y: pd.array(np.concatenate([x, y]) if links and deals else (x if links else y), dtype="Int64")
    return pd.DataFrame(
        {
            "a": both(signed(a), none(deals)), "b": both(signed(b), none(deals)),
            "mask": both(none(links), signed(mask)), "key": both(none(links), signed(key)), "fp": both(none(links), signed(fp)),
        }
    )


def _search(frames: Iterator[pd.DataFrame], bucket: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (mask, key): links of each key, or its fingerprints dealt anew when they are over ``bucket``."""
    held: list[np.ndarray] = []  # of the key that may go on in the next frame
    size, now, crowded = 0, None, False

    def close():
        nonlocal held, size, crowded
        out = None
        if size > 1 and not crowded:
            pairs = list(_forest(np.concatenate(held)))
            if pairs:
                a, b = zip(*pairs, strict=True)
                out = _frame(np.array(a, np.uint64), np.array(b, np.uint64))
        held, size, crowded = [], 0, False
        return out

    for f in frames:
        mask, key, fp = (f[c].to_numpy(np.int64).view(np.uint64) for c in ("mask", "key", "fp"))
        if not len(fp):
            continue
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], cut])
        ends = np.append(cut, len(fp))
        last = len(starts) - 1
        # keys of one row inside the frame pair with nothing
        for g in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)).tolist():
            s, e = int(starts[g]), int(ends[g])
            k = (int(mask[s]), int(key[s]))
            if k != now:
                if (x := close()) is not None:
                    yield x
                now = k
            held.append(fp[s:e])
            size += e - s
            if size > bucket and 64 - k[0].bit_count() > 12:  # 12 free bits hold 4096 at most
                yield _frame((), (), *_refine(k[0], np.concatenate(held)))
                held, crowded = [], True
            elif crowded and held:
                yield _frame((), (), *_refine(k[0], np.concatenate(held)))
                held = []
            if g != last:
                if (x := close()) is not None:
                    yield x
                now = None
    if (x := close()) is not None:
        yield x


def links(fps: DataFrame, bucket: int = 4096) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` with the same components as all pairs within three bits."""
    spark = fps.sparkSession

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64)
            for at in range(0, len(fp), 1 << 15):
                mask, key, x = _key_rows(fp[at : at + (1 << 15)])
                yield pd.DataFrame({"mask": mask.view(np.int64), "key": key.view(np.int64), "fp": x.view(np.int64)})

    rows = fps.select("fp").mapInPandas(keyed, "mask long, key long, fp long")
    found = []
    for _ in range(8):  # 32, 24, 18, 14, 11 free bits
        step = materialize(
            rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(lambda it: _search(it, bucket), _OUT), "simhash-links"
        )
        found.append(step.where("a is not null").select("a", "b"))
        rows = step.where("fp is not null").select("mask", "key", "fp")
        if rows.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out if len(found) else spark.createDataFrame([], "a long, b long")


def near_duplicates(docs: DataFrame, bucket: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of at most three differing
    bits. Null ids are listed; they bridge links but never name a component unless all
    ids of it are null (then it is null). Null, empty and wordless texts have
    fingerprint 0 and link as any other. Repeated rows each get their row."""
    require(docs, "doc_id", "text")
    rows = materialize(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "simhash-rows")
    return _classes(rows, bucket)


def _classes(rows: DataFrame, bucket: int) -> DataFrame:
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes, bucket), "simhash-components")
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        *[c for c in rows.columns if c != "fp"], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, bucket: int = 4096, width: int = 3) -> DataFrame:
    """docs with one document of each group of near-duplicates: the smallest (doc_id, hash of the text).

    Null ids come last; rows repeated with the same id and text count as one document.
    Null, empty and wordless texts are one group. An empty table gives no rows. All
    columns are kept, whatever their names."""
    require(docs, "doc_id", "text")
    own_id, own_hash = spare(docs, "key_id", "key_text")
    id_key, text_key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("text")
    rows = materialize(with_fingerprints(docs.select(id_key.alias("id"), text_key.alias("hash"), "text"), width=width).select("id", "hash", "fp"), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min(F.struct("id", "hash")).alias("least")), "simhash-nodes")
    roots = components(links(nodes, bucket), "simhash-components")
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    keep = of.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias(own_id), F.col("least.hash").alias(own_hash))
    kept = docs.withColumns({own_id: id_key, own_hash: text_key}).join(keep, [own_id, own_hash], "left_semi")
    return kept.dropDuplicates([own_id, own_hash]).select(*docs.columns)
