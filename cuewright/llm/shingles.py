"""Near copies by exact shingle similarity: a prefix-filtered set join.

Words are as in ``simhash`` (between ASCII white space, A-Z lowered); a text is the set
of its shingles of ``width`` words, a shorter one has its words as its only shingle.
Two texts are linked when |A & B| / |A | B| is at least ``similarity``, t below.

1. Shingles have one order for all texts: by how often a sample of the texts holds them,
   then by hash. Linked sets of a and b shingles share one of the first n - ceil(t n) + 1 of
   each, so only these are dealt out. The order decides the cost only: no link is lost
   whatever the sample holds.
2. Pairs under a shingle are dropped where the sizes, or the places of the shingle in both
   sets, allow no t. Under a shingle of more than ``NEXT`` + 1 texts only some pivots are
   paired with all others; the others meet again in a further round, with more pivots,
   unless the links found by then have joined them. The texts of a shingle that ``CROWD`` of
   them share are dealt to blocks, of which every two meet, so no task holds them all.
3. Every text has a bitmap of its shingles' parities, of about as many bits as shingles. Two
   bitmaps differ in at most as many bits as the sets do in shingles, so pairs whose bitmaps
   differ in more than t allows are dropped.
4. Of the pairs left, those that join new parts (a forest) are compared whole, by their
   exact sets, then all those that still would join parts.

Texts of one set are one node. Only small rows are shuffled, and the texts of nodes in step 4."""

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
from .hashing import mix

_STEP = 0x9E3779B97F4A7C15
NEXT = 16
PIVOTS = 8
PER_TASK = 500_000  # pairs of one forest
CROWD = 200_000  # rows of a shingle that one task holds
#: One of so many nodes is counted; shingles that so many of those hold count as common, the most common of them first.
SAMPLE, LEAST, COMMON = 16, 4, 1 << 18


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; none for null and wordless texts."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    total, power = np.zeros(n, np.uint64), _STEP
    for i in range(min(width, len(words))):
        total += w[i : i + n] * np.uint64(power)
        power = (power * _STEP & (1 << 64) - 1) | 1
    return np.unique(mix(total))


def parities(h: np.ndarray) -> np.ndarray:
    """Words of a bitmap: bit i is the parity of the number of shingles i by its low bits; a power of two of bits, at least len(h)."""
    bits = max(64, 1 << max(0, len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fewest_differences(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many shingles are in one set alone: the larger bitmap is folded to the smaller, parities add."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of at most COMMON shingles that a sample of the texts holds most often."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 256):
                own = [shingle_set(t, width) for t in f["text"].iloc[lo : lo + 256].tolist()]
                h, n = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInPandas(hashed, "h long, n long")
    counts = materialize(some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "shingles-common")
    total, bound = 0, None
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["n"]):  # at most as many rows as different counts
        total += r["m"]
        if total > COMMON:
            break
        bound = r["n"]
    if bound is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(F.col("n") >= bound).toArrow()
    h, n = got["h"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _nodes(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(id, hash, node, n, bits, keys) of (id, hash, text): keys are the first shingles of a set in the common order."""
    held = docs.sparkSession.sparkContext.broadcast(_common(docs, width))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, count = held.value
        for f in frames:
            for lo in range(0, len(f), 512):
                own = f.iloc[lo : lo + 512]
                sets = [shingle_set(t, width) for t in own["text"].tolist()]
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets)), n)
                rank = np.zeros(len(flat), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    rank = np.where(known[at] == flat, count[at], 0)
                order = np.lexsort((flat, rank, doc))
                first = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
                starts = np.cumsum(n) - n
                ordered = flat[order].view(np.int64)
                yield pd.DataFrame(
                    {
                        "id": own["id"].to_numpy(), "hash": own["hash"].to_numpy(), "n": n, "bits": [parities(x).tobytes() for x in sets],
                        "node": np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets), np.uint64, len(sets)).view(np.int64),
                        "keys": [ordered[s : s + k] for s, k in zip(starts.tolist(), first.tolist(), strict=True)],
                    }
                )

    return docs.mapInPandas(made, "id long, hash long, node long, n long, bits binary, keys array<long>")


def _may(n: np.ndarray, pos: np.ndarray, root: np.ndarray, a, b, similarity: float) -> np.ndarray:
    """Whether the pairs a, b of one key are not joined yet and may be similar, if the key is the first shingle they share."""
    least = np.ceil(similarity / (1 + similarity) * (n[a] + n[b]) - 1e-9)
    return (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least)


_STEPS = "key long, a long, b long, n long, pos long"


def _search(frames: Iterator[pd.DataFrame], similarity: float, pivots: int, few_rows: int, crowd_rows: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, node) -> pairs (a, b; n is 0) to compare, and the rows (a is the node) of keys that must meet again;
    n is negative for keys of over crowd_rows rows, which no task holds: they are dealt anew first."""

    def pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        zero = np.zeros(len(both), np.int64)
        return pd.DataFrame({"key": zero, "a": both[:, 0], "b": both[:, 1], "n": zero, "pos": zero})

    def dealt(rows: list[np.ndarray]) -> pd.DataFrame:
        key, node, n, pos, _ = rows
        return pd.DataFrame({"key": key, "a": node, "b": np.zeros(len(key), np.int64), "n": -n, "pos": pos})

    def met(key, node, n, pos, root) -> Iterator[pd.DataFrame]:
        if not len(key):
            return
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(starts, len(key)))
        few = np.repeat(size <= few_rows + 1, size)
        left, right = [], []
        for d in range(1, min(few_rows, int(size.max()) - 1) + 1):
            a = np.flatnonzero((key[d:] == key[:-d]) & few[d:])
            a = a[_may(n, pos, root, a, a + d, similarity)]
            left.append(node[a])
            right.append(node[a + d])
        if left and sum(map(len, left)):
            yield pairs(np.concatenate(left), np.concatenate(right))
        for s, m in zip(starts[size > few_rows + 1].tolist(), size[size > few_rows + 1].tolist(), strict=True):
            if (root[s : s + m] == root[s]).all():
                continue
            for p in range(s, s + min(pivots, m)):  # by node: much the same for all keys of a group
                b = np.arange(p + 1, s + m)
                b = b[_may(n, pos, root, np.full(len(b), p), b, similarity)]
                if len(b):
                    yield pairs(np.full(len(b), node[p]), node[b])
            rest = slice(s + pivots, s + m)
            if m - pivots > 1:
                yield pd.DataFrame({"key": key[rest], "a": node[rest], "b": np.zeros(m - pivots, np.int64), "n": n[rest], "pos": pos[rest]})

    held, crowd = None, None  # rows of the key that may go on in the next frame; a key that has too many
    for f in frames:
        now = [f[c].to_numpy(np.int64) for c in ("key", "node", "n", "pos", "root")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            held = None
        if crowd is not None:
            same = now[0] == crowd
            yield dealt([x[same] for x in now])
            now = [x[~same] for x in now]
        if not len(now[0]):
            continue
        fresh = np.append(True, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))  # texts of one set come once
        now = [x[fresh] for x in now]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # keys ascend
        yield from met(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
        if len(held[0]) > crowd_rows:
            yield dealt(held)
            held, crowd = None, held[0][0]
    if held is not None:
        yield from met(*held)


def _dealt(crowded: DataFrame) -> DataFrame:
    """Rows (key, node, n, pos) of keys with too many, in groups of bounded size: its nodes go to blocks, every two blocks meet."""
    counts = crowded.groupBy("key").agg(F.ceil(F.count("*") * 4 / CROWD).cast("int").alias("blocks"))  # fewer rows than rows / CROWD
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = crowded.join(counts, "key").withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "node", "n", "pos")


def _likely(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes whose bitmaps allow the similarity."""

    @F.pandas_udf("boolean")
    def may(x: pd.Series, y: pd.Series, total: pd.Series) -> pd.Series:
        most = np.floor((1 - similarity) / (1 + similarity) * total.to_numpy() + 1e-9)  # differences of similar sets
        return pd.Series([fewest_differences(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) <= m for a, b, m in zip(x, y, most.tolist(), strict=True)], dtype=bool)

    x = bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    y = bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(may("x", "y", F.col("na") + F.col("nb"))).select("a", "b")


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs (a, b; joined as roots ra, rb) of one task that join parts not joined before."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    for f in frames:
        keep = np.zeros(len(f), bool)
        for i, (a, b) in enumerate(zip(f["ra"].tolist(), f["rb"].tolist(), strict=True)):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                keep[i] = True
        yield f[keep]


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes with whether their whole sets are similar."""
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", (both / (total - both) >= similarity).alias("near"))


def _confirmed(pairs: DataFrame, known: DataFrame | None, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among ``pairs`` that, with the ``known`` ones, give the components of all similar pairs.

    First a forest of the pairs is compared, then all pairs that still join parts."""
    found = known
    for forest in (True, False):
        if found is None:
            crossing = pairs.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))
        else:
            roots = components(found, "shingles-components")
            x, y = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            crossing = pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
        crossing = materialize(crossing, "shingles-crossing")
        n = crossing.count()
        if not n:
            break
        tried = crossing.repartition(-(-n // PER_TASK)).mapInPandas(_forest, crossing.schema) if forest else crossing
        near = materialize(_compared(tried.select("a", "b"), sets, similarity).where("near").select("a", "b"), "shingles-near")
        found = near if found is None else found.union(near)
    return pairs.limit(0) if found is None else found


def links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): links of nodes with the same components as all similar pairs."""
    keyed = rows.select("node", "n", F.posexplode("keys").alias("pos", "key")).select("key", "node", "n", F.col("pos").cast("long").alias("pos"), F.col("node").alias("root"))
    bits = nodes.select("node", "least.n", "least.bits")
    found, pivots = None, PIVOTS
    while True:
        limits = (pivots, NEXT, CROWD)
        step = materialize(keyed.repartition("key").sortWithinPartitions("key", "node").mapInPandas(lambda it: _search(it, similarity, *limits), _STEPS), "shingles-pairs")  # noqa: B023
        pairs = materialize(_likely(step.where("n = 0").select("a", "b").distinct(), bits, similarity), "shingles-likely")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "least.id", "least.hash")
        sets = materialize(_sets(docs.join(ends, ["id", "hash"]).select("node", "text"), width), "shingles-sets")
        found = _confirmed(pairs, found, sets, similarity)
        again = step.where("n > 0").select("key", F.col("a").alias("node"), "n", "pos")
        crowded = step.where("n < 0").select("key", F.col("a").alias("node"), (-F.col("n")).alias("n"), "pos")
        if not crowded.isEmpty():
            again = again.union(_dealt(crowded))
        if again.isEmpty():
            return found
        keyed = again.join(components(found, "shingles-components"), "node", "left").select("key", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
        pivots *= 8


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text); of repeated rows one."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 256):
                own = f.iloc[lo : lo + 256]
                yield pd.DataFrame({"node": own["node"].to_numpy(), "shingles": [shingle_set(t, width).view(np.int64) for t in own["text"].tolist()]})

    return texts.dropDuplicates(["node"]).mapInPandas(hashed, "node long, shingles array<long>")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group joined by links: the smallest (doc_id, hash of the text).

    Null ids come last; rows repeated with the same id and text count as one document.
    Null, empty and wordless texts are one group. An empty table gives no rows. All
    columns are kept, whatever their names."""
    require(docs, "doc_id", "text")
    own_id, own_hash = spare(docs, "key_id", "key_text")
    id_key, text_key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("text")
    texts = docs.select(id_key.alias("id"), text_key.alias("hash"), "text")
    rows = materialize(_nodes(texts, width, similarity), "shingles-rows")
    nodes = materialize(rows.groupBy("node").agg(F.min_by(F.struct("id", "hash", "n", "bits"), F.struct("id", "hash")).alias("least")), "shingles-nodes")
    roots = components(links(texts, rows, nodes, width, similarity), "shingles-components")
    of = nodes.select("node", F.struct("least.id", "least.hash").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = of.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias(own_id), F.col("least.hash").alias(own_hash))
    kept = docs.withColumns({own_id: id_key, own_hash: text_key}).join(keep, [own_id, own_hash], "left_semi")
    return kept.dropDuplicates([own_id, own_hash]).select(*docs.columns)
