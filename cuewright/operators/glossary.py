"""Large glossaries: an Aho-Corasick automaton over words, run once over each video's sorted words; frequent word pairs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from cuewright.functions import text as X
from cuewright.names import spare

Entries = list[tuple[tuple[str, ...], str]]


class Automaton:
    """States over word ids: where a word leads, the longest suffix that is a state, and the entries that end there."""

    def __init__(self, entries: Entries):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, (parts, _) in enumerate(entries):
            state = 0
            for p in parts:
                word = self.ids.setdefault(p, len(self.ids))
                if word not in self.next[state]:
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][word]
            self.ends[state].append(number)
        self.fail, self.output = [0] * len(self.next), [0] * len(self.next)  # output: the nearest suffix at which an entry ends
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            for word, child in self.next[state].items():
                back = self.fail[state]
                while back and word not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(word, 0)
                todo.append(child)
            back = self.fail[state]
            self.output[state] = back if self.ends[back] else self.output[back]

    def found(self, state: int) -> Iterator[int]:
        """The entries that end at a state."""
        while state:
            yield from self.ends[state]
            state = self.output[state]


def _list(column: pa.Array) -> list:
    """As to_pylist, which makes an object of every place first."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def apply(words: DataFrame, entries: Entries) -> DataFrame:
    """words (video_id, pos, word, display, ...) with the entries' texts in ``display``; all other columns are kept.

    A video's words are one task's, sorted, and stream through it: what is held is a batch and one entry's length. They are
    numbered by a window, so words that are dealt by video already are not shuffled again."""
    held = words.sparkSession.sparkContext.broadcast(entries)  # its size is bounded by who calls
    lowered, place = spare(["lowered", "place"], words)
    fields = T.StructType(list(words.schema.fields))
    schema = to_arrow_schema(fields)
    names = words.columns
    shown = names.index("display")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = held.value
        a, longest = Automaton(entries), max(len(p) for p, _ in entries)
        ids, step, fail, ends, output = a.ids, a.next, a.fail, a.ends, a.output
        state, current, at = 0, None, 0
        free: dict[int, int] = {}  # entry: the first word that its next match may take
        rows, texts, by = None, [], []  # words that a match may still reach: their rows, texts and the entries that show there; the first is number ``at``

        def put(n: int) -> pa.RecordBatch:
            columns = [rows.column(c) if i != shown else pa.array(texts[:n], schema.field(i).type) for i, c in enumerate(names)]
            columns = [c if i == shown else c.slice(0, n) for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = at + len(texts)
            rows = pa.Table.from_batches([rows, batch]).combine_chunks().to_batches()[0] if texts else batch
            texts += _list(batch.column("display"))
            by += [-1] * batch.num_rows
            for i, (video, word) in enumerate(zip(_list(batch.column("video_id")), _list(batch.column(lowered)), strict=True), new):
                if video != current:
                    state, current, free = 0, video, {}
                known = ids.get(word)
                if known is None:
                    state = 0
                    continue
                while state and known not in step[state]:
                    state = fail[state]
                state = step[state].get(known, 0)
                if not (ends[state] or output[state]):
                    continue
                for entry in a.found(state):
                    parts, replacement = entries[entry]
                    start = i + 1 - len(parts)
                    if start < free.get(entry, 0):
                        continue
                    free[entry] = i + 1
                    for k in range(start - at, i + 1 - at):
                        if entry > by[k]:
                            by[k], texts[k] = entry, "" if k > start - at else replacement
            done = len(texts) - min(longest - 1, len(texts))
            if done:
                yield put(done)
                rows, texts, by, at = rows.slice(done), texts[done:], by[done:], at + done
        if texts:
            yield put(len(texts))

    numbered = F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    return words.withColumn(lowered, F.lower("word")).withColumn(place, numbered).select(*names, lowered, place).mapInArrow(run, fields)


#: Counters of pairs by hash, and how many travel in one row.
BUCKETS, BLOCK = 1 << 20, 1 << 14


def frequent_pairs(texts: DataFrame, most: int, buckets: int = BUCKETS) -> list[tuple[str, str, int]]:
    """(a, b, count) of the ``most`` most frequent pairs of unlike words that follow each other in a ``text``, lower-cased; of
    equally frequent ones the first by name.

    Exact, without a row for each of the many rare pairs. Tasks count all pairs in ``buckets`` counters by hash: none is
    more frequent than its counter. Pairs of the largest counters are counted themselves, and the last of the
    most frequent among them bounds the frequency from below; if counters outside reach it, they are counted too."""
    spark = texts.sparkSession
    lw = X.split_words(F.lower("text"))
    n = F.greatest(F.size("ws") - 1, F.lit(0))
    bucket = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")
    rows = texts.select(lw.alias("ws")).where("ws is not null").select(F.slice("ws", F.lit(1), n).alias("a"), F.slice("ws", F.lit(2), n).alias("b"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().drop_null().to_numpy(), minlength=buckets).astype(np.uint64)
        yield from _blocks((lo // BLOCK, counts[lo : lo + BLOCK]) for lo in range(0, buckets, BLOCK))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = _counts(block, counts, buckets)
                sums[block] = sums[block] + got if block in sums else got
        yield from _blocks(sums.items())

    at = rows.select(F.zip_with("a", "b", lambda a, b: F.when(a != b, bucket(a, b))).alias("at"))
    counts = np.zeros(buckets, np.uint64)
    for r in at.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary").toLocalIterator():
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = _counts(r["block"], r["counts"], buckets)

    def counted(least: int) -> list[tuple[str, str, int]]:
        own = spark.createDataFrame(pa.table({"at": pa.array(np.flatnonzero(counts >= least), pa.int32())}))
        pairs = rows.select(F.explode(F.zip_with("a", "b", lambda a, b: F.struct(a.alias("a"), b.alias("b"))))).select("col.*").where("a <> b")
        pairs = pairs.withColumn("at", bucket(F.col("a"), F.col("b"))).join(F.broadcast(own), "at", "left_semi")
        return [tuple(r) for r in pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(most).collect()]

    rank = min(2 * most, buckets)
    least = max(1, int(np.partition(counts, buckets - rank)[buckets - rank])) if rank else 1
    found = counted(least)
    bound = found[-1][2] if len(found) == most and most else 1
    return found if bound >= least or not most else counted(bound)


def _blocks(blocks: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counters that are not all zero, each block in as many bytes as its largest needs."""
    full = [(b, c.astype(np.min_scalar_type(c.max())).tobytes()) for b, c in blocks if c.any()]
    if full:
        yield pa.record_batch([pa.array([b for b, _ in full], pa.int32()), pa.array([c for _, c in full], pa.binary())], names=["block", "counts"])


def _counts(block: int, data: bytes, buckets: int) -> np.ndarray:
    size = min(BLOCK, buckets - block * BLOCK)
    return np.frombuffer(data, f"u{len(data) // size}").astype(np.uint64)
