"""Bulk-synchronous best-fit packing of documents into sequences of bounded length.

A document (its ids and an end id) longer than a sequence is cut; only its first piece
may be shorter. Pieces over half a sequence each open one, under their own id. The others
are placed in supersteps over two tables of rows, the pieces left and the open gaps:
1. Both are range-sorted together, the largest first.
2. Successor sweep: every range takes its rows in order; a piece goes to the tightest gap
   that holds it, and the gap that is left comes up again at its new size. The first range
   opens sequences for pieces without a gap; other ranges rank them, and every range ranks
   the gaps that it leaves. One row a range carries how many, and the pieces left are
   matched by rank to the gaps that earlier ranges carry over.
3. The gaps shrink by what they took, and the step is repeated until all pieces are
   placed. When few were, as many sequences are opened as the rest needs at least.
With one range this is best-fit decreasing. The driver sees one row a range; pieces and
gaps stay in Spark's tables, written to the shared folder after each step. No text is shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import materialize, release, require

CAPACITY = 1024
RANGE_ROWS = 100_000  # pieces and gaps that one task sweeps, about
_PIECES = "pid long, doc_id long, piece int, start long, length int, ids_crc32 long"
_STEP = "block int, kind int, id long, size int, at long, slots long, seq long, gap int, slot long"
GAP, LEFT, MATCHED, OPENED = 0, 1, 2, 3
NEW = 1 << 62  # ids of sequences opened empty start here


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first takes what full pieces leave."""
    first = n % capacity
    spans = [(0, first)] if first else []
    return spans + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with an id of its own."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId() << 40
        for f in frames:
            rows: list[tuple] = []
            for at, ids in enumerate(tokens.encoder(path).documents(f["text"].tolist())):
                raw = ids.astype("<u4").tobytes()
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((at, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
            if rows:
                at, k, s, n, crc = map(list, zip(*rows, strict=True))
                yield pd.DataFrame(
                    {"pid": np.arange(pid, pid + len(at)), "doc_id": f["doc_id"].astype("Int64").array.take(at), "piece": k, "start": s, "length": n, "ids_crc32": crc}
                )
                pid += len(at)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(made, _PIECES)


def sweep(kind: list[int], ids: list[int], size: list[int], first: bool, capacity: int) -> tuple[list[tuple], list[int], list[int], list[list[int]]]:
    """One range's rows in order -> matches (piece, length, sequence, its gap before, how many it took before),
    rows of pieces without a gap, sequences opened, and [sequence, gap before, room] of the gaps left, the tightest last."""
    free: list[list[int]] = []  # [sequence, gap before, room, taken]; the tightest last
    later: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # gaps that fit no piece yet, by room
    matched, alone, opened = [], [], []
    now = capacity + 1
    for i, (k, x, n) in enumerate(zip(kind, ids, size, strict=True)):
        while now > n:
            now -= 1
            if later[now]:
                free += later[now]
                later[now] = []
        if k == GAP:
            free.append([x, n, n, 0])
            continue
        if free:
            gap = free.pop()
        elif first:
            gap = [x, capacity, capacity, 0]
            opened.append(x)
        else:
            alone.append(i)
            continue
        matched.append((x, n, gap[0], gap[1], gap[3]))
        gap[2] -= n
        gap[3] += 1
        if gap[2] >= n:
            free.append(gap)
        elif gap[2]:
            later[gap[2]].append(gap)
    return matched, alone, opened, [g[:3] for g in free]


def _swept(frames: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """The rows of one range, sorted, -> its matches, sequences opened, the pieces left and the gaps left, both ranked."""
    rows = list(frames)
    if not rows:
        return
    f = pd.concat(rows)
    block = TaskContext.get().partitionId()
    kind, ids, size = (f[c].tolist() for c in ("kind", "id", "size"))
    matched, alone, opened, free = sweep(kind, ids, size, block == 0, capacity)
    columns = ["id", "size", "seq", "gap", "slot"]
    if matched:
        yield pd.DataFrame(matched, columns=columns).assign(block=block, kind=MATCHED, at=0, slots=0)
    if opened:
        yield pd.DataFrame({"block": block, "kind": OPENED, "id": opened, "size": capacity, "at": 0, "slots": 0, "seq": 0, "gap": 0, "slot": 0})
    if alone:
        at = np.arange(len(alone))
        yield pd.DataFrame({"block": block, "kind": LEFT, "id": [ids[i] for i in alone], "size": [size[i] for i in alone], "at": at, "slots": 0, "seq": 0, "gap": 0, "slot": 0})
    if free:  # pieces of later ranges are no longer than the last row here
        seq, gap, room = zip(*free, strict=True)
        slots = np.array(room) // size[-1]
        yield pd.DataFrame({"block": block, "kind": GAP, "id": seq, "size": room, "at": np.cumsum(slots) - slots, "slots": slots, "seq": seq, "gap": gap, "slot": 0})


def carried(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """From (range, pieces left, slots left), in order: which ranks of pieces take which slots of earlier ranges.

    Returns (range, first rank, end rank, gaps' range, slot of the first rank; the next ranks go down from it),
    and the least slot that was taken of every range."""
    free: list[list[int]] = []
    out, least = [], {}
    for block, n, slots in counts:
        rank = 0
        while rank < n and free:
            of, have = free[-1]
            take = min(n - rank, have)
            out.append((block, rank, rank + take, of, have - 1))
            rank += take
            least[of] = free[-1][1] = have - take
            if have == take:
                free.pop()
        if slots:
            free.append([block, slots])
    return out, least


def superstep(left: DataFrame, gaps: DataFrame, ranges: int, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One sweep: (placed, sequences opened, pieces left, number placed).

    left: (pid, length); gaps: (seq, gap), as is what was opened; placed: (pid, seq, offset, length)."""
    spark = left.sparkSession
    rows = left.select(F.lit(LEFT).alias("kind"), F.col("pid").alias("id"), F.col("length").alias("size")).union(gaps.select(F.lit(GAP), "seq", "gap"))
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    dealt = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)
    step = materialize(dealt.sortWithinPartitions(*order).mapInPandas(lambda it: _swept(it, capacity), _STEP), "packing-sweep")
    some = lambda k, c: F.sum(F.when(F.col("kind") == k, c).otherwise(0)).cast("long")
    counts = step.groupBy("block").agg(some(LEFT, F.lit(1)).alias("left"), some(GAP, F.col("slots")).alias("slots"), some(MATCHED, F.lit(1)).alias("matched")).collect()  # one row a range
    plan, least = carried(sorted((r["block"], r["left"], r["slots"]) for r in counts))
    own = step.where(F.col("kind") == MATCHED).select(F.col("id").alias("pid"), F.col("size").alias("length"), "seq", "gap", "slot")
    rest = step.where(F.col("kind") == LEFT)
    if plan:
        p = F.broadcast(spark.createDataFrame(plan, "b int, lo long, hi long, of int, top long"))  # at most two rows a range
        q = F.broadcast(spark.createDataFrame(sorted(least.items()), "b int, least long"))
        hit = (F.col("block") == F.col("b")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
        asking = rest.join(p, hit).select(F.col("id").alias("pid"), F.col("size").alias("length"), "of", (F.col("top") - F.col("at") + F.col("lo")).alias("place"))
        taken = (F.col("block") == F.col("b")) & (F.col("at") + F.col("slots") > F.col("least"))
        places = F.explode(F.sequence(F.greatest("at", "least"), F.col("at") + F.col("slots") - 1))
        open_ = step.where(F.col("kind") == GAP).join(q, taken).select(F.col("block").alias("of"), "seq", "gap", "at", places.alias("place"))
        after = F.lit(capacity) + F.col("place") - F.col("at")  # what came from other ranges stands behind a range's own
        own = own.unionByName(asking.join(open_, ["of", "place"]).select("pid", "length", "seq", "gap", after.alias("slot")))
        done = F.broadcast(spark.createDataFrame(sorted({block: end for block, _, end, *_ in plan}.items()), "b int, end long"))
        rest = rest.join(done, F.col("block") == F.col("b"), "left").where(F.coalesce(F.col("at") >= F.col("end"), F.lit(True)))
    before = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a sequence holds at most capacity pieces
    offset = F.lit(capacity) - F.col("gap") + F.coalesce(F.sum("length").over(before), F.lit(0))
    placed = materialize(own.select("pid", "seq", offset.cast("long").alias("offset"), "length"), "packing-placed")
    n = sum(r["matched"] for r in counts) + sum(hi - lo for _, lo, hi, *_ in plan)
    opened = step.where(F.col("kind") == OPENED).select(F.col("id").alias("seq"), F.col("size").alias("gap"))
    return placed, opened, rest.select(F.col("id").alias("pid"), F.col("size").alias("length")), n


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pid, sequence_id, offset) of every row of rows (pid, length), lengths from 1 to capacity."""
    spark: SparkSession = rows.sparkSession
    half = capacity // 2
    long = rows.where(F.col("length") > half)
    out = [long.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = long.where(F.col("length") < capacity).select(F.col("pid").alias("seq"), (F.lit(capacity) - F.col("length")).cast("int").alias("gap"))
    left, opened, old = rows.where(F.col("length") <= half).select("pid", "length"), 0, None
    known = gaps.count()  # open sequences, at most
    while True:
        n, total, shortest = left.agg(F.count("*"), F.sum("length"), F.min("length")).first()
        if old is not None:  # few were placed: open what the rest needs at least
            if n and done * 4 < n:
                need = -(-total // capacity)
                change = change.union(spark.range(NEW + opened, NEW + opened + need).select("id", F.lit(capacity)))
                opened += need
            if n:
                gaps = materialize(gaps.union(change).groupBy("seq").agg(F.sum("gap").cast("int").alias("gap")).where("gap > 0"), "packing-gaps")
                release(old)
                old = gaps
        if not n:
            return reduce(DataFrame.union, out)
        fit = gaps.where(F.col("gap") >= shortest)
        placed, fresh, left, done = superstep(left, fit, -(-(n + known + opened) // RANGE_ROWS), capacity)
        out.append(placed.select("pid", F.col("seq").alias("sequence_id"), "offset"))
        change = fresh.union(placed.select("seq", -F.col("length")))
        old = old or gaps


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of docs.

    Null texts are empty (the end id alone); repeated rows and null ids are packed as
    rows of their own; very long texts are cut; an empty table gives no rows; other columns are ignored."""
    require(docs, "doc_id", "text")
    rows = materialize(pieces(docs, path or tokens.vocabulary_path(), capacity), "packing-pieces")
    placed = place(rows.select("pid", "length"), capacity)
    return rows.join(placed, "pid").select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
