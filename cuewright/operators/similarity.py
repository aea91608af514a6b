"""Exact similarity join of dense vectors inside groups: all pairs of at least a cosine, without making all pairs.

1. Vectors are scaled to length one, and range-sorted by group, nearest of some fixed directions and
   angle to it, so that like vectors lie together and a large group spans many tasks. Runs of
   ``block_rows`` become blocks with a centre and the largest angle to it.
2. Two blocks of a group meet only if their centres' angle less both radii is within the threshold's.
3. Inside two blocks the dot product is taken over one slice of dimensions after the other. By
   Cauchy and Schwarz what is left is at most the product of the norms of both suffixes; pairs
   that cannot reach the threshold with it are dropped before the next slice.

Null vectors, those with a null entry and zero vectors have no direction and are in no pair; vectors of
different sizes are apart; rows of one id are no pair; ids must order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuewright.functions.numeric import dot
from cuewright.storage import written


@dataclass(frozen=True)
class JoinParams:
    block_rows: int = 1024
    slice_dims: int = 16
    directions: int = 64
    seed: int = 7


def _directions(dims: int, p: JoinParams) -> np.ndarray:
    """Fixed unit vectors, the same in every task."""
    v = np.random.default_rng(p.seed + dims).normal(size=(p.directions, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _placed(vectors: DataFrame, key: str, row_id: str, vec: str, p: JoinParams) -> DataFrame:
    """(g, id, dims, unit, near, angle) of the vectors that have a direction."""
    good = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double"))))
    rows = good.select(F.col(key).alias("g"), F.col(row_id).alias("id"), F.col(vec).cast("array<double>").alias("unit"))
    fields = T.StructType([rows.schema["g"], rows.schema["id"]]).add("dims", T.IntegerType()).add("unit", T.BinaryType()).add("near", T.IntegerType()).add("angle", T.DoubleType())
    schema = to_arrow_schema(fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(2).offsets.to_numpy())
            flat, starts = b.column(2).values.to_numpy(zero_copy_only=False), b.column(2).offsets.to_numpy()
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                v = flat[starts[own][:, None] + np.arange(d)]
                length = np.linalg.norm(v, axis=1)
                own, v = own[length > 0], v[length > 0] / length[length > 0, None]
                cos = v @ _directions(d, p).T
                near = cos.argmax(axis=1) if len(own) else np.zeros(0, np.int64)
                angle = np.arccos(np.clip(cos[np.arange(len(own)), near], -1, 1))
                columns = [b.column(0).take(own), b.column(1).take(own), np.full(len(own), d), [x.tobytes() for x in v], near, angle]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(place, fields)


def blocks(vectors: DataFrame, key: str, row_id: str, vec: str, p: JoinParams = JoinParams()) -> DataFrame:
    """(g, dims, block, ids, units, centre, radius): runs of like vectors of one group, written to the shared folder."""
    rows = _placed(vectors, key, row_id, vec, p)
    order = ["g", "dims", "near", "angle", "id"]
    fields = T.StructType([rows.schema["g"]]).add("dims", T.IntegerType()).add("block", T.LongType()).add("ids", T.ArrayType(rows.schema["id"].dataType))
    fields = fields.add("units", T.BinaryType()).add("centre", T.ArrayType(T.DoubleType())).add("radius", T.DoubleType())
    schema = to_arrow_schema(fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            g, dims = rows[0][:2]
            v = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), dims)
            mean = v.mean(axis=0)
            length = np.linalg.norm(mean)
            centre = mean / length if length > 1e-9 else v[0]
            radius = float(np.arccos(np.clip(v @ centre, -1, 1)).max())
            one = [g, dims, number, [r[2] for r in rows], v.tobytes(), centre.tolist(), radius]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(one, schema, strict=True)], schema=schema)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turned = held and held[-1][4] != row[4] and len(held) * 8 >= p.block_rows  # another direction: keep blocks tight
                if held and (held[0][:2] != row[:2] or len(held) >= p.block_rows or turned):
                    yield block(held)
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield block(held)

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("g", "dims", "id", "unit", "near")
    return written(sorted_rows.mapInArrow(pack, fields), "vector-blocks")


def near_rows(a: np.ndarray, b: np.ndarray, least: float, slice_dims: int, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places i, j and dot products of at least ``least`` of unit rows of a and b, and how many pairs outlived the first slice."""
    d = a.shape[1]
    cuts = list(range(slice_dims, d, slice_dims))
    rest = lambda v, at: np.sqrt(np.maximum((v[:, at:] ** 2).sum(axis=1), 0.0))
    first = cuts[0] if cuts else d
    s = a[:, :first] @ b[:, :first].T
    alive = s + np.outer(rest(a, first), rest(b, first)) >= least - 1e-9
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    s, outlived = s[i, j], len(i)
    for at in cuts:
        to = min(at + slice_dims, d)
        s = s + np.einsum("nd,nd->n", a[i, at:to], b[j, at:to])
        keep = s + rest(a, to)[i] * rest(b, to)[j] >= least - 1e-9
        i, j, s = i[keep], j[keep], s[keep]
    keep = s >= least
    return i[keep], j[keep], s[keep], outlived


def block_pairs(found: DataFrame, least: float) -> DataFrame:
    """(g, dims, a, b): pairs of blocks, a <= b, that may hold a pair of at least that cosine."""
    of = lambda n: found.select("g", "dims", F.col("block").alias(n), F.col("centre").alias(f"c{n}"), F.col("radius").alias(f"r{n}"))
    apart = F.acos(F.least(F.greatest(dot(F.col("ca"), F.col("cb")), F.lit(-1.0)), F.lit(1.0)))
    near = apart - F.col("ra") - F.col("rb") <= math.acos(max(-1.0, min(1.0, least))) + 1e-6
    return of("a").join(of("b"), ["g", "dims"]).where((F.col("a") <= F.col("b")) & near).select("g", "dims", "a", "b")


def cosine_pairs(vectors: DataFrame, key: str, row_id: str, vec: str, least: float, p: JoinParams = JoinParams()) -> DataFrame:
    """(key, id_a, id_b, similarity) of all pairs of a group, id_a < id_b, whose cosine is at least ``least``."""
    found = blocks(vectors, key, row_id, vec, p)
    work = block_pairs(found, least)
    for n in ("a", "b"):
        work = work.join(found.select(F.col("block").alias(n), F.col("ids").alias(f"ids_{n}"), F.col("units").alias(f"units_{n}")), n)
    fields = T.StructType([T.StructField(key, vectors.schema[key].dataType)])
    for n in ("id_a", "id_b"):
        fields = fields.add(n, vectors.schema[row_id].dataType)
    fields = fields.add("similarity", T.DoubleType())
    schema = to_arrow_schema(fields)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, dims, same, ids_a, ids_b, va, vb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(v).reshape(-1, dims) for v in (va, vb))
                i, j, s, _ = near_rows(a, b, least, p.slice_dims, same)
                rows = [(g, *sorted((ids_a[x], ids_b[y])), c) for x, y, c in zip(i.tolist(), j.tolist(), s.tolist(), strict=True) if ids_a[x] != ids_b[y]]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # a batch holds few pairs of blocks: each is two blocks' vectors
    return work.select("g", "dims", F.col("a") == F.col("b"), "ids_a", "ids_b", "units_a", "units_b").mapInArrow(compare, fields)
