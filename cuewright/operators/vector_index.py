"""A stored inverted file over vectors: cells of a k-means fit, written partitioned by cell, with binary codes.

``create`` fits cell centres on a bounded sample and writes every vector below its cell; ``append``
adds rows to the stored centres without a new fit. ``search`` reads only the cells nearest to its
queries (a partition filter), ranks what it finds there by the Hamming distance of sign codes,
which whole-stage code does on four longs, and takes exact cosines of the best of those only.

Rows without a vector, or with a zero one, are in no cell and are never found. Vectors of a size other
than the index's are refused. Centres are as many as ``cells``, a parameter, so they fit everywhere."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cuewright.functions.numeric import dot, half_up, norm

CODE_LONGS = 4


@dataclass(frozen=True)
class IndexParams:
    cells: int = 32
    #: Bound of the rows that the centres are fitted on; all rows are indexed.
    sample_rows: int = 100_000
    seed: int = 11


def _usable(df: DataFrame, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).where(F.coalesce(norm(F.col(vec)) > 0, F.lit(False)))


def fit_centres(chunks: DataFrame, vec: str = "embedding", p: IndexParams = IndexParams()) -> np.ndarray:
    """Unit centres of spherical k-means over about sample_rows rows, chosen by a hash of the vector."""
    good = _usable(chunks, vec)
    n = good.count()
    if n > p.sample_rows:
        good = good.where(F.pmod(F.xxhash64(vec), F.lit(1 << 31)) < int(p.sample_rows / n * (1 << 31)))
    if not n:
        raise ValueError("an index needs a vector to fit its cells on")
    v = good.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=p.cells, distanceMeasure="cosine", seed=p.seed, maxIter=15).fit(v)
    centres = np.array([c for c in model.clusterCenters() if np.linalg.norm(c) > 0])
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def _coded(df: DataFrame, vec: str, centres: np.ndarray, p: IndexParams, probes: int | None = None) -> DataFrame:
    """df with its nearest cell, or the list of its ``probes`` nearest ones, and the sign code of its vector."""
    held = df.sparkSession.sparkContext.broadcast(centres)  # cells x dims numbers
    dims = centres.shape[1]
    planes = lambda: np.random.default_rng(p.seed).normal(size=(dims, 64 * CODE_LONGS))
    fields = T.StructType(list(df.schema.fields)).add("cell", T.ArrayType(T.IntegerType()) if probes else T.IntegerType()).add("code", T.ArrayType(T.LongType()))

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = planes()
        for f in frames:
            if not len(f):
                continue
            if {len(x) for x in f[vec]} != {dims}:
                raise ValueError(f"the index holds vectors of {dims} dimensions")
            v = np.stack(f[vec].to_numpy()).astype(float)
            cos = v @ held.value.T
            near = np.argsort(-cos, axis=1, kind="stable")
            bits = np.packbits(v @ at > 0, axis=1, bitorder="little").view("<i8")
            yield f.assign(cell=list(near[:, :probes]) if probes else near[:, 0], code=list(bits))

    return _usable(df, vec).mapInPandas(code, fields)


def _write(chunks: DataFrame, path: str, vec: str, centres: np.ndarray, p: IndexParams) -> None:
    coded = _coded(chunks, vec, centres, p)
    # a cell's rows are shared by tasks as their number asks for, so a large one is not one task's
    coded.repartition("cell", F.pmod(F.xxhash64("code"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def create(chunks: DataFrame, path: str, vec: str = "embedding", p: IndexParams = IndexParams()) -> None:
    """Fit the centres and write all of chunks below path."""
    centres = fit_centres(chunks, vec, p)
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    chunks.sparkSession.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _write(chunks, path, vec, centres, p)


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # as many as cells


def append(chunks: DataFrame, path: str, vec: str = "embedding", p: IndexParams = IndexParams()) -> None:
    """Add rows to the cells of a stored index; its centres stay."""
    _write(chunks, path, vec, centres_of(chunks.sparkSession, path), p)


def candidates(queries: DataFrame, path: str, probes: int, refine: int, key: str = "video_id", p: IndexParams = IndexParams()) -> DataFrame:
    """(key, clip_id, q, chunk_id, embedding): of each query's probed cells the ``refine`` chunks of its key that are nearest by code."""
    spark = queries.sparkSession
    asked = _coded(queries.select(key, "clip_id", "embedding"), "embedding", centres_of(spark, path), p, probes)
    asked = asked.select(key, "clip_id", F.col("embedding").alias("q"), F.col("code").alias("q_code"), F.explode("cell").alias("cell"))
    cells = [r[0] for r in asked.select("cell").distinct().collect()]  # at most as many as cells
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(cells))
    far = F.aggregate(F.zip_with("code", "q_code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    met = asked.join(stored.select(key, "cell", "chunk_id", "code"), [key, "cell"]).select(key, "clip_id", "cell", "chunk_id", far.alias("far"))
    w = Window.partitionBy(key, "clip_id").orderBy("far", "chunk_id")
    best = met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= refine).drop("place", "far")
    whole = best.join(stored.select(key, "cell", "chunk_id", "embedding"), [key, "cell", "chunk_id"])
    return whole.join(queries.select(key, "clip_id", F.col("embedding").alias("q")), [key, "clip_id"]).select(key, "clip_id", "q", "chunk_id", "embedding")


def search(queries: DataFrame, path: str, k: int = 3, threshold: float = 0.5, probes: int = 8, refine: int = 64, p: IndexParams = IndexParams()) -> DataFrame:
    """(video_id, clip_id, chunk_id, similarity, rank) as ``vector.top_k`` gives, of the candidates that the index yields.

    queries: video_id, clip_id, embedding; chunk ids are unique inside a video."""
    found = candidates(queries, path, probes, refine, p=p)
    sim = half_up(dot(F.col("q"), F.col("embedding")) / (norm(F.col("q")) * norm(F.col("embedding"))), 6)
    s = found.select("video_id", "clip_id", "chunk_id", sim.alias("similarity"))
    w = Window.partitionBy("video_id", "clip_id").orderBy(F.desc("similarity"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("similarity") >= threshold))
