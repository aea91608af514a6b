"""Vector operators: exact top-k per video, related segments, hashing embedder. ``vector_index`` searches a stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions import text as X
from cuewright.functions.numeric import dot, half_up, norm

from .adapters import classify_continuations


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """(video_id, clip_id, chunk_id, similarity, rank): the k most similar chunks of the clip's video, then the threshold.

    Norms are taken once a row, before the join; the rank window carries scalars only."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    q = queries.select("video_id", "clip_id", F.col("embedding").alias("q"), one(norm(F.col("embedding"))).alias("qn"))
    c = chunks.where("embedding is not null").select("video_id", "chunk_id", F.col("embedding").alias("c"), one(norm(F.col("embedding"))).alias("cn"))
    sim = half_up(dot(F.col("q"), F.col("c")) / (F.col("qn") * F.col("cn")), 6)
    s = q.join(c, "video_id").select("video_id", "clip_id", "chunk_id", sim.alias("similarity"))
    w = Window.partitionBy("video_id", "clip_id").orderBy(F.desc("similarity"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.coalesce("similarity", F.lit(0.0)) >= threshold)


def related_segments(clips: DataFrame, chunks: DataFrame, k: int = 3, threshold: float = 0.5, classify=classify_continuations) -> DataFrame:
    """The top-k chunks of each clip but its own ones, with a decision on each.

    clips: video_id, clip_id, embedding, source_chunks (ids), e; chunks: video_id, chunk_id,
    embedding, start_ms. A clip's own chunks go after the limit, so fewer than k may stay;
    clips without an embedding have none. classify adds ``decision`` and ``confirmed``
    from similarity and gap_ms."""
    top = top_k(clips.where("embedding is not null"), chunks, k, threshold)
    j = top.join(clips.select("video_id", "clip_id", "source_chunks", "e"), ["video_id", "clip_id"]).join(chunks.select("video_id", "chunk_id", "start_ms"), ["video_id", "chunk_id"])
    j = j.where(~F.coalesce(F.array_contains("source_chunks", F.col("chunk_id")), F.lit(False)))
    return classify(j.withColumn("gap_ms", F.col("start_ms") - F.col("e"))).drop("source_chunks", "e", "start_ms")


def head(v: Column, dims: int) -> Column:
    """The first ``dims`` entries, of a vector that was normalised before: not of unit length when something is cut."""
    return F.slice(v, 1, dims)


def embed(texts: DataFrame, text: str = "text", dims: int = 64, out: str = "embedding") -> DataFrame:
    """The offline embedder: signed feature hashing of words, L2-normalised; rows that have an embedding keep it.

    Higher-order functions over the words, so it stays inside the JVM and needs no shuffle."""
    let = lambda v, f: F.get(F.transform(F.array(v), f), 0)  # noqa: E731  (v is worked out once, not in every turn of a lambda)
    words = X.split_words(F.lower(F.coalesce(text, F.lit(""))))
    hashed = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    cells = F.transform(hashed, lambda x: F.pmod(x, F.lit(dims)) * 2 + (x < 1 << 31).cast("int"))  # place and sign
    every = F.sequence(F.lit(0), F.lit(2 * dims - 1)).cast("array<bigint>")
    ordered = F.array_sort(F.concat(cells, every))  # every cell once more, so each has a first place
    first = let(ordered, lambda o: F.concat(F.transform(every, lambda c: F.array_position(o, c)), F.array(F.size(o).cast("bigint") + 1)))
    seen = lambda p, c: F.get(p, (c + 1).cast("int")) - F.get(p, c.cast("int"))
    counts = let(first, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (seen(p, i * 2) - seen(p, i * 2 + 1)).cast("double")))
    found = let(counts, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(F.transform(v, lambda x: x.cast("float")))))
    return texts.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(found) if out in texts.columns else found)


def migrate_dimension(chunks: DataFrame, links: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, links) for vectors of another size: embeddings of any other size are null, links of their chunks go."""
    fits = F.size("embedding") == dims
    stale = chunks.where(~F.coalesce(fits, F.lit(False))).select("chunk_id")
    return chunks.withColumn("embedding", F.when(fits, F.col("embedding"))), links.join(stale, "chunk_id", "left_anti")
