"""Sequence segmentation of word timelines: sentences, silence chunks, overlap chunks, outline windows.

All windows are partitioned by video_id and ordered by pos; no timeline meets another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.config import Chunking, Sentences
from cuewright.functions import text as X

def _video():
    return Window.partitionBy("video_id").orderBy("pos")


def _before():
    return _video().rowsBetween(Window.unboundedPreceding, -1)


def sentence_of_word(words: DataFrame, cfg: Sentences = Sentences()) -> DataFrame:
    """words with ``sentence`` (from 0) and ``punct``.

    A sentence ends at closing punctuation, at the last word, or at a long pause once it
    has min_words words. Only the last rule looks at earlier decisions, and only inside a
    run between punctuation marks, so it is a fold over that run's few pauses."""
    pause = F.lead("start_ms").over(_video()) - F.col("end_ms") >= cfg.pause_ms
    w = words.withColumns({"punct": X.ends_sentence(F.col("word")), "pause": F.coalesce(pause, F.lit(False)), "last": F.lead("pos").over(_video()).isNull()})
    w = w.withColumn("run", F.coalesce(F.sum(F.col("punct").cast("int")).over(_before()), F.lit(0)))
    run = Window.partitionBy("video_id", "run")
    at = F.row_number().over(run.orderBy("pos")) - 1
    w = w.withColumn("at", at)
    pauses = F.array_sort(F.collect_list(F.when(F.col("pause") & ~F.col("punct"), F.col("at"))).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    start = F.array(F.lit(-1))
    cuts = F.aggregate(pauses, start, lambda s, x: F.when(x - F.element_at(s, -1) >= cfg.min_words, F.concat(s, F.array(x))).otherwise(s))
    end = F.col("punct") | F.col("last") | (F.col("pause") & F.array_contains(cuts, F.col("at")))  # the fold runs at pauses only
    w = w.withColumn("end", end)
    # runs follow each other, so this is the order of pos, and the one that the rows lie in
    before = Window.partitionBy("video_id").orderBy("run", "pos").rowsBetween(Window.unboundedPreceding, -1)
    sentence = F.coalesce(F.sum(F.col("end").cast("int")).over(before), F.lit(0)).cast("long")
    return w.withColumn("sentence", sentence).drop("run", "at", "pause", "last", "end")


def ordered_text(order: str = "pos", word: str = "word"):
    """The words of a group joined by blanks, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), " ")


def sentences(words: DataFrame, cfg: Sentences = Sentences()) -> DataFrame:
    """One row per sentence: id, first and last word, times, text, and whether it reads complete."""
    g = sentence_of_word(words, cfg).groupBy("video_id", F.col("sentence").alias("id"))
    out = g.agg(
        F.min("pos").alias("start_word"), F.max("pos").alias("end_word"), F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", "pos").alias("end_ms"), ordered_text().alias("text"), F.max_by("punct", "pos").alias("ends_with_punctuation"),
    )
    return out.withColumn("heuristic_complete", F.col("ends_with_punctuation") & ~F.col("text").rlike(X.FILLER_ONLY))


def raw_chunk_of_word(words: DataFrame, cfg: Chunking = Chunking()) -> DataFrame:
    """words with ``chunk_start``: cuts at silences, moved to the next sentence end within reach, and one
    extra cut near the middle of a span over the token budget (not of the last span, and not again)."""
    ahead = _video().rowsBetween(0, cfg.look_ahead - 1)
    w = words.withColumns({"stop": X.ends_chunk(F.col("word")), "gap": F.col("start_ms") - F.lag("end_ms").over(_video())})
    nearest = F.min(F.when(F.col("stop"), F.col("pos") + 1)).over(ahead)
    clean = F.lag("stop").over(_video())
    target = F.when(F.col("gap") >= cfg.silence_ms, F.when(clean, F.col("pos")).otherwise(F.coalesce(nearest, F.col("pos"))))
    w = w.withColumn("target", target).withColumn("n", F.count("*").over(Window.partitionBy("video_id")))
    # targets never go back: a later silence before the same sentence end has the same one. So the last is looked at: no join
    last_target = F.max("target").over(_video().rowsBetween(Window.unboundedPreceding, 0))
    w = w.withColumn("cut", F.coalesce(last_target == F.col("pos"), F.lit(False)))
    w = w.withColumn("span", F.sum(F.col("cut").cast("int")).over(_video()))
    span = Window.partitionBy("video_id", "span")
    last = F.max("pos").over(span)
    tokens = F.floor((F.sum(F.length("word") + 1).over(span) - 1) / 4)
    low = F.min("pos").over(span)
    w = w.withColumns({"lo": low, "hi": last + 1, "tokens": tokens})
    is_tail = F.col("hi") == F.col("n")
    has_end_cut = F.max(F.when(F.col("target") == F.col("n"), True)).over(Window.partitionBy("video_id"))
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    w = w.withColumn("split", (F.col("tokens") > cfg.max_tokens) & (~is_tail | F.coalesce(has_end_cut, F.lit(False)))).withColumn("mid", mid)
    at = F.coalesce(F.min(F.when(F.col("stop") & (F.col("pos") >= F.col("mid")), F.col("pos") + 1)).over(span), F.col("mid"))
    w = w.withColumn("extra", F.when(F.col("split"), at))
    second = F.col("extra").isNotNull() & (F.col("pos") >= F.col("extra"))
    return w.withColumn("chunk_start", F.when(second, F.col("extra")).otherwise(F.col("lo"))).select(*words.columns, "gap", "chunk_start")


def _chunks(words: DataFrame, cfg: Chunking, *times: str) -> DataFrame:
    """Chunks with their words as ``items``: pos, word and the times that are asked for."""
    g = raw_chunk_of_word(words, cfg).groupBy("video_id", "chunk_start")
    c = g.agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.coalesce(F.min_by("gap", "pos"), F.lit(0)).cast("long").alias("silence_gap_before_ms"),
        F.max("pos").alias("end_word"), F.array_sort(F.collect_list(F.struct("pos", "word", *times))).alias("items"),
    )
    c = c.where(F.col("end_ms") - F.col("start_ms") >= cfg.min_ms).withColumn("text", _text(F.col("items"))).withColumn("token_count", X.approx_tokens(F.col("text")))
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("chunk_start")) - 1
    return c.withColumn("chunk_index", index.cast("long")).withColumnRenamed("chunk_start", "start_word")


def _text(items):
    return F.array_join(F.transform(items, lambda x: x["word"]), " ")


def silence_chunks(words: DataFrame, cfg: Chunking = Chunking()) -> DataFrame:
    """Chunks between silences, those under the least duration dropped, renumbered."""
    return _chunks(words, cfg).drop("items")


def overlap_chunks(words: DataFrame, cfg: Chunking = Chunking()) -> DataFrame:
    """Chunks with the words of the chunk before that end within overlap_ms of the start put in front.

    A chunk carries its words, so the chunk before is one row back: words are shuffled once. Only the words
    that the next chunk takes are handed on."""
    chunk = Window.partitionBy("video_id").orderBy("start_word")  # as they were numbered: not sorted again
    c = _chunks(words, cfg, "start_ms", "end_ms").withColumn("next", F.lead("start_ms").over(chunk))
    c = c.withColumn("tail", F.filter("items", lambda x: x["end_ms"] >= F.col("next") - cfg.overlap_ms)).withColumn("lead", F.lag("tail").over(chunk))
    c = c.withColumn("lead", F.when(F.size("lead") > 0, F.col("lead")))
    text = F.concat_ws(" ", _text(F.col("lead")), "text")
    return c.select(
        "video_id", "chunk_index", F.coalesce(F.get("lead", 0)["start_ms"], F.col("start_ms")).alias("start_ms"), "end_ms", text.alias("text"), X.approx_tokens(text).alias("token_count"),
        F.col("lead").isNotNull().alias("is_overlap_tail"), "silence_gap_before_ms",
    )


def outline_windows(sents: DataFrame, size: int = 40, overlap: int = 4, most: int = 12) -> DataFrame:
    """Overlapping windows of sentences with times, first ids and a title from the first eight words.

    A video of more than ``most`` windows gets wider ones, so that they still cover all of it."""
    n = F.count("*").over(Window.partitionBy("video_id"))
    count = lambda size: F.when(F.col("n") <= size, 1).otherwise(F.ceil((F.col("n") - size) / F.greatest(F.lit(1), size - overlap)) + 1)
    wider = F.greatest(F.lit(size), F.ceil(F.col("n") / most) + 4)
    sents = sents.withColumn("n", n).withColumn("size", F.when(count(F.lit(size)) > most, wider).otherwise(size).cast("long"))
    size, step = F.col("size"), F.greatest(F.lit(1), F.col("size") - overlap)
    ks = F.sequence(F.greatest(F.ceil((F.col("id") - size + 1) / step), F.lit(0)), F.least(F.floor(F.col("id") / step), F.col("windows") - 1))
    s = sents.withColumn("windows", F.least(count(size), F.lit(most)).cast("long"))
    s = s.withColumn("window", F.explode(ks))
    first = F.col("id") - F.col("window") * step < 3
    g = s.groupBy("video_id", "window").agg(
        F.min("id").alias("start_id"), F.max("id").alias("end_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_sort(F.collect_list(F.when(first, F.struct("id", "text")))).alias("heads"), F.slice(F.array_sort(F.collect_list("id")), 1, 6).alias("key_ids"),
    )
    words = X.split_words(F.array_join(F.transform("heads", lambda x: x["text"]), " "))
    return g.select("video_id", "window", "start_id", "end_id", "start_ms", "end_ms", F.array_join(F.slice(words, 1, 8), " ").alias("title"), F.array_join("key_ids", ",").alias("key_ids"))
