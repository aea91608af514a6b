"""Transcript sources: JSON transcripts, SRT files, and word timelines of plain documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions import text as X

#: Characters of text that one task takes apart. A word is some 100 bytes as a row, and the windows over a timeline sort
#: it up to five times in one stage, so this is a few hundred MB of a task's memory: nothing spills.
TASK_CHARS = 2_000_000

_WORD = "array<struct<word:string,start:string,end:string,display:string>>"


def parsed_transcripts(raw: DataFrame) -> DataFrame:
    """(video_id, value) -> (video_id, words, error): the words of ``segments[].words[]`` if present, else of a top-level
    list, else of ``word_segments``; ``error`` where the text is none of these."""
    nested = F.from_json("value", f"struct<segments:array<struct<words:{_WORD}>>,word_segments:{_WORD}>")
    is_list = F.ltrim("value").startswith("[")
    words = F.when(is_list, F.from_json("value", _WORD)).otherwise(
        F.coalesce(F.flatten(F.transform(nested["segments"], lambda s: F.coalesce(s["words"], F.array().cast(_WORD)))), nested["word_segments"])
    )
    return raw.select("video_id", words.alias("words")).withColumn("error", F.when(F.col("words").isNull(), "no words in the transcript"))


def read_transcripts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Words of transcript files, one row per word: video_id (the file), pos, word, display, start_ms, end_ms.

    Words without readable times or text are skipped (``skipped_words`` counts them); the
    rest are ordered by time. A file that is no transcript is an error, or left out if not strict."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("video_id"), "value")
    t = parsed_transcripts(raw)
    words = F.when(F.col("error").isNull(), F.col("words")).otherwise(F.raise_error(F.concat("error", F.lit(": "), "video_id")).cast(_WORD)) if strict else F.col("words")
    return order_words(t.select("video_id", F.posexplode(words).alias("seq", "w")).select("video_id", "seq", "w.*"))


def skipped_words(raw: DataFrame) -> DataFrame:
    """(video_id, words, skipped) of raw transcripts (video_id, value): words found, and those without readable times or text."""
    t = parsed_transcripts(raw).where("error is null")
    number = lambda x: x.try_cast("double").isNotNull()
    good = F.filter("words", lambda w: number(w["start"]) & number(w["end"]) & (F.trim(w["word"]) != ""))
    return t.select("video_id", F.size("words").alias("words"), (F.size("words") - F.size(good)).alias("skipped"))


#: Columns that the point reads of each table give, and their order.
READS = {
    "chunks": (["chunk_id", "chunk_index", "start_ms", "end_ms", "text", "token_count"], ["chunk_index"]),
    "clips": (["clip_id", "clip_number", "s", "e", "hook"], ["clip_number"]),
    "candidates": (["cand_id", "status", "s", "e", "hook"], ["s", "cand_id"]),
    "events": (["s", "e", "peak_ms", "energy_increase", "confidence"], ["s"]),
    "outlines": (["level", "idx", "start_ms", "end_ms", "title", "content"], ["level", "idx"]),
}


def rows_of_video(spark: SparkSession, root: str, table: str, video_id) -> DataFrame:
    """A table's rows of one video, in order: partition or filter and columns are pushed down to the scan."""
    columns, order = READS[table]
    t = spark.read.parquet(f"{root}/{table}").where(F.col("video_id") == F.lit(video_id))
    return t.select("video_id", *[c for c in columns if c in t.columns]).orderBy(*[c for c in order if c in t.columns])


def order_words(rows: DataFrame) -> DataFrame:
    """(video_id, seq, word, start, end[, display]) in seconds as text or numbers -> numbered words in milliseconds."""
    ms = lambda c: F.round(F.col(c).cast("string").try_cast("double") * 1000).cast("long")
    display = F.col("display") if "display" in rows.columns else F.lit(None).cast("string")
    rows = rows.select("video_id", "seq", F.trim("word").alias("word"), display.alias("display"), ms("start").alias("start_ms"), ms("end").alias("end_ms"))
    rows = rows.where("start_ms is not null and end_ms is not null and word <> ''")
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms", "seq")
    return rows.withColumn("pos", F.row_number().over(w) - 1).drop("seq")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT files: (video_id, cue, start_ms, end_ms, text). Blocks of under three lines are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("video_id"), F.regexp_replace("value", "\r", "").alias("value"))
    return srt_cues(raw)


def srt_cues(raw: DataFrame) -> DataFrame:
    blocks = raw.select("video_id", F.posexplode(F.split(F.trim("value", F.lit(" \n\t")), r"\n\s*\n")).alias("cue", "block"))
    lines = F.split(F.trim("block", F.lit(" \n\t")), "\n")
    times = F.split(F.get(lines, 1), " --> ")
    return (
        blocks.where(F.size(lines) >= 3)
        .select(
            "video_id", "cue", X.parse_srt_time(F.get(times, 0)).alias("start_ms"), X.parse_srt_time(F.get(times, 1)).alias("end_ms"),
            F.array_join(F.slice(lines, 3, 1_000_000), " ").alias("text"),
        )
        .where("start_ms is not null and end_ms is not null")
    )


def _lasts(word: Column) -> Column:
    return (80 * F.length(word) + 40).cast("long")


def _rests(word: Column, pos: Column, video: Column) -> Column:
    beat = pos * 7919 + video * 104729
    return F.when(X.ends_sentence(word), F.when(beat % 5 == 0, 1500).otherwise(600)).otherwise(F.when(beat % 97 == 0, 1300).otherwise(60)).cast("long")


def dealt(docs: DataFrame) -> DataFrame:
    """(video_id, text) of documents, dealt by id to tasks of TASK_CHARS characters: the number of tasks follows the
    characters of all texts; from shuffled bytes alone, Spark would make too few."""
    docs = docs.select(F.col("doc_id").alias("video_id"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return docs.repartition(max(1, math.ceil(chars / TASK_CHARS)), "video_id")


def word_timeline(docs: DataFrame) -> DataFrame:
    """A deterministic word timeline of documents: (video_id, pos, word, start_ms, end_ms).

    Words last 80 ms a letter and 40 more; the pauses between them depend on punctuation
    and position. Documents are dealt by id before they are exploded, so this and the
    later windows over video_id share one shuffle of texts instead of one of words."""
    rows = dealt(docs).select("video_id", F.posexplode(X.split_words(F.col("text"))).alias("pos", "word"))
    rows = rows.withColumn("pos", F.col("pos").cast("long"))  # before the window: later ones over pos find the rows sorted
    rows = rows.withColumn("dur", _lasts(F.col("word"))).withColumn("gap", _rests(F.col("word"), F.col("pos"), F.col("video_id")))
    before = Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0))
    return rows.withColumn("start_ms", start).select("video_id", "pos", "word", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"))


def timelines(docs: DataFrame) -> DataFrame:
    """The word timeline with one row a document: (video_id, text, word, lasts_ms, step_ms), the last three as arrays in the
    words' order: the words, what each lasts, and the time from its start to the next one's. A word starts when the steps
    before it are over; words are neither sorted nor shuffled."""
    rows = dealt(docs).withColumn("word", X.split_words(F.col("text"))).withColumn("lasts_ms", F.transform("word", _lasts))
    return rows.withColumn("step_ms", F.transform("word", lambda w, i: _lasts(w) + _rests(w, i.cast("long"), F.col("video_id"))))
