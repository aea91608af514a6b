"""Sinks: tables, reports, transcripts and caption scripts, all written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions import text as X
from cuewright.names import spare
from cuewright.operators.captions import with_items

#: Fixed format: the head of an ASS caption script.
ASS_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: 1080
PlayResY: 1920

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def write_table(df: DataFrame, path: str, key: str = "video_id") -> None:
    """Append rows, a folder per key value."""
    df.write.mode("append").partitionBy(key).parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str = "video_id") -> None:
    """Replace the folders of the keys in df, leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def clip_report(clips: DataFrame) -> DataFrame:
    """What a report says of each clip: refined bounds where there are some, and the output's length over its source ranges.

    clips: clip_id, s, e, refined_s, refined_e, ranges [(s, e)] (null or empty: the clip's own)."""
    own = F.array(F.struct("s", "e"))
    ranges = F.when(F.size("ranges") > 0, F.col("ranges")).otherwise(own)
    length = F.aggregate(ranges, F.lit(0).cast("long"), lambda t, r: t + r["e"] - r["s"])
    return clips.withColumns({"source_ranges": ranges, "output_ms": length, "start_ms": F.coalesce("refined_s", "s"), "end_ms": F.coalesce("refined_e", "e")}).drop("ranges", "refined_s", "refined_e", "s", "e")


def clips_analysis(clips: DataFrame) -> DataFrame:
    """(clip_id, line): each clip as a JSON object, without its embedding."""
    return clips.select("clip_id", F.to_json(F.struct(*[c for c in clips.columns if c != "embedding"])).alias("line"))


def outline_rows(windows: DataFrame) -> DataFrame:
    """(video_id, level, idx, start_ms, end_ms, title, content): a row for each section in order, and one for the video.

    windows: video_id, window, start_ms, end_ms, title and others, which content holds as JSON."""
    of, nth, row = spare(["of", "nth", "row"], windows)
    video = Window.partitionBy("video_id")
    whole = F.struct(F.count("*").over(video).alias("sections"), F.min("start_ms").over(video).alias("start_ms"), F.max("end_ms").over(video).alias("end_ms"))
    told = windows.withColumns({of: whole, nth: F.row_number().over(video.orderBy("window"))})
    as_row = lambda *values: F.struct(*[v.alias(c) for c, v in zip(("level", "idx", "start_ms", "end_ms", "title", "content"), values)])
    rest = F.to_json(F.struct(*[c for c in windows.columns if c != "video_id"]))
    section = as_row(F.lit("section"), F.col("window").cast("long"), F.col("start_ms"), F.col("end_ms"), F.col("title"), rest)
    video_row = as_row(F.lit("video"), F.lit(0).cast("long"), F.col(of)["start_ms"], F.col(of)["end_ms"], F.lit("video"), F.to_json(F.struct(F.col(of)["sections"].alias("sections"))))
    # the video's row goes with its first section's: the windows are worked out once
    rows = F.when(F.col(nth) == 1, F.array(section, video_row)).otherwise(F.array(section))
    return told.select("video_id", F.explode(rows).alias(row)).select("video_id", f"{row}.*")


def glossary_corrections(words: DataFrame) -> DataFrame:
    """(video_id, pos, word, display) of words that the glossary shows otherwise."""
    return words.where(~F.col("display").eqNullSafe(F.col("word"))).select("video_id", "pos", "word", "display")


def cached_labels(cache: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of wanted rows (key, ...) in a label cache (key, labels), of whose repeated keys the last (seq) counts."""
    latest = cache.groupBy("key").agg(F.max_by("labels", "seq").alias("labels"))
    return wanted.join(latest, "key"), wanted.join(latest, "key", "left_anti")


def write_transcript(segments: DataFrame, path: str) -> None:
    """Segments (video_id, pos, start_ms, end_ms, text) as JSON rows under ``path``/json and as readable lines under ``path``/txt, a folder for each video."""
    segments.write.mode("overwrite").partitionBy("video_id").json(f"{path}/json")
    lines = transcript_lines(segments).repartition("video_id").sortWithinPartitions("video_id", "pos")
    lines.select("video_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("video_id").text(f"{path}/txt")


def write_plans(plans: DataFrame, path: str) -> None:
    """Plans (clip_id, plan) as JSON, a folder for each clip."""
    plans.select("clip_id", F.to_json("plan").alias("value")).write.mode("overwrite").partitionBy("clip_id").text(path)


def transcript_lines(segments: DataFrame) -> DataFrame:
    """(video_id, pos, line): ``[HH:MM:SS --> HH:MM:SS] text``."""
    line = F.format_string("[%s --> %s] %s", X.clock(F.col("start_ms")), X.clock(F.col("end_ms")), F.col("text"))
    return segments.select("video_id", "pos", line.alias("line"))


def plan_json(plans: DataFrame, key: str) -> DataFrame:
    """(key, plan): every other column as one JSON object."""
    return plans.select(key, F.to_json(F.struct(*[c for c in plans.columns if c != key])).alias("plan"))


def ass_scripts(cues: DataFrame) -> DataFrame:
    """(video_id, script) from cues, or from their words with run and cue: one dialogue line a cue, each word with its length in centiseconds."""
    of = lambda c: F.transform("items", lambda x: x[c])
    cs = lambda x: F.floor((x["end_ms"] - x["start_ms"]) / 10)
    word = lambda x: F.concat(F.lit("{\\kf"), cs(x).cast("string"), F.lit("}"), X.ass_escape(x["word"]))
    g = with_items(cues).select(
        "video_id", F.get("items", 0)["pos"].alias("first"), F.array_min(of("start_ms")).alias("a"), F.array_max(of("end_ms")).alias("b"), F.array_join(F.transform("items", word), " ").alias("text")
    )
    line = F.concat(F.lit("Dialogue: 0,"), X.ass_time(F.col("a")), F.lit(","), X.ass_time(F.col("b")), F.lit(",Default,,0,0,0,,"), F.col("text"))
    lines = g.select("video_id", "first", line.alias("line")).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("first", "line"))).alias("l"))
    return lines.select("video_id", F.concat(F.lit(ASS_HEAD), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("script"))
