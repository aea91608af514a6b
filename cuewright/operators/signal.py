"""Energy series: frames, rolling-median baseline, spikes, and the candidates they cue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.config import Spikes
from cuewright.functions.numeric import clamp, half_up
from cuewright.storage import written

from .intervals import overlap_join


def frames(samples: DataFrame, per_frame: int, cfg: Spikes = Spikes()) -> DataFrame:
    """samples (key, pos, x) -> (key, frame, rms, db); a last part frame is dropped."""
    g = samples.groupBy("key", F.floor(F.col("pos") / per_frame).alias("frame")).agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("x")).alias("power"))
    g = g.where(F.col("n") == per_frame).select("key", "frame", F.sqrt(F.col("power") + 1e-12).alias("rms"))
    return g.withColumn("db", half_up(20 * F.log10(F.greatest("rms", F.lit(cfg.floor))), 6))


def baseline(f: DataFrame, cfg: Spikes = Spikes()) -> DataFrame:
    """f with ``base``: the median of db over the frames within radius, fewer at the edges."""
    w = Window.partitionBy("key").orderBy("frame").rowsBetween(-cfg.radius, cfg.radius)
    return f.withColumn("base", half_up(F.percentile("db", F.lit(0.5)).over(w), 6))


def spikes(f: DataFrame, cfg: Spikes = Spikes()) -> DataFrame:
    """Spike events of frames with baseline: runs of loud frames, capped, with confidence, merged when near."""
    quiet = half_up(20 * F.log10(F.lit(cfg.floor)) + 3.0, 6)
    up = half_up(F.col("db") - F.col("base"), 6)
    a = f.withColumn("rise", up).where((F.col("rise") >= cfg.threshold_db) & (F.col("db") > quiet))
    w = Window.partitionBy("key").orderBy("frame")
    a = a.withColumn("island", F.col("frame") - F.row_number().over(w))
    g = a.groupBy("key", "island").agg(
        F.min("frame").alias("a"), F.max("frame").alias("b"), F.max_by(F.struct("frame", "rise"), F.struct("db", -F.col("frame"))).alias("peak")
    )
    t = cfg.frame_ms
    e = g.select("key", (F.col("a") * t).alias("s"), ((F.col("b") + 1) * t).alias("e"), (F.col("peak.frame") * t + t // 2).alias("peak_ms"), half_up(F.col("peak.rise"), 2).alias("energy_increase"), F.col("peak.rise").alias("rise"))
    e = e.where(F.col("e") - F.col("s") >= cfg.min_ms)
    conf = clamp((F.col("rise") - cfg.threshold_db + 6.0) / 12.0, 0.05)
    long = F.col("e") - F.col("s") > cfg.max_ms
    e = e.withColumn("confidence", half_up(F.when(long, conf * 0.6).otherwise(conf), 3)).withColumn("e", F.when(long, F.col("s") + cfg.max_ms).otherwise(F.col("e")))
    return merge_events(e.drop("rise"), cfg)


def merge_events(e: DataFrame, cfg: Spikes = Spikes()) -> DataFrame:
    """Events joined when the next starts within merge_ms; the louder one's peak stays, confidences of record breakers are maximised."""
    w = Window.partitionBy("key").orderBy("s")
    fresh = F.coalesce((F.col("s") - F.lag("e").over(w) > cfg.merge_ms).cast("int"), F.lit(1))
    e = e.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    inside = Window.partitionBy("key", "island").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("record", F.coalesce(F.col("energy_increase") > F.max("energy_increase").over(inside), F.lit(True)))
    return e.groupBy("key", "island").agg(
        F.min("s").alias("s"), F.max_by("e", "s").alias("e"), F.max_by("peak_ms", F.when(F.col("record"), F.col("s"))).alias("peak_ms"),
        F.max("energy_increase").alias("energy_increase"), F.max(F.when(F.col("record"), F.col("confidence"))).alias("confidence"), F.count("*").alias("n"),
    ).drop("island")


def _few(rows: DataFrame) -> DataFrame:
    """rows, written: their size is known to the planner then. Spikes are few beside words, so they are sent to the tasks that
    hold the timelines while they fit spark.sql.autoBroadcastJoinThreshold, and words stay where they were dealt; more are joined by a shuffle."""
    return written(rows, "spikes")


def event_cues(events: DataFrame, sents: DataFrame, words: DataFrame, cfg: Spikes = Spikes()) -> DataFrame:
    """Candidates around spikes (key = video_id): the sentences near the peak, if spoken enough and of fit length.

    ``rationale`` says why in words, ``provenance`` in JSON, with ``energy_increase`` and ``label`` where events have them."""
    has = [c for c in ("energy_increase", "label") if c in events.columns]
    ev = _few(events.select(F.col("key").alias("video_id"), F.col("peak_ms"), "confidence", *has, (F.col("peak_ms") - cfg.pre_ms).alias("lo"), (F.col("peak_ms") + cfg.post_ms).alias("hi")))
    near = sents.select("video_id", "id", "start_ms", "end_ms")
    c = overlap_join(ev, near, "video_id", ("lo", "hi"), ("start_ms", "end_ms")).groupBy("video_id", "peak_ms", "confidence", *has).agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e")
    )
    c = _few(c)
    # the words of whole sentences: their summed length is the speech inside the span
    spoken = F.sum(F.col("end_ms") - F.col("start_ms"))
    w = words.select("video_id", "start_ms", "end_ms")
    met = overlap_join(c, w, "video_id", ("s", "e"), ("start_ms", "end_ms")).where((F.col("start_ms") < F.col("e")) & (F.col("end_ms") > F.col("s")))
    out = met.groupBy("video_id", "peak_ms", "confidence", *has, "first_id", "last_id", "s", "e").agg(spoken.alias("speech_ms"))
    span = F.col("e") - F.col("s")
    out = out.where((F.col("speech_ms") * 10 >= span * round(cfg.coverage * 10)) & span.between(cfg.min_span_ms, cfg.max_span_ms))
    rise = F.concat(F.lit(" +"), F.col("energy_increase").cast("string"), F.lit(" dB")) if "energy_increase" in has else F.lit("")
    second = F.format_string("%.1f", F.col("peak_ms") / 1000)
    why = F.concat(F.lit("audio spike"), rise, F.lit(" at "), second, F.lit(" s; speech covers "), F.floor(F.col("speech_ms") * 100 / span + 0.5).cast("string"), F.lit(" %"))
    told = F.to_json(F.struct(F.lit("audio_event").alias("source"), F.col("peak_ms").alias("event_peak"), *has))
    out = out.withColumns({"uncertainty": half_up(1.0 - 0.5 * F.col("confidence"), 3), "rationale": why, "provenance": told})
    return out.drop("confidence", *has)
