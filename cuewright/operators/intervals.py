"""Interval algebra: merging, timelines, as-of lookups, snapping, refinement, stitching.

Ranges are rows (key, s, e) in milliseconds. Joins are on the key and a range predicate, never on the range alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.config import Refine
from cuewright.names import spare
from cuewright.functions.numeric import overlap


def merge_ranges(ranges: DataFrame, key: str, tolerance_ms: int = 50) -> DataFrame:
    """(key, s, e, n): ranges joined when the next starts at most tolerance_ms after all before it ended."""
    w = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("s") > reach + tolerance_ms).cast("int"), F.lit(1))
    r = ranges.select(key, "s", "e").withColumn("fresh", fresh)
    r = r.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("island")


def output_timeline(ranges: DataFrame, key: str) -> DataFrame:
    """ranges with out_s and out_e: their places when played one after the other."""
    w = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    out = F.coalesce(F.sum(F.col("e") - F.col("s")).over(w), F.lit(0)).cast("long")
    return ranges.withColumn("out_s", out).withColumn("out_e", F.col("out_s") + F.col("e") - F.col("s"))


BUCKET_MS = 60_000


def overlap_join(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str], width: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals meet, once each.

    Both sides are dealt to buckets of the time axis, so the join is on (key, bucket) and a
    long video is many groups; a pair counts in the first bucket that both cover. ``right``
    must not share column names with ``left`` but for the key. Empty intervals meet nothing."""
    (at,) = spare(["cell"], left, right)
    cell = lambda c: F.floor(F.col(c) / width)
    deal = lambda d, x: d.where(F.col(x[0]) <= F.col(x[1])).withColumn(at, F.explode(F.sequence(cell(x[0]), cell(x[1]))))
    j = deal(left, l).join(deal(right, r), [key, at])
    once = F.col(at) == F.greatest(cell(l[0]), cell(r[0]))
    return j.where(once & (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))).drop(at)


def speech_coverage(ranges: DataFrame, words: DataFrame, key: str, range_id: str) -> DataFrame:
    """(key, range_id, speech_ms, span_ms): summed overlap of words with each range; overlapping words count twice."""
    got = overlap_join(ranges.select(key, range_id, "s", "e"), words.select(key, "start_ms", "end_ms"), key, ("s", "e"), ("start_ms", "end_ms"))
    got = got.groupBy(key, range_id).agg(F.sum(overlap(F.col("start_ms"), F.col("end_ms"), F.col("s"), F.col("e"))).cast("long").alias("speech_ms"))
    out = ranges.join(got, [key, range_id], "left")
    return out.select(key, range_id, F.coalesce("speech_ms", F.lit(0)).alias("speech_ms"), F.greatest(F.col("e") - F.col("s"), F.lit(0)).alias("span_ms"))


def sentence_at(points: DataFrame, sents: DataFrame, point_id: str, t: str, out: str) -> DataFrame:
    """points with ``out``: the id of the sentence that holds time t, else of the last that ended by t, else of the first.

    One pass over the union of points and sentences per video: running first/last values instead of a range join."""
    inside = F.struct(F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.col("id").alias("id"), F.col("end_ms").alias("end"))
    marks = sents.select("video_id", inside.alias("m")).select("video_id", "m.*", F.lit(None).cast(points.schema[point_id].dataType).alias(point_id))
    asked = points.select("video_id", F.col(t).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("end"), point_id)
    order = Window.partitionBy("video_id").orderBy("at", "kind", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    u = marks.unionByName(asked)
    u = u.withColumns(
        {
            "last": F.last(F.when(F.col("kind") == 0, F.struct("id", "end")), ignorenulls=True).over(so_far),
            "first": F.min("id").over(Window.partitionBy("video_id")),
        }
    )
    # sentences do not overlap: the last to start either holds t, or ended before it
    got = F.coalesce(F.col("last.id"), F.col("first"))
    return u.where("kind = 1").select("video_id", point_id, got.alias(out))


def neighbours(sents: DataFrame) -> DataFrame:
    """sents with ``prev_end`` and ``next_start``, by id, unless they have them: who writes sentences adds them where they are made, in no further shuffle."""
    if "prev_end" in sents.columns and "next_start" in sents.columns:
        return sents
    by_id = Window.partitionBy("video_id").orderBy("id")
    return sents.withColumns({"prev_end": F.lag("end_ms").over(by_id), "next_start": F.lead("start_ms").over(by_id)})


def snap(clips: DataFrame, sents: DataFrame, cfg: Refine = Refine()) -> DataFrame:
    """clips (video_id, clip_id, s, e) with s_id, e_id, det_s, det_e: moved to sentence bounds with padding, not into other words.

    Both ends are looked up in one pass: sentences, with their neighbours' bounds, and the
    clips' ends are ordered by time together, and the last sentence so far is carried along."""
    fields = ["id", "start_ms", "end_ms", "prev_end", "next_start"]
    n = neighbours(sents).select("video_id", *fields)
    marks = n.select("video_id", F.col("start_ms").alias("at"), F.struct(*fields).alias("m"))
    ends = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(0).alias("which")), F.struct(F.col("e").alias("at"), F.lit(1).alias("which"))))
    asked = clips.select("video_id", F.struct("clip_id", "s", "e").alias("c"), ends.alias("p")).select("video_id", "p.at", "p.which", "c")
    u = marks.unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy("video_id").orderBy("at", F.col("which").asc_nulls_first())  # a sentence that starts at a point holds it
    so_far = F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = u.withColumn("m", F.coalesce(so_far, first)).where("c is not null and m is not null")
    g = found.groupBy("video_id", "c").agg(F.max(F.when(F.col("which") == 0, F.col("m"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("m"))).alias("b"))
    det_s = F.greatest(F.lit(0).cast("long"), F.col("a.start_ms") - cfg.pad_before_ms, F.coalesce(F.col("a.prev_end") + 10, F.lit(0)))
    det_e = F.least(F.col("b.end_ms") + cfg.pad_after_ms, F.col("b.next_start") - 10)
    out = g.select("video_id", "c.clip_id", "c.s", "c.e", F.col("a.id").alias("s_id"), F.col("b.id").alias("e_id"), det_s.alias("det_s"), det_e.alias("det_e"))
    return out.withColumn("det_e", F.greatest("det_e", F.col("det_s") + 500))


def refine(clips: DataFrame, sents: DataFrame, cfg: Refine = Refine(), verdicts: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """Clips refined: snap or a validator's verdict, cap the extension, trim the start to the longest duration.

    verdicts: (video_id, clip_id, start_id, end_id, complete), of a validator that names
    sentences and never times; ids outside the clip's context are ignored, reversed ones
    swapped, and an incomplete thought ends at the last punctuated sentence before.
    durations: (video_id, duration_ms); bounds stay inside.
    Returns clip_id, video_id, refined_s, refined_e, refine_status, method. The sentences in
    a clip's context are gathered by one bucketed join, then every rule is one column."""
    keys = ["video_id", "clip_id", "s", "e"]
    own = clips.select(*keys)
    if durations is not None:
        own = own.join(durations.select("video_id", "duration_ms"), "video_id", "left").withColumn("e", F.least("e", "duration_ms"))
    else:
        own = own.withColumn("duration_ms", F.lit(None).cast("long"))
    bad = F.col("e") <= F.col("s")
    good = own.where(~bad)
    c = good.join(snap(good, sents, cfg), keys, "left")
    if verdicts is not None:
        c = c.join(verdicts.select("video_id", "clip_id", F.least("start_id", "end_id").alias("v0"), F.greatest("start_id", "end_id").alias("v1"), "complete"), ["video_id", "clip_id"], "left")
    else:
        c = c.withColumns({"v0": F.lit(None).cast("long"), "v1": F.lit(None).cast("long"), "complete": F.lit(None).cast("boolean")})
    fields, more = ["id", "start_ms", "end_ms", "ends_with_punctuation"], ["prev_end", "next_start"]
    if verdicts is not None:  # nothing else asks for a sentence's neighbours
        fields += more
    around = (sents if verdicts is None else neighbours(sents)).select("video_id", *fields)
    c = c.withColumns({"c0": F.col("s") - cfg.context_ms, "c1": F.col("e") + cfg.context_ms, "cap": F.col("e") + cfg.extension_ms})
    near = overlap_join(c.select("video_id", "clip_id", "c0", "c1"), around, "video_id", ("c0", "c1"), ("start_ms", "end_ms"))
    window = near.groupBy("video_id", "clip_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("around"))
    if verdicts is None:
        window = window.withColumn("around", F.transform("around", lambda z: F.struct(*[z[f].alias(f) for f in fields], *[F.lit(None).cast("long").alias(f) for f in more])))
    g = c.join(window, ["video_id", "clip_id"], "left").withColumn("around", F.coalesce("around", F.array().cast(window.schema["around"].dataType)))
    # the validator's sentences
    at = lambda x: F.get(F.filter("around", lambda z: z["id"] == x), 0)
    g = g.withColumns({"a": at(F.col("v0")), "b": at(F.col("v1"))}).withColumn("judged", F.col("a").isNotNull() & F.col("b").isNotNull())
    llm_s = F.greatest(F.col("a.start_ms") - cfg.pad_before_ms, F.coalesce(F.col("a.prev_end") + 10, F.lit(0)), F.lit(0))
    g = g.withColumn("llm_s", F.when(F.col("judged"), F.greatest(F.least(llm_s, F.col("duration_ms") - 500), F.lit(0))))
    whole = F.filter("around", lambda z: (z["id"] <= F.col("v1")) & z["ends_with_punctuation"] & (z["start_ms"] >= F.col("llm_s")))
    g = g.withColumn("earlier", F.when(F.col("judged") & ~F.col("complete"), F.try_element_at(whole, F.lit(-1))))
    g = g.withColumn("moved", F.coalesce(F.col("earlier.id") != F.col("b.id"), F.lit(False))).withColumn("b", F.when(F.col("moved"), F.col("earlier")).otherwise(F.col("b")))
    llm_e = F.least(F.col("b.end_ms") + cfg.pad_after_ms, F.col("b.next_start") - 10, F.when(~F.col("moved"), F.col("duration_ms")))
    g = g.withColumns({"new_s": F.coalesce("llm_s", "det_s"), "raw_e": F.when(F.col("judged"), F.greatest(llm_e, F.col("llm_s") + 500)).otherwise(F.col("det_e"))})
    # the longest extension
    over = F.col("raw_e") > F.col("cap")
    capped = F.try_element_at(F.filter("around", lambda z: (z["end_ms"] + cfg.pad_after_ms <= F.col("cap")) & z["ends_with_punctuation"]), F.lit(-1))["end_ms"] + cfg.pad_after_ms
    g = g.withColumn("capped", capped)
    g = g.withColumn("new_e", F.when(over, F.coalesce("capped", F.when(F.col("det_e") <= F.col("cap"), F.col("det_e")))).otherwise(F.col("raw_e")))
    first = F.get(F.filter("around", lambda z: (z["start_ms"] >= F.col("new_e") - cfg.max_ms) & (z["start_ms"] >= F.col("new_s"))), 0)["start_ms"]
    g = g.withColumns({"dur": F.col("new_e") - F.col("new_s"), "trim": first})
    long = F.col("dur") > cfg.max_ms
    trimmed = long & F.col("trim").isNotNull()
    status = (
        F.when(F.size("around") == 0, "passthrough_no_transcript")
        .when(F.col("new_e").isNull(), "rejected_extension")
        .when(long & F.col("trim").isNull(), "rejected_duration")
        .when(F.col("dur") < 1000, "rejected_short")
        .otherwise("refined")
    )
    start = F.when(trimmed, F.greatest(F.col("new_s"), F.col("trim") - cfg.pad_before_ms)).otherwise(F.col("new_s"))
    how = F.when(F.col("moved"), "earlier_ending").when(F.col("judged"), "validated").otherwise("snap")
    method = F.concat(how, F.when(over & (F.col("capped").isNotNull() | F.col("new_e").isNull()), "+capped").otherwise(""), F.when(trimmed, "+trimmed").otherwise(""))
    as_was = F.col("status").isin("passthrough_no_transcript", "rejected_extension")
    done = g.withColumn("status", status).select(
        "video_id", "clip_id", F.when(as_was, F.col("s")).otherwise(start).alias("refined_s"), F.when(as_was, F.col("e")).otherwise(F.col("new_e")).alias("refined_e"),
        F.col("status").alias("refine_status"), F.when(F.size("around") > 0, method).otherwise("").alias("method"),
    )
    refused = own.where(bad).select("video_id", "clip_id", F.col("s").alias("refined_s"), F.col("e").alias("refined_e"), F.lit("rejected_range").alias("refine_status"), F.lit("").alias("method"))
    return done.unionByName(refused)


def refine_all(clips: DataFrame, more: DataFrame, sents: DataFrame, cfg: Refine = Refine()) -> DataFrame:
    """Whole clips: the refined clip and its refined continuations, merged and put on an output timeline.

    clips: (video_id, clip_id, s, e); more: (video_id, clip_id, seg_id, s, e), of which
    ``stitch_limits`` keeps some. A rejected clip has no ranges; a rejected continuation is
    left out. Returns clip_id, video_id, refine_status, ranges [(s, e, out_s, out_e)], output_ms."""
    kept = _stitched(clips, more).where("outcome = 'kept'")
    parts = clips.select("video_id", F.struct("clip_id", F.lit(None).cast("long").alias("seg_id")).alias("clip_id"), "s", "e").union(
        kept.select("video_id", F.struct("clip_id", F.col("seg_id").cast("long").alias("seg_id")), "s", "e")
    )
    r = refine(parts, sents, cfg).select("video_id", "clip_id.*", F.col("refined_s").alias("s"), F.col("refined_e").alias("e"), "refine_status")
    status = r.where("seg_id is null").select("video_id", "clip_id", "refine_status")
    fine = status.where(~F.startswith("refine_status", F.lit("rejected"))).select("clip_id")
    ranges = r.where(~F.startswith("refine_status", F.lit("rejected"))).join(fine, "clip_id", "left_semi").select("clip_id", "s", "e")
    line = output_timeline(merge_ranges(ranges, "clip_id"), "clip_id").groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("s", "e", "out_s", "out_e"))).alias("ranges"), F.sum(F.col("e") - F.col("s")).alias("output_ms")
    )
    return status.join(line, "clip_id", "left").select("video_id", "clip_id", "refine_status", "ranges", F.coalesce("output_ms", F.lit(0)).cast("long").alias("output_ms"))


def cut_ranges(clips: DataFrame) -> DataFrame:
    """(clip_id, cuts): an explicit timeline in output order where there is one, else the merged source ranges.

    clips: clip_id, ranges and timeline, arrays of (s, e) and of (s, e, out_s)."""
    ordered = F.transform(F.array_sort(F.transform("timeline", lambda t: F.struct(t["out_s"].alias("o"), t["s"].alias("s"), t["e"].alias("e")))), lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e")))
    merged = merge_ranges(clips.select("clip_id", F.inline("ranges")), "clip_id").groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("merged"))
    return clips.join(merged, "clip_id", "left").select("clip_id", F.when(F.size("timeline") > 0, ordered).otherwise(F.col("merged")).alias("cuts"))


def stitch_limits(primary: DataFrame, more: DataFrame, max_gap_ms: int = 45_000, max_total_ms: int = 90_000) -> DataFrame:
    """Which continuations of each clip are kept, in order of start: not empty, not too far after the end so far, not too long in all.

    primary: (clip_id, s, e); more: (clip_id, seg_id, s, e). A fold over each clip's few continuations:
    state is the running end and total. Returns clip_id, seg_id, outcome."""
    return _stitched(primary, more, max_gap_ms, max_total_ms).select("clip_id", "seg_id", "outcome")


def _stitched(primary: DataFrame, more: DataFrame, max_gap_ms: int = 45_000, max_total_ms: int = 90_000) -> DataFrame:
    """What stitch_limits returns, and the continuations' other columns."""
    rest = [c for c in more.columns if c not in ("clip_id", "s", "seg_id", "e")]
    items = F.array_sort(F.collect_list(F.struct("s", "seg_id", "e", *rest)))
    g = more.groupBy("clip_id").agg(items.alias("items")).join(primary.select("clip_id", F.col("s").alias("p0"), F.col("e").alias("p1")), "clip_id")
    zero = F.struct(F.col("p1").alias("end"), (F.col("p1") - F.col("p0")).alias("total"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        what = (
            F.when(x["s"].isNull() | x["e"].isNull(), "unreadable")
            .when(x["e"] <= x["s"], "empty")
            .when(x["s"] - s["end"] > max_gap_ms, "too_far")
            .when(s["total"] + x["e"] - x["s"] > max_total_ms, "too_long")
            .otherwise("kept")
        )
        kept = what == "kept"
        return F.struct(
            F.when(kept, F.greatest(s["end"], x["e"])).otherwise(s["end"]).alias("end"), F.when(kept, s["total"] + x["e"] - x["s"]).otherwise(s["total"]).alias("total"),
            F.concat(s["out"], F.array(what)).alias("out"),
        )

    g = g.withColumn("out", F.aggregate("items", zero, step, lambda s: s["out"]))
    return g.select("clip_id", F.inline(F.arrays_zip("items", "out"))).select("clip_id", "items.*", F.col("out").alias("outcome"))
