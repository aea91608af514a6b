"""Editing and review operators: caption lines, regions, key frames, overrides, validation, layout and campaign rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions import text as X
from cuewright.functions.numeric import half_up, overlap

from .adapters import LAYOUTS
from .captions import with_items
from .intervals import overlap_join

def caption_lines(cues: DataFrame) -> DataFrame:
    """Cues, or their words with video_id, run, cue, pos, word -> (video_id, first_word, line_1, line_2): a cue in at most two lines.

    The break is after the first word that reaches half of the letters and ends a phrase, or
    reaches six tenths, or has at most three words behind it; one word must remain. It is a fold over the cue's words."""
    size = lambda x: (F.length(x["word"]) + 1).cast("long")
    none = F.lit(0).cast("long")
    c = with_items(cues).select("video_id", "items", F.size("items").alias("n"), F.aggregate("items", none, lambda s, x: s + size(x)).alias("total"))

    def step(s, x):
        acc, at = s["acc"] + size(x), s["at"] + 1
        left = F.col("n") - at
        stop = (acc * 10 >= F.col("total") * 6) | (left <= 3) | F.endswith(x["word"], F.lit(",")) | X.ends_sentence(x["word"])
        cut = F.when((s["cut"] == 0) & (acc * 2 >= F.col("total")) & (left >= 1) & stop, at).otherwise(s["cut"])
        return F.struct(acc.alias("acc"), at.alias("at"), cut.alias("cut"))

    cut = F.aggregate("items", F.struct(none.alias("acc"), F.lit(0).alias("at"), F.lit(0).alias("cut")), step, lambda s: F.when(s["cut"] == 0, s["at"]).otherwise(s["cut"]))
    line = lambda a, n: F.array_join(F.transform(F.slice("items", a, n), lambda x: x["word"]), " ")
    return c.withColumn("cut", cut).select(
        "video_id", F.get("items", 0)["pos"].alias("first_word"), line(F.lit(1), F.col("cut")).alias("line_1"), line(F.col("cut") + 1, F.col("n") - F.col("cut")).alias("line_2")
    )


def apply_caption_text(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """cues (cue_id, words array) with the words of an edited text (cue_id, text); null ``error`` if the counts agree, else the cue stays."""
    new = X.split_words(F.col("text"))
    j = cues.join(edits, "cue_id", "left")
    bad = F.col("text").isNotNull() & (F.size(new) != F.size("words"))
    return j.select("cue_id", F.when(F.col("text").isNull() | bad, F.col("words")).otherwise(new).alias("words"), F.when(bad, "word count differs").alias("error"))


def boundary_error(s: Column, e: Column, duration: Column) -> Column:
    """Why edited bounds (text or numbers, seconds) are refused; null if fine."""
    a, b = s.cast("string").try_cast("double"), e.cast("string").try_cast("double")
    return (
        F.when(a.isNull() | b.isNull(), "not numeric").when((a < 0) | (b <= a), "not in order").when(b - a < 1, "under one second").when(b > duration + 0.01, "beyond the end")
    )


def keyframes(clips: DataFrame, cuts: DataFrame, most: int = 4) -> DataFrame:
    """(clip_id, times): scene cuts inside each clip and its middle, in order, at most ``most``."""
    c = cuts.select(F.col("video_id").alias("v"), F.col("t"))
    j = clips.join(c, (F.col("video_id") == F.col("v")) & F.col("t").between(F.col("s"), F.col("e")), "left")
    mid = F.floor((F.col("s") + F.col("e")) / 2)
    g = j.groupBy("clip_id", "s", "e").agg(F.collect_set("t").alias("ts"))
    return g.select("clip_id", F.slice(F.array_sort(F.array_union("ts", F.array(mid))), 1, most).alias("times"))


def override_region(regions: Column, new: Column) -> Column:
    """An array of regions with ``new`` in place of one with the same time range, else at the end."""
    same = lambda r: r["t_start"].eqNullSafe(new["t_start"]) & r["t_end"].eqNullSafe(new["t_end"])
    return F.when(F.exists(regions, same), F.transform(regions, lambda r: F.when(same(r), new).otherwise(r))).otherwise(F.concat(regions, F.array(new)))


def layout(cli: Column, campaign: Column, default: Column, full_screen: bool = True) -> Column:
    """The first layout given, in lower case; one that is not known becomes auto, as does a fitted frame where every shot must fill the screen."""
    v = F.lower(F.trim(F.coalesce(cli, campaign, default, F.lit("auto"))))
    known = F.when(v.isin(LAYOUTS), v).otherwise("auto")
    return F.when(known == "branded_fit", "auto").otherwise(known) if full_screen else known


def dedupe_words(words: DataFrame) -> DataFrame:
    """The first of words equal in text and times."""
    w = Window.partitionBy("video_id", "word", "start_ms", "end_ms").orderBy("pos")
    return words.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def discovery_windows(sents: DataFrame, size: int = 120, target: int = 24) -> DataFrame:
    """Fixed slices of sentences with how many proposals each is asked for."""
    g = sents.groupBy("video_id", F.floor(F.col("id") / size).alias("window")).agg(
        F.min("id").alias("start_id"), F.max("id").alias("end_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )
    n = F.count("*").over(Window.partitionBy("video_id"))
    return g.withColumn("asked", F.greatest(F.lit(2), F.floor(F.lit(target) / n) + 1).cast("long"))


def section_windows(sents: DataFrame, sections: DataFrame, size: int = 120, target: int = 8) -> DataFrame:
    """(video_id, window, start_id, end_id, n_sentences, asked): what discovery reads at once, by outline sections.

    sections: (video_id, idx, start_id, end_id). A section's known sentences, in slices of ``size``; sections without any
    give no window. A video without sections goes in slices over all its sentences. A sentence in two sections is in both's
    windows. Numbers run in the sections' order; every window is asked for its share of the target and one more, two at least."""
    ids = sents.select("video_id", "id").distinct()
    s = sections.select("video_id", F.col("idx").cast("long").alias("idx"), F.col("start_id").cast("long").alias("a"), F.col("end_id").cast("long").alias("b"))
    inside = overlap_join(s, ids.withColumn("id_", F.col("id")), "video_id", ("a", "b"), ("id", "id_"), width=size).select("video_id", "idx", "id")
    whole = ids.join(s.select("video_id").distinct(), "video_id", "left_anti").select("video_id", F.lit(0).cast("long").alias("idx"), "id")
    w = Window.partitionBy("video_id", "idx").orderBy("id")
    cut = inside.unionByName(whole).withColumn("slice", F.floor((F.row_number().over(w) - 1) / size))
    g = cut.groupBy("video_id", "idx", "slice").agg(F.min("id").alias("start_id"), F.max("id").alias("end_id"), F.count("*").alias("n_sentences"))
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("idx", "slice")) - 1
    asked = F.greatest(F.lit(2), F.floor(F.lit(target) / F.count("*").over(Window.partitionBy("video_id"))) + 1)
    return g.select("video_id", number.cast("long").alias("window"), "start_id", "end_id", "n_sentences", asked.cast("long").alias("asked"))


def top_classes(scores: DataFrame, keys: list[str], labels: dict[str, str], least: float, k: int = 5) -> DataFrame:
    """(keys, label, confidence): mean score by class inside each key, the k best, the first that has a label and is confident."""
    g = scores.groupBy(*keys, "class").agg(half_up(F.avg("score"), 6).alias("confidence"))
    w = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "class")
    g = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    label = F.coalesce(*[F.when(F.contains("class", F.lit(part)), F.lit(name)) for part, name in labels.items()])
    g = g.withColumn("label", label).where((F.col("confidence") >= least) & F.col("label").isNotNull())
    return g.groupBy(*keys).agg(F.min_by(F.struct("label", "confidence"), "rank").alias("x")).select(*keys, "x.label", "x.confidence")


def content_bounds(lines: DataFrame, dark: int = 8) -> DataFrame:
    """lines (clip_id, axis (row or column), line, luma), one row per sampled frame -> (clip_id, x, y, w, h): from the first to the
    last row and column that is not dark in all samples.

    The whole frame where an axis is dark throughout, or where the content's last line less its first
    is under half of the lines on either axis: flashes and noise are no content."""
    g = lines.groupBy("clip_id", "axis", "line").agg(F.bool_and(F.col("luma") <= dark).alias("black"))
    lit = lambda axis: F.when((F.col("axis") == axis) & ~F.col("black"), F.col("line"))
    size = lambda axis: F.coalesce(F.max(F.when(F.col("axis") == axis, F.col("line"))) + 1, F.lit(0))
    b = g.groupBy("clip_id").agg(
        F.min(lit("column")).alias("x0"), F.max(lit("column")).alias("x1"), F.min(lit("row")).alias("y0"), F.max(lit("row")).alias("y1"), size("column").alias("width"), size("row").alias("height")
    )
    wide = (F.col("x1") - F.col("x0")) * 2 >= F.col("width")
    ok = F.coalesce(wide & ((F.col("y1") - F.col("y0")) * 2 >= F.col("height")), F.lit(False))
    pick = lambda found, whole, name: F.when(ok, found).otherwise(whole).cast("long").alias(name)
    span = lambda a: F.col(f"{a}1") - F.col(f"{a}0") + 1
    return b.select("clip_id", pick(F.col("x0"), F.lit(0), "x"), pick(F.col("y0"), F.lit(0), "y"), pick(span("x"), F.col("width"), "w"), pick(span("y"), F.col("height"), "h"))


def bounds_in_use(clips: DataFrame, estimated: DataFrame, threshold: int = 8, width: int = 1280, height: int = 720) -> DataFrame:
    """clips (clip_id, override (x, y, w, h), analysed (x, y, w, h)) with ``bounds``: the override if it has a size, else what
    an analysis stored, else the whole frame where detection is off (threshold 0), else the estimate (clip_id, x, y, w, h)."""
    whole = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("x", 0), ("y", 0), ("w", width), ("h", height))])
    part = lambda c: F.struct(*[F.col(f"{c}.{k}").cast("long").alias(k) for k in "xywh"])
    e = estimated.select("clip_id", F.struct("x", "y", "w", "h").alias("found"))
    set_ = (F.col("override.w") > 0) & (F.col("override.h") > 0)
    found = whole if threshold <= 0 else F.when(F.col("found").isNotNull(), part("found")).otherwise(whole)
    bounds = F.when(set_, part("override")).when(F.col("analysed").isNotNull(), part("analysed")).otherwise(found)
    return clips.join(e, "clip_id", "left").withColumn("bounds", bounds).drop("found")


def speaker_tracks(clips: DataFrame, speech: DataFrame, faces: DataFrame, speaker_map: dict[str, str], enabled: bool = True, auto_match: bool = False) -> DataFrame:
    """(clip_id, status, mapping {speaker: track}): voices to faces, by an explicit map of speakers to sides only.

    clips: (clip_id); speech: (clip_id, speaker); faces: (clip_id, track_id, cx). left is the
    track of the least mean place, right that of the greatest, in the order of (place, track) where places
    are equal; without two tracks, speech or a map there is no mapping, and nothing is guessed."""
    g = faces.where("track_id is not null").groupBy("clip_id", "track_id").agg(F.avg("cx").alias("x"))
    t = g.groupBy("clip_id").agg(F.count_distinct("track_id").alias("tracks"), F.min_by("track_id", F.struct("x", "track_id")).alias("left"), F.max_by("track_id", F.struct("x", "track_id")).alias("right"))
    j = clips.join(t, "clip_id", "left").join(speech.select("clip_id", F.lit(True).alias("spoken")).distinct(), "clip_id", "left")
    sides = {k: v for k, v in speaker_map.items() if v in ("left", "right")}
    entries = F.map_from_arrays(F.array(*map(F.lit, sides)), F.array(*map(F.col, sides.values()))) if sides else None
    status = (
        F.when(F.lit(not enabled), "disabled")
        .when(F.col("spoken").isNull(), "unavailable_no_diarization")
        .when(F.coalesce("tracks", F.lit(0)) < 2, "unavailable_no_faces")
        .otherwise("mapped_explicit" if sides else "unavailable_uncertain_map" if speaker_map else "unavailable_unevaluated" if auto_match else "unavailable_no_map")
    )
    none = F.lit(None).cast("map<string,bigint>")
    mapping = F.when(status == "mapped_explicit", entries.cast("map<string,bigint>")) if sides else none
    return j.select("clip_id", status.alias("status"), mapping.alias("mapping"))


#: What a plan's parts have where the job's settings say nothing.
PLAN_DEFAULTS = {
    "audio": {"normalize_loudness": True, "peak_limit_db": -1.5, "duck_music": True, "denoise": False, "audio_fade": False, "fade_duration": 0.5},
    "branding": {"logo": None, "logo_position": "top-right", "music": None, "music_volume": 0.1, "fade": True},
    "export": {"width": 1080, "height": 1920, "codec": "libx264", "preset": "fast", "crf": 23, "audio_bitrate": "128k", "fps": None, "setsar": True},
    "style": dict.fromkeys(["font", "font_size", "primary_color", "highlight_color", "outline_color", "outline_width", "shadow", "margin_v", "margin_v_top", "max_lines"]),
    "versions": {"whisper_model": None, "embed_model": None, "llm_model": None, "face_model": "blaze_face_short_range"},
}
PLAN_VERSION = 2
REVIEW_NOTE = "parts of this clip are framed by work area, centre or a held anchor; check that the subject is in view"
DETAIL_NOTE = "a larger export does not bring back detail that a narrow crop of a small source lost"
LIMITS = ["crop paths are worked out again from the plan's inputs; equal inputs and fingerprint give equal frames"]


def _part(name: str, settings: dict) -> Column:
    """A plan's part of constants: ``name.key`` of the settings over the default."""
    text = lambda v: F.lit(None).cast("string") if v is None else F.lit(v)
    return F.struct(*[text(settings.get(f"{name}.{k}", v)).alias(k) for k, v in PLAN_DEFAULTS[name].items()])


def edit_plan(clips: DataFrame, cues: DataFrame, scenes: DataFrame, rois: DataFrame, settings: dict[str, str], cuts: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """(clip_id, plan, fingerprint): everything a renderer needs of a clip as one struct.

    clips: clip_id, clip_number, layout, ranges [(s, e)], timeline [(s, e, out_s, out_e)], and, where the job has them,
    layout_reason, placement, bounds (x, y, w, h), source_width and source_height; cues: (clip_id, cue_id, start_ms, end_ms, text);
    scenes: (clip_id, scene, kind, cx, cy, needs_review); rois: (clip_id, idx, x, y, w, h), kept as they are; cuts: (clip_id, t), the
    scene cuts; samples: (clip_id, n), faces per sample, for the share with one. settings: flat names; those of a part (``audio.``,
    ``branding.``, ``export.``, ``style.``, ``versions.``) override its defaults, ``framing.full_screen_vertical`` is true unless set. The fingerprint covers
    the layout and all settings but the versions of models, so equal ones give equal renders."""
    per = lambda d, order, *cols, name: d.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias(name))
    parts = [per(cues, "cue_id", "start_ms", "end_ms", "text", name="cues"), per(scenes, "scene", "kind", "cx", "cy", "needs_review", name="scene_crops"), per(rois, "idx", "x", "y", "w", "h", name="manual_rois")]
    if cuts is not None:
        parts.append(per(cuts, "t", name="cuts"))
    j = clips
    for d in parts:
        name = d.columns[1]
        j = j.join(d, "clip_id", "left").withColumn(name, F.coalesce(name, F.array().cast(d.schema[name].dataType)))
    if samples is not None:
        share = samples.groupBy("clip_id").agg(half_up(F.avg((F.coalesce("n", F.lit(0)) > 0).cast("double")), 3).alias("face_fraction"))
        j = j.join(share, "clip_id", "left")
    given = lambda c, kind, default=None: F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in j.columns else F.lit(default).cast(kind)
    bounds, share, reason = given("bounds", "struct<x:bigint,y:bigint,w:bigint,h:bigint>"), given("face_fraction", "double"), given("layout_reason", "string", "")
    length = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    review = F.exists("scene_crops", lambda x: x["needs_review"])
    full = F.lit(str(settings.get("framing.full_screen_vertical", "true")).lower() == "true")
    size = F.concat(given("source_width", "string", "?"), F.lit("x"), given("source_height", "string", "?"))
    export = _part("export", settings)
    plan = F.struct(
        F.lit(PLAN_VERSION).alias("plan_version"), "clip_number", "clip_id", F.col("ranges").alias("source_ranges"), "timeline", length.alias("output_ms"),
        F.struct("cues", given("placement", "string", "bottom").alias("placement"), F.size("cues").alias("cue_count"), _part("style", settings).alias("style")).alias("captions"),
        (F.col("cuts") if cuts is not None else F.array().cast("array<struct<t:bigint>>")).alias("scenes"), "layout", reason.alias("layout_reason"), share.alias("face_fraction"),
        F.struct(
            full.alias("full_screen_vertical"), "layout", reason.alias("layout_reason"), "scene_crops", F.size("scene_crops").alias("scene_count"), "manual_rois", bounds.alias("content_bounds"),
            share.alias("face_fraction"), review.alias("needs_review"), F.when(review, REVIEW_NOTE).otherwise("").alias("review_note"),
        ).alias("framing"),
        _part("audio", settings).alias("audio"), _part("branding", settings).alias("branding"),
        export.withField("upscaled_from", size).withField("detail_note", F.lit(DETAIL_NOTE)).alias("export"), _part("versions", settings).alias("versions"),
        F.array(*map(F.lit, LIMITS)).alias("limits"), F.struct(*[F.lit(v).alias(k) for k, v in sorted(settings.items())]).alias("settings"),
    )
    covered = {k: v for k, v in settings.items() if not k.startswith("versions.")}
    mark = X.fingerprint(*[F.lit(f"{k}={v}") for k, v in sorted(covered.items())], F.col("layout"))
    return j.select("clip_id", plan.withField("config_fingerprint", mark).alias("plan"), mark.alias("fingerprint"))


def review_list(clips: DataFrame, plans: DataFrame, cands: DataFrame) -> DataFrame:
    """clips (clip_id, ...) with ``plan_version`` of their latest plan (clip_id, version) and the totals of their candidates (clip_id, cand_id, total)."""
    v = plans.groupBy("clip_id").agg(F.max("version").alias("plan_version"))
    c = cands.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_id", "total"))), lambda x: x["total"]).alias("candidate_scores"))
    return clips.join(v, "clip_id", "left").join(c, "clip_id", "left").withColumn("candidate_scores", F.coalesce("candidate_scores", F.array().cast("array<double>")))


def only_clips(clips: DataFrame, numbers: list[int] | None) -> DataFrame:
    """The clips to render again: those of the given numbers, or all."""
    return clips if numbers is None else clips.where(F.col("clip_number").isin(numbers))


#: What a reviewer may set a candidate to.
STATUSES = ["selected", "rejected", "proposed", "shortlisted"]


def set_statuses(cands: DataFrame, edits: DataFrame) -> DataFrame:
    """cands (cand_id, status, ...) with the statuses of edits (cand_id, status); ``error`` where one is not known, the old one stays."""
    e = edits.select("cand_id", F.col("status").alias("wanted"))
    j = cands.join(e, "cand_id", "left")
    bad = F.col("wanted").isNotNull() & ~F.col("wanted").isin(STATUSES)
    return j.withColumns({"status": F.when(F.col("wanted").isNull() | bad, F.col("status")).otherwise(F.col("wanted")), "error": F.when(bad, "bad status")}).drop("wanted")


def main_tracks(faces: DataFrame) -> DataFrame:
    """(clip_id, left_track, right_track): the two most frequent tracks by mean place; clips with one track give none."""
    g = faces.where("track_id is not null").groupBy("clip_id", "track_id").agg(F.count("*").alias("n"), F.avg("cx").alias("x"))
    w = Window.partitionBy("clip_id").orderBy(F.desc("n"), "track_id")
    top = g.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    p = top.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("x", "track_id"))).alias("t")).where(F.size("t") == 2)
    return p.select("clip_id", F.col("t")[0]["track_id"].alias("left_track"), F.col("t")[1]["track_id"].alias("right_track"))


def clipped_speech(segs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Parts of speech segments inside ranges (conv_id, range_id, a, b): (conv_id, range_id, seg_id, speaker, s, e)."""
    j = overlap_join(segs.select("conv_id", "seg_id", "speaker", "s", "e"), ranges.select("conv_id", "range_id", "a", "b"), "conv_id", ("s", "e"), ("a", "b"))
    return j.where(overlap(F.col("s"), F.col("e"), F.col("a"), F.col("b")) > 0).select("conv_id", "range_id", "seg_id", "speaker", F.greatest("s", "a").alias("s"), F.least("e", "b").alias("e"))
