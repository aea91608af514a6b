"""Borders to what is outside Spark: models and media tools, with deterministic offline defaults.

Nothing here downloads, transcribes or renders. A job that has such a tool passes a
function over DataFrames; without one the default states that it is not available."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layouts that a user may name.
LAYOUTS = ["auto", "speaker_crop", "stacked_split", "center_crop", "branded_fit"]

Proposer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Status:
    name: str
    available: bool
    reason: str


def backend_status(names: list[str]) -> list[Status]:
    """Model backends by import name; absent ones are reported, never imitated."""
    from importlib.util import find_spec

    return [Status(n, find_spec(n) is not None, "found" if find_spec(n) else "not installed") for n in names]


def classify_continuations(pairs: DataFrame, min_similarity: float = 0.5, max_gap_ms: int = 45_000) -> DataFrame:
    """The offline classifier of related segments (similarity, gap_ms): stitch, standalone or noise; null input is noise."""
    sim, gap = F.coalesce("similarity", F.lit(0.0)), F.coalesce("gap_ms", F.lit(max_gap_ms + 1))
    decision = F.when(sim < min_similarity, "noise").when(gap.between(0, max_gap_ms), "stitch").otherwise("standalone")
    return pairs.withColumn("decision", decision).withColumn("confirmed", decision == "stitch")


#: The campaign of a job without a description.
DEFAULT_CAMPAIGN = {
    "campaign_id": "default", "logo": None, "logo_position": None, "music": None, "music_volume": None, "split_screen": False, "split_screen_source": None,
    "layout": "auto", "subtitles": True, "subtitle_style": "karaoke", "aspect_ratio": "9:16", "template": None, "fade": True, "min_clip_duration": 45,
}


def campaign_columns(text: Column) -> dict[str, Column]:
    """Keyword rules for a campaign text: logo, split screen, subtitles, template (the last rule that fits), layout.

    Only the layout's words are looked for in any letter case."""
    told = F.coalesce(text, F.lit(""))
    low = F.lower(told)
    has = lambda c, *words: reduce(Column.__or__, [c.contains(w) for w in words])
    # fixed values: the words and the names they stand for
    template = F.when(has(told, "reaction"), "tiktok_reaction").when(has(told, "motivational"), "motivational_reel").when(has(told, "podcast"), "podcast_clip")
    layout = (
        F.when(has(low, "stacked", "split-screen", "split screen"), "stacked_split")
        .when(has(low, "speaker crop", "face-track", "face track"), "speaker_crop")
        .when(has(low, "branded", "full frame"), "branded_fit")
        .otherwise("auto")
    )
    split = has(told, "split screen")
    return {
        "logo": F.when(has(told, "logo"), "assets/logos/logo.png"), "split_screen": split, "subtitles": ~has(told, "no subtitles"), "template": template,
        "layout": campaign_layout(layout, split, F.lit(False)),
    }


def campaign_layout(layout: Column, split_screen: Column, explicit: Column) -> Column:
    """A campaign's layout, checked: unknown ones are auto; a split screen without a layout of its own is stacked."""
    v = F.lower(F.trim(F.coalesce(layout, F.lit("auto"))))
    v = F.when(v.isin(LAYOUTS), v).otherwise("auto")
    return F.when(F.coalesce(split_screen, F.lit(False)) & ~F.coalesce(explicit, F.lit(False)) & (v == "auto"), "stacked_split").otherwise(v)


def with_default_campaign(jobs: DataFrame) -> DataFrame:
    """jobs (campaign_id, ...) with the default campaign's values where a field is null or lacks."""
    kinds = {"music_volume": "double", "min_clip_duration": "int"}
    value = lambda k, v: F.lit(v) if v is not None else F.lit(None).cast(kinds.get(k, "string"))
    return jobs.withColumns({k: F.coalesce(F.col(k), value(k, v)) if k in jobs.columns else value(k, v) for k, v in DEFAULT_CAMPAIGN.items()})


def overlay(template: dict, campaign: DataFrame) -> DataFrame:
    """campaign with nulls filled from the template."""
    return campaign.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in campaign.columns else F.lit(v) for k, v in template.items()})


def boundary_verdicts(replies: DataFrame) -> DataFrame:
    """(video_id, clip_id, start_id, end_id, complete, reason) of a validator's replies (video_id, clip_id, reply).

    The reply is one JSON object, fenced or behind a think block; replies without readable ids give no row."""
    bare = F.regexp_replace(F.regexp_replace("reply", r"(?s)<think>.*?</think>", ""), "```(json)?", "")
    data = F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), "struct<start_id:bigint,end_id:bigint,complete:boolean,reason:string>")
    v = replies.select("video_id", "clip_id", data.alias("d")).where("d.start_id is not null and d.end_id is not null")
    return v.select("video_id", "clip_id", "d.start_id", "d.end_id", F.coalesce("d.complete", F.lit(True)).alias("complete"), F.substring(F.coalesce("d.reason", F.lit("")), 1, 300).alias("reason"))


def render_manifest(ranges: DataFrame) -> DataFrame:
    """What a renderer has to do: one row per clip with its cuts in order and its output length."""
    cuts = F.array_sort(F.collect_list(F.struct("s", "e")))
    return ranges.groupBy("clip_id").agg(cuts.alias("cuts"), F.sum(F.col("e") - F.col("s")).alias("output_ms"))
