"""String and time column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of sentence ends and of sentences that are filler only.
SENTENCE_END = "[.!?…]+$"
FILLER_ONLY = r"(?i)^(so|and|well|you know|um|uh|like)[,.\s]*$"


def split_words(text: Column) -> Column:
    """Non-empty white-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def ends_sentence(word: Column) -> Column:
    """Punctuation or an ellipsis at the end."""
    return word.rlike(SENTENCE_END)


def ends_chunk(word: Column) -> Column:
    """A plain full stop, exclamation or question mark at the end (no ellipsis character)."""
    return F.coalesce(F.right(F.trim(word), F.lit(1)).isin(".", "!", "?"), F.lit(False))


def first_word(text: Column) -> Column:
    """The first word in lower case without surrounding punctuation; empty if there is none."""
    return F.coalesce(F.lower(F.trim(F.get(split_words(text), 0), F.lit(" ,.!?\"'"))), F.lit(""))


def clock(ms: Column) -> Column:
    """HH:MM:SS, truncated."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm."""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc, not below zero."""
    cs = F.greatest(F.floor(ms / 10), F.lit(0))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def parse_clock(text: Column) -> Column:
    """Seconds of MM:SS, HH:MM:SS(.f) or a plain number; null if unreadable."""
    parts = F.split(F.trim(text), ":")
    n = F.size(parts)

    def part(i: int) -> Column:
        return F.get(parts, i).try_cast("double")

    return F.when(n == 1, part(0)).when(n == 2, part(0) * 60 + part(1)).when(n == 3, part(0) * 3600 + part(1) * 60 + part(2))


def parse_srt_time(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm."""
    p = F.split(F.regexp_replace(F.trim(text), ",", ":"), ":")
    return (F.get(p, 0).try_cast("long") * 3600 + F.get(p, 1).try_cast("long") * 60 + F.get(p, 2).try_cast("long")) * 1000 + F.get(p, 3).try_cast("long")


def ass_escape(text: Column) -> Column:
    return F.translate(text, "\\{}", "￣()")


def drawtext_escape(text: Column) -> Column:
    for c in ("\\", "'", ":", "%", ","):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def shown(display: Column, word: Column) -> Column:
    """The display text if there is one, the empty one too, else the word."""
    return F.coalesce(display, word)


#: How many characters of a field are kept.
CAPS = {"title": 80, "merged_hook": 120, "idea": 200, "hook": 300, "enriched": 400, "refine_reason": 500, "text": 600}


def capped(text: Column, field: str) -> Column:
    return F.substring(text, 1, CAPS[field])


def model_json(reply: Column) -> Column:
    """The JSON list in a model's reply: think blocks off, the first fenced part that starts a list or object,
    the outermost list, else an object wrapped in one, else a list inside the think block; null if there is none."""
    bare = F.trim(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))

    def fenced(x: Column) -> Column:
        parts = F.transform(F.split(x, "```"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"^json", ""), F.lit(" \n\r\t")))
        first = F.get(F.filter(parts, lambda p: p.startswith("[") | p.startswith("{")), 0)
        return F.when(F.contains(x, F.lit("```")), F.coalesce(first, x)).otherwise(x)

    def inside(x: Column, pattern: str) -> Column:
        got = F.regexp_extract(x, pattern, 1)
        return F.when(got != "", got)

    body = fenced(bare)
    thought = fenced(F.regexp_extract(reply, r"(?s)<think>(.*?)</think>", 1))
    wrapped = F.concat(F.lit("["), inside(body, r"(?s)(\{.*\})"), F.lit("]"))
    return F.coalesce(inside(body, r"(?s)(\[.*\])"), wrapped, inside(thought, r"(?s).*(\[.*\])"))


def content_signature(text: Column) -> Column:
    """A stable id of a transcript: size and digest of its content (times of files say nothing)."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))


def ranges_key(video: Column, ranges: Column) -> Column:
    """``video:a-b,a-b`` with seconds to one digit, of ranges (s, e) in milliseconds."""
    second = lambda ms: F.format_string("%.1f", half_up_tenth(ms))
    return F.concat(video.cast("string"), F.lit(":"), F.array_join(F.transform(ranges, lambda r: F.concat(second(r["s"]), F.lit("-"), second(r["e"]))), ","))


def half_up_tenth(ms: Column) -> Column:
    return F.floor(ms / 100.0 + 0.5) / 10.0


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def keywords(campaign: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"[a-z]{3,}", campaign.lower())))


def hashtags(text: Column) -> Column:
    return split_words(text)


def source_type(s: Column) -> Column:
    """Where an input string points: the first rule that fits."""
    file = F.lower(s).rlike(r"\.(mp4|mov|webm|mkv)$")
    return (
        F.when(s.contains("youtube.com") | s.contains("youtu.be"), F.when(s.contains("live"), "youtube_live").otherwise("youtube"))
        .when(s.contains("drive.google.com"), "google_drive")
        .when(file & (s.startswith("/") | s.startswith("./")), "local_file")
        .when(file, "direct_url")
        .otherwise("unknown")
    )


def hex_to_bgr(colour: Column, default: str = "FFFFFF") -> Column:
    """#RGB or #RRGGBB as BBGGRR in upper case; the default if unreadable."""
    c = F.upper(F.regexp_replace(F.trim(colour), "^#", ""))
    c = F.when(c.rlike("^[0-9A-F]{3}$"), F.regexp_replace(c, "(.)", "$1$1")).when(c.rlike("^[0-9A-F]{6}$"), c).otherwise(default)
    return F.concat(F.substring(c, 5, 2), F.substring(c, 3, 2), F.substring(c, 1, 2))


def fingerprint(*fields: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of the fields in a fixed order; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256), 1, 16)
