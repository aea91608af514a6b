"""Caption cues, subtitle lines, glossary display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.config import Captions
from cuewright.functions import text as X
from cuewright.names import spare

from . import glossary


def cues(words: DataFrame, cfg: Captions = Captions(), run_key: str = "run", keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Cues of words, of timelines named by ``keys``: ``run``, ``cue`` (0.. inside the run) and ``items``, the cue's words in order.

    Closing punctuation always ends a cue, so a run between punctuation marks is folded on
    its own: a cue closes at max_words words, max_chars letters, max_ms, or at a comma once it
    has three words and six tenths of the time. Letters are those shown: ``display`` where
    words have one. The fold is an aggregate over the run's array and carries four numbers
    and the cues' last places; the array is then cut there, so words are not grouped again."""
    if "display" not in words.columns:
        words = words.withColumn("display", F.col("word"))
    words = words.withColumn("display", X.shown(F.col("display"), F.col("word")))
    video = Window.partitionBy(*keys).orderBy("pos")
    ends = X.ends_sentence(F.col("word"))
    w = words.withColumn(run_key, F.coalesce(F.sum(ends.cast("int")).over(video.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = (F.length("display") + 1).cast("long").alias("size")
    items = F.sort_array(F.collect_list(F.struct("pos", "word", "display", "start_ms", "end_ms", size, F.endswith("word", F.lit(",")).alias("comma"))))
    g = w.groupBy(*keys, run_key).agg(items.alias("items"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "chars", "from")], F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(s, x):
        n, chars, at = s["n"] + 1, s["chars"] + x["size"], s["at"] + 1
        since = F.when(s["n"] == 0, x["start_ms"]).otherwise(s["from"])
        dur = x["end_ms"] - since
        full = (n >= cfg.max_words) | (chars >= cfg.max_chars) | (dur >= cfg.max_ms) | ((n >= 3) & (dur * 10 >= cfg.max_ms * 6) & x["comma"])
        state = lambda n, chars, ends: F.struct(n.alias("n"), chars.alias("chars"), since.alias("from"), at.alias("at"), ends.alias("ends"))
        none = F.lit(0).cast("long")
        return F.when(full, state(none, none, F.concat(s["ends"], F.array(at)))).otherwise(state(n, chars, s["ends"]))

    ends = F.aggregate("items", zero, step, lambda s: F.array_distinct(F.concat(s["ends"], F.array(s["at"]))))  # the last cue ends with the run
    g = g.withColumn("ends", ends)

    def cut(end, i):
        begin = F.coalesce(F.get("ends", i - 1), F.lit(0))
        return F.struct(i.cast("long").alias("cue"), F.slice("items", begin + 1, end - begin).alias("items"))

    return g.select(*keys, run_key, F.inline(F.transform("ends", cut)))


def cue_of_word(words: DataFrame, cfg: Captions = Captions(), run_key: str = "run", keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """words with ``run`` and ``cue`` of ``cues``."""
    g = cues(words, cfg, run_key, keys).select(*keys, run_key, "cue", F.explode("items").alias("w"))
    return g.select(*keys, run_key, "w.pos", "w.word", "w.display", "w.start_ms", "w.end_ms", "cue")


def with_items(cue_words: DataFrame) -> DataFrame:
    """Words with video_id, run and cue as rows of ``cues``, which are left as they are."""
    if "items" in cue_words.columns:
        return cue_words
    item = F.struct("pos", *[c for c in cue_words.columns if c not in ("video_id", "run", "cue", "pos")])
    return cue_words.groupBy("video_id", "run", "cue").agg(F.sort_array(F.collect_list(item)).alias("items"))


def caption_cues(words: DataFrame, cfg: Captions = Captions(), keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """One row per cue, numbered per video (per ``keys``): times, number of words, text."""
    of = lambda c: F.transform("items", lambda x: x[c])
    g = cues(words, cfg, keys=keys).select(
        *keys, F.array_min(of("start_ms")).alias("start_ms"), F.array_max(of("end_ms")).alias("end_ms"), F.size("items").cast("long").alias("n_words"),
        F.get("items", 0)["pos"].alias("first_word"), F.array_join(of("display"), " ").alias("text"),
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first_word")).cast("long")
    return g.withColumn("cue_id", number).select(*keys, "cue_id", "start_ms", "end_ms", "n_words", "text")


def on_output_time(words: DataFrame, ranges: DataFrame, slack_ms: int = 500) -> DataFrame:
    """Words of clips on their output time; words outside the ranges, but for ``slack_ms`` over an end, are left out.

    ranges: (clip_id, video_id, s, e); a clip is of one video. A word maps by the first range that holds it.
    The ranges of each minute are one row that is put among the minute's words and carried along, so words that are
    dealt by video stay where they are. Returns clip_id, video_id and the words' columns with the new times."""
    w = Window.partitionBy("video_id", "clip_id").orderBy("s", "e")
    r = ranges.select("clip_id", "video_id", "s", "e")
    r = r.withColumn("out", F.coalesce(F.sum(F.col("e") - F.col("s")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("k", F.row_number().over(w))
    r = r.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / 60_000), F.floor((F.col("e") + slack_ms) / 60_000))))
    r = r.groupBy("video_id", "cell").agg(F.array_sort(F.collect_list(F.struct("clip_id", "k", "s", "e", "out"))).alias("near"))
    rest = [c for c in words.columns if c not in ("video_id", "pos", "start_ms", "end_ms")]
    word = F.struct("pos", "start_ms", "end_ms", *rest)
    u = words.select("video_id", F.floor(F.col("start_ms") / 60_000).alias("cell"), word.alias("w")).unionByName(r, allowMissingColumns=True)
    held = Window.partitionBy("video_id", "cell").orderBy(F.col("w").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("near", F.first("near", ignorenulls=True).over(held)).where("w is not null and near is not null")
    inside = F.filter("near", lambda x: (F.col("w.start_ms") >= x["s"]) & (F.col("w.end_ms") <= x["e"] + slack_ms))
    first = F.filter(inside, lambda x, i: (i == 0) | ~x["clip_id"].eqNullSafe(F.get(inside, i - 1)["clip_id"]))  # by clip, then k
    m = u.select("video_id", "w", F.explode(first).alias("r"))
    moved = lambda c: (F.col(f"w.{c}") - F.col("r.s") + F.col("r.out")).alias(c)
    return m.select("r.clip_id", "video_id", "w.pos", moved("start_ms"), moved("end_ms"), *[F.col(f"w.{c}").alias(c) for c in rest])


def srt_lines(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """Words inside a clip's ranges (up to half a second over the end), on the clip's output time.

    ranges: (clip_id, video_id, s, e), disjoint. Returns clip_id, n (from 1, in source order), start_ms, end_ms, line."""
    m = on_output_time(words, ranges)
    n = F.row_number().over(Window.partitionBy("video_id", "clip_id").orderBy("pos")).cast("long")
    line = F.concat(X.srt_time(F.col("start_ms")), F.lit(" --> "), X.srt_time(F.col("end_ms")), F.lit(" "), F.col("word"))
    return m.withColumn("n", n).select("clip_id", "n", "start_ms", "end_ms", line.alias("line"))


def burn_passes(lines: DataFrame, size: int = 80) -> DataFrame:
    """lines (clip_id, n from 1) with the pass of the renderer that burns them, ``size`` in each."""
    return lines.withColumn("burn_pass", F.floor((F.col("n") - 1) / size).cast("long"))


def clip_cues(words: DataFrame, ranges: DataFrame, cfg: Captions = Captions()) -> DataFrame:
    """Caption cues of clips: words on output time, shown by their ``display`` where there is one."""
    return caption_cues(on_output_time(words, ranges), cfg, ("video_id", "clip_id")).drop("video_id")


def placement(tracks: DataFrame, height: int = 720, forced: str = "auto") -> DataFrame:
    """(clip_id, placement) of face rows (clip_id, cy): top when at least three faces stand low, by their upper median."""
    g = tracks.where("cy is not null").groupBy("clip_id").agg(F.array_sort(F.collect_list("cy")).alias("ys"))
    low = (F.size("ys") >= 3) & (F.get("ys", F.floor(F.size("ys") / 2).cast("int")) > height * 0.6)
    at = F.lit(forced.lower()) if forced.lower() in ("top", "bottom") else F.when(low, "top").otherwise("bottom")
    clips = tracks.select("clip_id").distinct()
    return clips.join(g, "clip_id", "left").select("clip_id", F.coalesce(at, F.lit("bottom")).alias("placement"))


def srt_files(lines: DataFrame) -> DataFrame:
    """(clip_id, srt): the whole subtitle text of each clip."""
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), F.regexp_replace("line", r"^(\S+ --> \S+) ", "$1\n"), F.lit("\n"))
    g = lines.select("clip_id", "n", block.alias("block")).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"))
    return g.select("clip_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("srt"))


#: Glossaries of up to this many entries run as windows, larger ones as an automaton.
FEW = 8
#: Characters of entries that are sent to the tasks at once; a larger glossary takes several passes.
SENT = 16_000_000


def cleaned(entries: list[tuple[str, str]]) -> list[tuple[tuple[str, ...], str]]:
    """Entries as lower-cased words and replacement; those that are empty or change nothing are skipped."""
    pairs = [(m.strip(), r.strip()) for m, r in entries]
    return [(tuple(m.lower().split()), r) for m, r in pairs if m.split() and r and m != r]


def glossary_display(words: DataFrame, entries: list[tuple[str, str]], few: int = FEW, sent: int = SENT) -> DataFrame:
    """words with ``display``: entries (match, replacement) over consecutive words, ignoring case.

    Matches of one entry do not overlap, left to right; later entries overwrite. The
    replacement stands at the first word, the others are shown empty. Entries that are
    empty or change nothing are skipped. Of matches of one entry that overlap each other a
    scan from the left takes the first, then the first that does not overlap it.

    A few entries are windows over each video. More are one automaton over words that every task
    builds from the broadcast entries and runs once over the sorted words of its videos; entries
    beyond ``sent`` characters go in several such passes, in order."""
    found = cleaned(entries)
    out = words.withColumn("display", F.col("word"))
    if len(found) <= few:
        for parts, replacement in found:
            out = _windowed(out, parts, replacement)
        return out
    at = 0
    while at < len(found):
        size, end = 0, at
        while end < len(found) and (end == at or size < sent):
            size += sum(map(len, found[end][0])) + len(found[end][1])
            end += 1
        out = glossary.apply(out, found[at:end])
        at = end
    return out


def _windowed(out: DataFrame, parts: tuple[str, ...], replacement: str) -> DataFrame:
    video, (hit_, cover_) = Window.partitionBy("video_id").orderBy("pos"), spare(["hit", "cover"], out)
    hit = F.lit(True)
    for i, p in enumerate(parts):
        hit = hit & F.coalesce(F.lower(F.lead("word", i).over(video) if i else F.col("word")) == p, F.lit(False))
    m = len(parts)
    out = out.withColumn(hit_, hit)
    if m > 1 and any(parts[i:] == parts[: m - i] for i in range(1, m)):  # only such entries can overlap themselves
        out = _spaced(out, m, hit_)
    cover = F.lit(False)
    for i in range(1, m):
        cover = cover | F.coalesce(F.lag(hit_, i).over(video), F.lit(False))
    out = out.withColumn(cover_, cover)
    return out.withColumn("display", F.when(F.col(hit_), replacement).when(F.col(cover_), "").otherwise(F.col("display"))).drop(hit_, cover_)


def _spaced(words: DataFrame, m: int, hit: str) -> DataFrame:
    """Keep the hits that a left-to-right scan takes: a fold over each video's hit places."""
    taken_, place_ = spare(["taken", "place"], words)
    words = words.withColumn(place_, F.row_number().over(Window.partitionBy("video_id").orderBy("pos")).cast("long"))  # places may have gaps
    hits = words.where(hit).groupBy("video_id").agg(F.array_sort(F.collect_list(place_)).alias("at"))
    kept = F.aggregate("at", F.array().cast("array<bigint>"), lambda s, x: F.when((F.size(s) == 0) | (x - F.try_element_at(s, F.lit(-1)) >= m), F.concat(s, F.array(x))).otherwise(s))
    taken = hits.select("video_id", F.explode(kept).alias(place_), F.lit(True).alias(taken_))
    return words.join(taken, ["video_id", place_], "left").withColumn(hit, F.coalesce(taken_, F.lit(False))).drop(taken_, place_)
