"""Clip candidates: validation of proposed sentence spans, editorial scores, ordered greedy selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.config import Fusion
from cuewright.functions import text as X
from cuewright.functions.numeric import clamp, half_up, overlap
from cuewright.storage import written

from . import similarity
from .intervals import overlap_join

#: Openers that weaken a hook, pronouns that lean on earlier talk.
FILLER_OPENERS = ["so", "and", "well", "you know", "um", "uh", "like", "okay", "right", "now"]
PRONOUN_OPENERS = ["it", "this", "that", "these", "those", "they", "them", "he", "she", "his", "her", "its", "there"]


#: Sentences that travel together when proposals look theirs up.
BLOCK = 64


@dataclass(frozen=True)
class Proposer:
    """Where clips may begin and end, in milliseconds, and what speaks for a beginning."""

    least_ms: int = 20_000
    most_ms: int = 90_000
    pause_ms: int = 700
    question: float = 1.0
    after_pause: float = 0.6
    loud: float = 0.8
    long_enough: float = 0.3
    leaning: float = 1.2  # off for an opener that leans on earlier talk
    least_score: float = 0.6


def propose(sents: DataFrame, events: DataFrame | None = None, p: Proposer = Proposer()) -> DataFrame:
    """(video_id, proposal_id, start_id, end_id, hook, score, why) by cues in the text: the offline proposer.

    sents: video_id, id, start_ms, end_ms, text, ends_with_punctuation; events: (video_id, peak_ms), rises in
    energy. A sentence may open a clip for a question, a pause before it, a rise in energy in its time, and enough
    words; fillers and pronouns at its start speak against it. The clip ends at the first whole sentence
    after least_ms that a pause follows, else at the last whole sentence within most_ms; openings without
    such an end, or under least_score, are not proposed. Sentences of one video only are looked at, over a window of most_ms."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "id")
    before, after = F.col("start_ms") - F.lag("end_ms").over(w), F.lead("start_ms").over(w) - F.col("end_ms")
    s = sents.select("video_id", "id", "start_ms", "end_ms", "text", F.coalesce("ends_with_punctuation", F.lit(False)).alias("whole"))
    s = s.withColumns({"before": before, "after": after})
    if events is None:
        s = s.withColumn("loud", F.lit(False))
    else:
        peaks = events.select("video_id", F.col("peak_ms").alias("p0"), F.col("peak_ms").alias("p1"))
        hit = overlap_join(s.select("video_id", "id", "start_ms", "end_ms"), peaks, "video_id", ("start_ms", "end_ms"), ("p0", "p1")).select("video_id", "id").distinct()
        s = s.join(hit.withColumn("loud", F.lit(True)), ["video_id", "id"], "left").withColumn("loud", F.coalesce("loud", F.lit(False)))
    ahead = Window.partitionBy("video_id").orderBy("start_ms").rangeBetween(0, p.most_ms)
    s = s.withColumn("ahead", F.collect_list(F.struct("end_ms", "id", "whole", (F.coalesce("after", F.lit(p.pause_ms)) >= p.pause_ms).alias("rests"))).over(ahead))
    fits = F.filter("ahead", lambda x: x["whole"] & (x["end_ms"] - F.col("start_ms") >= p.least_ms) & (x["end_ms"] - F.col("start_ms") <= p.most_ms) & (x["id"] >= F.col("id")))
    rests = F.array_min(F.filter(fits, lambda x: x["rests"]))
    end = F.coalesce(rests, F.array_max(fits))["id"]
    first, words = X.first_word(F.col("text")), F.size(X.split_words(F.col("text")))
    cues = {
        "question": (F.rtrim("text").endswith("?"), p.question), "pause": (F.coalesce(F.col("before") >= p.pause_ms, F.lit(True)), p.after_pause),
        "energy": (F.col("loud"), p.loud), "length": (words.between(3, 25), p.long_enough), "leans": (first.isin(FILLER_OPENERS + PRONOUN_OPENERS), -p.leaning),
    }
    score = sum((F.when(c, v).otherwise(0.0) for c, v in cues.values()), F.lit(0.0))
    why = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, (c, v) in cues.items() if v > 0])), ", ")
    hook = X.capped(F.array_join(F.slice(X.split_words(F.col("text")), 1, 20), " "), "hook")
    out = s.select("video_id", F.col("id").alias("proposal_id"), F.col("id").alias("start_id"), end.alias("end_id"), hook.alias("hook"), half_up(score, 3).alias("score"), why.alias("why"))
    return out.where(F.col("end_id").isNotNull() & (F.col("score") >= p.least_score))


def validate(props: DataFrame, sents: DataFrame, min_ms: int = 15_000, max_ms: int = 90_000, max_sentences: int = 120, join_gap_ms: int = 60_000) -> DataFrame:
    """Proposals with their known sentences' span and the first rule they break (null: accepted). Reversed ids are swapped.

    Proposals may name further sentences in ``join_ids`` (an array; those unknown or inside the
    span are ignored): at least one must be left, and they must start or end within
    join_gap_ms of the span. ``sentence_ids`` are all known ids, joined ones last."""
    if "join_ids" not in props.columns:
        props = props.withColumn("join_ids", F.lit(None).cast("array<bigint>"))
    p = props.select("video_id", "proposal_id", F.least("start_id", "end_id").alias("lo"), F.greatest("start_id", "end_id").alias("hi"), "join_ids")
    # sentences travel in blocks of ids, so a proposal meets one or two rows; ids beyond the video's own are unknown
    ends = sents.groupBy("video_id").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    known = p.where("lo is not null and hi is not null").join(ends, "video_id")
    block = lambda i: F.floor(i / BLOCK)
    none = F.array().cast("array<bigint>")
    span = F.when((F.col("lo") <= F.col("most")) & (F.col("hi") >= F.col("least")), F.sequence(block(F.greatest("lo", "least")), block(F.least("hi", "most"))))
    further = F.filter(F.array_distinct(F.coalesce("join_ids", none)), lambda i: i.isNotNull() & ~i.between(F.col("lo"), F.col("hi")))
    asked = known.withColumn("further", further).select("video_id", "proposal_id", "lo", "hi", "further", F.explode(F.array_distinct(F.concat(F.coalesce(span, none), F.transform("further", block)))).alias("block"))
    s = sents.groupBy("video_id", block(F.col("id")).alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "start_ms", "end_ms", "text"))).alias("near"))
    met = asked.join(s, ["video_id", "block"]).select(
        "video_id", "proposal_id", F.filter("near", lambda x: x["id"].between(F.col("lo"), F.col("hi"))).alias("own"), F.filter("near", lambda x: F.array_contains("further", x["id"])).alias("more")
    )
    of = lambda c, f: F.transform(c, lambda x: x[f])
    met = met.where((F.size("own") > 0) | (F.size("more") > 0)).select(
        "video_id", "proposal_id", F.size("own").alias("n"), F.array_min(of("own", "start_ms")).alias("s"), F.array_max(of("own", "end_ms")).alias("e"), F.get("own", 0)["id"].alias("first"), F.get("own", 0)["text"].alias("text"),
        F.size("more").alias("m"), F.array_min(of("more", "start_ms")).alias("js"), F.array_max(of("more", "end_ms")).alias("je"), of("own", "id").alias("own_ids"), of("more", "id").alias("more_ids"),
    )
    every = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    g = met.groupBy("video_id", "proposal_id").agg(
        F.sum("n").alias("n_sentences"), F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("text", "first").alias("first_text"),
        F.sum("m").alias("n_joins"), F.min("js").alias("join_s"), F.max("je").alias("join_e"), F.concat(every("own_ids"), every("more_ids")).alias("ids"),
    )
    out = p.join(g, ["video_id", "proposal_id"], "left")
    length = F.col("e") - F.col("s")
    joins = F.size("join_ids") > 0
    away = F.least(F.abs(F.col("join_s") - F.col("e")), F.abs(F.col("s") - F.col("join_e")))
    reason = (
        F.when(F.col("lo").isNull() | F.col("hi").isNull(), "missing ids")
        .when(F.coalesce("n_sentences", F.lit(0)) == 0, "no known sentences")
        .when(F.col("n_sentences") > max_sentences, "too many sentences")
        .when(joins & (F.col("n_joins") == 0), "unknown joins")
        .when(joins & (away > join_gap_ms), "joins too far")
        .when(length <= 0, "degenerate")
        .when(length < min_ms, "too short")
        .when(length > max_ms, "too long")
    )
    return out.select(
        "video_id", "proposal_id", "lo", "hi", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), "s", "e", "first_text", reason.alias("reject_reason"),
        F.coalesce("n_joins", F.lit(0)).alias("n_joins"), "join_s", "join_e", F.col("ids").alias("sentence_ids"),
    )


def first_accepted(valid: DataFrame, most: int = 24) -> DataFrame:
    """At most ``most`` accepted proposals of each video, in their order."""
    w = Window.partitionBy("video_id").orderBy("proposal_id")
    return valid.where("reject_reason is null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def scores(cands: DataFrame, campaign: str = "", cfg: Fusion = Fusion()) -> DataFrame:
    """cands with the seven component scores and their weighted total.

    Relevance looks for the campaign's keywords in hook and main idea; a rise in energy
    makes a clip easier to edit and is the best audio support. Both columns may lack."""
    idea = F.col("main_idea") if "main_idea" in cands.columns else F.lit("")
    loud = F.coalesce(F.col("energy_increase"), F.lit(0.0)) != 0 if "energy_increase" in cands.columns else F.lit(False)
    hook, first = F.trim("hook"), X.first_word(F.col("hook"))
    n = F.size(X.split_words(F.col("hook")))
    opening = F.when(hook == "", 0.3).otherwise(
        clamp(F.lit(0.6) - F.when(first.isin(FILLER_OPENERS), 0.35).otherwise(0.0) + F.when(hook.rlike("[?!]$"), 0.15).otherwise(0.0) + F.when(n.between(3, 20), 0.1).otherwise(0.0))
    )
    alone = clamp(F.when(F.trim("required_context") != "", 0.3).otherwise(0.8) - F.when((hook != "") & first.isin(PRONOUN_OPENERS), 0.3).otherwise(0.0))
    has_payoff = F.trim("payoff") != ""
    complete = clamp(1.0 - 0.6 * clamp(F.col("uncertainty")) - F.when(has_payoff, 0.0).otherwise(0.2))
    span = (F.col("e") - F.col("s")) / 1000.0
    edit = F.when(span < 20, F.greatest(F.lit(0.2), span / 20)).when(span <= 90, 1.0).otherwise(F.greatest(F.lit(0.2), 1.0 - (span - 90) / 120))
    edit = F.when(loud, F.least(F.lit(1.0), edit + 0.1)).otherwise(edit)
    words = X.keywords(campaign)
    told = F.lower(F.concat_ws(" ", F.coalesce("hook", F.lit("")), F.coalesce(idea, F.lit(""))))
    hits = sum((F.contains(told, F.lit(w)).cast("int") for w in words), F.lit(0))
    relevance = F.least(F.lit(1.0), hits / float(max(1, min(len(words), 6)))) if words else F.lit(0.5)
    parts = {
        "opening": half_up(opening, 3), "standalone": half_up(alone, 3), "payoff_score": F.when(has_payoff, 1.0).otherwise(0.4),
        "completeness": half_up(complete, 3), "relevance": half_up(relevance, 3), "editability": half_up(edit, 3),
        "audio_support": F.when(loud, 0.8).when(F.col("source") == "audio_event", 0.7).otherwise(0.3),
    }
    out = cands.withColumns(parts)
    total = sum((F.col(k) * cfg.weights["payoff" if k == "payoff_score" else k] for k in parts), F.lit(0.0))
    return out.withColumn("total", half_up(total, 4))


def pair_table(c: DataFrame) -> DataFrame:
    """Overlapping pairs of one video's candidates, earlier rank first: (video_id, rk, e_rk, inter, len_a, len_b).

    Only ranks and times are dealt to the buckets of the overlap join."""
    a = c.select("video_id", "rk", F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = c.select("video_id", F.col("rk").alias("e_rk"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    p = overlap_join(a, b, "video_id", ("s1", "e1"), ("s2", "e2"))
    inter = overlap(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    p = p.where(F.col("e_rk") < F.col("rk")).select("video_id", "rk", "e_rk", inter.alias("inter"), (F.col("e1") - F.col("s1")).alias("len_a"), (F.col("e2") - F.col("s2")).alias("len_b"))
    return p.where("inter > 0")


def union() -> Column:
    return F.col("len_a") + F.col("len_b") - F.col("inter")


def iou_at_least(share: float) -> Column:
    """Of pair_table's rows, in whole numbers."""
    return F.col("inter") * 10 >= union() * round(share * 10)


def alike(pairs: DataFrame, r: DataFrame, cfg: Fusion) -> DataFrame:
    """Of pairs (video_id, rk, e_rk) of r's rows those with nearly the same content.

    Where both rows have an ``embedding``, by cosine, from the exact similarity join; else by
    the Jaccard similarity of their ``words``."""
    keys = ["video_id", "rk", "e_rk"]
    held = "embedding" in r.columns
    told = lambda n, w: r.select("video_id", F.col("rk").alias(n), F.col("words").alias(w), *([F.col("embedding").isNotNull().alias(f"has_{w}")] if held else []))
    both = pairs.select(*keys).join(told("rk", "wa"), ["video_id", "rk"]).join(told("e_rk", "wb"), ["video_id", "e_rk"])
    same = X.jaccard(F.col("wa"), F.col("wb")) >= cfg.near_similarity
    if not held:
        return both.where(same).select(*keys)
    vectors = F.col("has_wa") & F.col("has_wb")
    near = similarity.cosine_pairs(r.where("embedding is not null").select("video_id", "rk", "embedding"), "video_id", "rk", "embedding", cfg.near_similarity)
    by_vector = both.where(vectors).select(*keys).join(near.select("video_id", F.col("id_a").alias("e_rk"), F.col("id_b").alias("rk")), keys, "left_semi")
    return by_vector.unionByName(both.where(~vectors & same).select(*keys))


def near_duplicates(pairs: DataFrame, r: DataFrame, cfg: Fusion, more: Column | None = None) -> DataFrame:
    """(video_id, rk, e_rk): pairs of high overlap (or that satisfy ``more``), and those of some overlap with nearly the same content."""
    keys = ["video_id", "rk", "e_rk"]
    high = iou_at_least(cfg.diversity_iou) if more is None else iou_at_least(cfg.diversity_iou) | more
    some = pairs.where(~high & iou_at_least(cfg.near_iou))
    return pairs.where(high).select(*keys).unionByName(alike(some, r, cfg))


def greedy(r: DataFrame, clashes: DataFrame, most: int | None = None) -> DataFrame:
    """Keep rows in rank order unless they clash with one kept before; at most ``most``.

    r: (video_id, rk, ...), with a true ``low`` for rows that are never kept; clashes: (video_id, rk,
    e_rk), a row and an earlier one that bars it. The fold over a video carries ranks alone, for each row
    the earlier ranks it clashes with; all other columns join its result by rank. Adds
    ``kept`` and ``winner`` (the rank of the first kept row it clashes with)."""
    barred = F.col("low") if "low" in r.columns else F.lit(False)
    earlier = clashes.groupBy("video_id", "rk").agg(F.array_sort(F.collect_list("e_rk")).alias("es"))
    rows = r.select("video_id", "rk", barred.alias("low")).join(earlier, ["video_id", "rk"], "left")
    x = F.struct("rk", F.coalesce("es", F.array().cast("array<int>")).alias("es"), "low")
    g = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(x), lambda p, q: p["rk"] - q["rk"]).alias("xs"))
    room = (lambda k: F.size(k) < most) if most else (lambda k: F.lit(True))
    kept = F.aggregate("xs", F.array().cast("array<int>"), lambda k, z: F.when(room(k) & ~z["low"] & ~F.arrays_overlap(k, z["es"]), F.concat(k, F.array(z["rk"]))).otherwise(k))
    out = g.withColumn("ks", kept).select("video_id", "ks", F.inline("xs"))
    own = F.array_contains("ks", F.col("rk"))
    winner = F.array_min(F.array_intersect("es", "ks"))
    return r.join(out.select("video_id", "rk", own.alias("kept"), F.when(~own, winner).alias("winner")), ["video_id", "rk"])


def with_words(c: DataFrame) -> DataFrame:
    return c.withColumn("words", F.array_distinct(X.split_words(F.lower("hook"))))


def ranked(c: DataFrame, *order: Column) -> DataFrame:
    return c.withColumn("rk", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)))


def merge_overlaps(c: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """Candidates in order of uncertainty; one that overlaps a kept one by merge_iou or more is merged into the first such.

    ``winner_id`` is where it went; the winner's ``sentence_ids`` (where candidates have
    them) are the sorted union, its span does not grow."""
    r = written(ranked(c, F.asc("uncertainty"), F.asc("cand_id")), "ranked")
    g = greedy(r, pair_table(r).where(iou_at_least(cfg.merge_iou)))
    group = Window.partitionBy("video_id", F.coalesce("winner", "rk"))
    if "sentence_ids" in c.columns:
        every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("sentence_ids").over(group))))
        g = g.withColumn("sentence_ids", F.when(F.col("kept"), every).otherwise(F.col("sentence_ids")))
    first = F.max(F.when(F.col("kept"), F.col("cand_id"))).over(group)
    return g.withColumn("winner_id", F.when(~F.col("kept"), first)).drop("winner", "rk")


def select_diverse(c: DataFrame, campaign: str = "", cfg: Fusion = Fusion()) -> DataFrame:
    """Score what merging kept, and take the best that are not near-duplicates of one taken, up to the target.

    Rows under the quality floor rank last and are never taken. Candidates may have an
    ``embedding``; those that do are alike by cosine, others by words. ``reason`` says why a row has its status."""
    has = ["embedding"] if "embedding" in c.columns else []
    # merging leaves a winner's texts and span as they are, so scores are taken first and texts stay out of its shuffles
    s = with_words(scores(c, campaign, cfg)).select("video_id", "cand_id", "s", "e", "uncertainty", "words", *has, "total", (F.col("total") < cfg.min_score).alias("scored_low"))
    kept = merge_overlaps(s, cfg).where("kept").drop("kept", "winner_id", "uncertainty").withColumnRenamed("scored_low", "low")
    r = written(ranked(kept, F.asc("low"), F.desc("total"), F.asc("cand_id")), "ranked")
    g = greedy(r, near_duplicates(pair_table(r), r, cfg), cfg.target)
    video = Window.partitionBy("video_id")
    taken = F.col("kept") & ~F.col("low")
    last = F.max(F.when(taken, F.col("rk"))).over(video)
    full = F.sum(taken.cast("int")).over(video) >= cfg.target
    status = F.when(F.col("low"), "below_floor").when(F.col("kept"), "selected").when(full & (F.col("rk") > last), "surplus").otherwise("near_duplicate")
    names = r.select("video_id", F.col("rk").alias("winner"), F.col("cand_id").alias("winner_id"))
    g = g.withColumn("status", status).join(names, ["video_id", "winner"], "left")
    place = F.row_number().over(Window.partitionBy("video_id", "status").orderBy("rk"))
    reason = (
        F.when(F.col("status") == "below_floor", F.lit(f"below quality floor {cfg.min_score}"))
        .when(F.col("status") == "selected", F.concat(F.lit("ranked #"), place.cast("string")))
        .when(F.col("status") == "surplus", F.lit(f"surplus beyond target {cfg.target}"))
        .otherwise(F.concat(F.lit("near-duplicate of "), F.col("winner_id").cast("string")))
    )
    return g.select("video_id", "cand_id", "total", "status", reason.alias("reason"))


def dedup_refined(c: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """Clips in order of score; one goes when IoU, coverage of the shorter, or overlap with the same content is high."""
    has = ["embedding"] if "embedding" in c.columns else []
    r = written(ranked(with_words(scores(c, "", cfg)).select("video_id", "cand_id", "s", "e", "words", *has, "total"), F.desc("total"), F.asc("cand_id")), "ranked")
    covered = F.col("inter") * 10 >= F.least("len_a", "len_b") * round(cfg.coverage * 10)
    return greedy(r, near_duplicates(pair_table(r), r, cfg, covered)).select("video_id", "cand_id", "total", "kept")


def similar_pairs(c: DataFrame, text: str = "hook") -> DataFrame:
    """(video_id, cand_a, cand_b, similarity): content similarity of all pairs of a video's candidates, by their word sets.

    Pairs without a common word (similarity 0) are left out. Candidates meet in blocks of ``BLOCK``, whole word sets at once: a
    pair is never shuffled, and a long video is many pairs of blocks."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("cand_id")) - 1
    w = c.select("video_id", "cand_id", F.array_distinct(X.split_words(F.lower(text))).alias("ws")).withColumn("block", F.floor(number / BLOCK))
    b = w.groupBy("video_id", "block").agg(F.collect_list(F.struct("cand_id", "ws")).alias("xs"))
    later = b.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("block"), F.col("xs").alias("ys"))
    met = b.join(later, ["video_id", "block"]).select("video_id", F.explode("xs").alias("x"), "ys").select("video_id", "x", F.explode("ys").alias("y")).where("x.cand_id < y.cand_id")
    both = F.size(F.array_intersect("x.ws", "y.ws"))
    g = met.select("video_id", F.col("x.cand_id").alias("cand_a"), F.col("y.cand_id").alias("cand_b"), F.size("x.ws").alias("n"), F.size("y.ws").alias("m"), both.alias("both")).where("both > 0")
    return g.select("video_id", "cand_a", "cand_b", half_up(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("similarity"))


def insert_winners(selected: DataFrame, chunks: DataFrame, least_ms: int = 15_000) -> DataFrame:
    """Selected candidates (video_id, cand_id, rank, s, e, hook, main_idea, rationale, total) as numbered clips.

    Those under least_ms are refused (``insertion_statuses``). Texts are cut to their fields' lengths. ``source_chunks``
    are the chunks (video_id, chunk_index, start_ms, end_ms) whose closed range meets the clip's. ``provenance``
    is JSON of source, sentence_ids, uncertainty (where candidates have them) and the score; an ``embedding`` goes along,
    made of hook and reason where the job asks an embedder (``vector.embed``, ``models.embed_with``)."""
    rows = selected.where(F.col("e") - F.col("s") >= least_ms)
    told = [F.col(c) for c in ("source", "sentence_ids", "uncertainty") if c in selected.columns]
    provenance = F.to_json(F.struct(*told, F.col("total").alias("fusion_score")))
    more = [provenance.alias("provenance"), *([F.col("embedding")] if "embedding" in selected.columns else [])]
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("rank", "cand_id")).cast("long")
    hook, idea, why = (F.coalesce(F.col(x), F.lit("")) for x in ("hook", "main_idea", "rationale"))
    said = F.filter(F.array(why, F.when(idea != "", F.concat(F.lit("idea: "), X.capped(idea, "idea"))).otherwise("")), lambda x: x != "")
    none = lambda x: F.when(x != "", x)
    clips = rows.select(
        "video_id", number.alias("clip_number"), "cand_id", "s", "e", (F.col("e") - F.col("s")).alias("duration_ms"), none(hook).alias("hook"),
        none(X.capped(F.array_join(said, " "), "text")).alias("reason"), none(X.capped(F.when(hook != "", hook).otherwise(idea), "title")).alias("title"), "total", *more,
    )
    met = overlap_join(clips.select("video_id", "cand_id", "s", "e"), chunks.select("video_id", "chunk_index", "start_ms", "end_ms"), "video_id", ("s", "e"), ("start_ms", "end_ms"))
    of = met.groupBy("video_id", "cand_id").agg(F.array_sort(F.collect_list("chunk_index")).alias("source_chunks"))
    return clips.join(of, ["video_id", "cand_id"], "left").withColumn("source_chunks", F.coalesce("source_chunks", F.array().cast("array<bigint>")))


def insertion_statuses(considered: DataFrame, least_ms: int = 15_000) -> DataFrame:
    """(video_id, cand_id, status, reason) after insertion, of all candidates that selection looked at (s, e, status, reason).

    Selected ones become ``selected``, or ``rejected`` where they are too short; near-duplicates and those under the floor
    are ``rejected``; surplus ones stay ``proposed``. None goes without a status."""
    short = (F.col("status") == "selected") & (F.col("e") - F.col("s") < least_ms)
    status = F.when(short, "rejected").when(F.col("status") == "selected", "selected").when(F.col("status") == "surplus", "proposed").otherwise("rejected")
    reason = F.when(short, F.lit(f"shorter than {least_ms // 1000}s")).otherwise(F.coalesce("reason", F.lit("")))
    return considered.select("video_id", "cand_id", status.alias("status"), reason.alias("reason"))


def extracted_clips(replies: DataFrame, least_s: float = 15.0) -> DataFrame:
    """(chunk_id, n, start, end, duration_s, hook) from a model's replies (chunk_id, reply), a JSON list of clips each.

    Clips without both times (HH:MM:SS), with unreadable ones, or under least_s are left out."""
    kind = "array<struct<start_time:string,end_time:string,hook:string>>"
    c = replies.select("chunk_id", F.posexplode(F.from_json(X.model_json(F.col("reply")), kind)).alias("n", "c"))
    dur = X.parse_clock(F.col("c.end_time")) - X.parse_clock(F.col("c.start_time"))
    return c.select("chunk_id", F.col("n").cast("long").alias("n"), F.col("c.start_time").alias("start"), F.col("c.end_time").alias("end"), dur.alias("duration_s"), F.col("c.hook").alias("hook")).where(F.col("duration_s") >= least_s)


def enriched(cues: DataFrame, replies: DataFrame) -> DataFrame:
    """cues with hook, main_idea and payoff of a model's replies (video_id, peak_ms, hook, main_idea, payoff) where it gave some."""
    r = replies.select("video_id", "peak_ms", *[F.col(c).alias(f"new_{c}") for c in ("hook", "main_idea", "payoff")])
    j = cues.join(r, ["video_id", "peak_ms"], "left")
    old = lambda c: F.col(c) if c in cues.columns else F.lit(None).cast("string")
    return j.withColumns({c: F.when(F.col(f"new_{c}") != "", X.capped(F.col(f"new_{c}"), "enriched")).otherwise(old(c)) for c in ("hook", "main_idea", "payoff")}).drop("new_hook", "new_main_idea", "new_payoff")


def dedup_near_starts(c: DataFrame, within_ms: int = 5000) -> DataFrame:
    """Clips by start; one that starts within within_ms of the last kept replaces it if longer, else goes.

    The replacement's start is the new anchor, so this is a fold over each video's clips in order."""
    items = F.array_sort(F.collect_list(F.struct("s", F.col("cand_id").alias("id"), "e")))
    g = c.groupBy("video_id").agg(items.alias("xs"))
    kind = "array<struct<s:bigint,id:bigint,e:bigint>>"

    def step(k, x):
        last = F.try_element_at(k, F.lit(-1))
        near = (F.size(k) > 0) & (x["s"] - last["s"] < within_ms)
        longer = x["e"] - x["s"] > last["e"] - last["s"]
        swapped = F.concat(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), F.array(x))
        return F.when(~near, F.concat(k, F.array(x))).when(longer, swapped).otherwise(k)

    kept = F.aggregate("xs", F.array().cast(kind), step)
    return g.select("video_id", F.inline(kept)).select("video_id", F.col("id").alias("cand_id"), "s", "e")
