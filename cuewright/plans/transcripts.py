"""Queries over word timelines: segmentation, coverage, captions, boundaries, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions import text as X
from cuewright.functions.numeric import half_up
from cuewright.operators import candidates as C
from cuewright.operators import captions, glossary, intervals, segment
from cuewright.sources import transcript
from cuewright.storage import written

from . import fixtures, sql
from .registry import query, table


def words(spark: SparkSession, d: str) -> DataFrame:
    return transcript.word_timeline(table(spark, d, "documents"))


def sents(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentences(words(spark, d))


@query(f"WITH {sql.WORDS} SELECT * FROM w")
def word_timeline(spark, d):
    return words(spark, d)


@query(
    f"WITH {sql.SENTENCES} SELECT *, ends_with_punctuation AND NOT regexp_matches(lower(text), '^(so|and|well|you know|um|uh|like)[,.\\s]*$') AS heuristic_complete FROM s"
)
def sentence_units(spark, d):
    return sents(spark, d)


@query(f"WITH {sql.CHUNKS} SELECT video_id, start_word, end_word, start_ms, end_ms, text, silence_gap_before_ms, token_count, chunk_index FROM c")
def silence_chunks(spark, d):
    return segment.silence_chunks(words(spark, d)).select("video_id", "start_word", "end_word", "start_ms", "end_ms", "text", "silence_gap_before_ms", "token_count", "chunk_index")


@query(rf"""WITH {sql.CHUNKS},
o AS (SELECT *, lag(start_word) OVER v AS p0, lag(end_word) OVER v AS p1 FROM c WINDOW v AS (PARTITION BY video_id ORDER BY chunk_index)),
l AS (SELECT o.video_id, o.chunk_index, min(w.start_ms) AS lead_ms, string_agg(w.word, ' ' ORDER BY w.pos) AS lead_text
  FROM o JOIN w ON w.video_id = o.video_id AND w.pos BETWEEN p0 AND p1 AND w.end_ms >= o.start_ms - 25000 GROUP BY ALL),
f AS (SELECT o.*, lead_ms, CASE WHEN lead_text IS NULL THEN text ELSE lead_text || ' ' || text END AS full_text FROM o LEFT JOIN l USING (video_id, chunk_index))
SELECT video_id, chunk_index, coalesce(lead_ms, start_ms) AS start_ms, end_ms, full_text AS text, greatest(1, length(full_text) // 4)::BIGINT AS token_count,
  lead_ms IS NOT NULL AS is_overlap_tail, silence_gap_before_ms FROM f""")
def overlap_chunks(spark, d):
    return segment.overlap_chunks(words(spark, d))


_OUTLINE = rf"""{sql.SENTENCES},
n0 AS (SELECT video_id, count(*) AS n FROM s GROUP BY 1),
n AS (SELECT video_id, n, CASE WHEN n > 40 AND ((n - 40 + 35) // 36) + 1 > 12 THEN greatest(40, (n + 11) // 12 + 4) ELSE 40 END AS size FROM n0),
wins AS (SELECT video_id, size, unnest(range(least(12, CASE WHEN n <= size THEN 1 ELSE ((n - size + size - 5) // (size - 4)) + 1 END))) AS win FROM n),
j AS (SELECT wins.video_id, win, size, s.* EXCLUDE (video_id) FROM wins JOIN s ON s.video_id = wins.video_id AND s.id >= win * (size - 4) AND s.id < win * (size - 4) + size),
g AS (SELECT video_id, win AS "window", min(id) AS start_id, max(id) AS end_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
  string_agg(text, ' ' ORDER BY id) FILTER (WHERE id < win * (size - 4) + 3) AS head, list(id ORDER BY id)[1:6] AS ids FROM j GROUP BY video_id, win),
ol AS (SELECT video_id, "window", start_id, end_id, start_ms, end_ms, array_to_string(list_filter(regexp_split_to_array(head, '\s+'), lambda x: x <> '')[1:8], ' ') AS title,
  array_to_string(ids, ',') AS key_ids FROM g)"""


@query(f"WITH {_OUTLINE} SELECT * FROM ol")
def outline_windows(spark, d):
    return segment.outline_windows(sents(spark, d))


def minutes(w: DataFrame) -> DataFrame:
    """Half-minute ranges over each timeline."""
    n = w.groupBy("video_id").agg(F.max("end_ms").alias("end"))
    return n.select("video_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("end") / 30_000))).alias("range_id")).select(
        "video_id", "range_id", (F.col("range_id") * 30_000).alias("s"), (F.col("range_id") * 30_000 + 30_000).alias("e")
    )


@query(f"""WITH {sql.WORDS},
r AS (SELECT video_id, unnest(range((max(end_ms) // 30000) + 1)) AS range_id FROM w GROUP BY 1),
b AS (SELECT w.video_id, unnest(range(start_ms // 30000, (end_ms // 30000) + 1)) AS range_id, start_ms, end_ms FROM w)
SELECT r.video_id, r.range_id, coalesce(sum(greatest(least(end_ms, (r.range_id + 1) * 30000) - greatest(start_ms, r.range_id * 30000), 0)), 0)::BIGINT AS speech_ms, 30000::BIGINT AS span_ms
FROM r LEFT JOIN b USING (video_id, range_id) GROUP BY ALL""")
def speech_coverage(spark, d):
    w = words(spark, d)
    return intervals.speech_coverage(minutes(w), w, "video_id", "range_id")


@query(f"WITH {sql.PROPOSALS} SELECT video_id, proposal_id, lo, hi, n_sentences, s, e, reject_reason FROM p")
def candidate_validation(spark, d):
    s = written(sents(spark, d), "shared")  # proposed from twice and looked up twice
    return C.validate(fixtures.proposals(s), s).select("video_id", "proposal_id", "lo", "hi", "n_sentences", "s", "e", "reject_reason")


def cands(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    return written(judged(spark, d, s), "shared")  # met with themselves


def judged(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    """The candidates, for those who take them once."""
    s = s or written(sents(spark, d).select("video_id", "id", "start_ms", "end_ms", "text"), "shared")
    return fixtures.candidates(C.validate(fixtures.proposals(s), s))


KEYWORDS = X.keywords(sql.CAMPAIGN)


@query(
    f"WITH {sql.PROPOSALS} SELECT video_id, cand_id, opening, standalone, payoff_score, completeness, relevance, editability, audio_support, total FROM ({sql.scores('k', KEYWORDS)})"
)
def editorial_scores(spark, d):
    return C.scores(judged(spark, d), sql.CAMPAIGN).select(
        "video_id", "cand_id", "opening", "standalone", "payoff_score", "completeness", "relevance", "editability", "audio_support", "total"
    )


@query(f"""WITH {sql.PROPOSALS},
j AS (SELECT a.video_id, a.cand_id AS cand_a, b.cand_id AS cand_b, least(a.e, b.e) - greatest(a.s, b.s) AS i, a.e - a.s AS la, b.e - b.s AS lb
  FROM k a JOIN k b ON a.video_id = b.video_id AND b.cand_id < a.cand_id AND b.s < a.e AND b.e > a.s)
SELECT video_id, cand_a, cand_b, i AS inter_ms, floor(i / (la + lb - i)::DOUBLE * 1000000 + 0.5) / 1000000.0::DOUBLE AS iou,
  floor(i / least(la, lb)::DOUBLE * 1000000 + 0.5) / 1000000.0::DOUBLE AS coverage FROM j""")
def pairwise_iou(spark, d):
    r = cands(spark, d).withColumn("rk", F.col("cand_id"))
    i = F.col("inter")
    return C.pair_table(r).select(
        "video_id", F.col("rk").alias("cand_a"), F.col("e_rk").alias("cand_b"), i.alias("inter_ms"),
        half_up(i / C.union(), 6).alias("iou"), half_up(i / F.least("len_a", "len_b"), 6).alias("coverage"),
    )


_MERGED = f"""{sql.PROPOSALS},
mr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY uncertainty, cand_id) AS rk FROM k),
{sql.greedy('mr', 'x.inter * 10 >= (x.la + x.lb - x.inter) * 7')}"""


@query(
    f"""WITH {_MERGED},
ml AS (SELECT g.*, coalesce(winner, rk) AS top FROM g),
ms AS (SELECT ml.video_id, ml.top, array_to_string(list(DISTINCT s.id ORDER BY s.id), ',') AS sentence_ids FROM ml JOIN p ON p.video_id = ml.video_id AND p.proposal_id = ml.cand_id JOIN s ON s.video_id = p.video_id AND s.id BETWEEN p.lo AND p.hi GROUP BY ALL)
SELECT ml.video_id, ml.cand_id, ml.kept, CASE WHEN NOT ml.kept THEN m.cand_id END AS winner_id, CASE WHEN ml.kept THEN ms.sentence_ids END AS merged_ids
FROM ml LEFT JOIN mr m ON m.video_id = ml.video_id AND m.rk = ml.winner JOIN ms ON ms.video_id = ml.video_id AND ms.top = ml.top"""
)
def merged_candidates(spark, d):
    m = C.merge_overlaps(cands(spark, d))
    return m.select("video_id", "cand_id", "kept", "winner_id", F.when(F.col("kept"), F.array_join("sentence_ids", ",")).alias("merged_ids"))


def _renamed(ctes: str, prefix: str) -> str:
    for name in ("g_pairs", "g_rows", "g_fold"):
        ctes = ctes.replace(name, f"{prefix}_{name}")
    return ctes


_DIVERSE = f"""{_renamed(_MERGED, 'm')},
sc AS ({sql.scores("(SELECT video_id, cand_id, s, e, hook, main_idea, energy_increase, payoff, required_context, uncertainty, source FROM g WHERE kept)", KEYWORDS)}),
dr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY total DESC, cand_id) AS rk FROM sc WHERE total >= 0.45),
{sql.greedy('dr', f"x.inter * 10 >= (x.la + x.lb - x.inter) * 5 OR (x.inter * 10 >= (x.la + x.lb - x.inter) * 3 AND {sql.alike()})", 8).replace('g AS (SELECT', 'g2 AS (SELECT')},
z AS (SELECT *, max(CASE WHEN kept THEN rk END) OVER (PARTITION BY video_id) AS lastk, sum(kept::INT) OVER (PARTITION BY video_id) AS nk FROM g2)"""


@query(f"""WITH {_DIVERSE}
SELECT video_id, cand_id, total, CASE WHEN kept THEN 'selected' WHEN nk >= 8 AND rk > lastk THEN 'surplus' ELSE 'near_duplicate' END AS status FROM z
UNION ALL SELECT video_id, cand_id, total, 'below_floor' FROM sc WHERE total < 0.45""")
def diverse_selection(spark, d):
    return C.select_diverse(cands(spark, d), sql.CAMPAIGN).drop("reason")


@query(f"""WITH {sql.PROPOSALS},
sc AS ({sql.scores('k', [])}),
dr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY total DESC, cand_id) AS rk FROM sc),
{sql.greedy('dr', f"x.inter * 10 >= (x.la + x.lb - x.inter) * 5 OR x.inter * 10 >= least(x.la, x.lb) * 6 OR (x.inter * 10 >= (x.la + x.lb - x.inter) * 3 AND {sql.alike()})")}
SELECT video_id, cand_id, total, kept FROM g""")
def refined_dedup(spark, d):
    return C.dedup_refined(cands(spark, d))


@query(f"""WITH {sql.PROPOSALS},
l AS (SELECT video_id, list({{'s': s, 'id': cand_id, 'e': e}} ORDER BY s, cand_id) AS xs FROM k GROUP BY 1),
f AS (SELECT video_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN x[1].s - a[-1].s >= 5000 THEN list_concat(a, x)
   WHEN x[1].e - x[1].s > a[-1].e - a[-1].s THEN list_concat(a[:-2], x) ELSE a END) AS kept FROM l)
SELECT video_id, z.id AS cand_id, z.s AS s, z.e AS e FROM (SELECT video_id, unnest(kept) AS z FROM f)""")
def near_start_dedup(spark, d):
    return C.dedup_near_starts(cands(spark, d))


def clips(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clips off the sentence grid: candidates shifted by a few hundred milliseconds; and the sentences."""
    # bounds only: neighbours are found where sentences are made, texts are neither written nor sent along
    s = intervals.neighbours(sents(spark, d)).select("video_id", "id", "start_ms", "end_ms", "ends_with_punctuation", "prev_end", "next_start")
    s = written(s, "shared")
    c = written(judged(spark, d, s.withColumn("text", F.lit(""))).select("video_id", "cand_id", "s", "e"), "shared")
    i = F.col("cand_id")
    return c.select(
        "video_id", (F.col("video_id") * 10_000_000 + i).alias("clip_id"), (F.col("s") + i % 7 * 311).alias("s"),
        F.when(i % 44 == 4, F.col("s")).otherwise(F.col("e") - i % 5 * 977 + F.when(i % 3 == 0, 4000).otherwise(0)).alias("e"),
    ), s


_SNAP = """nb AS MATERIALIZED (SELECT *, lag(end_ms) OVER v AS prev_end, lead(start_ms) OVER v AS next_start FROM s WINDOW v AS (PARTITION BY video_id ORDER BY id)),
sa AS (SELECT clip_id, coalesce(max(nb.id), 0) AS sid FROM cl LEFT JOIN nb ON nb.video_id = cl.video_id AND nb.start_ms <= cl.s GROUP BY 1),
ea AS (SELECT clip_id, coalesce(max(nb.id), 0) AS eid FROM cl LEFT JOIN nb ON nb.video_id = cl.video_id AND nb.start_ms <= cl.e GROUP BY 1),
sn AS MATERIALIZED (SELECT cl.*, sid, eid, greatest(0, a.start_ms - 150, coalesce(a.prev_end + 10, 0)) AS det_s,
  greatest(least(b.end_ms + 300, coalesce(b.next_start - 10, b.end_ms + 300)), greatest(0, a.start_ms - 150, coalesce(a.prev_end + 10, 0)) + 500) AS det_e
  FROM cl JOIN sa USING (clip_id) JOIN ea USING (clip_id) JOIN nb a ON a.video_id = cl.video_id AND a.id = sid JOIN nb b ON b.video_id = cl.video_id AND b.id = eid)"""
_CLIPS = f"""{sql.PROPOSALS},
cl AS MATERIALIZED (SELECT video_id, video_id * 10000000 + cand_id AS clip_id, s + cand_id % 7 * 311 AS s,
  CASE WHEN cand_id % 44 = 4 THEN s ELSE e - cand_id % 5 * 977 + CASE WHEN cand_id % 3 = 0 THEN 4000 ELSE 0 END END AS e FROM k),
{_SNAP}"""


@query(f"WITH {_CLIPS} SELECT clip_id, video_id, s, e, sid AS s_id, eid AS e_id, det_s, det_e FROM sn")
def snap_boundaries(spark, d):
    c, s = clips(spark, d)
    return intervals.snap(c, s).select("clip_id", "video_id", "s", "e", "s_id", "e_id", "det_s", "det_e")


_REFINE = """cx AS (SELECT sn.clip_id, sn.video_id, sn.s, sn.e, det_s, det_e, arg_max(x.end_ms + 300, x.id) FILTER (WHERE x.end_ms + 300 <= sn.e + 15000 AND x.ends_with_punctuation) AS capped, list(x.start_ms ORDER BY x.start_ms) AS starts
  FROM sn JOIN s x ON x.video_id = sn.video_id AND x.end_ms >= sn.s - 20000 AND x.start_ms <= sn.e + 20000 WHERE sn.e > sn.s GROUP BY ALL),
rc1 AS (SELECT *, CASE WHEN det_e > e + 15000 THEN capped ELSE det_e END AS new_e FROM cx),
rc2 AS (SELECT *, new_e - det_s AS dur, list_filter(starts, lambda x: x >= new_e - 90000 AND x >= det_s)[1] AS trim FROM rc1),
refined AS (SELECT video_id, clip_id,
  CASE WHEN new_e IS NULL THEN s WHEN dur > 90000 AND trim IS NOT NULL THEN greatest(det_s, trim - 150) ELSE det_s END AS refined_s, coalesce(new_e, e) AS refined_e,
  CASE WHEN new_e IS NULL THEN 'rejected_extension' WHEN dur > 90000 AND trim IS NULL THEN 'rejected_duration' WHEN dur < 1000 THEN 'rejected_short' ELSE 'refined' END AS refine_status,
  'snap' || CASE WHEN det_e > e + 15000 THEN '+capped' ELSE '' END || CASE WHEN dur > 90000 AND trim IS NOT NULL THEN '+trimmed' ELSE '' END AS method FROM rc2
  UNION ALL SELECT video_id, clip_id, s, e, 'rejected_range', '' FROM cl WHERE e <= s
  UNION ALL SELECT video_id, clip_id, s, e, 'passthrough_no_transcript', '' FROM cl WHERE e > s AND clip_id NOT IN (SELECT clip_id FROM cx))"""
_REFINED = f"{_CLIPS},\n{_REFINE}"


@query(f"WITH {_REFINED} SELECT * FROM refined")
def refined_clips(spark, d):
    c, s = clips(spark, d)
    return intervals.refine(c, s)


@query(f"""WITH {_REFINED}
SELECT video_id, count(*)::BIGINT AS clips, count(*) FILTER (WHERE starts_with(refine_status, 'rejected'))::BIGINT AS rejected,
  coalesce(sum(CASE WHEN NOT starts_with(refine_status, 'rejected') THEN refined_e - refined_s END), 0)::BIGINT AS output_ms,
  max(CASE WHEN NOT starts_with(refine_status, 'rejected') THEN printf('%02d:%02d:%02d', refined_s // 3600000, refined_s // 60000 % 60, refined_s // 1000 % 60) END) AS last_start FROM refined GROUP BY 1""")
def clip_report(spark, d):
    """Clips to render (status not rejected; null would be kept) and their output length by video."""
    r = refined_clips(spark, d)
    out = ~F.coalesce(F.startswith("refine_status", F.lit("rejected")), F.lit(False))
    return r.groupBy("video_id").agg(
        F.count("*").alias("clips"), F.count(F.when(~out, 1)).alias("rejected"),
        F.coalesce(F.sum(F.when(out, F.col("refined_e") - F.col("refined_s"))), F.lit(0)).cast("long").alias("output_ms"), F.max(F.when(out, X.clock(F.col("refined_s")))).alias("last_start"),
    )


@query(f"""WITH {sql.CHUNKS},
pr AS (SELECT video_id, chunk_index AS clip, start_ms AS s, end_ms AS e FROM c),
mo AS (SELECT pr.video_id, pr.clip, c.chunk_index AS seg, CASE WHEN c.chunk_index % 11 = 5 THEN NULL ELSE c.start_ms END AS s, CASE WHEN c.chunk_index % 13 = 6 THEN c.start_ms ELSE c.end_ms END AS e
  FROM pr JOIN c ON c.video_id = pr.video_id AND c.chunk_index > pr.clip AND c.chunk_index <= pr.clip + 5),
l AS (SELECT video_id, clip, list({{'s': s, 'seg': seg, 'e': e}} ORDER BY s NULLS FIRST, seg) AS xs FROM mo GROUP BY ALL),
f AS (SELECT l.*, list_reduce(list_transform(xs, lambda x: {{'x': x, 'p1': 0::BIGINT, 'total': 0::BIGINT, 'o': []::VARCHAR[]}}),
  lambda a, y: CASE WHEN y.x.s IS NULL OR y.x.e IS NULL THEN {{'x': y.x, 'p1': a.p1, 'total': a.total, 'o': list_append(a.o, 'unreadable')}}
    WHEN y.x.e <= y.x.s THEN {{'x': y.x, 'p1': a.p1, 'total': a.total, 'o': list_append(a.o, 'empty')}}
    WHEN y.x.s - a.p1 > 45000 THEN {{'x': y.x, 'p1': a.p1, 'total': a.total, 'o': list_append(a.o, 'too_far')}}
    WHEN a.total + y.x.e - y.x.s > 90000 THEN {{'x': y.x, 'p1': a.p1, 'total': a.total, 'o': list_append(a.o, 'too_long')}}
    ELSE {{'x': y.x, 'p1': greatest(a.p1, y.x.e), 'total': a.total + y.x.e - y.x.s, 'o': list_append(a.o, 'kept')}} END,
  {{'x': xs[1], 'p1': pr.e, 'total': pr.e - pr.s, 'o': []::VARCHAR[]}}).o AS o FROM l JOIN pr USING (video_id, clip))
SELECT video_id, clip AS clip_index, unnest(xs).seg AS seg_id, unnest(o) AS outcome FROM f""")
def stitch_limits(spark, d):
    c = segment.silence_chunks(words(spark, d)).select("video_id", "chunk_index", "start_ms", "end_ms")
    clip = F.concat_ws(":", "video_id", "clip")
    p = c.select("video_id", F.col("chunk_index").alias("clip"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    near = p.select("video_id", "clip", F.explode(F.sequence(F.col("clip") + 1, F.col("clip") + 5)).alias("chunk_index"))
    m = near.join(c, ["video_id", "chunk_index"]).select(
        clip.alias("clip_id"), F.col("chunk_index").alias("seg_id"), F.when(F.col("chunk_index") % 11 != 5, F.col("start_ms")).alias("s"),
        F.when(F.col("chunk_index") % 13 == 6, F.col("start_ms")).otherwise(F.col("end_ms")).alias("e"),
    )
    out = intervals.stitch_limits(p.select(clip.alias("clip_id"), "s", "e"), m)
    return out.select(F.substring_index("clip_id", ":", 1).cast("long").alias("video_id"), F.substring_index("clip_id", ":", -1).cast("long").alias("clip_index"), "seg_id", "outcome")


_CUES = (
    sql.WORDS
    + r""",
q0 AS (SELECT *, length(word) + 1 AS size, ends_with(word, ',') AS comma, regexp_matches(word, '[.!?…]+$') AS ends FROM w),
q1 AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM q0),
q2 AS (SELECT video_id, run, list({'pos': pos, 'size': size, 'a': start_ms, 'b': end_ms, 'comma': comma} ORDER BY pos) AS xs FROM q1 GROUP BY ALL),
q3 AS (SELECT video_id, run, xs, list_reduce(list_transform(xs, lambda x: {'x': x, 'n': 0::BIGINT, 'c': 0::BIGINT, 'f': 0::BIGINT, 'cue': 0::BIGINT, 'o': []::BIGINT[]}),
  lambda s, y: {'x': y.x,
    'n': CASE WHEN s.n + 1 >= 8 OR s.c + y.x.size >= 42 OR y.x.b - (CASE WHEN s.n = 0 THEN y.x.a ELSE s.f END) >= 4000 OR (s.n + 1 >= 3 AND (y.x.b - (CASE WHEN s.n = 0 THEN y.x.a ELSE s.f END)) * 10 >= 24000 AND y.x.comma) THEN 0 ELSE s.n + 1 END,
    'c': CASE WHEN s.n + 1 >= 8 OR s.c + y.x.size >= 42 OR y.x.b - (CASE WHEN s.n = 0 THEN y.x.a ELSE s.f END) >= 4000 OR (s.n + 1 >= 3 AND (y.x.b - (CASE WHEN s.n = 0 THEN y.x.a ELSE s.f END)) * 10 >= 24000 AND y.x.comma) THEN 0 ELSE s.c + y.x.size END,
    'f': CASE WHEN s.n = 0 THEN y.x.a ELSE s.f END,
    'cue': CASE WHEN s.n + 1 >= 8 OR s.c + y.x.size >= 42 OR y.x.b - (CASE WHEN s.n = 0 THEN y.x.a ELSE s.f END) >= 4000 OR (s.n + 1 >= 3 AND (y.x.b - (CASE WHEN s.n = 0 THEN y.x.a ELSE s.f END)) * 10 >= 24000 AND y.x.comma) THEN s.cue + 1 ELSE s.cue END,
    'o': list_append(s.o, s.cue)},
  {'x': xs[1], 'n': 0::BIGINT, 'c': 0::BIGINT, 'f': 0::BIGINT, 'cue': 0::BIGINT, 'o': []::BIGINT[]}).o AS cues FROM q2),
q4 AS (SELECT video_id, run, unnest(xs).pos AS pos, unnest(cues) AS cue FROM q3),
q5 AS (SELECT video_id, run, cue, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, min(pos) AS first_word, string_agg(word, ' ' ORDER BY pos) AS text FROM q4 JOIN w USING (video_id, pos) GROUP BY ALL)
"""
)


@query(f"WITH {_CUES} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY first_word) AS cue_id, start_ms, end_ms, n_words, text FROM q5")
def caption_cues(spark, d):
    return captions.caption_cues(words(spark, d))


_SRT = f"""WITH {sql.CHUNKS},
r AS (SELECT video_id * 10000000 + (chunk_index // 2) AS clip_id, video_id, start_ms AS s, end_ms - 400 AS e FROM c),
r2 AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY clip_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, row_number() OVER (PARTITION BY clip_id ORDER BY s) AS kk FROM r),
m AS (SELECT clip_id, w.pos, arg_min(word, kk) AS word, arg_min(start_ms - s + o, kk) AS a, arg_min(end_ms - s + o, kk) AS b
  FROM r2 JOIN w ON w.video_id = r2.video_id AND start_ms >= s AND end_ms <= e + 500 GROUP BY ALL),
sl AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS n, a AS start_ms, b AS end_ms,
  printf('%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d ', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000, b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || word AS line FROM m)"""


@query(_SRT + " SELECT * FROM sl")
def srt_lines(spark, d):
    w = words(spark, d)
    return captions.srt_lines(w, chunk_ranges(w))


def chunk_ranges(w: DataFrame) -> DataFrame:
    """Two neighbouring chunks a clip, each as a range that ends a little early."""
    clip = F.col("video_id") * 10_000_000 + F.floor(F.col("chunk_index") / 2)
    return segment.silence_chunks(w).select(clip.alias("clip_id"), "video_id", F.col("start_ms").alias("s"), (F.col("end_ms") - 400).alias("e"))


GLOSSARY = [("the", "THE"), ("of the", "of-the"), ("de la", "de-la"), ("und der", "u.d."), ("same", "same"), ("", "x")]


@query(rf"""WITH {sql.WORDS},
l AS (SELECT *, lower(word) AS lw, lower(lead(word) OVER v) AS nx, lower(lag(word) OVER v) AS pv FROM w WINDOW v AS (PARTITION BY video_id ORDER BY pos))
SELECT video_id, pos, word, CASE WHEN lw = 'und' AND nx = 'der' THEN 'u.d.' WHEN pv = 'und' AND lw = 'der' THEN ''
  WHEN lw = 'de' AND nx = 'la' THEN 'de-la' WHEN pv = 'de' AND lw = 'la' THEN '' WHEN lw = 'of' AND nx = 'the' THEN 'of-the' WHEN pv = 'of' AND lw = 'the' THEN ''
  WHEN lw = 'the' THEN 'THE' ELSE word END AS display FROM l""")
def glossary_display(spark, d):
    return captions.glossary_display(words(spark, d).select("video_id", "pos", "word"), GLOSSARY).select("video_id", "pos", "word", "display")


@query(f"""WITH {sql.WORDS},
bi AS (SELECT video_id, pos, lower(word) AS a, lower(lead(word) OVER (PARTITION BY video_id ORDER BY pos)) AS b FROM w),
ct AS (SELECT a, b, count(*) AS n FROM bi WHERE b IS NOT NULL AND a <> b GROUP BY ALL),
tp AS (SELECT a, b, row_number() OVER (ORDER BY n DESC, a, b) AS e FROM (FROM ct ORDER BY n DESC, a, b LIMIT 3000)),
m AS (SELECT video_id, pos, e FROM bi JOIN tp USING (a, b))
SELECT w.video_id, w.pos, word, CASE WHEN m1.e IS NULL AND m0.e IS NULL THEN word WHEN coalesce(m1.e, 0) > coalesce(m0.e, 0) THEN 'G' || m1.e::VARCHAR ELSE '' END AS display
FROM w LEFT JOIN m m1 ON m1.video_id = w.video_id AND m1.pos = w.pos LEFT JOIN m m0 ON m0.video_id = w.video_id AND m0.pos = w.pos - 1""")
def large_glossary(spark, d):
    """Display texts by a glossary of three thousand entries, here the most frequent word pairs, by the automaton."""
    found = glossary.frequent_pairs(table(spark, d, "documents").select("text"), 3000)
    return captions.glossary_display(words(spark, d).select("video_id", "pos", "word"), [(f"{a} {b}", f"G{i}") for i, (a, b, _) in enumerate(found, 1)])


@query(rf"""WITH {sql.PROPOSALS},
h AS (SELECT video_id, cand_id, list_distinct(list_filter(regexp_split_to_array(lower(hook), '\s+'), lambda x: x <> '')) AS ws FROM k)
SELECT a.video_id, a.cand_id AS cand_a, b.cand_id AS cand_b, floor(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE * 1000000 + 0.5) / 1000000.0::DOUBLE AS similarity
FROM h a JOIN h b ON a.video_id = b.video_id AND a.cand_id < b.cand_id WHERE list_has_any(a.ws, b.ws)""")
def token_jaccard(spark, d):
    """Word-set similarity of all pairs of a video's candidates that share a word."""
    return C.similar_pairs(cands(spark, d))
