"""Queries over whole clips: validators' verdicts, stitched clips, inserted winners, cues of clips, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions import text as X
from cuewright.functions.numeric import coverage, half_up, iou
from cuewright.operators import adapters, captions, intervals, segment
from cuewright.operators import candidates as C
from cuewright.sources import sinks
from cuewright.storage import written

from . import fixtures, media, sql, transcripts
from .registry import query

_SENTENCES_AND_CHUNKS = sql.SENTENCES + "," + sql.CHUNKS[len(sql.WORDS) :].lstrip().lstrip(",")


def _pairs(c: Column) -> Column:
    """Ranges as text."""
    return F.array_join(F.transform(c, lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ";")


def chunk_clips(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every chunk as a clip, its next three chunks as continuations, and the sentences."""
    w = transcripts.words(spark, d)
    c = written(segment.silence_chunks(w).select("video_id", "chunk_index", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")), "shared")  # met with itself
    clip = lambda i: F.col("video_id") * 10_000_000 + F.col(i)
    clips = c.select("video_id", clip("chunk_index").alias("clip_id"), "s", "e")
    by_index = Window.partitionBy("video_id").orderBy("chunk_index")  # numbers have no gaps
    ahead = F.array(*[F.struct(F.lit(k).cast("long").alias("seg_id"), F.lead("s", k).over(by_index).alias("s"), F.lead("e", k).over(by_index).alias("e")) for k in (1, 2, 3)])
    more = c.select("video_id", clip("chunk_index").alias("clip_id"), ahead.alias("ahead")).select("video_id", "clip_id", F.inline("ahead")).where("s is not null")
    s = intervals.neighbours(segment.sentences(w)).select("video_id", "id", "start_ms", "end_ms", "ends_with_punctuation", "prev_end", "next_start")
    return clips, more, written(s, "sentences")


_STITCHED = f"""{_SENTENCES_AND_CHUNKS},
pr AS (SELECT video_id, video_id * 10000000 + chunk_index AS clip, chunk_index, start_ms AS s, end_ms AS e FROM c),
mo AS (SELECT pr.video_id, pr.clip, c.chunk_index - pr.chunk_index AS seg, c.start_ms AS s, c.end_ms AS e FROM pr JOIN c ON c.video_id = pr.video_id AND c.chunk_index > pr.chunk_index AND c.chunk_index <= pr.chunk_index + 3),
ls AS (SELECT video_id, clip, list({{'s': s, 'seg': seg, 'e': e}} ORDER BY s, seg) AS xs FROM mo GROUP BY ALL),
fo AS (SELECT ls.*, list_reduce(list_transform(xs, lambda x: {{'x': x, 'p1': 0::BIGINT, 'total': 0::BIGINT, 'o': []::BOOLEAN[]}}),
  lambda a, y: CASE WHEN y.x.e <= y.x.s OR y.x.s - a.p1 > 45000 OR a.total + y.x.e - y.x.s > 90000 THEN {{'x': y.x, 'p1': a.p1, 'total': a.total, 'o': list_append(a.o, false)}}
    ELSE {{'x': y.x, 'p1': greatest(a.p1, y.x.e), 'total': a.total + y.x.e - y.x.s, 'o': list_append(a.o, true)}} END,
  {{'x': xs[1], 'p1': pr.e, 'total': pr.e - pr.s, 'o': []::BOOLEAN[]}}).o AS o FROM ls JOIN pr USING (video_id, clip)),
un AS (SELECT video_id, clip, unnest(xs) AS x, unnest(o) AS kept FROM fo),
cl AS MATERIALIZED (SELECT video_id, clip * 10 AS clip_id, s, e FROM pr UNION ALL SELECT video_id, clip * 10 + x.seg, x.s, x.e FROM un WHERE kept),
{transcripts._SNAP},
{transcripts._REFINE},
st AS (SELECT video_id, clip_id // 10 AS clip_id, refine_status FROM refined WHERE clip_id % 10 = 0),
ra AS (SELECT r.clip_id // 10 AS clip_id, refined_s AS s, refined_e AS e FROM refined r JOIN st ON st.clip_id = r.clip_id // 10 AND NOT starts_with(st.refine_status, 'rejected') WHERE NOT starts_with(r.refine_status, 'rejected')),
g1 AS (SELECT *, coalesce((s > max(e) OVER v + 50)::INT, 1) AS fresh FROM ra WINDOW v AS (PARTITION BY clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g2 AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM g1),
g3 AS (SELECT clip_id, min(s) AS s, max(e) AS e FROM g2 GROUP BY clip_id, island),
g4 AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM g3),
ln AS (SELECT clip_id, string_agg(s::VARCHAR || '-' || e::VARCHAR, ';' ORDER BY s) AS ranges, string_agg(o::VARCHAR, ';' ORDER BY s) AS starts, sum(e - s)::BIGINT AS output_ms FROM g4 GROUP BY 1)"""


@query(f"WITH {_STITCHED} SELECT video_id, clip_id, refine_status, ranges, starts, coalesce(output_ms, 0) AS output_ms FROM st LEFT JOIN ln USING (clip_id)")
def refined_stitched(spark, d):
    r = intervals.refine_all(*chunk_clips(spark, d))
    starts = F.array_join(F.transform("ranges", lambda x: x["out_s"].cast("string")), ";")
    return r.select("video_id", "clip_id", "refine_status", _pairs(F.col("ranges")).alias("ranges"), starts.alias("starts"), "output_ms")


@query(f"""WITH {media._MERGED},
cl AS (SELECT user_id AS clip_id, list({{'s': s, 'e': e}} ORDER BY s) AS rs, count(*) AS n FROM mr GROUP BY 1)
SELECT clip_id, array_to_string(list_transform(CASE WHEN clip_id % 2 = 0 THEN list_reverse(rs) ELSE rs END, lambda x: x.s::VARCHAR || '-' || x.e::VARCHAR), ';') AS cuts FROM cl""")
def cut_ranges(spark, d):
    """What is cut of each clip: an explicit timeline, here of the ranges backwards, wins over the source ranges."""
    m = media.merged_ranges(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"))))
    g = m.groupBy(F.col("user_id").alias("clip_id")).agg(
        F.collect_list(F.struct("s", "e")).alias("ranges"), F.collect_list(F.when(F.col("user_id") % 2 == 0, F.struct("s", "e", F.col("k").alias("out_s")))).alias("timeline")
    )
    return intervals.cut_ranges(g).select("clip_id", _pairs(F.col("cuts")).alias("cuts"))


def verdict_replies(clips: DataFrame) -> DataFrame:
    """A validator's replies: ids near the clip's sentences, some reversed, some far off, some unreadable."""
    i = F.col("clip_id") % 10_000_000
    a, b = i + i % 3 - 1, i + 3 + i % 4
    flip = i % 5 == 0
    data = F.to_json(F.struct(F.when(flip, b).otherwise(a).alias("start_id"), F.when(i % 11 == 0, b + 5000).when(flip, a).otherwise(b).alias("end_id"), (i % 4 != 0).alias("complete"), F.lit("so").alias("reason")))
    return clips.select("video_id", "clip_id", F.when(i % 7 == 0, "no idea").otherwise(F.concat(F.lit("<think>{}</think>```json\n"), data, F.lit("\n```"))).alias("reply"))


@query(f"""WITH {transcripts._CLIPS},
vd AS (SELECT clip_id, clip_id % 10000000 AS i FROM cl),
v1 AS (SELECT clip_id, i + i % 3 - 1 AS a0, CASE WHEN i % 11 = 0 THEN i + 3 + i % 4 + 5000 WHEN i % 5 = 0 THEN i + i % 3 - 1 ELSE i + 3 + i % 4 END AS x0, CASE WHEN i % 5 = 0 THEN i + 3 + i % 4 ELSE i + i % 3 - 1 END AS y0, i % 4 <> 0 AS complete FROM vd WHERE i % 7 <> 0),
v2 AS (SELECT clip_id, least(y0, x0) AS v0, greatest(y0, x0) AS v1, complete FROM v1),
cx AS MATERIALIZED (SELECT sn.clip_id AS cid, nb.* FROM sn JOIN nb ON nb.video_id = sn.video_id AND nb.end_ms >= sn.s - 20000 AND nb.start_ms <= sn.e + 20000 WHERE sn.e > sn.s),
b0 AS (SELECT sn.video_id, sn.clip_id, sn.s, sn.e, sn.det_s, sn.det_e, sn.e + 15000 AS cap, v2.v1, v2.complete, a.start_ms AS a_start, a.prev_end AS a_prev, b.id AS b_id, b.end_ms AS b_end, b.next_start AS b_next,
  a.id IS NOT NULL AND b.id IS NOT NULL AS judged FROM sn LEFT JOIN v2 USING (clip_id) LEFT JOIN cx a ON a.cid = sn.clip_id AND a.id = v2.v0 LEFT JOIN cx b ON b.cid = sn.clip_id AND b.id = v2.v1 WHERE sn.e > sn.s),
b1 AS (SELECT *, CASE WHEN judged THEN greatest(a_start - 150, coalesce(a_prev + 10, 0), 0) END AS llm_s FROM b0),
b2 AS (SELECT b1.clip_id, max(cx.id) AS eid FROM b1 JOIN cx ON cx.cid = b1.clip_id AND judged AND NOT complete AND cx.id <= v1 AND cx.ends_with_punctuation AND cx.start_ms >= llm_s GROUP BY 1),
b3 AS (SELECT b1.*, coalesce(eid <> b_id, false) AS moved, x.end_ms AS m_end, x.next_start AS m_next FROM b1 LEFT JOIN b2 USING (clip_id) LEFT JOIN cx x ON x.cid = b1.clip_id AND x.id = eid),
b4 AS (SELECT *, coalesce(llm_s, det_s) AS new_s, CASE WHEN judged THEN greatest(least(CASE WHEN moved THEN m_end ELSE b_end END + 300, coalesce(CASE WHEN moved THEN m_next ELSE b_next END - 10, 1000000000000)), llm_s + 500) ELSE det_e END AS raw_e FROM b3),
b5 AS (SELECT b4.*, (SELECT arg_max(cx.end_ms + 300, cx.id) FROM cx WHERE cx.cid = b4.clip_id AND cx.end_ms + 300 <= cap AND cx.ends_with_punctuation) AS capped FROM b4),
b6 AS (SELECT *, CASE WHEN raw_e > cap THEN coalesce(capped, CASE WHEN det_e <= cap THEN det_e END) ELSE raw_e END AS new_e FROM b5),
b7 AS (SELECT b6.*, new_e - new_s AS dur, (SELECT min(cx.start_ms) FROM cx WHERE cx.cid = b6.clip_id AND cx.start_ms >= new_e - 90000 AND cx.start_ms >= new_s) AS trim FROM b6)
SELECT video_id, clip_id, CASE WHEN new_e IS NULL THEN s WHEN dur > 90000 AND trim IS NOT NULL THEN greatest(new_s, trim - 150) ELSE new_s END AS refined_s, coalesce(new_e, e) AS refined_e,
  CASE WHEN new_e IS NULL THEN 'rejected_extension' WHEN dur > 90000 AND trim IS NULL THEN 'rejected_duration' WHEN dur < 1000 THEN 'rejected_short' ELSE 'refined' END AS refine_status,
  CASE WHEN moved THEN 'earlier_ending' WHEN judged THEN 'validated' ELSE 'snap' END || CASE WHEN raw_e > cap AND (capped IS NOT NULL OR new_e IS NULL) THEN '+capped' ELSE '' END || CASE WHEN dur > 90000 AND trim IS NOT NULL THEN '+trimmed' ELSE '' END AS method FROM b7
UNION ALL SELECT video_id, clip_id, s, e, 'rejected_range', '' FROM cl WHERE e <= s""")
def verdict_clips(spark, d):
    """Clips refined by a validator's sentence ids, by snapping where it gave none."""
    c, s = transcripts.clips(spark, d)
    return intervals.refine(c, s, verdicts=adapters.boundary_verdicts(verdict_replies(c)))


def join_proposals(s: DataFrame) -> DataFrame:
    i = F.col("proposal_id")
    more = F.when(i % 12 == 0, F.array(i + 12, i + 13, i + 1)).when(i % 12 == 4, F.array(i + 400, i + 401)).when(i % 24 == 8, F.array(F.lit(9_000_000).cast("long"))).when(i % 24 == 20, F.array(i, i + 1))
    return fixtures.proposals(s).withColumn("join_ids", more)


@query(f"""WITH {sql.PROPOSALS},
ji AS (SELECT video_id, proposal_id, lo, hi, n_sentences, s, e, reject_reason, CASE WHEN proposal_id % 12 = 0 THEN [proposal_id + 12, proposal_id + 13, proposal_id + 1] WHEN proposal_id % 12 = 4 THEN [proposal_id + 400, proposal_id + 401]
  WHEN proposal_id % 24 = 8 THEN [9000000] WHEN proposal_id % 24 = 20 THEN [proposal_id, proposal_id + 1] END AS js FROM p),
jx AS (SELECT video_id, proposal_id, lo, hi, unnest(js) AS j FROM ji),
jn AS (SELECT jx.video_id, jx.proposal_id, count(*) AS n_joins, min(s.start_ms) AS join_s, max(s.end_ms) AS join_e, string_agg(s.id::VARCHAR, ',' ORDER BY s.id) AS joined FROM jx JOIN s ON s.video_id = jx.video_id AND s.id = j WHERE j NOT BETWEEN lo AND hi GROUP BY ALL),
jo AS (SELECT ji.*, coalesce(n_joins, 0) AS n_joins, join_s, join_e, joined FROM ji LEFT JOIN jn USING (video_id, proposal_id)),
jk AS (SELECT jo.video_id, jo.proposal_id, string_agg(x.id::VARCHAR, ',' ORDER BY x.id) AS own FROM jo JOIN s x ON x.video_id = jo.video_id AND x.id BETWEEN lo AND hi GROUP BY ALL)
SELECT jo.video_id, jo.proposal_id, n_sentences, n_joins, join_s, join_e, nullif(concat_ws(',', own, joined), '') AS ids, CASE WHEN n_sentences = 0 OR n_sentences > 120 THEN reject_reason WHEN js IS NOT NULL AND n_joins = 0 THEN 'unknown joins'
  WHEN js IS NOT NULL AND least(abs(join_s - e), abs(s - join_e)) > 60000 THEN 'joins too far' ELSE reject_reason END AS reject_reason FROM jo LEFT JOIN jk USING (video_id, proposal_id)""")
def join_validation(spark, d):
    """Proposals that join passages which are not contiguous."""
    # ids and times only: no text is asked for
    s = written(transcripts.sents(spark, d).select("video_id", "id", "start_ms", "end_ms"), "shared").withColumn("text", F.lit(""))
    v = C.validate(join_proposals(s), s)
    ids = F.array_join("sentence_ids", ",")
    return v.select("video_id", "proposal_id", "n_sentences", "n_joins", "join_s", "join_e", F.when(ids != "", ids).alias("ids"), "reject_reason")


@query(f"WITH {sql.PROPOSALS}, z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY proposal_id) AS n FROM p WHERE reject_reason IS NULL) SELECT video_id, proposal_id, lo, hi, s, e FROM z WHERE n IN (1, 2, 3, 4, 5)")
def capped_candidates(spark, d):
    """The first accepted proposals of each video, up to the most that discovery takes."""
    s = written(transcripts.sents(spark, d), "shared")
    return C.first_accepted(C.validate(fixtures.proposals(s), s), 5).select("video_id", "proposal_id", "lo", "hi", "s", "e")


_WINNERS = transcripts._DIVERSE + """,
wn AS (SELECT z.video_id, z.cand_id, z.total, z.rk, k.s, k.e, k.hook, k.main_idea, CASE WHEN z.cand_id % 16 = 0 THEN '' ELSE 'why ' || (z.cand_id % 10)::VARCHAR END AS rationale FROM z JOIN k ON k.video_id = z.video_id AND k.cand_id = z.cand_id WHERE z.kept AND k.e - k.s >= 20000),
wi AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rk, cand_id) AS clip_number FROM wn)"""


@query(f"""WITH {_WINNERS},
{sql.CHUNKS[len(sql.WORDS):].lstrip().lstrip(',')},
sc2 AS (SELECT wi.video_id, wi.cand_id, string_agg(c.chunk_index::VARCHAR, ',' ORDER BY c.chunk_index) AS chunks FROM wi JOIN c ON c.video_id = wi.video_id AND c.end_ms >= wi.s AND c.start_ms <= wi.e GROUP BY ALL)
SELECT wi.video_id, clip_number, wi.cand_id, e - s AS duration_ms, nullif(hook, '') AS hook, nullif(array_to_string(list_filter([rationale, CASE WHEN main_idea <> '' THEN 'idea: ' || main_idea[1:200] ELSE '' END], lambda x: x <> ''), ' ')[1:600], '') AS reason,
  nullif((CASE WHEN hook <> '' THEN hook ELSE main_idea END)[1:80], '') AS title, coalesce(chunks, '') AS source_chunks FROM wi LEFT JOIN sc2 USING (video_id, cand_id)""")
def inserted_clips(spark, d):
    return inserted(spark, d).select("video_id", "clip_number", "cand_id", "duration_ms", "hook", "reason", "title", F.array_join("source_chunks", ",").alias("source_chunks"))


def inserted(spark: SparkSession, d: str) -> DataFrame:
    """The selected candidates as numbered clips, with the chunks they overlap."""
    c = transcripts.cands(spark, d)
    best = C.select_diverse(c, sql.CAMPAIGN).where("status = 'selected'")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("total"), "cand_id"))
    why = F.when(F.col("cand_id") % 16 == 0, "").otherwise(F.concat(F.lit("why "), (F.col("cand_id") % 10).cast("string")))
    rows = best.withColumn("rank", rank).join(c.select("video_id", "cand_id", "s", "e", "hook", "main_idea"), ["video_id", "cand_id"]).withColumn("rationale", why)
    return C.insert_winners(rows, segment.silence_chunks(transcripts.words(spark, d)), 20_000)


@query(f"""WITH {media._MERGED},
li AS (SELECT user_id, s, e FROM mr),
le AS (SELECT user_id, sum(e - s) AS len FROM li GROUP BY 1),
it AS (SELECT a.user_id, b.user_id AS other, sum(greatest(least(a.e, b.e) - greatest(a.s, b.s), 0)) AS inter FROM li a JOIN li b ON b.user_id = a.user_id + 1 GROUP BY ALL)
SELECT it.user_id AS list_a, other AS list_b, floor(CASE WHEN x.len + y.len - inter > 0 THEN inter / (x.len + y.len - inter)::DOUBLE ELSE 0 END * 1000000 + 0.5) / 1000000.0::DOUBLE AS iou,
  floor(CASE WHEN least(x.len, y.len) > 0 THEN inter / least(x.len, y.len)::DOUBLE ELSE 0 END * 1000000 + 0.5) / 1000000.0::DOUBLE AS coverage FROM it JOIN le x ON x.user_id = it.user_id JOIN le y ON y.user_id = other""")
def range_list_iou(spark, d):
    """Overlap of whole lists of ranges, of each user's against the next user's."""
    m = media.merged_ranges(spark, d)
    g = m.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("r"))
    o = g.select((F.col("user_id") - 1).alias("user_id"), F.col("user_id").alias("list_b"), F.col("r").alias("q"))
    j = g.join(o, "user_id")
    return j.select(F.col("user_id").alias("list_a"), "list_b", half_up(iou(F.col("r"), F.col("q")), 6).alias("iou"), half_up(coverage(F.col("r"), F.col("q")), 6).alias("coverage"))


_CLIP_CUES = transcripts._CUES[len(sql.WORDS) :].replace("FROM w)", "FROM mw)").replace("JOIN w USING", "JOIN mw USING").replace("length(word) + 1 AS size", "length(display) + 1 AS size").replace("string_agg(word", "string_agg(display")


@query(rf"""WITH {sql.CHUNKS},
r AS (SELECT video_id * 10000000 + (chunk_index // 2) AS clip_id, video_id, start_ms AS s, end_ms - 400 AS e FROM c),
r2 AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY clip_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, row_number() OVER (PARTITION BY clip_id ORDER BY s) AS kk FROM r),
mm AS (SELECT clip_id, w.pos, arg_min(word, kk) AS word, arg_min(start_ms - s + o, kk) AS start_ms, arg_min(end_ms - s + o, kk) AS end_ms
  FROM r2 JOIN w ON w.video_id = r2.video_id AND start_ms >= s AND end_ms <= e + 500 GROUP BY ALL),
mw AS MATERIALIZED (SELECT clip_id AS video_id, pos, word, CASE WHEN lower(word) = 'the' THEN 'the (article)' ELSE word END AS display, start_ms, end_ms FROM mm){_CLIP_CUES}
SELECT video_id AS clip_id, row_number() OVER (PARTITION BY video_id ORDER BY first_word) AS cue_id, start_ms, end_ms, n_words, text FROM q5""")
def clip_cues(spark, d):
    """Cues of clips on output time, with the glossary's display texts."""
    w = transcripts.words(spark, d)
    shown = captions.glossary_display(w, [("the", "the (article)")])
    return captions.clip_cues(shown, transcripts.chunk_ranges(w))


@query(transcripts._SRT + " SELECT clip_id, (n - 1) // 80 AS burn_pass, count(*) AS lines, min(start_ms) AS start_ms FROM sl GROUP BY ALL")
def burn_passes(spark, d):
    g = captions.burn_passes(transcripts.srt_lines(spark, d)).groupBy("clip_id", "burn_pass")
    return g.agg(F.count("*").alias("lines"), F.min("start_ms").alias("start_ms"))


@query(f"""WITH {transcripts._OUTLINE} SELECT video_id, 'section' AS level, "window" AS idx, start_ms, end_ms, title, start_id::VARCHAR || ':' || end_id::VARCHAR AS content FROM ol
UNION ALL SELECT video_id, 'video', 0, min(start_ms), max(end_ms), 'video', count(*)::VARCHAR FROM ol GROUP BY 1""")
def outline_rows(spark, d):
    """The outline's two levels as rows; of the JSON content the ids and the number of sections are read back."""
    o = sinks.outline_rows(segment.outline_windows(transcripts.sents(spark, d)))
    j = F.from_json("content", "struct<start_id:bigint,end_id:bigint,sections:bigint>")
    told = F.when(F.col("level") == "video", j["sections"].cast("string")).otherwise(F.concat(j["start_id"].cast("string"), F.lit(":"), j["end_id"].cast("string")))
    return o.withColumn("content", told)


@query(rf"""WITH {sql.WORDS} SELECT video_id, pos, word, 'THE' AS display FROM w WHERE lower(word) = 'the' AND word <> 'THE'""")
def glossary_corrections(spark, d):
    w = transcripts.words(spark, d).select("video_id", "pos", "word")
    return sinks.glossary_corrections(captions.glossary_display(w, [("the", "THE")]))


@query(f"""WITH {transcripts._REFINED}
SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN refined_s ELSE s END AS start_ms, CASE WHEN clip_id % 3 = 0 THEN refined_e ELSE e END AS end_ms, CASE WHEN clip_id % 2 = 0 THEN refined_e - refined_s + 1000 ELSE e - s END AS output_ms,
  CASE WHEN clip_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_ranges FROM refined JOIN cl USING (clip_id)""")
def report_rows(spark, d):
    """The report's rows: clips with refined bounds or without, with source ranges or without."""
    c, s = transcripts.clips(spark, d)
    r = intervals.refine(c, s).select("clip_id", "refined_s", "refined_e").join(c.select("clip_id", "s", "e"), "clip_id")
    third, even = F.col("clip_id") % 3 == 0, F.col("clip_id") % 2 == 0
    ranges = F.when(even, F.array(F.struct(F.col("refined_s").alias("s"), F.col("refined_e").alias("e")), F.struct((F.col("refined_e") + 5000).alias("s"), (F.col("refined_e") + 6000).alias("e"))))
    rows = r.withColumn("ranges", ranges).withColumns({x: F.when(third, F.col(x)) for x in ("refined_s", "refined_e")})
    return sinks.clip_report(rows).select("clip_id", "start_ms", "end_ms", "output_ms", F.size("source_ranges").cast("long").alias("n_ranges"))


@query(f"""WITH {_SENTENCES_AND_CHUNKS} SELECT video_id, chunk_index AS pos, printf('[%02d:%02d:%02d --> %02d:%02d:%02d] ', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60) || text AS line FROM c""")
def transcript_text(spark, d):
    c = segment.silence_chunks(transcripts.words(spark, d))
    return sinks.transcript_lines(c.withColumn("pos", F.col("chunk_index")))


@query(r"""WITH h AS (SELECT event_id, (event_id % 9)::VARCHAR AS m FROM events),
r AS (SELECT event_id, m, event_id % 4 AS k FROM h)
SELECT event_id AS chunk_id, 0 AS n, '00:0' || m || ':00' AS "start", '00:0' || m || ':45' AS "end", 45.0::DOUBLE AS duration_s, 'hook ' || m AS hook FROM r WHERE k IN (0, 1)
UNION ALL SELECT event_id, 3, '00:0' || m || ':10', '00:1' || m || ':10.5', 600.5::DOUBLE, NULL FROM r WHERE k = 0""")
def extracted_clips(spark, d):
    """Clips that a model extracted: a short one, one without an end and an unreadable one are left out, as are replies without JSON."""
    i = F.col("event_id")
    m = (i % 9).cast("string")
    clip = lambda a, b, h: F.concat(F.lit('{"start_time": "'), a, F.lit('", "end_time": "'), b, F.lit('"'), h, F.lit("}"))
    good = clip(F.concat(F.lit("00:0"), m, F.lit(":00")), F.concat(F.lit("00:0"), m, F.lit(":45")), F.concat(F.lit(', "hook": "hook '), m, F.lit('"')))
    short = clip(F.lit("00:00:00"), F.lit("00:00:14"), F.lit(""))
    late = clip(F.concat(F.lit("00:0"), m, F.lit(":10")), F.concat(F.lit("00:1"), m, F.lit(":10.5")), F.lit(""))
    many = F.concat(F.lit("["), good, F.lit(","), short, F.lit(',{"start_time": "00:00:09"},'), late, F.lit(',{"start_time": "soon", "end_time": "later"}]'))
    reply = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), many, F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit("One: "), good)).when(i % 4 == 2, "[]").otherwise("nothing strong here")
    from .registry import table

    return C.extracted_clips(table(spark, d, "events").select(i.alias("chunk_id"), reply.alias("reply")))


@query(f"""WITH {sql.SENTENCES}, {media._SPIKES.strip()},
x AS (SELECT spk.key AS video_id, peak_ms, min(s.start_ms) AS s, max(s.end_ms) AS e FROM spk JOIN s ON s.video_id = spk.key AND s.end_ms >= peak_ms - 25000 AND s.start_ms <= peak_ms + 10000 GROUP BY ALL),
y AS (SELECT x.video_id, peak_ms, s, e, sum(w.end_ms - w.start_ms)::BIGINT AS speech_ms FROM x JOIN w ON w.video_id = x.video_id AND w.start_ms < e AND w.end_ms > s GROUP BY ALL)
SELECT video_id, peak_ms, CASE WHEN video_id % 2 = 0 THEN 'cheers at ' || peak_ms::VARCHAR END AS hook, CASE WHEN video_id % 2 = 0 THEN 'a score' END AS main_idea, NULL::VARCHAR AS payoff FROM y WHERE speech_ms * 10 >= (e - s) * 3 AND e - s BETWEEN 15000 AND 90000""")
def enriched_cues(spark, d):
    """Audio cues with the texts a model wrote for some; an empty text changes nothing."""
    cues = written(media.event_cues(spark, d), "shared")
    hook = F.concat(F.lit("cheers at "), F.col("peak_ms").cast("string"))
    replies = cues.where("video_id % 2 = 0").select("video_id", "peak_ms", hook.alias("hook"), F.lit("a score").alias("main_idea"), F.lit("").alias("payoff"))
    return C.enriched(cues, replies).select("video_id", "peak_ms", "hook", "main_idea", "payoff")


@query(f"""WITH {transcripts._CUES},
cu AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY first_word) AS n, n_words, text FROM q5)
SELECT video_id * 100000 + n AS cue_id, CASE WHEN n % 3 = 0 THEN lower(text) ELSE text END AS text, CASE WHEN n % 3 = 1 THEN 'word count differs' END AS error FROM cu""")
def caption_edits(spark, d):
    """Edited cue texts: of the same number of words, of another, and none."""
    from cuewright.operators import editing

    c = captions.caption_cues(transcripts.words(spark, d)).select((F.col("video_id") * 100_000 + F.col("cue_id")).alias("cue_id"), "text", F.col("cue_id").alias("n"))
    edits = c.where("n % 3 <> 2").select("cue_id", F.when(F.col("n") % 3 == 0, F.lower("text")).otherwise(F.concat("text", F.lit(" more"))).alias("text"))
    out = editing.apply_caption_text(c.select("cue_id", X.split_words(F.col("text")).alias("words")), edits)
    return out.select("cue_id", F.array_join("words", " ").alias("text"), "error")
