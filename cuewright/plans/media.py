"""Queries over energy series, vectors, speaker turns, face samples, ranges and state logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions import text as X
from cuewright.functions.numeric import half_up
from cuewright.operators import adapters, framing, intervals, segment, signal, similarity, speakers, state, vector, vector_index
from cuewright.storage import new_path
from cuewright.sources import transcript

from . import sql
from .registry import query, table


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time in milliseconds."""
    e = table(spark, d, "events")
    return e.withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Each user's values in time order as an amplitude series: (key, pos, x)."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.coalesce("value", F.lit(0.0)).alias("x"))


_FRAMES = r"""
sm AS (SELECT user_id AS key, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS pos, coalesce(value, 0) AS x FROM events),
f0 AS (SELECT key, pos // 2 AS frame, count(*) AS n, avg(x * x) AS power FROM sm GROUP BY ALL),
f AS (SELECT key, frame, sqrt(power + 1e-12) AS rms, floor(20 * log10(greatest(sqrt(power + 1e-12), 1e-4)) * 1000000 + 0.5) / 1000000.0::DOUBLE AS db FROM f0 WHERE n = 2)
"""
_BASE = (
    _FRAMES
    + r""",
bl AS (SELECT *, floor(median(db) OVER (PARTITION BY key ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) * 1000000 + 0.5) / 1000000.0::DOUBLE AS base FROM f)
"""
)
_SPIKES = (
    _BASE
    + r""",
ac AS (SELECT *, floor((db - base) * 1000000 + 0.5) / 1000000.0::DOUBLE AS rise FROM bl),
ai AS (SELECT *, frame - row_number() OVER (PARTITION BY key ORDER BY frame) AS island FROM ac WHERE rise >= 8 AND db > floor((20 * log10(1e-4) + 3) * 1000000 + 0.5) / 1000000.0::DOUBLE),
rn AS (SELECT key, min(frame) * 200 AS s, (max(frame) + 1) * 200 AS e, arg_max(frame, db * 1000000000 - frame) * 200 + 100 AS peak_ms, arg_max(rise, db * 1000000000 - frame) AS rise FROM ai GROUP BY key, island),
ev AS (SELECT key, s, CASE WHEN e - s > 8000 THEN s + 8000 ELSE e END AS e, peak_ms, floor(rise * 100 + 0.5) / 100.0::DOUBLE AS energy_increase,
  floor((CASE WHEN e - s > 8000 THEN 0.6::DOUBLE ELSE 1 END) * least(greatest((rise - 8 + 6) / 12, 0.05::DOUBLE), 1) * 1000 + 0.5) / 1000.0::DOUBLE AS confidence FROM rn WHERE e - s >= 400),
e1 AS (SELECT *, coalesce((s - lag(e) OVER (PARTITION BY key ORDER BY s) > 1000)::INT, 1) AS fresh FROM ev),
e2 AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY s) AS island FROM e1),
e3 AS (SELECT *, coalesce(energy_increase > max(energy_increase) OVER (PARTITION BY key, island ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS record FROM e2),
spk AS (SELECT key, min(s)::BIGINT AS s, arg_max(e, s)::BIGINT AS e, (arg_max(peak_ms, s) FILTER (WHERE record))::BIGINT AS peak_ms, max(energy_increase) AS energy_increase, max(confidence) FILTER (WHERE record) AS confidence, count(*) AS n FROM e3 GROUP BY key, island)
"""
)


@query(f"WITH {_FRAMES} SELECT key, frame, floor(rms * 1000000 + 0.5) / 1000000.0::DOUBLE AS rms, db FROM f")
def energy_frames(spark, d):
    return signal.frames(samples(spark, d), 2).select("key", "frame", half_up(F.col("rms"), 6).alias("rms"), "db")


@query(f"WITH {_BASE} SELECT key, frame, db, base FROM bl")
def rolling_median_baseline(spark, d):
    return signal.baseline(signal.frames(samples(spark, d), 2)).select("key", "frame", "db", "base")


def spikes(spark: SparkSession, d: str) -> DataFrame:
    return signal.spikes(signal.baseline(signal.frames(samples(spark, d), 2)))


@query(f"WITH {_SPIKES} SELECT * FROM spk")
def spike_events(spark, d):
    return spikes(spark, d)


@query(f"""WITH {sql.SENTENCES}, {_SPIKES.strip()},
x AS (SELECT spk.key AS video_id, peak_ms, confidence, min(s.id) AS first_id, max(s.id) AS last_id, min(s.start_ms) AS s, max(s.end_ms) AS e
  FROM spk JOIN s ON s.video_id = spk.key AND s.end_ms >= peak_ms - 25000 AND s.start_ms <= peak_ms + 10000 GROUP BY ALL),
y AS (SELECT x.video_id, peak_ms, confidence, first_id, last_id, s, e, sum(w.end_ms - w.start_ms)::BIGINT AS speech_ms FROM x JOIN w ON w.video_id = x.video_id AND w.start_ms < e AND w.end_ms > s GROUP BY ALL)
SELECT video_id, peak_ms, first_id, last_id, s, e, speech_ms, floor((1.0::DOUBLE - 0.5 * confidence) * 1000 + 0.5) / 1000.0::DOUBLE AS uncertainty
FROM y WHERE speech_ms * 10 >= (e - s) * 3 AND e - s BETWEEN 15000 AND 90000""")
def event_cues(spark, d):
    w = transcript.word_timeline(table(spark, d, "documents"))
    return signal.event_cues(spikes(spark, d), segment.sentences(w), w).drop("rationale", "provenance")


_VIDEO = "label"


def clip_and_chunk_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every 20th vector is a clip, all are chunks, a second for each id; the label is the video. A clip comes of its own and the next chunk."""
    e = table(spark, d, "embeddings").withColumnRenamed("label", "video_id")
    i = F.col("vec_id")
    clips = e.where("vec_id % 20 = 0").select("video_id", i.alias("clip_id"), "embedding", F.array(i, i + 1).alias("source_chunks"), (i * 1000).alias("e"))
    return clips, e.select("video_id", i.alias("chunk_id"), "embedding", (i * 1000).alias("start_ms"))


_TOPK = r"""
sim AS (SELECT q.label AS video_id, q.vec_id AS clip_id, c.vec_id AS chunk_id, floor(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) * 1000000 + 0.5) / 1000000.0::DOUBLE AS similarity
  FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 20 = 0),
tk AS (SELECT *, (row_number() OVER (PARTITION BY video_id, clip_id ORDER BY similarity DESC, chunk_id))::INT AS rank FROM sim)
"""


@query(f"WITH {_TOPK} SELECT * FROM tk WHERE rank <= 4 AND similarity >= 0.05")
def vector_topk(spark, d):
    return vector.top_k(*clip_and_chunk_vectors(spark, d), k=4, threshold=0.05)


@query()
def approximate_topk(spark, d):
    """The same search through a stored inverted file; its recall against vector_topk and the pairs it scores are tested.

    These vectors have no clusters, so most cells are probed; codes leave under a fifth of the pairs to score."""
    clips, chunks = clip_and_chunk_vectors(spark, d)
    path = new_path(spark, "vector-index")
    vector_index.create(chunks, path)
    return vector_index.search(clips, path, k=4, threshold=0.05, probes=PROBES, refine=REFINE)


PROBES, REFINE = 27, 36


def _all_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every vector, and one of eight a second time with a small change, as a near copy of another video's take."""
    e = table(spark, d, "embeddings").select((F.col("label") % 3).alias("video_id"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    moved = F.transform("v", lambda x, i: x + F.when(i % 8 == F.col("id") % 8, 0.05).otherwise(0.0))
    return e.unionByName(e.where("id % 8 = 0").select("video_id", (F.col("id") + 1_000_000).alias("id"), moved.alias("v")))


_NEAR = """
e AS (SELECT label % 3 AS video_id, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
al AS (SELECT * FROM e UNION ALL SELECT video_id, id + 1000000, list_transform(v, lambda x, i: x + CASE WHEN (i - 1) % 8 = id % 8 THEN 0.05 ELSE 0.0 END) FROM e WHERE id % 8 = 0)"""


@query(f"""WITH {_NEAR}
SELECT a.video_id, a.id AS id_a, b.id AS id_b, floor(list_cosine_similarity(a.v, b.v) * 1000000 + 0.5) / 1000000.0::DOUBLE AS similarity
FROM al a JOIN al b ON a.video_id = b.video_id AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.92""")
def similar_vectors(spark, d):
    """Pairs of one video's vectors that count as the same content, by the exact threshold join."""
    pairs = similarity.cosine_pairs(_all_vectors(spark, d), "video_id", "id", "v", 0.92)
    return pairs.select("video_id", "id_a", "id_b", half_up(F.col("similarity"), 6).alias("similarity"))


@query(f"""WITH {_NEAR}
SELECT a.video_id, a.id AS id_a, b.id AS id_b FROM al a JOIN al b ON a.video_id = b.video_id AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.35""")
def related_vectors(spark, d):
    """The same join at a threshold that many pairs reach."""
    return similarity.cosine_pairs(_all_vectors(spark, d), "video_id", "id", "v", 0.35).drop("similarity")


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """Related segments: the top chunks of each clip, its own ones excluded after the limit, with a decision by similarity and gap."""
    clips, chunks = clip_and_chunk_vectors(spark, d)
    return vector.related_segments(clips, chunks, 4, 0.05, lambda p: adapters.classify_continuations(p, 0.1, 300_000))


_BRIDGE = f"""{_TOPK},
br AS (SELECT *, (chunk_id - clip_id) * 1000 AS gap_ms, CASE WHEN similarity < 0.1 THEN 'noise' WHEN (chunk_id - clip_id) * 1000 BETWEEN 0 AND 300000 THEN 'stitch' ELSE 'standalone' END AS decision
  FROM tk WHERE rank <= 4 AND similarity >= 0.05 AND chunk_id <> clip_id AND chunk_id <> clip_id + 1)"""


@query(f"WITH {_BRIDGE} SELECT *, decision = 'stitch' AS confirmed FROM br")
def related_segments(spark, d):
    return bridge(spark, d)


@query(f"""WITH {_BRIDGE}
SELECT clip_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY chunk_id) AS chunk_ids, count(*) AS n, max(similarity) AS best FROM br
JOIN embeddings c ON c.vec_id = br.chunk_id JOIN embeddings q ON q.vec_id = br.clip_id AND q.label = br.video_id WHERE decision = 'stitch' GROUP BY 1""")
def confirmed_segments(spark, d):
    """Confirmed chunks of each clip, through the bridge joined with both sides."""
    b = bridge(spark, d).where("confirmed")
    e = table(spark, d, "embeddings")
    clip = e.select(F.col("vec_id").alias("clip_id"), F.col("label").alias("video_id"))
    chunk = e.select(F.col("vec_id").alias("chunk_id"))
    g = b.join(chunk, "chunk_id").join(clip, ["clip_id", "video_id"]).groupBy("clip_id")
    return g.agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("chunk_ids"), F.count("*").alias("n"), F.max("similarity").alias("best"))


@query(f"""WITH {_BRIDGE} SELECT q.label AS video_id, br.clip_id, br.chunk_id, similarity, decision, row_number() OVER (PARTITION BY br.clip_id ORDER BY similarity DESC, br.chunk_id) AS n
FROM br JOIN embeddings q ON q.vec_id = br.clip_id JOIN embeddings c ON c.vec_id = br.chunk_id""")
def decision_report(spark, d):
    b = bridge(spark, d).drop("video_id")
    e = table(spark, d, "embeddings")
    j = b.join(e.select(F.col("vec_id").alias("clip_id"), F.col("label").alias("video_id")), "clip_id").join(e.select(F.col("vec_id").alias("chunk_id")), "chunk_id")
    n = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("similarity"), "chunk_id")).cast("long")
    return j.select("video_id", "clip_id", "chunk_id", "similarity", "decision", n.alias("n"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select("user_id", F.col("ms").alias("s"), (F.col("ms") + F.col("event_id") % 90 * 60_000).alias("e"))


_MERGED = r"""
rg AS (SELECT user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + event_id % 90 * 60000 AS e FROM events),
r1 AS (SELECT *, coalesce((s > max(e) OVER v + 50)::INT, 1) AS fresh FROM rg WINDOW v AS (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r2 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r1),
mr AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM r2 GROUP BY user_id, island)
"""


@query(f"WITH {_MERGED} SELECT * FROM mr")
def merged_ranges(spark, d):
    return intervals.merge_ranges(ranges(spark, d), "user_id")


@query(f"""WITH {_MERGED}, o AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS out_s FROM mr)
SELECT *, out_s + e - s AS out_e FROM o""")
def output_timeline(spark, d):
    return intervals.output_timeline(merged_ranges(spark, d), "user_id")


def diarization(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as speech: (conv_id, seg_id, speaker, s, e)."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    dur, gap = (F.length("text") * 60).cast("long"), F.col("turn") % 3 * 300
    before = F.coalesce(F.sum(dur + gap).over(w), F.lit(0))
    return c.select("conv_id", F.col("turn").alias("seg_id"), F.col("role").alias("speaker"), before.alias("s"), (before + dur).alias("e"))


_DIAR = r"""
di AS (SELECT conv_id, turn AS seg_id, role AS speaker, coalesce(sum(length(text) * 60 + turn % 3 * 300) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, length(text) * 60 AS dur FROM conversations),
dg AS (SELECT conv_id, seg_id, speaker, s, s + dur AS e FROM di)
"""
_TURNS = (
    _DIAR
    + r""",
t1 AS (SELECT *, (speaker IS DISTINCT FROM lag(speaker) OVER v OR row_number() OVER v = 1)::INT AS turned FROM dg WINDOW v AS (PARTITION BY conv_id ORDER BY s, e, speaker)),
t2 AS (SELECT *, sum(turned) OVER (PARTITION BY conv_id ORDER BY s, e, speaker ROWS UNBOUNDED PRECEDING) AS run FROM t1),
t3 AS (SELECT *, coalesce((s - max(e) OVER (PARTITION BY conv_id, run ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 500)::INT, 1) AS fresh FROM t2),
t4 AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, run ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM t3),
tn AS (SELECT conv_id, speaker, min(s) AS s, max(e) AS e, count(*) AS n FROM t4 GROUP BY conv_id, run, part, speaker HAVING max(e) - min(s) >= 1500)
"""
)


@query(f"WITH {_TURNS} SELECT * FROM tn")
def stable_turns(spark, d):
    return speakers.stable_turns(diarization(spark, d))


@query(f"""WITH {_DIAR},
pt AS (SELECT conv_id, unnest(range(0, max(e) + 1, 5000)) AS t FROM dg GROUP BY 1),
sp AS (SELECT pt.conv_id, pt.t, arg_min(speaker, seg_id) AS speaker FROM pt LEFT JOIN dg ON dg.conv_id = pt.conv_id AND pt.t BETWEEN s AND e GROUP BY ALL),
ch AS (SELECT *, lag(speaker) OVER v AS prev, row_number() OVER v AS rn FROM sp WINDOW v AS (PARTITION BY conv_id ORDER BY t))
SELECT conv_id, t, speaker, CASE WHEN rn = 1 THEN speaker IS NOT NULL ELSE speaker IS DISTINCT FROM prev END AS turn_starts FROM ch""")
def speaker_for_time(spark, d):
    """The speaker every five seconds, and whether a turn starts there."""
    s = diarization(spark, d)
    p = s.groupBy("conv_id").agg(F.max("e").alias("end")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end"), F.lit(5000).cast("long"))).alias("t"))
    spoken = speakers.speaker_at(p, s, "t", "t").select("conv_id", "t", "speaker")
    changed = speakers.change_points(spoken, "t").select("conv_id", "t", F.lit(True).alias("c"))
    return spoken.join(changed, ["conv_id", "t"], "left").select("conv_id", "t", "speaker", F.coalesce("c", F.lit(False)).alias("turn_starts"))


@query(f"""WITH {_TURNS},
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, speaker) AS turn FROM tn),
b AS (SELECT a.*, EXISTS (SELECT 1 FROM a x WHERE x.conv_id = a.conv_id AND x.speaker <> a.speaker AND x.s < a.e AND x.e > a.s) AS crossed FROM a),
l AS (SELECT conv_id, list({{'turn': turn, 's': s, 'speaker': speaker, 'crossed': crossed}} ORDER BY turn) AS xs FROM b WHERE speaker IN ('user', 'assistant') GROUP BY 1),
f AS (SELECT conv_id, list_reduce(list_transform(xs, lambda x: [x]), lambda k, y: CASE WHEN y[1].speaker = k[-1].speaker OR y[1].crossed OR y[1].s - k[-1].s < 2000 THEN k ELSE list_concat(k, y) END) AS kept FROM l),
u AS (SELECT conv_id, unnest(kept) AS z FROM f)
SELECT conv_id, z.s AS t, z.speaker AS speaker, CASE z.speaker WHEN 'assistant' THEN 1 ELSE 0 END AS track_id FROM u""")
def speaker_switches(spark, d):
    return speakers.switches(speakers.stable_turns(diarization(spark, d)), {"user": 0, "assistant": 1})


def faces(spark: SparkSession, d: str) -> DataFrame:
    """Face samples, a quarter of a second apart: each user's events in order. No face where the count is 0."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    i, u = F.col("event_id"), F.col("user_id")
    n = i % 3
    return e.select(
        u.alias("clip_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), n.alias("n"), F.when(n > 0, (u * 37 + i * 13) % 1280).alias("cx"),
        F.when(n > 0, (u * 11 + i * 7) % 720).alias("cy"), F.when(n > 0, i % 4).alias("track_id"), (i % 17 == 0).alias("cut"),
    )


_FACES = r"""
fc AS MATERIALIZED (SELECT user_id AS clip_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS pos, event_id % 3 AS n,
  CASE WHEN event_id % 3 > 0 THEN (user_id * 37 + event_id * 13) % 1280 END AS cx, CASE WHEN event_id % 3 > 0 THEN (user_id * 11 + event_id * 7) % 720 END AS cy,
  CASE WHEN event_id % 3 > 0 THEN event_id % 4 END AS track_id, event_id % 17 = 0 AS cut FROM events)
"""


@query(f"""WITH {_FACES},
v AS (SELECT clip_id, pos, n, count(*) FILTER (WHERE n = 1) OVER z AS c0, count(*) FILTER (WHERE n >= 2) OVER z AS c1, count(*) FILTER (WHERE n = 0) OVER z AS c2
  FROM fc WINDOW z AS (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS m FROM v),
g AS (SELECT clip_id, count(*) FILTER (WHERE m = 0) AS votes_speaker_crop, count(*) FILTER (WHERE m = 1) AS votes_stacked_split, count(*) FILTER (WHERE m = 2) AS votes_center_crop, count(*) AS samples, count(*) FILTER (WHERE n > 0) AS faces FROM m GROUP BY 1)
SELECT clip_id, votes_speaker_crop, votes_stacked_split, votes_center_crop, samples, floor(faces / samples::DOUBLE * 1000 + 0.5) / 1000.0::DOUBLE AS face_fraction,
  CASE WHEN faces < samples * 0.5 THEN 'center_crop' WHEN votes_speaker_crop >= votes_stacked_split AND votes_speaker_crop >= votes_center_crop THEN 'speaker_crop' WHEN votes_stacked_split >= votes_center_crop THEN 'stacked_split' ELSE 'center_crop' END AS layout FROM g""")
def layout_votes(spark, d):
    return framing.layout_votes(faces(spark, d).select("clip_id", "pos", "n"))


@query(rf"""WITH RECURSIVE {_FACES},
r AS (SELECT clip_id, pos, cx::DOUBLE AS x, cy::DOUBLE AS y, CASE WHEN cx IS NULL THEN 1 ELSE 0 END::BIGINT AS missing FROM fc WHERE pos = 0
  UNION ALL SELECT f.clip_id, f.pos,
    CASE WHEN f.cx IS NULL THEN r.x WHEN r.x IS NULL OR abs(f.cx - r.x) > 320 THEN f.cx::DOUBLE WHEN abs(f.cx - r.x) > 405 * 0.15::DOUBLE + 5 THEN r.x + (f.cx - r.x) * 0.3::DOUBLE ELSE r.x END,
    CASE WHEN f.cx IS NULL THEN r.y WHEN r.x IS NULL OR abs(f.cx - r.x) > 320 THEN f.cy::DOUBLE WHEN abs(f.cy - r.y) > 5 THEN r.y + (f.cy - r.y) * 0.3::DOUBLE ELSE r.y END,
    CASE WHEN f.cx IS NOT NULL THEN 0 WHEN f.cut THEN 1 ELSE r.missing + 1 END FROM r JOIN fc f ON f.clip_id = r.clip_id AND f.pos = r.pos + 1)
SELECT clip_id, pos, floor(x * 1000 + 0.5) / 1000.0::DOUBLE AS cam_x, floor(y * 1000 + 0.5) / 1000.0::DOUBLE AS cam_y, missing, missing > 4 AS lost FROM r""")
def smoothed_centres(spark, d):
    return framing.smoothed_centres(faces(spark, d).select("clip_id", "pos", "cx", "cy", "cut"))


@query(f"""WITH {_FACES},
sc AS (SELECT *, (sum(cut::INT) OVER (PARTITION BY clip_id ORDER BY pos))::BIGINT AS scene FROM fc),
ss AS (SELECT clip_id, scene, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS samples FROM sc GROUP BY ALL),
tr AS (SELECT clip_id, scene, track_id, count(*) AS seen, min(pos) AS since, list(cx ORDER BY cx) AS xs, list(cy ORDER BY cy) AS ys FROM sc WHERE track_id IS NOT NULL GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY clip_id, scene ORDER BY seen DESC, since, track_id) AS rn FROM tr),
pl AS (SELECT ss.*, track_id AS own, xs[len(xs) // 2 + 1] AS x, ys[len(ys) // 2 + 1] AS y FROM ss LEFT JOIN bs ON bs.clip_id = ss.clip_id AND bs.scene = ss.scene AND rn = 1),
ca AS (SELECT *, last_value(own IGNORE NULLS) OVER v AS tid, last_value(x IGNORE NULLS) OVER v AS ax, last_value(y IGNORE NULLS) OVER v AS ay FROM pl WINDOW v AS (PARTITION BY clip_id ORDER BY scene ROWS UNBOUNDED PRECEDING))
SELECT clip_id, scene, first_pos, last_pos, samples, CASE WHEN own IS NOT NULL THEN 'face' WHEN tid IS NOT NULL THEN 'retain' ELSE 'center' END AS kind, tid AS track_id,
  coalesce(ax, 640)::BIGINT AS cx, coalesce(ay, 360)::BIGINT AS cy, own IS NULL AS needs_review FROM ca""")
def scene_plan(spark, d):
    return framing.scene_plan(faces(spark, d).select("clip_id", "pos", "track_id", "cx", "cy", "cut"))


@query(f"""WITH {_FACES},
ce AS (SELECT clip_id, pos * 250 AS t, cx::DOUBLE AS x, cut FROM fc),
pt AS (SELECT DISTINCT clip_id, pos AS point_id, pos * 400 AS t FROM fc),
ab AS (SELECT pt.clip_id, pt.point_id, pt.t, max(a.t) FILTER (WHERE a.t < pt.t) AS ta, min(a.t) FILTER (WHERE a.t >= pt.t) AS tb, max(a.t) AS tl FROM pt JOIN ce a USING (clip_id) GROUP BY ALL)
SELECT ab.clip_id, ab.point_id, ab.t, floor(CASE WHEN ta IS NULL THEN b.x WHEN tb IS NULL THEN a.x WHEN ab.t = tl OR b.cut THEN b.x WHEN a.x IS NULL THEN b.x WHEN b.x IS NULL THEN a.x
  ELSE a.x + (b.x - a.x) * (ab.t - ta) / (tb - ta) END * 1000 + 0.5) / 1000.0::DOUBLE AS x
FROM ab LEFT JOIN ce a ON a.clip_id = ab.clip_id AND a.t = ta LEFT JOIN ce b ON b.clip_id = ab.clip_id AND b.t = tb""")
def interp_anchor(spark, d):
    f = faces(spark, d)
    c = f.select("clip_id", (F.col("pos") * 250).alias("t"), F.col("cx").cast("double").alias("x"), "cut")
    return framing.interpolated_anchors(c, f.select("clip_id", F.col("pos").alias("point_id"), (F.col("pos") * 400).alias("t")))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders)
SELECT o_custkey AS clip_id, arg_max(o_orderkey, version) AS plan_id, max(version) AS version, arg_max(o_totalprice, version) AS total, max(version) + 1 AS next_version FROM v GROUP BY 1""")
def latest_plan_version(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("plan_id"), F.col("o_totalprice").alias("total"), "o_orderdate")
    v = state.numbered_versions(o, "clip_id", "o_orderdate", "plan_id").drop("o_orderdate")
    return state.latest(v, ["clip_id"], ["version"]).withColumn("next_version", F.col("version") + 1)


def run_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ["running", "done", "failed", "done"])), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").alias("video_id"), F.col("event_type").alias("stage"), "ts", "event_id", status.alias("status"), "value")


@query("""WITH l AS (SELECT user_id AS video_id, event_type AS stage, ts, event_id, (['running', 'done', 'failed', 'done'])[event_id % 4 + 1] AS status FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id, stage ORDER BY ts DESC, event_id DESC) AS rn FROM l)
SELECT video_id, stage, count(*) AS attempts, count(*) FILTER (WHERE status = 'failed') AS failures, max(CASE WHEN rn = 1 THEN status END) AS status, max(CASE WHEN rn = 1 THEN status END) = 'done' AS skip FROM n GROUP BY ALL""")
def stage_status(spark, d):
    return state.stage_status(run_log(spark, d).drop("value"), ["video_id", "stage"], ["ts", "event_id"])


@query("""WITH l AS (SELECT user_id AS video_id, event_type AS stage, ts, event_id, props FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id, stage ORDER BY ts DESC, event_id DESC) AS rn FROM l)
SELECT video_id, stage, event_id, substr(sha256(video_id::VARCHAR || '|' || stage || '|' || coalesce(props, '')), 1, 16) AS fingerprint FROM n WHERE rn = 1""")
def fingerprint_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("stage"), "ts", "event_id", "props")
    now = state.upsert(e, ["video_id", "stage"], ["ts", "event_id"])
    return now.select("video_id", "stage", "event_id", X.fingerprint(F.col("video_id"), F.col("stage"), F.col("props")).alias("fingerprint"))


@query("""WITH RECURSIVE dep(a, b) AS (VALUES ('audio_events', 'analyze'), ('audio_events', 'similarity'), ('audio_events', 'refine'), ('audio_events', 'render'), ('outline', 'analyze'), ('outline', 'similarity'), ('outline', 'refine'), ('outline', 'render'), ('refine', 'render')),
c(a, b) AS (SELECT a, b FROM dep UNION SELECT c.a, d.b FROM c JOIN dep d ON c.b = d.a),
l AS (SELECT user_id AS video_id, CASE event_type WHEN 'view' THEN 'outline' WHEN 'click' THEN 'refine' ELSE 'audio_events' END AS changed, count(*) AS n FROM events GROUP BY ALL)
SELECT video_id, changed, b AS stale, n FROM l JOIN c ON c.a = changed""")
def invalidation_closure(spark, d):
    """What goes stale in every video by the stages that changed there."""
    stale = F.create_map(*[x for a in state.DEPENDS for x in (F.lit(a), F.array(*map(F.lit, state.stale(a))))])
    changed = F.when(F.col("event_type") == "view", "outline").when(F.col("event_type") == "click", "refine").otherwise("audio_events")
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("video_id"), changed.alias("changed")).agg(F.count("*").alias("n"))
    return g.select("video_id", "changed", F.explode(stale[F.col("changed")]).alias("stale"), "n")


@query(r"""SELECT page_id, CASE WHEN contains(url, 'youtube.com') OR contains(url, 'youtu.be') THEN CASE WHEN contains(url, 'live') THEN 'youtube_live' ELSE 'youtube' END
  WHEN contains(url, 'drive.google.com') THEN 'google_drive' WHEN regexp_matches(lower(url), '\.(mp4|mov|webm|mkv)$') THEN CASE WHEN starts_with(url, '/') OR starts_with(url, './') THEN 'local_file' ELSE 'direct_url' END
  ELSE 'unknown' END AS source_type FROM (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://youtu.be/' || page_id WHEN 1 THEN 'https://youtube.com/live/' || page_id WHEN 2 THEN url || '.MP4' WHEN 3 THEN './a/' || page_id || '.mkv' WHEN 4 THEN 'https://drive.google.com/' || page_id ELSE url END AS url FROM pages)""")
def source_type(spark, d):
    p, i = table(spark, d, "pages"), F.col("page_id")
    s = i.cast("string")
    url = (
        F.when(i % 6 == 0, F.concat(F.lit("https://youtu.be/"), s)).when(i % 6 == 1, F.concat(F.lit("https://youtube.com/live/"), s)).when(i % 6 == 2, F.concat("url", F.lit(".MP4")))
        .when(i % 6 == 3, F.concat(F.lit("./a/"), s, F.lit(".mkv"))).when(i % 6 == 4, F.concat(F.lit("https://drive.google.com/"), s)).otherwise(F.col("url"))
    )
    return p.select("page_id", X.source_type(url).alias("source_type"))


@query(r"""SELECT event_id, CASE event_id % 6 WHEN 3 THEN NULL ELSE (regexp_extract(props, '"k": *(-?[0-9]+)', 1))::BIGINT END AS k FROM events""")
def llm_json_extract(spark, d):
    """A number from a model's reply: fenced, behind a think block, a bare object, no JSON at all, inside the think block, or with words around."""
    i, p = F.col("event_id") % 6, F.col("props")
    reply = (
        F.when(i == 0, F.concat(F.lit("```json\n["), p, F.lit("]\n```"))).when(i == 1, F.concat(F.lit("<think>[1]\n</think>\n["), p, F.lit("]"))).when(i == 2, F.concat(F.lit("Here: "), p, F.lit(" so")))
        .when(i == 3, F.lit("no moments")).when(i == 4, F.concat(F.lit("<think>first\n["), p, F.lit("]</think>"))).otherwise(F.concat(F.lit("Sure.\n```\n["), p, F.lit("]\n```\nDone [x]")))
    )
    e = table(spark, d, "events").select("event_id", X.model_json(reply).alias("j"))
    return e.select("event_id", F.get(F.from_json("j", "array<struct<k:bigint>>"), 0)["k"].alias("k"))


@query("""SELECT event_type AS stage, (['running', 'done', 'failed', 'done'])[event_id % 4 + 1] AS status, count(*) AS n FROM events GROUP BY ROLLUP (event_type, (['running', 'done', 'failed', 'done'])[event_id % 4 + 1])""")
def status_rollup(spark, d):
    """Added surface: counts by stage and status with subtotals."""
    return run_log(spark, d).rollup("stage", "status").agg(F.count("*").alias("n"))


@query("""(SELECT o_custkey AS id FROM orders WHERE o_totalprice > 100000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT s_suppkey FROM supplier""")
def set_ops(spark, d):
    """Added surface: set algebra."""
    a = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("id"))
    b = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return a.intersect(b).subtract(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER v + INTERVAL 10 HOUR OR lag(ts) OVER v IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_utterances(spark, d):
    """Added surface: sessions split by pauses of ten hours."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("at", "10 hours")).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("last_us"), "n")
