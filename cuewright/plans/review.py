"""Queries over framing decisions, review state, stage logs and text helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions import text as X
from cuewright.functions.numeric import half_up
from cuewright.operators import captions, framing, segment, state, vector
from cuewright.operators import editing as E
from cuewright.sources import sinks, transcript

from . import media, sql, transcripts
from .registry import query, table

_FACES = media._FACES


@query(f"""WITH {_FACES}, g AS (SELECT clip_id, count(cy) AS n, list(cy ORDER BY cy) FILTER (WHERE cy IS NOT NULL) AS ys FROM fc WHERE clip_id % 3 > 0 OR pos IN (0, 1) GROUP BY 1)
SELECT clip_id, CASE WHEN n >= 3 AND ys[len(ys) // 2 + 1] > 720 * 0.5 THEN 'top' ELSE 'bottom' END AS placement FROM g""")
def caption_placement(spark, d):
    """Top where faces stand low, here in the lower half; every third clip has too few faces to tell."""
    f = media.faces(spark, d).where("clip_id % 3 > 0 or pos in (0, 1)")
    return captions.placement(f, height=600)


def plan_and_smoothed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scene plan with times, the smoothed centres, and points every 400 ms with some beyond the end."""
    f = media.faces(spark, d)
    plan = framing.scene_plan(f.select("clip_id", "pos", "track_id", "cx", "cy", "cut"))
    plan = plan.withColumns({"t0": F.col("first_pos") * 250, "t1": (F.col("last_pos") + 1) * 250})
    s = framing.smoothed_centres(f.select("clip_id", "pos", "cx", "cy", "cut")).join(f.select("clip_id", "pos", "cut"), ["clip_id", "pos"])
    s = s.select("clip_id", (F.col("pos") * 250).alias("t"), F.col("cam_x").alias("x"), F.col("cam_y").alias("y"), "cut", "lost")
    return plan, s, f.select("clip_id", F.col("pos").alias("point_id"), (F.col("pos") * 400).alias("t"))


def rois(spark: SparkSession, d: str) -> DataFrame:
    """Manual regions of every seventh clip: three, that overlap, one open at its end."""
    i = F.explode(F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(a).alias("t0"), F.lit(b).cast("long").alias("t1"), F.lit(x).alias("x"), F.lit(100).alias("y"), F.lit(90).alias("w"), F.lit(160).alias("h")) for k, a, b, x in ((0, 0, 3000, 10), (1, 2000, 5000, 200), (2, 9000, None, 400))]))
    return table(spark, d, "events").where("user_id % 7 = 0").select(F.col("user_id").alias("clip_id")).distinct().select("clip_id", i.alias("r")).select("clip_id", "r.*")


_ANCHORS = rf"""{_FACES},
cam AS (SELECT clip_id, pos, x, y, missing > 4 AS lost FROM (SELECT clip_id, pos, floor(x * 1000 + 0.5) / 1000.0::DOUBLE AS x, floor(y * 1000 + 0.5) / 1000.0::DOUBLE AS y, missing FROM rc)),
sc AS (SELECT *, (sum(cut::INT) OVER (PARTITION BY clip_id ORDER BY pos))::BIGINT AS scene FROM fc),
ss AS (SELECT clip_id, scene, min(pos) * 250 AS t0, (max(pos) + 1) * 250 AS t1 FROM sc GROUP BY ALL),
tr AS (SELECT clip_id, scene, track_id, count(*) AS seen, min(pos) AS since, list(cx ORDER BY cx) AS xs, list(cy ORDER BY cy) AS ys FROM sc WHERE track_id IS NOT NULL GROUP BY ALL),
bs AS (SELECT *, row_number() OVER (PARTITION BY clip_id, scene ORDER BY seen DESC, since, track_id) AS rn FROM tr),
pl AS (SELECT ss.*, track_id AS own, xs[len(xs) // 2 + 1] AS x, ys[len(ys) // 2 + 1] AS y FROM ss LEFT JOIN bs ON bs.clip_id = ss.clip_id AND bs.scene = ss.scene AND rn = 1),
ca AS (SELECT *, last_value(own IGNORE NULLS) OVER v AS tid, last_value(x IGNORE NULLS) OVER v AS ax, last_value(y IGNORE NULLS) OVER v AS ay FROM pl WINDOW v AS (PARTITION BY clip_id ORDER BY scene ROWS UNBOUNDED PRECEDING)),
sp AS (SELECT clip_id, t0, t1, CASE WHEN own IS NOT NULL THEN 'face' WHEN tid IS NOT NULL THEN 'retain' ELSE 'center' END AS kind, coalesce(ax, 640) AS cx, coalesce(ay, 360) AS cy, own IS NULL AS needs_review FROM ca),
pt AS (SELECT clip_id, pos AS point_id, pos * 400 AS t FROM fc),
ro(idx, r0, r1, rx) AS (VALUES (0, 0, 3000, 10), (1, 2000, 5000, 200), (2, 9000, NULL, 400)),
mn AS (SELECT clip_id, point_id, arg_max(rx, idx) + 45.0::DOUBLE AS mx, 180.0::DOUBLE AS my FROM pt JOIN ro ON t >= r0 AND t <= coalesce(r1, 1000000000) WHERE clip_id % 7 = 0 GROUP BY ALL),
sg AS (SELECT pt.clip_id, point_id, arg_min(kind, t0) AS kind, arg_min(cx, t0)::DOUBLE AS cx, arg_min(cy, t0)::DOUBLE AS cy, arg_min(needs_review, t0) AS needs_review FROM pt JOIN sp ON sp.clip_id = pt.clip_id AND t BETWEEN t0 AND t1 GROUP BY ALL),
sx AS (SELECT cam.clip_id, cam.pos * 250 AS t, x, y, cut, lost FROM cam JOIN fc USING (clip_id, pos)),
ab AS (SELECT pt.clip_id, point_id, pt.t, max(sx.t) FILTER (WHERE sx.t < pt.t) AS ta, min(sx.t) FILTER (WHERE sx.t >= pt.t) AS tb, max(sx.t) AS tl FROM pt JOIN sx USING (clip_id) GROUP BY ALL),
il AS (SELECT ab.clip_id, point_id, CASE WHEN ta IS NULL THEN b.lost WHEN tb IS NULL THEN a.lost WHEN ab.t = tl OR b.cut OR a.x IS NULL THEN b.lost WHEN b.x IS NULL THEN a.lost ELSE b.lost END AS lost,
  floor(CASE WHEN ta IS NULL THEN b.x WHEN tb IS NULL THEN a.x WHEN ab.t = tl OR b.cut THEN b.x WHEN a.x IS NULL THEN b.x WHEN b.x IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (ab.t - ta) / (tb - ta) END * 1000 + 0.5) / 1000.0::DOUBLE AS fx,
  floor(CASE WHEN ta IS NULL THEN b.y WHEN tb IS NULL THEN a.y WHEN ab.t = tl OR b.cut THEN b.y WHEN a.y IS NULL THEN b.y WHEN b.y IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (ab.t - ta) / (tb - ta) END * 1000 + 0.5) / 1000.0::DOUBLE AS fy
  FROM ab LEFT JOIN sx a ON a.clip_id = ab.clip_id AND a.t = ta LEFT JOIN sx b ON b.clip_id = ab.clip_id AND b.t = tb),
an AS (SELECT pt.clip_id, pt.point_id, pt.t, CASE WHEN mx IS NOT NULL THEN 'manual' WHEN kind = 'face' THEN CASE WHEN fx IS NOT NULL AND NOT coalesce(lost, false) THEN 'face' ELSE 'retain' END ELSE coalesce(kind, 'center') END AS kind,
  CASE WHEN mx IS NOT NULL THEN mx WHEN kind = 'face' AND fx IS NOT NULL THEN fx ELSE coalesce(cx, 640) END AS cx, CASE WHEN mx IS NOT NULL THEN my WHEN kind = 'face' AND fx IS NOT NULL THEN fy ELSE coalesce(cy, 360) END AS cy,
  CASE WHEN mx IS NOT NULL THEN false WHEN kind = 'face' THEN NOT (fx IS NOT NULL AND NOT coalesce(lost, false)) ELSE coalesce(needs_review, true) END AS needs_review
  FROM pt LEFT JOIN mn USING (clip_id, point_id) LEFT JOIN sg USING (clip_id, point_id) LEFT JOIN il USING (clip_id, point_id))"""
_ANCHORS = "RECURSIVE " + _ANCHORS.replace(
    "\ncam AS",
    """
rc AS (SELECT clip_id, pos, cx::DOUBLE AS x, cy::DOUBLE AS y, CASE WHEN cx IS NULL THEN 1 ELSE 0 END::BIGINT AS missing FROM fc WHERE pos = 0
  UNION ALL SELECT f.clip_id, f.pos,
    CASE WHEN f.cx IS NULL THEN r.x WHEN r.x IS NULL OR abs(f.cx - r.x) > 320 THEN f.cx::DOUBLE WHEN abs(f.cx - r.x) > 405 * 0.15::DOUBLE + 5 THEN r.x + (f.cx - r.x) * 0.3::DOUBLE ELSE r.x END,
    CASE WHEN f.cx IS NULL THEN r.y WHEN r.x IS NULL OR abs(f.cx - r.x) > 320 THEN f.cy::DOUBLE WHEN abs(f.cy - r.y) > 5 THEN r.y + (f.cy - r.y) * 0.3::DOUBLE ELSE r.y END,
    CASE WHEN f.cx IS NOT NULL THEN 0 WHEN f.cut THEN 1 ELSE r.missing + 1 END FROM rc r JOIN fc f ON f.clip_id = r.clip_id AND f.pos = r.pos + 1),
cam AS""",
    1,
)


def anchors(spark: SparkSession, d: str) -> DataFrame:
    plan, smoothed, points = plan_and_smoothed(spark, d)
    return framing.resolved_anchors(points, plan, smoothed, rois(spark, d))


@query(f"WITH {_ANCHORS} SELECT * FROM an")
def resolved_anchors(spark, d):
    return anchors(spark, d)


@query(f"WITH {_ANCHORS}, n AS (SELECT clip_id, kind, count(*) AS n FROM an GROUP BY ALL) SELECT *, floor(n / sum(n) OVER (PARTITION BY clip_id) * 1000000 + 0.5) / 1000000.0::DOUBLE AS share FROM n")
def anchor_shares(spark, d):
    return framing.anchor_shares(anchors(spark, d))


@query(f"""WITH {_FACES}, g AS (SELECT clip_id, track_id, count(*) AS n, avg(cx) AS x FROM fc WHERE track_id IS NOT NULL GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, track_id) AS rank FROM g),
p AS (SELECT clip_id, list(track_id ORDER BY x, track_id) AS t FROM q WHERE rank IN (1, 2) GROUP BY 1),
s AS (SELECT fc.clip_id, pos AS point_id, pos * 300 AS t, unnest([{{'side': 'left', 'tr': p.t[1]}}, {{'side': 'right', 'tr': p.t[2]}}]) AS z FROM fc JOIN p ON p.clip_id = fc.clip_id AND len(p.t) = 2),
a AS (SELECT s.clip_id, s.point_id, z.side AS side, arg_max(f.cx, f.pos) AS cx, arg_max(f.cy, f.pos) AS cy FROM s LEFT JOIN fc f ON f.clip_id = s.clip_id AND f.track_id = z.tr AND f.pos * 250 <= s.t GROUP BY ALL)
SELECT clip_id, point_id, side, coalesce(cx, CASE side WHEN 'left' THEN 384 ELSE 896 END)::DOUBLE AS cx, coalesce(cy, 288)::DOUBLE AS cy FROM a""")
def panel_places(spark, d):
    f = media.faces(spark, d)
    points = f.select("clip_id", F.col("pos").alias("point_id"), (F.col("pos") * 300).alias("t"))
    out = framing.panel_places(points, E.main_tracks(f), f.withColumn("t", F.col("pos") * 250))
    return out.select("clip_id", "point_id", "side", half_up(F.col("cx"), 3).alias("cx"), half_up(F.col("cy"), 3).alias("cy"))


@query()
def tracked_faces(spark, d):
    """Faces of neighbouring samples as tracks; each association depends on the one before, so tests hold it against a loop."""
    f = media.faces(spark, d)
    box = lambda k: F.struct(((F.col("cx") + k * 331 + F.col("pos") * 17) % 1280).alias("cx"), ((F.col("cy") + k * 97) % 720).alias("cy"))
    boxes = F.when(F.col("n") == 1, F.array(box(0))).when(F.col("n") == 2, F.array(box(0), box(1))).otherwise(F.array().cast("array<struct<cx:bigint,cy:bigint>>"))
    return framing.associate(f.select("clip_id", "pos", "cut", boxes.alias("boxes")))


@query("""WITH f AS (SELECT label AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, list_transform(embedding[1:16], lambda x: floor(x * 200)) AS p FROM embeddings),
g AS (SELECT *, lag(p) OVER (PARTITION BY clip_id ORDER BY pos) AS q FROM f),
h AS (SELECT clip_id, pos, floor(list_sum(list_transform(range(1, 17), lambda i: abs(p[i] - q[i])))::DOUBLE / 16 * 1000000 + 0.5) / 1000000.0::DOUBLE AS diff FROM g)
SELECT clip_id, pos, diff, coalesce(diff > 28, false) AS cut FROM h""")
def scene_cuts(spark, d):
    """Frames of sixteen pixels out of the vectors."""
    e = table(spark, d, "embeddings")
    pos = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    pixel = lambda x: F.floor(x * F.lit(200).cast("float"))  # noqa: E731  (in single precision, as the vectors are)
    f = e.select(F.col("label").alias("clip_id"), pos.alias("pos"), F.transform(F.slice("embedding", 1, 16), pixel).alias("pixels"))
    return framing.scene_cuts(f, 28.0).select("clip_id", "pos", "diff", "cut")


@query("""WITH e AS (SELECT user_id AS clip_id, (['top', 'bottom', 'left', 'right'])[event_id % 4 + 1] AS edge, CASE WHEN user_id % 5 = 0 THEN 16.0 + event_id % 3 * 0.5 ELSE event_id % 200 END::DOUBLE AS mean, CASE WHEN user_id % 10 = 0 THEN 0.25 ELSE event_id % 3 END::DOUBLE AS std FROM events),
g AS (SELECT clip_id, edge, max(mean) - min(mean) AS r, max(std) AS s FROM e GROUP BY ALL)
SELECT clip_id, edge, CASE WHEN r < 3 AND s < 1 THEN 0.0::DOUBLE ELSE floor(r * 100 + 0.5) / 100.0::DOUBLE END AS variation, r < 3 AND s < 1 AS is_bar FROM g""")
def fill_bars(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    edge = F.get(F.array(*map(F.lit, ["top", "bottom", "left", "right"])), (i % 4).cast("int"))
    mean = F.when(u % 5 == 0, 16.0 + i % 3 * 0.5).otherwise((i % 200).cast("double"))
    std = F.when(u % 10 == 0, 0.25).otherwise((i % 3).cast("double"))
    return framing.fill_bars(table(spark, d, "events").select(u.alias("clip_id"), edge.alias("edge"), mean.alias("mean"), std.alias("std")))


@query(f"""WITH {_FACES},
v AS (SELECT clip_id, pos, n, count(*) FILTER (WHERE n = 1) OVER z AS c0, count(*) FILTER (WHERE n >= 2) OVER z AS c1, count(*) FILTER (WHERE n = 0) OVER z AS c2 FROM fc WINDOW z AS (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS m FROM v),
g AS (SELECT clip_id, count(*) FILTER (WHERE m = 0) AS a, count(*) FILTER (WHERE m = 1) AS b, count(*) FILTER (WHERE m = 2) AS c, count(*) AS samples, count(*) FILTER (WHERE n > 0) AS faces FROM m GROUP BY 1),
l AS (SELECT clip_id, CASE WHEN faces < samples * 0.5 THEN 'center_crop' WHEN a >= b AND a >= c THEN 'speaker_crop' WHEN b >= c THEN 'stacked_split' ELSE 'center_crop' END AS voted FROM g),
k AS (SELECT DISTINCT user_id AS clip_id, CASE user_id % 5 WHEN 0 THEN 'Center_Crop' WHEN 1 THEN 'branded_fit' WHEN 2 THEN 'mosaic' END AS o FROM events UNION ALL SELECT 900000, NULL),
w AS (SELECT k.clip_id, CASE WHEN lower(o) = 'center_crop' THEN 'center_crop' END AS manual, voted FROM k LEFT JOIN l USING (clip_id))
SELECT clip_id, coalesce(manual, voted, 'center_crop') AS layout, manual IS NULL AND coalesce(voted, 'center_crop') = 'center_crop' AS needs_review FROM w""")
def layout_decisions(spark, d):
    """Manual layouts, fitted frames that become automatic, unknown ones, and a clip without samples."""
    u = F.col("clip_id")
    clips = table(spark, d, "events").select(F.col("user_id").alias("clip_id")).distinct()
    clips = clips.select("clip_id", F.when(u % 5 == 0, "Center_Crop").when(u % 5 == 1, "branded_fit").when(u % 5 == 2, "mosaic").alias("override"))
    clips = clips.unionByName(spark.createDataFrame([(900000, None)], "clip_id long, override string"))
    return framing.decide_layout(clips, media.faces(spark, d).select("clip_id", "pos", "n"))


@query(f"""WITH {_FACES},
sc AS (SELECT *, (sum(cut::INT) OVER (PARTITION BY clip_id ORDER BY pos))::BIGINT AS scene FROM fc),
g AS (SELECT clip_id, scene, count(track_id) > 0 AS seen FROM sc GROUP BY ALL),
h AS (SELECT *, row_number() OVER v AS rn, max(seen::INT) OVER v AS had FROM g WINDOW v AS (PARTITION BY clip_id ORDER BY scene))
SELECT CASE WHEN seen THEN 'face' WHEN rn = 1 THEN 'workarea' ELSE 'retain' END AS kind, had = 0 AS in_work_area, count(*) AS n FROM h GROUP BY ALL""")
def work_area_plan(spark, d):
    """Scene plans with a work area to stand at before any face is seen."""
    p = framing.scene_plan(media.faces(spark, d).select("clip_id", "pos", "track_id", "cx", "cy", "cut"), work_area=(100, 50, 201, 300))
    inside = (F.col("cx") == 200) & (F.col("cy") == 200) & F.col("track_id").isNull()
    return p.groupBy("kind", inside.alias("in_work_area")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS clip_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 > 0 THEN 10 WHEN c_custkey % 4 = 0 THEN 20 WHEN c_custkey % 5 = 0 THEN 30 ELSE 0 END::BIGINT AS x,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 > 0 THEN 600 WHEN c_custkey % 4 = 0 THEN 700 WHEN c_custkey % 5 = 0 THEN 800 ELSE 1280 END::BIGINT AS w FROM customer""")
def bounds_in_use(spark, d):
    """An override (not one without a size), else the analysis, else the estimate, else the frame."""
    k = F.col("c_custkey")
    at = lambda x, w: F.struct(F.lit(x).alias("x"), F.lit(0).alias("y"), w.alias("w"), F.lit(700).alias("h"))
    c = table(spark, d, "customer").select(k.alias("clip_id"), F.when(k % 3 == 0, at(10, F.when(k % 6 > 0, 600).otherwise(0))).alias("override"), F.when(k % 4 == 0, at(20, F.lit(700))).alias("analysed"))
    e = c.where("clip_id % 5 = 0").select("clip_id", F.lit(30).alias("x"), F.lit(0).alias("y"), F.lit(800).alias("w"), F.lit(700).alias("h"))
    return E.bounds_in_use(c, e).select("clip_id", "bounds.x", "bounds.w")


@query(f"""WITH {_FACES}, g AS (SELECT clip_id, track_id, avg(cx) AS x FROM fc WHERE track_id IS NOT NULL AND (clip_id % 3 > 0 OR track_id = 1) GROUP BY ALL),
t AS (SELECT clip_id, list(track_id ORDER BY x, track_id) AS ts FROM g GROUP BY 1),
c AS (SELECT DISTINCT clip_id FROM fc)
SELECT c.clip_id, CASE WHEN c.clip_id % 4 = 0 THEN 'unavailable_no_diarization' WHEN coalesce(len(ts), 0) < 2 THEN 'unavailable_no_faces' ELSE 'mapped_explicit' END AS status,
  CASE WHEN c.clip_id % 4 > 0 AND len(ts) >= 2 THEN ts[1] END AS host, CASE WHEN c.clip_id % 4 > 0 AND len(ts) >= 2 THEN ts[-1] END AS guest FROM c LEFT JOIN t USING (clip_id)""")
def speaker_map(spark, d):
    """Speakers on fixed seats; some clips have no speech, some one face."""
    f = media.faces(spark, d)
    clips = f.select("clip_id").distinct()
    speech = clips.where("clip_id % 4 > 0").withColumn("speaker", F.lit("host"))
    m = E.speaker_tracks(clips, speech, f.where("clip_id % 3 > 0 or track_id = 1"), {"host": "left", "guest": "right", "crowd": "middle"})
    return m.select("clip_id", "status", F.col("mapping")["host"].alias("host"), F.col("mapping")["guest"].alias("guest"))


@query(f"""WITH {transcripts._CLIPS},
ms AS (SELECT video_id, clip_id, det_s, det_e FROM sn)
SELECT clip_id, det_e - det_s AS output_ms, clip_id % 3 AS cue_count, (clip_id % 4)::INT AS scene_count, clip_id % 4 > 1 AS needs_review, CASE WHEN clip_id % 5 = 0 THEN 1 ELSE 0 END AS rois,
  substr(sha256('captions.max_words=8|fade=true|' || CASE WHEN clip_id % 2 = 0 THEN 'auto' ELSE 'center_crop' END), 1, 16) AS fingerprint FROM ms""")
def edit_plans(spark, d):
    """Plans put together from clips, cues, scenes and manual regions; read back from their JSON."""
    s = transcripts.snap_boundaries(spark, d)
    i = F.col("clip_id")
    clips = s.select(
        "clip_id", F.col("clip_id").alias("clip_number"), F.when(i % 2 == 0, "auto").otherwise("center_crop").alias("layout"), F.array(F.struct(F.col("det_s").alias("s"), F.col("det_e").alias("e"))).alias("ranges"),
        F.array(F.struct(F.col("det_s").alias("s"), F.col("det_e").alias("e"), F.lit(0).cast("long").alias("out_s"), (F.col("det_e") - F.col("det_s")).alias("out_e"))).alias("timeline"),
    )
    many = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))
    cues = clips.select("clip_id", many(i % 3).alias("cue_id")).select("clip_id", "cue_id", F.lit(0).alias("start_ms"), F.lit(900).alias("end_ms"), F.lit("words").alias("text"))
    scenes = clips.select("clip_id", many(i % 4).alias("scene")).select("clip_id", "scene", F.lit("face").alias("kind"), F.lit(640).alias("cx"), F.lit(360).alias("cy"), (F.col("scene") == 2).alias("needs_review"))
    regions = clips.where("clip_id % 5 = 0").select("clip_id", *[F.lit(v).alias(k) for k, v in (("idx", 0), ("x", 10), ("y", 20), ("w", 90), ("h", 160))])
    p = E.edit_plan(clips, cues, scenes, regions, {"fade": "true", "captions.max_words": "8"})
    back = F.from_json(F.to_json("plan"), p.schema["plan"].dataType)
    p = p.select("clip_id", back.alias("p"), "fingerprint")
    return p.select("clip_id", "p.output_ms", F.col("p.captions.cue_count").cast("long").alias("cue_count"), F.col("p.framing.scene_count").alias("scene_count"), F.col("p.framing.needs_review").alias("needs_review"), F.size("p.framing.manual_rois").alias("rois"), "fingerprint")


@query("""WITH v AS (SELECT o_custkey AS clip_id, count(*) AS plan_version, string_agg(floor(o_totalprice / 1000)::BIGINT::VARCHAR, ',' ORDER BY o_orderkey) AS scores FROM orders GROUP BY 1)
SELECT c_custkey AS clip_id, c_custkey % 50 AS clip_number, plan_version, coalesce(scores, '') AS candidate_scores FROM customer LEFT JOIN v ON clip_id = c_custkey WHERE c_custkey % 50 IN (1, 2, 3, 49)""")
def review_clips(spark, d):
    """The review list of the clips that a selective render asks for."""
    o = table(spark, d, "orders")
    clips = table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"), (F.col("c_custkey") % 50).alias("clip_number"))
    plans = state.numbered_versions(o.select(F.col("o_custkey").alias("clip_id"), "o_orderkey"), "clip_id", "o_orderkey")
    cands = o.select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("cand_id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("total"))
    r = E.review_list(E.only_clips(clips, [1, 2, 3, 49]), plans, cands)
    return r.select("clip_id", "clip_number", "plan_version", F.array_join(F.transform("candidate_scores", lambda x: x.cast("long").cast("string")), ",").alias("candidate_scores"))


@query("""SELECT o_orderkey AS cand_id, CASE o_orderkey % 5 WHEN 0 THEN 'selected' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status, CASE WHEN o_orderkey % 5 = 2 THEN 'bad status' END AS error FROM orders""")
def candidate_statuses(spark, d):
    k = F.col("cand_id")
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("cand_id"), F.lit("proposed").alias("status"))
    edits = c.where("cand_id % 5 < 3").select("cand_id", F.when(k % 5 == 0, "selected").when(k % 5 == 1, "rejected").otherwise("loved").alias("status"))
    return E.set_statuses(c, edits)


_RUNS = """r AS (SELECT user_id AS video_id, (['audio_events', 'embed', 'outline', 'chunk'])[event_id % 4 + 1] AS stage, (['running', 'done', 'failed', 'done', 'running'])[event_id % 5 + 1] AS status, event_id AS seq FROM events)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("video_id"), pick(["audio_events", "embed", "outline", "chunk"], i % 4).alias("stage"), pick(["running", "done", "failed", "done", "running"], i % 5).alias("status"), i.alias("seq"))


@query(f"""WITH {_RUNS}, s AS (SELECT DISTINCT user_id AS video_id FROM events WHERE user_id % 3 = 0),
k AS (SELECT r.* FROM r LEFT JOIN s ON s.video_id = r.video_id AND r.stage = 'embed' WHERE s.video_id IS NULL OR r.status = 'done' UNION ALL SELECT video_id, 'embed', 'running', 10000000 FROM s)
SELECT video_id, stage, seq, CASE WHEN status = 'running' AND stage = 'embed' AND video_id % 2 = 0 THEN 'done' WHEN status = 'running' AND stage = 'embed' AND video_id % 6 = 3 THEN 'failed' ELSE status END AS status FROM k""")
def stage_events(spark, d):
    """A stage starts again for some videos, then completes or fails where it runs."""
    log = runs(spark, d)
    v = log.select("video_id").distinct()
    starts = v.where("video_id % 3 = 0").select("video_id", F.lit("embed").alias("stage"), F.lit(10_000_000).cast("long").alias("seq"))
    ends = v.where("video_id % 2 = 0 or video_id % 6 = 3").select("video_id", F.lit("embed").alias("stage"), F.when(F.col("video_id") % 2 == 0, "done").otherwise("failed").alias("outcome"))
    return state.finish_stage(state.start_stage(log, starts), ends).select("video_id", "stage", "seq", "status")


@query("""WITH w AS (SELECT DISTINCT user_id AS video_id, event_type AS stage FROM events)
SELECT video_id, stage, video_id % 3 = 0 AND stage <> 'view' AS matches FROM w""")
def fingerprint_match(spark, d):
    """Stored fingerprints: equal for every third video, else different, and none for one stage."""
    w = table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("stage")).distinct()
    mark = X.fingerprint(F.col("video_id"), F.col("stage"))
    stored = w.where("stage <> 'view'").select("video_id", "stage", F.when(F.col("video_id") % 3 == 0, mark).otherwise("old").alias("fingerprint"))
    return state.fingerprint_matches(w.withColumn("fingerprint", mark), stored).drop("fingerprint")


@query("""WITH j AS (SELECT p_partkey AS video_id, (['outline', 'discovery', 'other'])[p_partkey % 3 + 1] AS stage, p_size::VARCHAR AS w FROM part)
SELECT video_id, stage, CASE stage WHEN 'outline' THEN substr(sha256('outline|transcript=t' || video_id::VARCHAR || '|model=|prompt=v1|window_sentences=' || w), 1, 16)
  WHEN 'discovery' THEN substr(sha256('discovery|transcript=t' || video_id::VARCHAR || '|outline=|model=|prompt=v1|target_clips=|max_candidates=|min_span=|max_span=|allow_noncontiguous='), 1, 16) END AS fingerprint FROM j""")
def stage_fingerprints(spark, d):
    """A stage's fingerprint covers its own settings only."""
    k = F.col("p_partkey")
    settings = F.create_map(F.lit("transcript"), F.concat(F.lit("t"), k.cast("string")), F.lit("prompt"), F.lit("v1"), F.lit("window_sentences"), F.col("p_size").cast("string"), F.lit("unused"), F.lit("x"))
    stage = F.get(F.array(*map(F.lit, ["outline", "discovery", "other"])), (k % 3).cast("int"))
    return state.stage_fingerprints(table(spark, d, "part").select(k.alias("video_id"), stage.alias("stage"), settings.alias("settings")))


@query(f"""WITH {_RUNS}, v AS (SELECT DISTINCT user_id AS video_id FROM events WHERE user_id % 4 = 0),
c AS (SELECT event_id AS clip_id, user_id AS video_id FROM events WHERE event_id % 3 = 0),
l AS (SELECT event_id - event_id % 6 AS clip_id FROM events)
SELECT video_id, 'clips' AS "table", count(*) AS removed FROM c JOIN v USING (video_id) GROUP BY 1
UNION ALL SELECT video_id, 'candidates', count(*) FROM r JOIN v USING (video_id) GROUP BY 1 UNION ALL SELECT video_id, 'outlines', count(*) FROM r JOIN v USING (video_id) WHERE stage = 'outline' GROUP BY 1
UNION ALL SELECT video_id, 'pipeline_runs', count(*) FROM r JOIN v USING (video_id) WHERE stage <> 'chunk' GROUP BY 1 UNION ALL SELECT video_id, 'related_segments', count(*) FROM l JOIN c USING (clip_id) JOIN v USING (video_id) GROUP BY 1
UNION ALL SELECT -1, 'runs_left', count(*) FROM r WHERE stage = 'chunk' OR video_id NOT IN (SELECT video_id FROM v) UNION ALL SELECT -1, 'links_left', count(*) FROM l WHERE clip_id NOT IN (SELECT clip_id FROM c JOIN v USING (video_id))""")
def rerun_cleanup(spark, d):
    """What a rerun removes of some videos, and how many runs and links stay in all."""
    e, r = table(spark, d, "events"), runs(spark, d)
    tables = {
        "related_segments": e.select((F.col("event_id") - F.col("event_id") % 6).alias("clip_id")), "clips": e.where("event_id % 3 = 0").select(F.col("event_id").alias("clip_id"), F.col("user_id").alias("video_id")),
        "candidates": r.select("video_id"), "outlines": r.where("stage = 'outline'").select("video_id"), "pipeline_runs": r,
    }
    left, removed = state.clean_up(tables, e.where("user_id % 4 = 0").select(F.col("user_id").alias("video_id")))
    stay = [left[t].agg(F.count("*").alias("removed")).select(F.lit(-1).cast("long").alias("video_id"), F.lit(n).alias("table"), "removed") for t, n in (("pipeline_runs", "runs_left"), ("related_segments", "links_left"))]
    return removed.union(stay[0]).union(stay[1])


@query("""SELECT event_id, event_id % 7 = 0 OR (user_id % 2 = 0 AND event_id % 3 = 0) AS stitched FROM events""")
def stitched_links(spark, d):
    """Confirmed links of the clips that were stitched are marked, others stay as they were."""
    e = table(spark, d, "events")
    links = e.select("event_id", F.col("user_id").alias("clip_id"), (F.col("event_id") % 3 == 0).alias("confirmed"), F.when(F.col("event_id") % 7 == 0, True).alias("stitched"))
    return state.mark_stitched(links, e.where("user_id % 2 = 0").select(F.col("user_id").alias("clip_id"))).select("event_id", "stitched")


@query("""WITH e AS (SELECT vec_id, label, vec_id % 3 > 0 AS fits FROM embeddings)
SELECT vec_id AS chunk_id, fits AS kept, CASE WHEN fits THEN 2 ELSE 0 END::BIGINT AS links FROM e""")
def migrated_vectors(spark, d):
    """Vectors of another size go, and the links of their chunks; every third chunk still has the old size."""
    e = table(spark, d, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 3 > 0, vector.head(F.col("embedding"), 32)).otherwise(F.col("embedding")).alias("embedding"))
    links = chunks.select("chunk_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("clip_id"))
    now, kept = vector.migrate_dimension(chunks, links, 32)
    n = kept.groupBy("chunk_id").agg(F.count("*").alias("links"))
    return now.join(n, "chunk_id", "left").select("chunk_id", F.col("embedding").isNotNull().alias("kept"), F.coalesce("links", F.lit(0)).alias("links"))


@query("""WITH u AS (SELECT conv_id, count(*) AS words, count(*) FILTER (WHERE turn % 3 = 1) AS skipped FROM conversations GROUP BY 1)
SELECT conv_id AS video_id, words::INT AS words, skipped::INT AS skipped FROM u WHERE conv_id % 4 < 3""")
def skipped_words(spark, d):
    """Transcripts of three shapes, and one that is none; words without a readable time are counted."""
    c = table(spark, d, "conversations")
    word = F.to_json(F.struct(F.concat(F.lit("w"), F.col("turn").cast("string")).alias("word"), F.when(F.col("turn") % 3 == 1, "soon").otherwise(F.col("turn").cast("string")).alias("start"), (F.col("turn") + 1).cast("string").alias("end")))
    g = c.groupBy("conv_id").agg(F.array_join(F.collect_list(word), ",").alias("ws"))
    i, ws = F.col("conv_id") % 4, F.col("ws")
    value = F.when(i == 0, F.concat(F.lit("["), ws, F.lit("]"))).when(i == 1, F.concat(F.lit('{"word_segments": ['), ws, F.lit("]}"))).when(i == 2, F.concat(F.lit('{"segments": [{"text": "x"}, {"words": ['), ws, F.lit("]}]}"))).otherwise("no json")
    return transcript.skipped_words(g.select(F.col("conv_id").alias("video_id"), value.alias("value")))


@query(r"""SELECT p_partkey, replace(replace(replace(replace(replace(t, '\', '\\'), '''', '\'''), ':', '\:'), '%', '\%'), ',', '\,') AS drawn, CASE p_partkey % 4 WHEN 0 THEN 'CCBBAA' WHEN 1 THEN '332211' WHEN 2 THEN 'FFFFFF' ELSE '030201' END AS bgr,
  3::BIGINT AS tags, p_partkey::VARCHAR || ':1.3-2.0,10.0-' || (p_partkey % 9)::VARCHAR || '.5' AS cache_key, length(t)::VARCHAR || ':' || substr(sha256(t), 1, 16) AS signature, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_name END AS shown, substr(t || t || t || t, 1, 80) AS title
FROM (SELECT *, p_name || ': 50%, it''s ' || p_type AS t FROM part)""")
def text_helpers(spark, d):
    """Escapes, colours, hashtags, cache keys, signatures, display texts and length caps."""
    k = F.col("p_partkey")
    t = F.concat("p_name", F.lit(": 50%, it's "), "p_type")
    ranges = F.array(*[F.struct(a.alias("s"), b.alias("e")) for a, b in ((F.lit(1250), F.lit(1999)), (F.lit(9950), k % 9 * 1000 + 500))])
    colour = F.when(k % 4 == 0, "#abc").when(k % 4 == 1, "112233").when(k % 4 == 2, "red").otherwise(" #010203 ")
    display = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_brand"))
    return table(spark, d, "part").select(
        "p_partkey", X.drawtext_escape(t).alias("drawn"), X.hex_to_bgr(colour).alias("bgr"), F.size(X.hashtags(F.lit(" #a  #b\n#c "))).cast("long").alias("tags"),
        X.ranges_key(k, ranges).alias("cache_key"), X.content_signature(t).alias("signature"), X.shown(display, F.col("p_name")).alias("shown"), X.capped(F.concat(t, t, t, t), "title").alias("title"),
    )


@query("""WITH w AS (SELECT o_custkey AS video_id, o_orderkey FROM orders)
SELECT o_orderkey, o_orderkey % 8 < 4 AS cached, CASE WHEN o_orderkey % 8 < 2 THEN 'new' WHEN o_orderkey % 8 < 4 THEN 'old' END AS labels FROM orders""")
def cached_labels(spark, d):
    """Labels found in a cache of ranges, the last of a repeated key; the rest would be asked for."""
    k = F.col("o_orderkey")
    w = table(spark, d, "orders").select("o_orderkey", X.ranges_key(F.col("o_custkey"), F.array(F.struct((k * 100).alias("s"), (k * 100 + 900).alias("e")))).alias("key"))
    cache = w.where("o_orderkey % 8 < 4").select("key", F.lit("old").alias("labels"), F.lit(1).alias("seq")).union(w.where("o_orderkey % 8 < 2").select("key", F.lit("new"), F.lit(2)))
    found, missing = sinks.cached_labels(cache, w)
    return found.select("o_orderkey", F.lit(True).alias("cached"), "labels").union(missing.select("o_orderkey", F.lit(False), F.lit(None).cast("string")))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 3 = 0)
SELECT o_orderkey AS cue_id, o_custkey AS clip_id, CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS text FROM orders WHERE o_custkey % 3 > 0 OR o_orderkey % 2 = 0""")
def replaced_rows(spark, d):
    """All rows of some clips replaced by fewer new ones."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cue_id"), F.col("o_custkey").alias("clip_id"), F.lit("old").alias("text"))
    keep = o.where("clip_id % 3 = 0 and cue_id % 2 = 0").withColumn("text", F.lit("new"))
    gone = o.where("clip_id % 3 > 0 or cue_id % 2 = 1")  # new rows only for clips that have an even order
    odd = o.where("clip_id % 3 = 0").groupBy("clip_id").agg(F.max((F.col("cue_id") % 2 == 0).cast("int")).alias("even")).where("even = 0").select("clip_id")
    return state.replace_by(gone.unionByName(keep).join(odd, "clip_id", "left_anti"), keep, "clip_id").select("cue_id", "clip_id", "text")


@query(f"""WITH {sql.CHUNKS} SELECT video_id * 100000 + chunk_index AS clip_id, start_ms, text FROM c""")
def clips_analysis(spark, d):
    """Clips as JSON lines without their embedding, read back."""
    c = segment.silence_chunks(transcripts.words(spark, d)).select((F.col("video_id") * 100_000 + F.col("chunk_index")).alias("clip_id"), "start_ms", "text", F.array(F.lit(0.5)).alias("embedding"))
    lines = sinks.clips_analysis(c)
    back = F.from_json("line", "struct<clip_id:bigint,start_ms:bigint,text:string,embedding:array<double>>")
    return lines.select(back.alias("b")).where("b.embedding is null").select("b.clip_id", "b.start_ms", "b.text")
