"""Queries through Spark's other surfaces: SQL over table functions, variants, tables that drifted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import sql_functions
from cuewright.operators import candidates as C
from cuewright.operators import editing as E
from cuewright.operators import segment
from cuewright.sources import drift, transcript
from cuewright.storage import new_path, written

from . import sql, transcripts
from .registry import query, table


@query(rf"""WITH {sql.WORDS} SELECT video_id, pos, word, greatest(1, length(word) // 4) AS tokens, regexp_matches(word, '[.!?…]+$') AS ends,
  printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS at FROM w""")
def sql_words(spark: SparkSession, d: str) -> DataFrame:
    """Words by the table function, with the scalar functions, as SQL text; times come from the timeline's steps."""
    sql_functions.register(spark)
    return spark.sql(
        """SELECT video_id, pos, word, token_estimate(word) AS tokens, ends_sentence(word) AS ends, srt_clock(start_ms) AS at
        FROM timed_words(TABLE(SELECT video_id, text, running_sums(step_ms) AS start_ms FROM {lines}))""",
        lines=transcript.timelines(table(spark, d, "documents")).select("video_id", "text", "step_ms"),
    )


@query(f"WITH {transcripts._CUES} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY first_word) AS cue_id, start_ms, end_ms, n_words, text FROM q5")
def sql_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues by the table function, which takes a video a row, as SQL text."""
    sql_functions.register(spark)
    return spark.sql(
        """SELECT * FROM range_cues(TABLE(SELECT video_id, word, start_ms, zip_with(start_ms, lasts_ms, (a, b) -> a + b) AS end_ms
        FROM (SELECT video_id, word, lasts_ms, running_sums(step_ms) AS start_ms FROM {lines})))""",
        lines=transcript.timelines(table(spark, d, "documents")).select("video_id", "word", "lasts_ms", "step_ms"),
    )


@query("""WITH n AS (SELECT o_custkey AS clip_id, o_orderkey, o_orderkey % 3 AS kind, (o_orderkey * 37 % 90000)::BIGINT AS ms, o_orderkey % 5 AS scenes FROM orders)
SELECT clip_id, CASE kind WHEN 1 THEN 2 ELSE 1 END AS plan_version, CASE WHEN kind = 2 THEN NULL ELSE ms END AS output_ms, CASE kind WHEN 0 THEN 'speaker_crop' WHEN 1 THEN 'stacked_split' ELSE 'auto' END AS layout,
  CASE WHEN kind = 2 THEN 0 ELSE scenes END::INT AS scene_count, kind = 1 AND scenes > 2 AS needs_review FROM n""")
def plan_versions(spark: SparkSession, d: str) -> DataFrame:
    """Plans of two versions, and some that are no JSON or lack everything, read by paths of a variant."""
    k, ms, scenes = F.col("o_orderkey"), (F.col("o_orderkey") * 37 % 90000).cast("long"), F.sequence(F.lit(1).cast("long"), F.col("o_orderkey") % 5)
    scenes = F.when(k % 5 > 0, F.transform(scenes, lambda t: F.struct(t.alias("t")))).otherwise(F.array().cast("array<struct<t:bigint>>"))
    old = F.to_json(F.struct((ms / 1000).alias("output_duration"), F.lit("speaker_crop").alias("layout"), scenes.alias("scenes")))
    framing = F.struct(F.lit("stacked_split").alias("layout"), scenes.alias("scene_crops"), (k % 5 > 2).alias("needs_review"))
    new = F.to_json(F.struct(F.lit(2).alias("plan_version"), ms.alias("output_ms"), framing.alias("framing")))
    none = F.when(k % 2 == 0, F.lit("no json")).otherwise(F.lit('{"layout": null, "scenes": "none"}'))
    plans = table(spark, d, "orders").select(F.col("o_custkey").alias("clip_id"), F.when(k % 3 == 0, old).when(k % 3 == 1, new).otherwise(none).alias("plan"))
    return drift.plan_fields(plans)


@query("""SELECT event_id AS clip_id, user_id AS video_id, event_id * 1000 AS s, event_id * 1000 + 20000 AS e, CASE WHEN event_type IN ('view', 'click') THEN '' ELSE event_type END AS hook,
  CASE WHEN event_type = 'click' OR (event_type NOT IN ('view', 'click') AND user_id % 3 > 0) THEN 'center_crop' ELSE 'auto' END AS layout, 'pending' AS refine_status, '{}' AS provenance FROM events WHERE event_type <> 'error'""")
def drifted_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips written at three ages, each with the columns of its time, read as of today with one age left out by its partition."""
    e = table(spark, d, "events")
    path = new_path(spark, "drifted-clips")
    base = [F.col("event_id").alias("clip_id"), F.col("user_id").alias("video_id"), (F.col("event_id") * 1000).alias("s"), (F.col("event_id") * 1000 + 20000).alias("e")]
    first = e.where("event_type = 'view'").select(base[0].cast("int"), *base[1:])  # ids were narrower once
    second = e.where("event_type = 'click'").select(*base, F.lit("center_crop").alias("layout"))
    third = e.where("event_type NOT IN ('view', 'click', 'error')").select(*base, F.col("event_type").alias("hook"), F.when(F.col("user_id") % 3 > 0, "center_crop").alias("layout"), F.lit(1.5).alias("unheard_of"))
    broken = e.where("event_type = 'error'").select(*base, F.lit("lost").alias("hook"))
    for age, rows in enumerate((first, second, third, broken), 1):
        rows.write.parquet(f"{path}/age={age}")
    return drift.read_drifted(spark, path, keep=["age"]).where("age < 4").drop("age")


@query(rf"""WITH {sql.SENTENCES},
n AS (SELECT *, start_ms - lag(end_ms) OVER v AS bf, coalesce(lead(start_ms) OVER v - end_ms, 700) >= 700 AS rests, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM s WINDOW v AS (PARTITION BY video_id ORDER BY start_ms, id)),
t AS (SELECT x.video_id, x.id, coalesce(arg_min(y.id, y.end_ms) FILTER (WHERE y.rests), arg_max(y.id, y.end_ms)) AS end_id FROM n x JOIN n y ON y.video_id = x.video_id AND y.start_ms BETWEEN x.start_ms AND x.start_ms + 90000
  AND y.id >= x.id AND y.ends_with_punctuation AND y.end_ms - x.start_ms BETWEEN 20000 AND 90000 GROUP BY ALL),
c AS (SELECT n.video_id, n.id, end_id, ends_with(rtrim(text), '?') AS q, coalesce(bf >= 700, true) AS p, len(ws) BETWEEN 3 AND 25 AS l,
  coalesce(lower(trim(ws[1], ' ,.!?"''')), '') IN ('so','and','well','you know','um','uh','like','okay','right','now','it','this','that','these','those','they','them','he','she','his','her','its','there') AS o FROM n JOIN t USING (video_id, id)),
z AS (SELECT *, floor(((CASE WHEN q THEN 1.0 ELSE 0 END + CASE WHEN p THEN 0.6 ELSE 0 END + CASE WHEN l THEN 0.3 ELSE 0 END - CASE WHEN o THEN 1.2 ELSE 0 END)::DOUBLE) * 1000 + 0.5) / 1000.0::DOUBLE AS score FROM c)
SELECT video_id, id AS proposal_id, end_id, score, array_to_string(list_filter([CASE WHEN q THEN 'question' END, CASE WHEN p THEN 'pause' END, CASE WHEN l THEN 'length' END], lambda x: x IS NOT NULL), ', ') AS why FROM z WHERE score >= 0.6""")
def proposed_clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips by cues in the text, over every sentence."""
    return C.propose(transcripts.sents(spark, d)).select("video_id", "proposal_id", "end_id", "score", "why")


@query(f"""WITH {transcripts._OUTLINE},
se AS (SELECT video_id, "window" AS idx, start_id AS a, end_id AS b FROM ol WHERE video_id % 3 > 0),
ins AS (SELECT se.video_id, idx, s.id FROM se JOIN s ON s.video_id = se.video_id AND s.id BETWEEN a AND b UNION ALL SELECT video_id, 0, id FROM s WHERE video_id % 3 = 0),
cu AS (SELECT video_id, idx, id, (row_number() OVER (PARTITION BY video_id, idx ORDER BY id) - 1) // 7 AS sl FROM ins),
gw AS (SELECT video_id, idx, sl, min(id) AS start_id, max(id) AS end_id, count(*) AS n_sentences FROM cu GROUP BY ALL)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx, sl) - 1 AS "window", start_id, end_id, n_sentences, greatest(2, 8 // count(*) OVER (PARTITION BY video_id) + 1) AS asked FROM gw""")
def section_windows(spark: SparkSession, d: str) -> DataFrame:
    """Discovery windows by outline sections; every third video has no outline and goes in slices."""
    # ids and times, worked out once: titles are not asked for
    s = written(transcripts.sents(spark, d).select("video_id", "id", "start_ms", "end_ms"), "shared").withColumn("text", F.lit(""))
    o = segment.outline_windows(s).where("video_id % 3 > 0").select("video_id", F.col("window").alias("idx"), "start_id", "end_id")
    return E.section_windows(s, o, 7)


@query(f"""WITH {transcripts._DIVERSE},
dv AS (SELECT video_id, cand_id, CASE WHEN kept THEN 'selected' WHEN nk >= 8 AND rk > lastk THEN 'surplus' ELSE 'near_duplicate' END AS status FROM z UNION ALL SELECT video_id, cand_id, 'below_floor' FROM sc WHERE total < 0.45)
SELECT dv.video_id, dv.cand_id, CASE WHEN status = 'selected' AND k.e - k.s < 20000 THEN 'rejected' WHEN status = 'selected' THEN 'selected' WHEN status = 'surplus' THEN 'proposed' ELSE 'rejected' END AS status,
  CASE status WHEN 'selected' THEN CASE WHEN k.e - k.s < 20000 THEN 'shorter than 20s' ELSE 'ranked' END WHEN 'surplus' THEN 'surplus beyond target 8' WHEN 'below_floor' THEN 'below quality floor 0.45' ELSE 'near-duplicate of' END AS reason
FROM dv JOIN k USING (video_id, cand_id)""")
def insertion_statuses(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every candidate that selection looked at; of reasons with a number the words."""
    c = transcripts.cands(spark, d)
    looked = C.select_diverse(c, sql.CAMPAIGN).join(c.select("video_id", "cand_id", "s", "e"), ["video_id", "cand_id"])
    return C.insertion_statuses(looked, 20_000).withColumn("reason", F.regexp_replace("reason", "(ranked|near-duplicate of) .*", "$1"))


@query("""WITH o AS (SELECT o_custkey AS clip_id, o_orderkey AS k FROM orders),
c AS (SELECT clip_id, count(*) AS n, min(k) AS k, max((k % 4 = 0)::INT) = 1 AS review, floor(avg((k % 3 > 0)::INT::DOUBLE) * 1000 + 0.5) / 1000.0::DOUBLE AS share FROM o GROUP BY 1)
SELECT clip_id, 2 AS plan_version, (n * 20000)::BIGINT AS output_ms, CASE WHEN clip_id % 2 = 0 THEN 'top' ELSE 'bottom' END AS placement, n AS cue_count, n AS scene_count, review AS needs_review, share AS face_fraction, n AS cuts,
  CASE WHEN clip_id % 5 > 0 THEN 1280 - clip_id % 100 END AS bounds_w, 'votes ' || (clip_id % 7)::VARCHAR AS layout_reason, '1280x720' AS upscaled_from, 23 AS crf, 'slow' AS preset, -1.5::DOUBLE AS peak_limit_db, 'top-right' AS logo_position, 'big' AS whisper_model,
  substr(sha256('export.preset=slow|logo=x|' || CASE WHEN clip_id % 2 = 0 THEN 'auto' ELSE 'center_crop' END), 1, 16) AS config_fingerprint FROM c""")
def edit_plan_fields(spark: SparkSession, d: str) -> DataFrame:
    """Whole plans, of made-up parts by the orders of each customer, read back from JSON as variants."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("k"))
    i, number = F.col("clip_id"), F.lit(0).cast("long")
    ranges = F.array_sort(F.collect_list(F.struct((F.col("k") * 30_000).alias("s"), (F.col("k") * 30_000 + 20_000).alias("e"))))
    clips = o.groupBy("clip_id").agg(ranges.alias("ranges")).select(
        "clip_id", i.alias("clip_number"), F.when(i % 2 == 0, "auto").otherwise("center_crop").alias("layout"), "ranges", F.array().cast("array<struct<s:bigint,e:bigint,out_s:bigint,out_e:bigint>>").alias("timeline"),
        F.concat(F.lit("votes "), (i % 7).cast("string")).alias("layout_reason"), F.when(i % 2 == 0, "top").alias("placement"), F.lit(1280).alias("source_width"), F.lit(720).alias("source_height"),
        F.when(i % 5 > 0, F.struct(number.alias("x"), number.alias("y"), (1280 - i % 100).alias("w"), F.lit(720).cast("long").alias("h"))).alias("bounds"),
    )
    cues = o.select("clip_id", F.col("k").alias("cue_id"), F.lit(0).alias("start_ms"), F.lit(900).alias("end_ms"), F.lit("words").alias("text"))
    scenes = o.select("clip_id", F.col("k").alias("scene"), F.lit("face").alias("kind"), F.lit(640).alias("cx"), F.lit(360).alias("cy"), (F.col("k") % 4 == 0).alias("needs_review"))
    regions = o.where("false").select("clip_id", F.lit(0).alias("idx"), *[F.lit(1).alias(c) for c in "xywh"])
    settings = {"export.preset": "slow", "logo": "x", "versions.whisper_model": "big"}
    p = E.edit_plan(clips, cues, scenes, regions, settings, o.select("clip_id", F.col("k").alias("t")), o.select("clip_id", (F.col("k") % 3).alias("n")))
    v = p.select("clip_id", F.parse_json(F.to_json("plan")).alias("p"))
    get = lambda path, kind, name: drift.at(F.col("p"), path, kind).alias(name)
    return v.select(
        "clip_id", get("$.plan_version", "int", "plan_version"), get("$.output_ms", "long", "output_ms"), get("$.captions.placement", "string", "placement"), get("$.captions.cue_count", "long", "cue_count"),
        get("$.framing.scene_count", "long", "scene_count"), get("$.framing.needs_review", "boolean", "needs_review"), get("$.face_fraction", "double", "face_fraction"),
        F.size(drift.at(F.col("p"), "$.scenes", "array<variant>")).cast("long").alias("cuts"), get("$.framing.content_bounds.w", "long", "bounds_w"), get("$.layout_reason", "string", "layout_reason"),
        get("$.export.upscaled_from", "string", "upscaled_from"), get("$.export.crf", "int", "crf"), get("$.export.preset", "string", "preset"), get("$.audio.peak_limit_db", "double", "peak_limit_db"),
        get("$.branding.logo_position", "string", "logo_position"), get("$.versions.whisper_model", "string", "whisper_model"), get("$.config_fingerprint", "string", "config_fingerprint"),
    )
