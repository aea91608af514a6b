"""State streams, the subtitle data source, SQL functions, drifted tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cuewright import sql_functions
from cuewright.functions import text as X
from cuewright.operators import captions, framing
from cuewright.sources import drift, formats
from cuewright.streaming import stateful

WORDS = "video_id long, pos long, word string, start_ms long, end_ms long"
SAMPLES = "clip_id long, pos long, cx double, cy double, cut boolean"


def drain(spark, source, schema, out, checkpoint, make):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(200)


@pytest.fixture
def rocksdb(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_streams_in_any_order_and_after_a_restart_equal_the_batch(spark, tmp_path, rocksdb):
    rng = random.Random(4)
    words = [(v, i, f"w{i}" + rng.choice(["", "", ",", "."]), i * 400, i * 400 + 350) for v in range(3) for i in range(30)]
    samples = [(c, i, *((None, None) if rng.random() < 0.3 else (rng.uniform(0, 1280), rng.uniform(0, 720))), rng.random() < 0.1) for c in range(3) for i in range(30)]
    ends = [(v, 30, None, None, None) for v in range(3)]
    for name, rows, schema, make in (("words", words, WORDS, stateful.cues), ("samples", samples, SAMPLES, stateful.centres)):
        mixed = rows + ends + rng.sample(rows, 10)  # any order, ends and repeats among them
        rng.shuffle(mixed)
        source, out, checkpoint = (f"file://{tmp_path}/{name}-{x}" for x in ("in", "out", "checkpoint"))
        for part in (0, 1):  # the second half comes after a restart
            for k in range(2):
                spark.createDataFrame(mixed[part * 2 + k :: 4], schema).coalesce(1).write.mode("append").parquet(source)
            drain(spark, source, schema, out, checkpoint, make)
        df = spark.createDataFrame(rows, schema)
        if name == "words":
            want = captions.caption_cues(df).select("video_id", "start_ms", "end_ms", "text")
        else:
            want = framing.smoothed_centres(df)
        assert sorted(map(str, spark.read.parquet(out).select(*want.columns).collect())) == sorted(map(str, want.collect()))


CUES = "clip_id string, cue long, start_ms long, end_ms long, text string"


def test_subtitles_round_trip_and_pushed_filters(spark, tmp_path):
    formats.register(spark)
    rows = [(f"clip {c}/é", i, c * 1000 + i * 700, c * 1000 + i * 700 + 650, f"text {c}.{i}") for c in range(4) for i in range(5)]
    df = spark.createDataFrame(rows, CUES)
    path = f"file://{tmp_path}/subs"
    os.mkdir(tmp_path / "subs")
    df.repartition("clip_id").write.format("subtitles").mode("append").save(path)
    assert sorted(os.listdir(tmp_path / "subs")) == sorted(f"clip%20{c}%2F%C3%A9.srt" for c in range(4))
    (tmp_path / "subs" / "talk.json").write_text('{"segments": [{"words": [{"word": " hi ", "start": 0.1, "end": "0.25"}, {"word": "x"}]}]}')
    back = spark.read.format("subtitles").load(path)
    got = {tuple(r) for r in back.collect()}
    assert got == {tuple(r) for r in rows} | {("talk", 0, 100, 250, "hi")}
    one = spark.read.format("subtitles").load(path).where(F.col("video_id") == "talk").where("start_ms >= 0")
    assert [tuple(r) for r in one.collect()] == [("talk", 0, 100, 250, "hi")] and one.rdd.getNumPartitions() == 1
    df.where("clip_id like '%0%'").repartition("clip_id").write.format("subtitles").option("kind", "ass").mode("append").save(path)
    assert "Dialogue: 0,0:00:00.00,0:00:00.65,Default,,0,0,0,,text 0.0" in (tmp_path / "subs" / "clip%200%2F%C3%A9.ass").read_text()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    formats.register(spark)
    path = tmp_path / "subs"
    os.mkdir(path)
    df = spark.createDataFrame([("a", 0, 0, 1, "x"), ("b", 0, 0, 1, "y")], CUES).repartition(2, "clip_id")
    broken = df.withColumn("text", F.when(F.col("clip_id") == "b", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        broken.write.format("subtitles").mode("append").save(f"file://{path}")
    assert os.listdir(path) == []
    twice = df.union(df.withColumn("cue", F.lit(1).cast("long"))).repartitionByRange(2, "cue")  # a clip in two tasks
    with pytest.raises(Exception, match="repartition by clip_id"):
        twice.write.format("subtitles").mode("append").save(f"file://{path}")
    assert os.listdir(path) == []


def test_sql_functions_equal_the_column_functions(spark):
    sql_functions.register(spark)
    df = spark.createDataFrame([(0, "a"), (3_723_456, "{x}\\"), (-40, "Wait…"), (35_999_999, ""), (None, None), (59_999, "end.")], "ms long, t string")
    got = df.selectExpr("clip_clock(ms)", "srt_clock(ms)", "ass_clock(ms)", "ass_text(t)", "token_estimate(t)", "ends_sentence(t)").collect()
    want = df.select(X.clock(F.col("ms")), X.srt_time(F.col("ms")), X.ass_time(F.col("ms")), X.ass_escape(F.col("t")), X.approx_tokens(F.col("t")), X.ends_sentence(F.col("t"))).collect()
    for g, w, r in zip(got, want, df.collect(), strict=True):
        assert tuple(g)[2:] == tuple(w)[2:] and (r.ms is None or r.ms < 0 or tuple(g) == tuple(w)), (g, w)
    none = spark.sql("SELECT count(*) AS n FROM (SELECT CAST(NULL AS STRING) AS x UNION ALL SELECT '') s, LATERAL text_words(s.x) t").first().n
    assert none == 0


def test_drifted_tables_widen_default_and_prune(spark, tmp_path):
    path = f"file://{tmp_path}/clips"
    spark.createDataFrame([(1, 2)], "clip_id int, s int").write.parquet(path + "/age=1")
    spark.createDataFrame([(2, 3, None, "x"), (3, 4, "hi", "y")], "clip_id long, s long, hook string, other string").write.parquet(path + "/age=2")
    df = drift.read_drifted(spark, path, keep=["age"])
    assert {(r.clip_id, r.s, r.hook, r.layout, r.age) for r in df.collect()} == {(1, 2, "", "auto", 1), (2, 3, "", "auto", 2), (3, 4, "hi", "auto", 2)}
    plan = df.where("age = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(age" in plan
    merged = drift.read_drifted(spark, path + "/age=2", merge=True)
    assert "other" in merged.columns and merged.where("hook = ''").count() == 1
