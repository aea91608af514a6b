"""Streaming forms against their batch results."""

from pyspark.sql import functions as F

from cuewright.operators import captions
from cuewright.streaming import utterances

WORDS = "video_id long, pos long, word string, start_ms long, end_ms long"


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_cues_carry_state_between_batches(spark, tmp_path):
    rows = [(v, i, f"w{i}" + ("." if i % 11 == 10 else ""), i * 400, i * 400 + 350) for v in range(3) for i in range(44)]
    df = spark.createDataFrame(rows, WORDS)
    for a in range(0, 44, 11):
        df.where(F.col("pos").between(a, a + 10)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(WORDS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = run(spark, utterances.cues(stream), "cues_out")
    want = captions.caption_cues(df).select("video_id", "start_ms", "end_ms", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_end_mark_gives_out_the_open_cue(spark, tmp_path):
    rows = [(1, i, f"w{i}", i * 400, i * 400 + 350) for i in range(11)]
    df = spark.createDataFrame(rows, WORDS)
    df.where("pos < 9").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    df.where("pos >= 9").union(spark.createDataFrame([(1, 99, None, None, None), (2, 0, None, None, None)], WORDS)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(WORDS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for name, idle in (("ended_out", None), ("idle_out", "10 minutes")):
        got = run(spark, utterances.cues(stream, idle=idle), name)
        want = captions.caption_cues(df).select("video_id", "start_ms", "end_ms", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-02 00:00:00"), (2, "2024-01-01 00:00:00"), (9, "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = utterances.event_time(spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(f"file://{tmp_path}/in"))
    got = run(spark, utterances.sessions(stream, "user_id"), "sessions_out")
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_tumbling_energy_in_batch(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 3.0), (1, "2024-01-01 05:00:00", 4.0)], "k long, t string, v double").withColumn("at", F.col("t").cast("timestamp"))
    assert abs(utterances.tumbling_energy(df, "k", "v").first().rms - 12.5**0.5) < 1e-6
