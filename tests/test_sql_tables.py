"""Table functions over rows and over arrays: the same results, and no shuffle of words."""

import random

from pyspark.sql import functions as F

from cuewright import catalogue, sql_functions  # noqa: F401  (registers the queries)
from cuewright.config import Captions
from cuewright.plans.registry import QUERIES
from cuewright.sources import transcript


def _plan(spark, query):
    return QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_sql_words_shuffles_texts_only(spark):
    plan = _plan(spark, "sql_words")
    assert plan.count("Exchange") == 1 and "Join" not in plan  # two word tables met in a sort-merge join


def test_sql_cues_shuffles_texts_only(spark):
    plan = _plan(spark, "sql_cues")
    assert plan.count("Exchange") == 1 and "BatchEvalPythonUDTF" not in plan  # words were shuffled and pickled one by one


def test_steps_add_up_to_the_timeline(spark, monkeypatch):
    sql_functions.register(spark)
    monkeypatch.setattr(sql_functions, "OUT", 3)
    texts = [(1, "Wait, what? I am here… Now."), (2, None), (3, "  "), (4, "\tone\x0b\ntwo\f three\r\n"), (5, "ünd ßo. " * 300), (None, "of none")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(r.video_id, r.pos, r.word, r.start_ms) for r in transcript.word_timeline(docs).collect()}
    lines = transcript.timelines(docs)
    got = spark.sql("SELECT * FROM timed_words(TABLE(SELECT video_id, text, running_sums(step_ms) AS start_ms FROM {lines}))", lines=lines).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert spark.sql("SELECT * FROM timed_words(TABLE(SELECT video_id, text, step_ms AS start_ms FROM {lines} WHERE false))", lines=lines).count() == 0


def test_srt_clock_is_that_of_format_string(spark):
    sql_functions.register(spark)
    edges = [0, 7, 999, 1000, 59_999, 60_000, 3_599_999, 3_600_000, 359_999_999, 360_000_000, 1 << 50, -1, -61_001, -3_600_000, None]
    df = spark.createDataFrame([(x,) for x in edges], "ms long")
    for r in df.selectExpr("ms", "srt_clock(ms) AS a", "format_string('%02d:%02d:%02d,%03d', ms div 3600000, ms div 60000 % 60, ms div 1000 % 60, ms % 1000) AS b").collect():
        assert r.a == r.b, r


def test_running_sums(spark):
    sql_functions.register(spark)
    df = spark.createDataFrame([(0, [3, 4, 5]), (1, None), (2, []), (3, [7]), (4, [1 << 60, 1])], "i int, x array<bigint>").coalesce(1)
    got = [r.y for r in df.selectExpr("i", "running_sums(x) AS y").orderBy("i").collect()]
    assert got == [[0, 3, 7], None, [], [0], [0, 1 << 60]]


def _loop(words, c=Captions()):
    """The cue rule, a word at a time."""
    out, own = [], []
    for word, start, end in words:
        if not word or start is None or end is None:
            continue
        own.append((word, start, end))
        span, letters = end - own[0][1], sum(len(w) + 1 for w, *_ in own)
        if len(own) >= c.max_words or letters >= c.max_chars or span >= c.max_ms or word[-1] in ".!?…" or (len(own) >= 3 and word[-1] == "," and span * 10 >= c.max_ms * 6):
            out, own = [*out, own], []
    return [(i, x[0][1], x[-1][2], len(x), " ".join(w for w, *_ in x)) for i, x in enumerate([*out, own] if own else out, 1)]


def test_cues_of_rows_and_of_arrays_are_those_of_a_loop(spark):
    sql_functions.register(spark)
    rng, videos = random.Random(5), {}
    for v in [*range(8), None]:
        at, videos[v] = 0, []
        for _ in range(rng.choice([0, 1, 7, 400])):
            word = rng.choice(["a", "of,", "three,", "some", "end.", "Wait…", "extraordinarily", "", None])
            end = None if rng.random() < 0.03 else at + rng.randrange(50, 900)
            videos[v].append((word, at, end))
            at = (end or at) + rng.choice([0, 60, 900])
    want = {(v, *cue) for v, words in videos.items() for cue in _loop(words)}
    for words in videos.values():  # the rule a word at a time, as streams use it
        cue = sql_functions._OpenCue()
        found = [cue.take() for w in words if w[0] and w[2] is not None and cue.add(*w)]
        assert [*found, *([cue.take()] if cue.n else [])] == [c[1:] for c in _loop(words)]
    rows = spark.createDataFrame([(v, i, *w) for v, words in videos.items() for i, w in enumerate(words)], "video_id long, pos long, word string, start_ms long, end_ms long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # a cue is open across batches
    try:
        by_row = spark.sql("SELECT * FROM range_cues(TABLE(SELECT * FROM {rows}) PARTITION BY video_id ORDER BY pos)", rows=rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in by_row} == want and len(by_row) == len(want)
    lists = spark.createDataFrame([(v, *(map(list, zip(*words, strict=True)) if words else (None, None, None))) for v, words in videos.items()], "video_id long, word array<string>, start_ms array<bigint>, end_ms array<bigint>")
    by_video = spark.sql("SELECT * FROM range_cues(TABLE(SELECT * FROM {lists}))", lists=lists.coalesce(2)).collect()
    assert {tuple(r) for r in by_video} == want and len(by_video) == len(want)
    assert spark.sql("SELECT * FROM range_cues(TABLE(SELECT * FROM {rows}) PARTITION BY video_id ORDER BY pos)", rows=rows.where(F.lit(False))).count() == 0
