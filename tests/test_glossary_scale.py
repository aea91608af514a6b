"""Large glossaries where rows are many: words stay where they are, and pairs are counted by hash first."""

import random
from collections import Counter

import pytest

from cuewright import catalogue  # noqa: F401  (registers the queries)
from cuewright.operators import captions, glossary
from cuewright.plans.registry import QUERIES


def test_words_that_are_dealt_by_video_are_not_shuffled_again(spark):
    plan = QUERIES["large_glossary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1


@pytest.mark.parametrize(("most", "buckets"), [(1, 1 << 20), (5, 7), (40, 64), (40, 1 << 20), (10_000, 1 << 15), (0, 8)])
def test_frequent_pairs_equal_a_count_of_all(spark, most, buckets):
    rng = random.Random(most)
    vocabulary = [f"{rng.choice('aBcÉΣ')}{int(rng.expovariate(0.2))}" for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(90))) for _ in range(120)] + [None, "", "  ", "one", "same SAME Same", "x\ty\n x  y"]
    counts = Counter()
    for t in texts:
        ws = (t or "").lower().split()
        counts.update(p for p in zip(ws, ws[1:], strict=False) if p[0] != p[1])
    want = sorted(((a, b, n) for (a, b), n in counts.items()), key=lambda r: (-r[2], r[0].encode(), r[1].encode()))[:most]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert glossary.frequent_pairs(df, most, buckets) == want
    assert glossary.frequent_pairs(df.where("false"), most, buckets) == []


def test_rare_pairs_of_full_counters_are_not_taken_for_frequent_ones(spark):
    # 200 pairs of one occurrence share two counters, which are the largest; the frequent pair has the third place or is with them
    texts = [(f"u{i} v{i}",) for i in range(200)] + [("often seen",)] * 60
    df = spark.createDataFrame(texts, "text string")
    for buckets in range(2, 7):
        assert glossary.frequent_pairs(df, 1, buckets) == [("often", "seen", 60)]


def test_entries_reach_across_batches(spark):
    words = [(v, i, w) for v in (1, 2, None) for i, w in enumerate("a b c d a b c a b x c d a b c d".split())]
    df = spark.createDataFrame(words, "video_id long, pos long, word string").coalesce(1)
    entries = [("a b c d", "ABCD"), ("b c", "BC"), ("c d a", "CDA"), ("x", "X")]
    want = {(r.video_id, r.pos): r.display for r in captions.glossary_display(df, entries, 0).collect()}
    for size in (1, 2, 3, 5, 17):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = captions.glossary_display(df, entries, 0).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r.video_id, r.pos): r.display for r in got} == want and len(got) == len(words), size
