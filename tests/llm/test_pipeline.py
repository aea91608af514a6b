"""The corpus pipeline on a small table: every stage against its own input."""

import collections
import zlib

import numpy as np
import pytest

pytest.importorskip("cuewright.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm_operators import brute_components, brute_fingerprint, reference_ids
from test_shingles import brute_set, near

from cuewright.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(name, input rows, output rows) of each stage, written and read again in between."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        df = stage(spark, docs, SF)
        if name != "packing":
            assert df.columns == docs.columns
        df.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return {name: (a, b) for name, a, b in out}


def test_filters_only_drop_rows(steps):
    for name in ("toxicity", "quality", "simhash", "decontamination"):
        before, after = (collections.Counter(map(tuple, x)) for x in steps[name])
        assert not after - before, name


def test_labelled_documents_fare_as_labelled(spark, steps):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, good in (("toxicity", lambda r: r.toxic == 0), ("quality", lambda r: r.quality == 1)):
        before, after = steps[name]
        kept = {r.doc_id for r in after}
        known = [labels[r.doc_id] for r in before if r.doc_id in labels]
        clean = [r for r in known if good(r)]
        assert sum(r.doc_id in kept for r in clean) >= 0.9 * len(clean), name


def test_one_document_of_each_group_stays(steps):
    """Groups by SimHash of five-word shingles, and by their exact similarity."""
    before, after = steps["simhash"]
    marks = [(brute_fingerprint(r.text, 5), brute_set(r.text)) for r in before]
    roots = brute_components(marks, lambda a, b: (a[0] ^ b[0]).bit_count() <= 3 or near(a[1], b[1]))
    least = {}
    for r, root in zip(before, roots, strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values())


ODD = "doc_id long, text string, Score double, _score string, score_ int, key_id string, KEY_TEXT long, _id string, _text string, id int, hash string"


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    texts = ["some plain words here", None, "", " ", "long " * 40_000, "some plain words here"]
    rows = [(i % 5 if i else None, t, 0.5, f"a{i}", i, f"b{i}", i, f"c{i}", f"d{i}", i, f"e{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ODD)
    spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, f"file://{tmp_path}")
            assert got.columns == docs.columns, name
            kept = [tuple(r) for r in got.collect()]
            assert set(kept) <= set(rows), name
            if name in ("toxicity", "quality", "decontamination"):  # nothing to learn from, nothing to find
                assert len(kept) == table.count()
            if name == "simhash":
                assert len(kept) == (3 if table is docs else 0)
        packed = corpus_pipeline.pack(spark, table, f"file://{tmp_path}").collect()
        assert {r.doc_id for r in packed} == {r[0] for r in rows if table is docs}


def test_no_benchmark_text_is_left(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = steps["decontamination"]
    leaks = {r.doc_id for r in before if any(t in r.text for t in items)}
    assert leaks and not leaks & {r.doc_id for r in after}
    assert len(before) - len(after) <= 2 * len(leaks)


def test_packing_holds_all_that_was_kept(steps):
    before, after = steps["packing"]
    want = collections.Counter()
    for r, ids in zip(before, reference_ids([r.text for r in before]), strict=True):
        for k, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            want[r.doc_id, k, s, n, zlib.crc32(np.asarray(ids[s : s + n], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    total = sum(r.length for r in after)
    assert len({r.sequence_id for r in after}) <= 1.02 * -(-total // packing.CAPACITY) + 1


def test_run_gives_the_last_stage(spark, steps):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert collections.Counter(map(key, corpus_pipeline.run(spark, SF).collect())) == collections.Counter(map(key, steps["packing"][1]))
