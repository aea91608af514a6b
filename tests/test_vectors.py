"""The exact similarity join, its use in selection, and the stored vector index."""

import math

import numpy as np
import pytest

from cuewright.config import Fusion
from cuewright.operators import candidates, similarity, vector, vector_index
from cuewright.plans import media

VECTORS = "g long, id long, v array<double>, ids string"


def clustered(rng, n, dims, centres, spread):
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


def brute(rows, least):
    out = {}
    for g, i, v, _ in rows:
        for h, j, w, _ in rows:
            if g == h and i is not None and j is not None and i < j and v and w and len(v) == len(w) and None not in v and None not in w and any(v) and any(w):
                a, b = np.array(v), np.array(w)
                s = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
                if s >= least:
                    out[g, i, j] = s
    return out


@pytest.mark.parametrize(("least", "block"), [(0.92, 7), (0.5, 1024), (-1.0, 5)])
def test_similarity_join_equals_brute_force(spark, least, block):
    rng = np.random.default_rng(3)
    v = clustered(rng, 120, 20, 9, 0.25)
    rows = [(int(i % 3 == 0) if i < 90 else 7, i, v[i].tolist(), "x") for i in range(120)]  # a large group
    rows += [(7, 500, None, "x"), (7, 501, [0.0] * 20, "x"), (7, 502, [], "x"), (7, 503, [1.0, None] * 10, "x"), (7, 504, v[3].tolist(), "x"), (7, 505, (v[3] * 3).tolist(), "x")]
    rows += [(7, 600, [1.0, 2.0, 3.0], "x"), (7, 601, [1.0, 2.0, 3.1], "x"), (8, 1, v[0].tolist(), "x"), (7, 504, v[3].tolist(), "again")]
    p = similarity.JoinParams(block_rows=block, slice_dims=6)
    got = similarity.cosine_pairs(spark.createDataFrame(rows, VECTORS).repartition(5), "g", "id", "v", least, p).collect()
    want = brute(rows, least)
    assert {(r.g, r.id_a, r.id_b) for r in got} == set(want)
    assert all(abs(r.similarity - want[r.g, r.id_a, r.id_b]) < 1e-9 for r in got)


def test_similarity_join_of_an_empty_table(spark):
    assert similarity.cosine_pairs(spark.createDataFrame([], VECTORS), "g", "id", "v", 0.9).count() == 0


def test_blocks_and_slices_prune(spark):
    rng = np.random.default_rng(5)
    v = clustered(rng, 1500, 32, 12, 0.05)
    df = spark.createDataFrame([(1, i, x.tolist(), "") for i, x in enumerate(v)], VECTORS)
    blocks = similarity.blocks(df, "g", "id", "v", similarity.JoinParams(block_rows=50))
    n = blocks.count()
    assert similarity.block_pairs(blocks, 0.92).count() < 0.5 * n * (n + 1) / 2
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j, s, outlived = similarity.near_rows(u[:300], u[300:600], 0.92, 8)
    assert len(i) and (s >= 0.92).all() and outlived < 0.3 * 300 * 300


CANDS = "video_id long, cand_id long, s long, e long, hook string, payoff string, required_context string, uncertainty double, source string, embedding array<double>"


def test_selection_compares_vectors_where_there_are_some(spark):
    near, far = [1.0, 0.02], [0.0, 1.0]
    # overlap of 0.40: near-duplicates only if their content is alike
    pair = lambda video, a, b, hook: [(video, 1, 0, 40_000, "what a story it was", "p", "", 0.0, "outline", a), (video, 2, 17_000, 57_000, hook, "p", "", 0.1, "outline", b)]
    rows = pair(1, [1.0, 0.0], near, "entirely other words here") + pair(2, [1.0, 0.0], far, "what a story it was")
    rows += pair(3, [1.0, 0.0], None, "what a story it was") + pair(4, None, None, "entirely other words here")
    df = spark.createDataFrame(rows, CANDS)
    got = {(r.video_id, r.cand_id): (r.status, r.reason) for r in candidates.select_diverse(df).collect()}
    assert got[1, 1] == ("selected", "ranked #1") and got[1, 2] == ("near_duplicate", "near-duplicate of 1")
    assert [got[v, 2][0] for v in (2, 3, 4)] == ["selected", "near_duplicate", "selected"]
    kept = {(r.video_id, r.cand_id) for r in candidates.dedup_refined(df).where("kept").collect()}
    assert kept == {(v, 1) for v in (1, 2, 3, 4)} | {(2, 2), (4, 2)}
    assert Fusion().near_similarity == 0.92


def recall(exact, found):
    return len(exact & found) / len(exact)


def test_index_recall_and_pairs_scored_on_the_table(spark, tmp_path, capsys):
    clips, chunks = media.clip_and_chunk_vectors(spark, "/root/testdata/sf0.1")
    path = str(tmp_path / "index")
    vector_index.create(chunks, path)
    exact = {(r.clip_id, r.chunk_id) for r in vector.top_k(clips, chunks, 4, 0.05).collect()}
    found = {(r.clip_id, r.chunk_id) for r in vector_index.search(clips, path, 4, 0.05, media.PROBES, media.REFINE).collect()}
    scored = vector_index.candidates(clips, path, media.PROBES, media.REFINE).count()
    every = clips.join(chunks, "video_id").count()
    with capsys.disabled():
        print(f"\nvector index at sf0.1: recall {recall(exact, found):.3f}, {scored} of {every} pairs scored")
    assert recall(exact, found) >= 0.9 and scored < every / 5


def test_index_of_clustered_vectors_probes_few_cells_and_grows(spark, tmp_path):
    rng = np.random.default_rng(8)
    v = clustered(rng, 3000, 24, 40, 0.2)
    df = spark.createDataFrame([(int(i % 2), i, x.tolist()) for i, x in enumerate(v)], "video_id long, chunk_id long, embedding array<double>")
    queries = df.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "clip_id")
    path, p = str(tmp_path / "index"), vector_index.IndexParams(cells=40, sample_rows=500)
    vector_index.create(df.where("chunk_id < 2000"), path, p=p)
    before = vector_index.centres_of(spark, path)
    vector_index.append(df.where("chunk_id >= 2000").unionByName(spark.createDataFrame([(0, 9000, None), (0, 9001, [0.0] * 24)], df.schema)), path, p=p)
    assert (vector_index.centres_of(spark, path) == before).all()
    assert spark.read.parquet(path + "/vectors").count() == 3000
    exact = {(r.clip_id, r.chunk_id) for r in vector.top_k(queries, df, 5, 0.5).collect()}
    out = vector_index.search(queries, path, 5, 0.5, probes=4, refine=100, p=p)
    assert recall(exact, {(r.clip_id, r.chunk_id) for r in out.collect()}) >= 0.9
    assert vector_index.candidates(queries, path, 4, 100, p=p).count() < queries.join(df, "video_id").count() / 5
    one = vector_index.search(queries.limit(1), path, 5, 0.5, probes=4, p=p)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_index_refuses_other_sizes_and_empty_tables(spark, tmp_path):
    kind = "video_id long, chunk_id long, embedding array<double>"
    with pytest.raises(ValueError):
        vector_index.create(spark.createDataFrame([(1, 1, None)], kind), str(tmp_path / "none"))
    vector_index.create(spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(9)], kind), str(tmp_path / "two"), p=vector_index.IndexParams(cells=2))
    with pytest.raises(Exception, match="2 dimensions"):
        vector_index.append(spark.createDataFrame([(1, 9, [1.0, 2.0, 3.0])], kind), str(tmp_path / "two"))
    assert math.isclose(np.linalg.norm(vector_index.centres_of(spark, str(tmp_path / "two"))[0]), 1.0)
