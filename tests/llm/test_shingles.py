"""Near copies by exact shingle similarity, against brute force."""

import random

import numpy as np
import pytest

pytest.importorskip("cuewright.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm_operators import brute_components, docs, words

from cuewright.llm import shingles, simhash


def brute_set(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def survivors(rows):
    roots = brute_components([brute_set(t) for _, t in rows], near)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, 1 << 63), (1 << 63) - 1 if i is None else i)
    return sorted(least.values())


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9999)}"
    return " ".join(w)


@pytest.mark.parametrize(("next_", "crowd"), [(1, 200_000), (16, 200_000), (4, 12)])
def test_near_copies_against_brute_force(spark, monkeypatch, next_, crowd):
    monkeypatch.setattr(shingles, "NEXT", next_)
    monkeypatch.setattr(shingles, "CROWD", crowd)
    monkeypatch.setattr(shingles, "PIVOTS", 2)
    rng = random.Random(9)
    line = words(rng, 12)
    rows = [(i, words(rng, rng.randint(1, 90)) + (" " + line if i % 2 else "")) for i in range(40)]
    for i in range(60):
        rows.append((100 + i, edited(rng, rows[i % 12][1], i % 7)))
    crowd = words(rng, 120)
    rows += [(300 + i, edited(rng, crowd, rng.randint(0, 5))) for i in range(50)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, rows[0][1]), (None, None), (7, rows[7][1]), (403, "one two"), (404, "One  two"), (405, "two one")]
    got = shingles.keep_one(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    assert sorted((1 << 63) - 1 if r.doc_id is None else r.doc_id for r in got.collect()) == survivors(rows)


def test_bitmaps_never_count_too_many_differences():
    rng = np.random.default_rng(3)
    for n, m, both in ((10, 12, 8), (300, 290, 250), (100, 1, 0), (64, 65, 64), (5000, 4000, 3900)):
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
        assert shingles.fewest_differences(shingles.parities(a), shingles.parities(b)) <= n + m - 2 * both
    assert shingles.fewest_differences(shingles.parities(pool[:70]), shingles.parities(pool[:70])) == 0


def test_the_pipeline_leaves_no_near_copy(spark):
    rng = random.Random(4)
    while True:
        text = " ".join(f"word{rng.randint(0, 5000)}" for _ in range(60))
        other = edited(rng, text, 1)  # 51 of 61 shingles
        if (simhash.fingerprint(text) ^ simhash.fingerprint(other)).bit_count() > 3:
            break
    assert near(brute_set(text), brute_set(other))
    left = docs(spark, [(1, text), (2, other), (3, "something else of its own words")])
    for name, stage in corpus_pipeline.STAGES:
        if name in ("simhash", "near_copies"):
            left = stage(spark, left, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
