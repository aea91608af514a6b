"""Batch embedding and outside calls by stubs that count, and the proposer, windows and provenance."""

import glob
import json
import os
import time
import uuid

import numpy as np
import pytest

from cuewright.operators import candidates, editing, models


def loader_of(folder):
    """A model that notes each load, and each batch's lengths; local functions travel to the workers whole."""

    def load():
        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts, prompt):
            with open(f"{folder}/batch-{uuid.uuid4().hex}", "w") as f:
                json.dump([len(t) for t in texts], f)
            return np.array([[len(t), len(prompt), 3.0, 4.0] for t in texts])

        return model

    return load


def test_models_load_once_a_worker_and_keep_the_order(spark, tmp_path):
    rows = [(i, "x" * (1 + i * 7919 % 50) if i % 9 else None, [9.0] if i % 10 == 1 else None) for i in range(200)] + [(999, "  ", None)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<float>").repartition(12)
    out = models.embed_with(df, f"stub-{tmp_path}", loader_of(str(tmp_path)), prompt="query", batch=16)
    got = {r.id: r.embedding for r in out.collect()}
    want = {i: e if e else [float(len(t)), 5.0, 3.0, 4.0] if t and t.strip() else None for i, t, e in rows}
    assert got == want
    loads = [os.path.basename(f).split("-")[1] for f in glob.glob(f"{tmp_path}/load-*")]
    assert len(loads) == len(set(loads)) <= 4 < 12  # a load a worker, not a task
    for f in glob.glob(f"{tmp_path}/batch-*"):
        lengths = json.load(open(f))
        assert lengths == sorted(lengths) and len(lengths) <= 16
    head = models.embed_with(df.drop("embedding"), f"stub-{tmp_path}", loader_of(str(tmp_path)), head=2).where("id = 1").first().embedding
    assert np.linalg.norm(head) == pytest.approx(1.0) and len(head) == 2


def client_of(folder, fatal=None):
    """Replies to all; some prompts find the service busy at first, some always, some break it. Notes every call."""

    def client(prompt):
        n = len(glob.glob(f"{folder}/{prompt}-*"))
        open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w").close()
        k = int(prompt[1:])
        if k == fatal:
            raise SystemExit("the worker dies")
        if k % 10 == 3 and n < 2 or k % 10 == 7:
            raise models.Busy(0.01 if k % 20 == 3 else None)
        if k % 10 == 9:
            raise RuntimeError("broken")
        return f"reply to {prompt}"

    return client


def test_calls_are_tried_again_and_asked_once(spark, tmp_path):
    calls, store = tmp_path / "calls", tmp_path / "store"
    calls.mkdir()
    store.mkdir()
    p = models.CallParams(first_wait=0.01)
    df = spark.createDataFrame([(i, f"p{i % 30}" if i % 11 else None, 1) for i in range(90)], "id long, prompt string, Reply int").repartition(3)
    with pytest.raises(Exception, match="dies|exited|crash|SystemExit|failed"):
        models.ask(df, client_of(str(calls), fatal=20), f"file://{store}", p=p).collect()
    out = models.ask(df, client_of(str(calls)), f"file://{store}", p=p)
    rows = out.collect()
    again = models.ask(df, client_of(str(calls)), f"file://{store}", p=p).where("prompt in ('p1', 'p2', 'p13')").collect()
    assert len(rows) == 90 and out.columns == ["id", "prompt", "Reply", "reply_", "error"]
    for r in rows + again:
        k = int(r.prompt[1:]) if r.prompt else None
        if k is None:
            assert (r.reply_, r.error) == (None, None)
        elif k % 10 == 7:
            assert (r.reply_, r.error) == (None, "busy after 4 tries")
        elif k % 10 == 9:
            assert (r.reply_, r.error) == (None, "RuntimeError: broken")
        else:
            assert (r.reply_, r.error) == (f"reply to p{k}", None)
    count = lambda k: len(glob.glob(f"{calls}/p{k}-*"))
    assert all(count(k) == 1 for k in range(30) if k % 10 in (0, 1, 2, 4, 5, 6, 8) and k != 20)  # through three jobs, one of them broken
    assert all(count(k) == 3 for k in (3, 13, 23))


def test_the_rate_is_shared_by_processes(tmp_path):
    rate = models.Rate(uuid.uuid4().hex, 50.0)
    began = time.time()
    for _ in range(11):
        models.Rate(rate.path.rsplit("cuewright-rate-", 1)[1], 50.0).turn()
    assert time.time() - began >= 0.19


def test_the_proposer_follows_cues_in_the_text(spark):
    texts = [("Why does it work?", 0), ("so this is it.", 0), ("The second one rests.", 2000), ("Nothing much.", 0), ("It leans on that.", 900), ("A long and quiet sentence here.", 0), ("no end", 0)]
    rows, at = [], 0
    for i in range(28):
        text, pause = texts[i % 7]
        at += pause
        rows.append((1, i, at, at + 4000, text, text[-1] in ".?"))
        at += 4100
    df = spark.createDataFrame(rows, "video_id long, id long, start_ms long, end_ms long, text string, ends_with_punctuation boolean")
    got = {r.start_id: r for r in candidates.propose(df).collect()}
    assert 0 in got and got[0].why.startswith("question") and got[0].end_id == 8  # the next end that a pause follows
    assert all(i % 7 not in (1, 4) for i in got)
    assert all(rows[r.end_id][5] and 20_000 <= rows[r.end_id][3] - rows[i][2] <= 90_000 for i, r in got.items())
    loud = {r.start_id for r in candidates.propose(df, spark.createDataFrame([(1, rows[5][2] + 10)], "video_id long, peak_ms long")).collect()}
    assert 5 in loud and 5 not in got
    assert candidates.propose(df.where("false")).count() == 0


def test_windows_by_section(spark):
    sents = spark.createDataFrame([(v, i) for v in (1, 2, 3) for i in range(10)], "video_id long, id long")
    sections = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 30), (1, 2, 40, 50), (3, 0, 2, 3)], "video_id long, idx long, start_id long, end_id long")
    got = sorted((r.video_id, r.window, r.start_id, r.end_id, r.n_sentences, r.asked) for r in editing.section_windows(sents, sections, 4, 8).collect())
    assert got == [(1, 0, 0, 3, 4, 3), (1, 1, 4, 4, 1, 3), (1, 2, 5, 8, 4, 3), (1, 3, 9, 9, 1, 3), (2, 0, 0, 3, 4, 3), (2, 1, 4, 7, 4, 3), (2, 2, 8, 9, 2, 3), (3, 0, 2, 3, 2, 9)]


def test_inserted_clips_tell_where_they_come_from(spark):
    kind = "video_id long, cand_id long, rank int, s long, e long, hook string, main_idea string, rationale string, total double, source string, sentence_ids array<long>, uncertainty double, embedding array<float>"
    rows = [(1, 7, 1, 0, 20_000, "h", "", "", 0.8, "outline", [1, 2], 0.25, [1.0]), (1, 8, 2, 0, 9000, "h", "", "", 0.7, "audio_event", [3], 0.5, None)]
    df = spark.createDataFrame(rows, kind)
    chunks = spark.createDataFrame([(1, 0, 0, 60_000)], "video_id long, chunk_index long, start_ms long, end_ms long")
    (clip,) = candidates.insert_winners(df, chunks).collect()
    assert json.loads(clip.provenance) == {"source": "outline", "sentence_ids": [1, 2], "uncertainty": 0.25, "fusion_score": 0.8} and clip.embedding == [1.0]
    looked = spark.createDataFrame([(1, 7, 0, 20_000, "selected", "ranked #1"), (1, 8, 0, 9000, "selected", "ranked #2"), (1, 9, 0, 1, "surplus", "s"), (1, 10, 0, 1, "near_duplicate", None)], "video_id long, cand_id long, s long, e long, status string, reason string")
    got = {r.cand_id: (r.status, r.reason) for r in candidates.insertion_statuses(looked).collect()}
    assert got == {7: ("selected", "ranked #1"), 8: ("rejected", "shorter than 15s"), 9: ("proposed", "s"), 10: ("rejected", "")}


def test_event_cues_say_why(spark):
    from cuewright.operators import signal

    events = spark.createDataFrame([(1, 30_000, 0.8, 9.5, "laughter")], "key long, peak_ms long, confidence double, energy_increase double, label string")
    sents = spark.createDataFrame([(1, i, i * 2000, i * 2000 + 1900) for i in range(30)], "video_id long, id long, start_ms long, end_ms long")
    words = sents.select("video_id", "start_ms", "end_ms")
    (cue,) = signal.event_cues(events, sents, words).collect()
    assert cue.rationale == "audio spike +9.5 dB at 30.0 s; speech covers 95 %"
    assert json.loads(cue.provenance) == {"source": "audio_event", "event_peak": 30000, "energy_increase": 9.5, "label": "laughter"}
