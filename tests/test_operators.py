"""Operators on tiny tables: restated loops, examples and edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.config import Captions, Chunking
from cuewright.functions import numeric, text
from cuewright.operators import adapters, candidates, captions, framing, intervals, segment, signal, speakers, state, vector
from cuewright.sources import sinks, transcript


def word_rows(rng, video, n, punct=0.15, pause=0.1):
    t, rows = 0, []
    for i in range(n):
        w = rng.choice(["so", "talk", "clip", "moment", "a"]) + rng.choice(["", "", "", ","])
        if rng.random() < punct:
            w += rng.choice([".", "!", "?", "…"])
        dur = rng.randint(100, 600)
        rows.append((video, i, w, t, t + dur))
        t += dur + (rng.choice([1000, 1300, 2500]) if rng.random() < pause else rng.randint(10, 400))
    return rows


WORDS = "video_id long, pos long, word string, start_ms long, end_ms long"


@pytest.fixture(scope="module")
def timeline(spark):
    rng = random.Random(1)
    rows = [r for v in range(12) for r in word_rows(rng, v, rng.choice([1, 2, 30, 150]))]
    rows += word_rows(rng, 50, 120, punct=0.0, pause=0.4) + word_rows(rng, 51, 900, punct=0.05, pause=0.01)
    return rows, spark.createDataFrame(rows, WORDS).cache()


def by_video(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def ends(w, chars=".!?…"):
    return w.rstrip()[-1:] in chars and w.strip() != ""


def loop_sentences(ws):
    out, cur = [], []
    for i, (_, _, w, _, e) in enumerate(ws):
        cur.append(i)
        last = i == len(ws) - 1
        pause = not last and ws[i + 1][3] - e >= 1000 and len(cur) >= 3
        if ends(w) or pause or last:
            out.append((cur[0], cur[-1], ends(w)))
            cur = []
    return out


def test_sentences_equal_the_loop(timeline):
    rows, df = timeline
    got = {}
    for r in segment.sentences(df).collect():
        got.setdefault(r.video_id, []).append((r.start_word, r.end_word, r.ends_with_punctuation, r.text))
    for v, ws in by_video(rows).items():
        assert [x[:3] for x in sorted(got[v])] == loop_sentences(ws)
        assert " ".join(x[3] for x in sorted(got[v])) == " ".join(w[2] for w in ws)


def loop_chunks(ws, cfg):
    cuts = set()
    for i in range(1, len(ws)):
        if ws[i][3] - ws[i - 1][4] >= cfg.silence_ms:
            if ends(ws[i - 1][2], ".!?"):
                cuts.add(i)
            else:
                cuts.add(next((j + 1 for j in range(i, min(i + 20, len(ws))) if ends(ws[j][2], ".!?")), i))
    final, lo = set(cuts), 0
    for hi in sorted(cuts):
        if max(1, len(" ".join(w[2] for w in ws[lo:hi])) // 4) > cfg.max_tokens:
            mid = (lo + hi) // 2
            final.add(next((k + 1 for k in range(mid, hi) if ends(ws[k][2], ".!?")), mid))
        lo = hi
    out, bounds = [], [0, *sorted(final), len(ws)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a and ws[b - 1][4] - ws[a][3] >= cfg.min_ms:
            out.append((a, b - 1))
    return out


@pytest.mark.parametrize("cfg", [Chunking(min_ms=3000), Chunking(min_ms=0, max_tokens=30), Chunking(silence_ms=400, min_ms=1000, max_tokens=10)])
def test_chunks_equal_the_loop(timeline, cfg):
    rows, df = timeline
    got = {}
    for r in segment.silence_chunks(df, cfg).collect():
        got.setdefault(r.video_id, []).append((r.chunk_index, r.start_word, r.end_word))
    for v, ws in by_video(rows).items():
        assert [x[1:] for x in sorted(got.get(v, []))] == loop_chunks(ws, cfg)
        assert [x[0] for x in sorted(got.get(v, []))] == list(range(len(got.get(v, []))))


def test_overlap_puts_earlier_words_in_front(timeline):
    rows, df = timeline
    cfg = Chunking(min_ms=3000, overlap_ms=4000)
    raw = {v: loop_chunks(ws, cfg) for v, ws in by_video(rows).items()}
    for r in segment.overlap_chunks(df, cfg).collect():
        ws, cs = by_video(rows)[r.video_id], raw[r.video_id]
        a, b = cs[r.chunk_index]
        lead = []
        if r.chunk_index:
            p, q = cs[r.chunk_index - 1]
            lead = [w for w in ws[p : q + 1] if w[4] >= ws[a][3] - 4000]
        assert r.text == " ".join(w[2] for w in lead + ws[a : b + 1]) and r.is_overlap_tail == bool(lead)
        assert r.start_ms == (lead[0][3] if lead else ws[a][3])


def loop_cues(ws, cfg):
    out, cur = [], []
    for w in ws:
        cur.append(w)
        chars, dur = sum(len(x[2]) + 1 for x in cur), cur[-1][4] - cur[0][3]
        if len(cur) >= cfg.max_words or chars >= cfg.max_chars or dur >= cfg.max_ms or ends(w[2]) or (len(cur) >= 3 and dur * 10 >= cfg.max_ms * 6 and w[2].endswith(",")):
            out.append(cur)
            cur = []
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("cfg", [Captions(), Captions(max_words=4), Captions(max_ms=1200)])
def test_cues_equal_the_loop(timeline, cfg):
    rows, df = timeline
    got = {}
    for r in captions.caption_cues(df, cfg).collect():
        got.setdefault(r.video_id, []).append((r.cue_id, r.start_ms, r.end_ms, r.text))
    for v, ws in by_video(rows).items():
        want = [(i + 1, c[0][3], c[-1][4], " ".join(w[2] for w in c)) for i, c in enumerate(loop_cues(ws, cfg))]
        assert sorted(got[v]) == want


def test_ten_plain_words_make_three_cues(spark):
    rows = [(1, i, f"w{i}", i * 400, i * 400 + 350) for i in range(10)]
    assert captions.caption_cues(spark.createDataFrame(rows, WORDS), Captions(max_words=4)).count() == 3


def test_srt_continues_on_output_time(spark):
    rows = [(1, i, f"w{i}", t, t + 300) for i, t in enumerate([0, 500, 1500, 10_000, 11_000])]
    r = spark.createDataFrame([(7, 1, 0, 2000), (7, 1, 10_000, 12_000)], "clip_id long, video_id long, s long, e long")
    lines = captions.srt_lines(spark.createDataFrame(rows, WORDS), r)
    got = [x.line for x in lines.orderBy("n").collect()]
    assert got[3] == "00:00:02,000 --> 00:00:02,300 w3" and len(got) == 5
    srt = captions.srt_files(lines).first().srt
    assert srt.startswith("1\n00:00:00,000 --> 00:00:00,300\nw0\n") and srt.count(" --> ") == 5
    back = transcript.srt_cues(spark.createDataFrame([("a", srt)], "video_id string, value string")).orderBy("cue").collect()
    assert [(x.start_ms, x.text) for x in back][3] == (2000, "w3")


def test_glossary(spark):
    ws = "Open ai is open AI not open air a a a".split()
    rows = [(1, i, w, i, i + 1) for i, w in enumerate(ws)]
    got = captions.glossary_display(spark.createDataFrame(rows, WORDS), [("open ai", "OpenAI"), ("a a", "AA"), ("", "x"), ("is", "is")])
    assert [r.display for r in got.orderBy("pos").collect()] == ["OpenAI", "", "is", "OpenAI", "", "not", "open", "air", "AA", "", "a"]


def test_merge_ranges(spark):
    rng = random.Random(3)
    rows = [(k, a, a + rng.randint(0, 80)) for k in range(6) for a in rng.choices(range(800), k=25)]
    got = sorted((r.k, r.s, r.e) for r in intervals.merge_ranges(spark.createDataFrame(rows, "k long, s long, e long"), "k").collect())
    want = []
    for k in range(6):
        out = []
        for _, a, b in sorted(r for r in rows if r[0] == k):
            if out and a <= out[-1][1] + 50:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want += [(k, *x) for x in out]
    assert got == want


def test_output_timeline_is_gapless(spark):
    r = spark.createDataFrame([(1, 0, 10), (1, 20, 25), (1, 25, 25)], "k long, s long, e long")
    assert [(x.out_s, x.out_e) for x in intervals.output_timeline(r, "k").orderBy("s", "e").collect()] == [(0, 10), (10, 15), (15, 15)]


def test_iou_and_coverage(spark):
    row = spark.sql("select array(named_struct('s', 0L, 'e', 10L)) a, array(named_struct('s', 5L, 'e', 15L)) b, cast(array() as array<struct<s:bigint,e:bigint>>) z")
    got = row.select(numeric.iou(F.col("a"), F.col("b")), numeric.coverage(F.col("a"), F.col("b")), numeric.iou(F.col("a"), F.col("z")), numeric.ranges_overlap(F.col("a"), F.col("b"))).first()
    assert (round(got[0], 9), got[1], got[2], got[3]) == (round(1 / 3, 9), 0.5, 0.0, 5)


def test_stitch_limits(spark):
    p = spark.createDataFrame([(1, 0, 20_000)], "clip_id long, s long, e long")
    more = [(1, 1, 30_000, 50_000), (1, 2, 60_000, 60_000), (1, 3, 200_000, 210_000), (1, 4, 70_000, 130_000), (1, 5, None, 1), (1, 6, 80_000, 90_000)]
    got = {r.seg_id: r.outcome for r in intervals.stitch_limits(p, spark.createDataFrame(more, "clip_id long, seg_id long, s long, e long")).collect()}
    assert got == {1: "kept", 2: "empty", 3: "too_far", 4: "too_long", 5: "unreadable", 6: "kept"}


def test_sentence_at_three_cases(spark):
    s = spark.createDataFrame([(1, 0, 100, 200), (1, 1, 300, 400)], "video_id long, id long, start_ms long, end_ms long")
    pts = spark.createDataFrame([(1, 1, 150), (1, 2, 250), (1, 3, 50), (1, 4, 300), (1, 5, 999)], "video_id long, clip_id long, t long")
    assert {r.clip_id: r.sid for r in intervals.sentence_at(pts, s, "clip_id", "t", "sid").collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_refine_statuses(spark, timeline):
    _, df = timeline
    s = segment.sentences(df).where("video_id = 51")
    clips = spark.createDataFrame([(51, 1, 5000, 40_000), (51, 2, 50_000, 50_000), (51, 3, 10_000_000, 10_050_000), (51, 4, 0, 120_000)], "video_id long, clip_id long, s long, e long")
    got = {r.clip_id: r for r in intervals.refine(clips, s).collect()}
    assert got[2].refine_status == "rejected_range" and got[3].refine_status == "passthrough_no_transcript"
    assert len(got) == 4 and got[1].refined_e > got[1].refined_s
    assert got[4].refine_status == "rejected_duration" or got[4].refined_e - got[4].refined_s <= 90_150


def loop_greedy(rows, clash, most=None):
    kept = []
    for r in rows:
        if (most is None or len(kept) < most) and not any(clash(r, k) for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


def iou(a, b):
    inter = max(0, min(a[3], b[3]) - max(a[2], b[2]))
    return inter, a[3] - a[2] + b[3] - b[2] - inter


CANDS = "video_id long, cand_id long, s long, e long, hook string, payoff string, required_context string, uncertainty double, source string"


def random_candidates(rng, n=60):
    rows = []
    for i in range(n):
        a = rng.randint(0, 200_000)
        rows.append((i % 3, i, a, a + rng.randint(10_000, 90_000), rng.choice(["", "So why?", "it is a plain hook", "one two"]), rng.choice(["", "p"]), rng.choice(["", "c"]), rng.randint(0, 100) / 100, "outline"))
    return rows


def test_merging_equals_the_loop(spark):
    rows = random_candidates(random.Random(4))
    got = {r.cand_id for r in candidates.merge_overlaps(spark.createDataFrame(rows, CANDS)).where("kept").collect()}
    want = set()
    for v in range(3):
        own = sorted((r for r in rows if r[0] == v), key=lambda r: (r[7], r[1]))
        want |= loop_greedy(own, lambda a, b: iou(a, b)[0] * 10 >= iou(a, b)[1] * 7)
    assert got == want


def test_selection_drops_near_duplicates_and_stops_at_the_target(spark):
    base = ("a hook of five words", "p", "", 0.1, "outline")
    rows = [(1, 0, 0, 30_000, *base), (1, 1, 10_000, 40_000, *base)] + [(1, 10 + i, 100_000 * (i + 1), 100_000 * (i + 1) + 30_000, *base) for i in range(9)]
    rows += [(1, 99, 5_000_000, 5_001_000, "so", "", "c", 1.0, "outline")]
    got = {r.cand_id: r.status for r in candidates.select_diverse(spark.createDataFrame(rows, CANDS)).collect()}
    assert got[0] == "selected" and got[1] == "near_duplicate" and got[99] == "below_floor"
    assert sum(s == "selected" for s in got.values()) == 8 and sum(s == "surplus" for s in got.values()) == 2


def test_scores_of_known_candidates(spark):
    rows = [(1, 1, 0, 30_000, "Why does it work?", "yes", "", 0.5, "audio_event"), (1, 2, 0, 10_000, "so", "", "ctx", 1.0, "outline"), (1, 3, 0, 150_000, "", "x", " ", 0.0, "outline")]
    got = {r.cand_id: r for r in candidates.scores(spark.createDataFrame(rows, CANDS)).collect()}
    assert (got[1].opening, got[1].standalone, got[1].payoff_score, got[1].completeness, got[1].editability, got[1].audio_support) == (0.85, 0.8, 1.0, 0.7, 1.0, 0.7)
    assert (got[2].opening, got[2].standalone, got[2].completeness, got[2].editability) == (0.25, 0.3, 0.2, 0.5)
    assert (got[3].opening, got[3].editability) == (0.3, 0.5)


def test_validation_reasons(spark):
    s = spark.createDataFrame([(1, i, i * 4000, i * 4000 + 3000, "x") for i in range(200)], "video_id long, id long, start_ms long, end_ms long, text string")
    p = [(1, 1, 0, 9), (1, 2, 9, 0), (1, 3, 500, 510), (1, 4, 0, 1), (1, 5, 0, 60), (1, 6, 0, 150), (1, 7, None, 3)]
    got = {r.proposal_id: r.reject_reason for r in candidates.validate(spark.createDataFrame(p, "video_id long, proposal_id long, start_id long, end_id long"), s).collect()}
    assert got == {1: None, 2: None, 3: "no known sentences", 4: "too short", 5: "too long", 6: "too many sentences", 7: "too short"} or got[7] == "too short"


def test_near_start_dedup_moves_its_anchor(spark):
    rows = [(1, 1, 0, 10_000), (1, 2, 4000, 20_000), (1, 3, 8000, 9000), (1, 4, 9001, 50_000)]
    got = sorted(r.cand_id for r in candidates.dedup_near_starts(spark.createDataFrame(rows, "video_id long, cand_id long, s long, e long")).collect())
    assert got == [2, 4]


def test_spikes_in_a_known_signal(spark):
    rng = random.Random(0)
    x = [0.01 + rng.random() * 0.001 for _ in range(600)]
    for i in (*range(50, 55), *range(200, 210), 300, *range(400, 475)):
        x[i] = 0.5
    f = signal.baseline(signal.frames(spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "key long, pos long, x double"), 1))
    got = sorted((r.s, r.e, r.n) for r in signal.spikes(f).collect())
    assert (10_000, 11_000, 1) in got and (40_000, 42_000, 1) in got  # the click at frame 300 is too short
    assert all(not s <= 60_000 <= e for s, e, _ in got)


def test_stable_turns_equal_the_loop(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for _ in range(300):
        d = rng.randint(200, 3000)
        rows.append((1, rng.choice("ab"), t, t + d))
        t += d + rng.choice([-100, 100, 499, 500, 900])
    got = sorted((r.s, r.e, r.speaker) for r in speakers.stable_turns(spark.createDataFrame(rows, "conv_id long, speaker string, s long, e long")).collect())
    out = []
    for _, who, a, b in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if out and out[-1][2] == who and a - out[-1][1] < 500:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, who])
    assert got == sorted(tuple(x) for x in out if x[1] - x[0] >= 1500)


def test_switches_hold(spark):
    turns = [(1, "a", 0, 5000), (1, "b", 5100, 9000), (1, "a", 6000, 20_000), (1, "b", 20_500, 30_000), (1, "c", 31_000, 40_000), (1, "a", 41_000, 50_000)]
    got = speakers.switches(spark.createDataFrame(turns, "conv_id long, speaker string, s long, e long"), {"a": 0, "b": 1}).orderBy("t").collect()
    assert [(r.t, r.speaker) for r in got] == [(0, "a"), (20_500, "b"), (41_000, "a")]


def test_layout_and_centres(spark):
    one = spark.createDataFrame([(1, i, 1) for i in range(20)] + [(2, i, i % 5 == 0) for i in range(20)] + [(3, i, 2) for i in range(9)], "clip_id long, pos long, n int") if False else spark.createDataFrame([(1, i, 1) for i in range(20)] + [(2, i, int(i % 5 == 0)) for i in range(20)] + [(3, i, 2) for i in range(9)], "clip_id long, pos long, n int")
    assert {r.clip_id: r.layout for r in framing.layout_votes(one).collect()} == {1: "speaker_crop", 2: "center_crop", 3: "stacked_split"}
    rows = [(1, 0, None, None, False), (1, 1, 600, 300, False), (1, 2, 610, 302, False), (1, 3, 700, 300, False), (1, 4, 1200, 300, False)] + [(1, 5 + i, None, None, i == 3) for i in range(6)]
    got = framing.smoothed_centres(spark.createDataFrame(rows, "clip_id long, pos long, cx long, cy long, cut boolean")).orderBy("pos").collect()
    assert [r.cam_x for r in got[:5]] == [None, 600.0, 600.0, 630.0, 1200.0]
    assert [r.missing for r in got] == [1, 0, 0, 0, 0, 1, 2, 3, 1, 2, 3]


def test_interpolation_does_not_cross_cuts(spark):
    c = spark.createDataFrame([(1, 0, 0.0, False), (1, 100, 10.0, False), (1, 200, 90.0, True), (1, 300, None, False)], "clip_id long, t long, x double, cut boolean")
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate([-5, 0, 50, 150, 250, 400, 100])], "clip_id long, point_id long, t long")
    assert {r.point_id: r.x for r in framing.interpolated_anchors(c, p).collect()} == {0: 0.0, 1: 0.0, 2: 5.0, 3: 90.0, 4: 90.0, 5: None, 6: 10.0}


def test_vector_topk(spark):
    q = spark.createDataFrame([(1, 1, [1.0, 0.0])], "video_id long, clip_id long, embedding array<float>")
    c = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 1.0]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0]), (1, 5, None), (1, 6, [0.0, 0.0])], "video_id long, chunk_id long, embedding array<float>")
    assert [(r.chunk_id, r.similarity) for r in vector.top_k(q, c).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707107)]
    plan = vector.top_k(q, c)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    e = vector.embed(spark.createDataFrame([(1, "a b", None), (2, "", None), (3, "x", [1.0])], "id long, text string, embedding array<float>"))
    got = {r.id: r.embedding for r in e.collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[3] == [1.0] and sum(got[2]) == 0


def test_state_views(spark):
    log = spark.createDataFrame([(1, "a", 1, "running"), (1, "a", 2, "done"), (1, "b", 1, "failed"), (2, "a", 1, None)], "video_id long, stage string, at long, status string")
    got = {(r.video_id, r.stage): (r.status, r.attempts) for r in state.stage_status(log, ["video_id", "stage"], ["at"]).collect()}
    assert got == {(1, "a"): ("done", 2), (1, "b"): ("failed", 1), (2, "a"): (None, 1)}
    plans = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "clip_id long, version long, plan string")
    more = state.append_version(plans, spark.createDataFrame([(1, "z"), (2, "w")], "clip_id long, plan string"), "clip_id")
    assert sorted((r.clip_id, r.version) for r in more.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    new = state.replace_by(plans, spark.createDataFrame([(1, 9, "q")], plans.schema), "clip_id")
    assert [r.plan for r in new.collect()] == ["q"]
    upd = state.update(plans, spark.createDataFrame([(1, None)], "clip_id long, plan string"), "clip_id")
    assert sorted(r.plan for r in upd.collect()) == ["x", "y"]
    assert state.stale("audio_events") == ["analyze", "refine", "render", "similarity"]


def test_text_functions(spark):
    d = spark.createDataFrame([("01:02:03.5", "/a/b.MP4"), ("2:05", "https://youtu.be/live1"), ("7.25", "x"), ("bad", None)], "t string, u string")
    got = d.select(text.parse_clock(F.col("t")).alias("s"), text.source_type(F.col("u")).alias("k")).collect()
    assert [r.s for r in got] == [3723.5, 125.0, 7.25, None] and [r.k for r in got][:3] == ["local_file", "youtube_live", "unknown"]
    one = d.limit(1).select(
        text.clock(F.lit(3_723_900)).alias("a"), text.srt_time(F.lit(3_723_045)).alias("b"), text.ass_time(F.lit(-5)).alias("c"), text.hex_to_bgr(F.lit("#f80")).alias("d"),
        text.ass_escape(F.lit("a{b}")).alias("e"), text.drawtext_escape(F.lit("1:2%")).alias("f"), text.first_word(F.lit(' "So, yes')).alias("g"), text.approx_tokens(F.lit("")).alias("h"),
    ).first()
    assert tuple(one) == ("01:02:03", "01:02:03,045", "0:00:00.00", "0088FF", "a(b)", "1\\:2\\%", "so", 1)


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"segments": [{"words": [{"word": " hi ", "start": 1.0, "end": 1.5}, {"word": "no"}]}, {"words": [{"word": "there", "start": 0.2, "end": 0.4}]}]}')
    (tmp_path / "b.json").write_text('[{"word": "x", "start": 0, "end": 1}, {"word": "", "start": 2, "end": 3}]')
    (tmp_path / "c.json").write_text('{"word_segments": [{"word": "y", "start": "bad", "end": 1}, {"word": "z", "start": 2, "end": 3}]}')
    got = transcript.read_transcripts(spark, f"file://{tmp_path}/*.json").collect()
    (tmp_path / "d.json").write_text("not a transcript")
    with pytest.raises(Exception, match="no words in the transcript"):
        transcript.read_transcripts(spark, f"file://{tmp_path}/*.json").collect()
    assert transcript.read_transcripts(spark, f"file://{tmp_path}/*.json", strict=False).count() == len(got)
    assert sorted((r.video_id[-6:], r.pos, r.word, r.start_ms) for r in got) == [("a.json", 0, "there", 200), ("a.json", 1, "hi", 1000), ("b.json", 0, "x", 0), ("c.json", 0, "z", 2000)]


def test_sinks_and_adapters(spark, tmp_path, timeline):
    _, df = timeline
    script = sinks.ass_scripts(captions.cue_of_word(df.where("video_id = 51"))).first().script
    assert script.startswith("[Script Info]") and script.count("Dialogue:") == captions.caption_cues(df.where("video_id = 51")).count()
    assert adapters.backend_status(["surely_not_there"])[0].available is False
    pairs = spark.createDataFrame([(0.9, 10), (0.9, 90_000), (0.1, 5), (None, None)], "similarity double, gap_ms long")
    assert [r.decision for r in adapters.classify_continuations(pairs).collect()] == ["stitch", "standalone", "noise", "noise"]
    told = [("Add our logo to the top right, podcast style.",), ("motivational podcast, no subtitles",), ("a reaction, motivational",), ("use Split-Screen",), ("split screen, speaker crop",), ("Face Track LOGO Podcast",), ("Branded full frame",), (None,)]
    c = spark.createDataFrame(told, "t string").select(*[v.alias(k) for k, v in adapters.campaign_columns(F.col("t")).items()]).collect()
    assert [tuple(r) for r in c] == [
        ("assets/logos/logo.png", False, True, "podcast_clip", "auto"), (None, False, False, "motivational_reel", "auto"), (None, False, True, "tiktok_reaction", "auto"), (None, False, True, None, "stacked_split"),
        (None, True, True, None, "stacked_split"), (None, False, True, None, "speaker_crop"), (None, False, True, None, "branded_fit"), (None, False, True, None, "auto"),
    ]
    sinks.write_table(df, f"file://{tmp_path}/w")
    sinks.replace_partitions(df.where("video_id = 51").limit(3), f"file://{tmp_path}/w")
    assert spark.read.parquet(f"file://{tmp_path}/w").where("video_id = 51").count() == 3


def test_ranks_do_not_mix_videos_that_share_a_clip_id(spark):
    q = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0])], "video_id long, clip_id long, embedding array<float>")
    c = spark.createDataFrame([(v, 10 * v + i, [1.0, float(i)]) for v in (1, 2) for i in range(3)], "video_id long, chunk_id long, embedding array<float>")
    got = sorted((r.video_id, r.chunk_id, r["rank"]) for r in vector.top_k(q, c, k=2).collect())
    assert got == [(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2)]


def test_embedder_equals_plain_hashing(spark):
    import hashlib

    texts = ["so it goes so it goes", "", "Ünder a  Tree\n", "x " * 500]
    got = {r.t: r.embedding for r in vector.embed(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 16).collect()}
    for t in texts:
        v = [0.0] * 16
        for w in t.lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            v[h % 16] += 1 if h >= 1 << 31 else -1
        n = sum(x * x for x in v) ** 0.5 or 1.0
        assert all(abs(a - b / n) < 1e-6 for a, b in zip(got[t], v, strict=True)), t


def test_related_segments_leave_out_own_chunks_after_the_limit(spark):
    clips = spark.createDataFrame([(1, 1, [1.0, 0.0], [10], 5000), (1, 2, None, [], 0)], "video_id long, clip_id long, embedding array<float>, source_chunks array<long>, e long")
    chunks = spark.createDataFrame([(1, 10, [1.0, 0.0], 0), (1, 11, [1.0, 0.1], 6000), (1, 12, [1.0, 0.2], 90_000), (1, 13, [1.0, 0.3], 7000)], "video_id long, chunk_id long, embedding array<float>, start_ms long")
    got = {r.chunk_id: (r.decision, r.confirmed) for r in vector.related_segments(clips, chunks, 3, 0.5).collect()}
    assert got == {11: ("stitch", True), 12: ("standalone", False)}


def test_merging_unites_sentences_and_relevance_reads_the_idea(spark):
    kind = "video_id long, cand_id long, s long, e long, hook string, main_idea string, payoff string, required_context string, uncertainty double, source string, energy_increase double, sentence_ids array<long>"
    rows = [(1, 1, 0, 30_000, "a hook", "about coils", "p", "", 0.1, "outline", None, [1, 2]), (1, 2, 1000, 30_000, "b", "", "p", "", 0.2, "outline", 9.0, [2, 3]), (1, 3, 90_000, 105_000, "c", "", "p", "", 0.2, "audio_event", 4.0, [9])]
    df = spark.createDataFrame(rows, kind)
    m = {r.cand_id: (r.kept, r.winner_id, r.sentence_ids) for r in candidates.merge_overlaps(df).collect()}
    assert m == {1: (True, None, [1, 2, 3]), 2: (False, 1, [2, 3]), 3: (True, None, [9])}
    s = {r.cand_id: r for r in candidates.scores(df, "the coils of it").collect()}
    assert s[1].relevance == 0.5 and s[2].relevance == 0.0
    assert (s[1].audio_support, s[2].audio_support, s[3].audio_support) == (0.3, 0.8, 0.8) and (s[1].editability, s[3].editability) == (1.0, 0.85)


def test_known_stitch_limits_and_dedup(spark):
    kind = "clip_id long, seg_id long, s long, e long"
    more = spark.createDataFrame([(1, 1, 200_000, 250_000), (2, 1, 32_000, 50_000), (3, 1, 30_000, 70_000), (3, 2, 70_000, 120_000), (4, 1, 5000, None), (4, 2, 40_000, 30_000)], kind)
    first = spark.createDataFrame([(i, 0, 30_000) for i in range(1, 5)], "clip_id long, s long, e long")
    got = {(r.clip_id, r.seg_id): r.outcome for r in intervals.stitch_limits(first, more).collect()}
    assert got == {(1, 1): "too_far", (2, 1): "kept", (3, 1): "kept", (3, 2): "too_long", (4, 1): "unreadable", (4, 2): "empty"}


def test_second_range_starts_where_the_first_ended(spark):
    r = spark.createDataFrame([(1, 0, 2000), (1, 10_000, 12_000)], "clip_id long, s long, e long")
    assert [(x.out_s, x.out_e) for x in intervals.output_timeline(r, "clip_id").orderBy("s").collect()] == [(0, 2000), (2000, 4000)]


def test_overlap_join_equals_the_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 2), i, s := rng.randint(0, 900), s + rng.choice([-5, 0, 10, 400])) for i in range(120)]
    a, b = spark.createDataFrame(rows[:60], "k long, i long, a0 long, a1 long"), spark.createDataFrame(rows[60:], "k long, j long, b0 long, b1 long")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, "k", ("a0", "a1"), ("b0", "b1"), 50).collect())
    want = sorted((x[1], y[1]) for x in rows[:60] for y in rows[60:] if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want


def test_faces_associate_as_in_the_loop(spark):
    rng = random.Random(6)
    rows = [(c, p, p % 9 == 8, [(rng.randint(0, 1279), rng.randint(0, 719)) for _ in range(rng.randint(0, 3))]) for c in range(4) for p in range(30)]
    for c in range(4):  # faces that stay near
        for p in range(30):
            rows.append((c + 10, p, p == 15, [(300 + p * 3, 200), (900 - p * 2, 220 + p)][: 1 + p % 3]))
    df = spark.createDataFrame(rows, "clip_id long, pos long, cut boolean, boxes array<struct<cx:long,cy:long>>")
    got = {(r.clip_id, r.pos, r.box): r.track_id for r in framing.associate(df).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        tracks, new = [], 0
        for _, p, cut, boxes in sorted(r for r in rows if r[0] == c):
            tracks, now, used = [] if cut else tracks, [], set()
            for t, x, y in tracks:
                near = sorted((abs(bx - x) + abs(by - y), j) for j, (bx, by) in enumerate(boxes) if j not in used)
                if near and near[0][0] < 1280 * 0.12:
                    j = near[0][1]
                    used.add(j)
                    now.append((t, *boxes[j]))
                    want[c, p, j] = t
            for j, box in enumerate(boxes):
                if j not in used:
                    now.append((new, *box))
                    want[c, p, j] = new
                    new += 1
            tracks = now
    assert got == want


def test_model_replies(spark):
    told = ["```json\n[1]\n```", "<think>[0]</think> [2]", 'x {"a": 3} y', "none", "<think>so [4]", "<think>a [5] b</think>", None, "[7] and [8]"]
    df = spark.createDataFrame(list(enumerate(told)), "i int, t string").select("i", text.model_json(F.col("t")).alias("j"))
    got = {r.i: r.j for r in df.collect()}
    assert got == {0: "[1]", 1: "[2]", 2: '[{"a": 3}]', 3: None, 4: "[4]", 5: "[5]", 6: None, 7: "[7] and [8]"}


def test_written_tables_are_read_by_video(spark, tmp_path, timeline):
    _, df = timeline
    root = f"file://{tmp_path}"
    chunks = segment.silence_chunks(df, Chunking(min_ms=0)).withColumn("chunk_id", F.col("chunk_index"))
    sinks.write_table(chunks, f"{root}/chunks")
    got = transcript.rows_of_video(spark, root, "chunks", 51)
    assert [r.chunk_index for r in got.collect()] == sorted(r.chunk_index for r in chunks.where("video_id = 51").collect())
    assert "PartitionFilters: [isnotnull(video_id" in got._jdf.queryExecution().executedPlan().toString()
    sinks.write_transcript(chunks.withColumn("pos", F.col("chunk_index")), f"{root}/t")
    lines = spark.read.text(f"{root}/t/txt").where("video_id = 51").count()
    assert lines == chunks.where("video_id = 51").count() == spark.read.json(f"{root}/t/json").where("video_id = 51").count()
    plans = spark.createDataFrame([(1, (2, "x")), (2, (3, "y"))], "clip_id long, plan struct<version:int,layout:string>")
    sinks.write_plans(plans, f"{root}/plans")
    assert sorted(r.value for r in spark.read.text(f"{root}/plans").collect()) == ['{"version":2,"layout":"x"}', '{"version":3,"layout":"y"}']
    sinks.write_report(sinks.plan_json(plans, "clip_id"), f"{root}/r")
    assert spark.read.json(f"{root}/r").count() == 2


def test_rows_without_windows_or_with_bad_ranges_pass_or_go(spark, timeline):
    _, df = timeline
    s = segment.sentences(df.where("video_id = 51"))
    clips = spark.createDataFrame([(51, 1, 10_000, 40_000), (51, 2, 9_000_000, 9_030_000), (51, 3, 5000, 5000), (7000, 4, 0, 20_000)], "video_id long, clip_id long, s long, e long")
    more = spark.createDataFrame([(51, 1, 1, 41_000, 60_000), (51, 1, 2, 300_000, 320_000), (51, 3, 1, 6000, 30_000)], "video_id long, clip_id long, seg_id long, s long, e long")
    got = {r.clip_id: r for r in intervals.refine_all(clips, more, s).collect()}
    assert {k: r.refine_status for k, r in got.items()} == {1: "refined", 2: "passthrough_no_transcript", 3: "rejected_range", 4: "passthrough_no_transcript"}
    assert got[3].ranges is None and got[2].output_ms == 30_000 and got[1].output_ms == sum(x.e - x.s for x in got[1].ranges)
    ends = spark.createDataFrame([(51, 30_000)], "video_id long, duration_ms long")
    assert max(r.refined_e for r in intervals.refine(clips.where("clip_id = 1"), s, durations=ends).collect()) <= 30_000 + 300


def test_overlay_and_defaults(spark):
    c = spark.createDataFrame([("a", None, "top"), ("b", False, None)], "campaign_id string, fade boolean, logo string")
    assert [tuple(r) for r in adapters.overlay({"fade": True, "music": "x"}, c).select("fade", "logo", "music").collect()] == [(True, "top", "x"), (False, None, "x")]
    d = adapters.with_default_campaign(c).collect()
    assert (d[0].fade, d[1].fade, d[0].layout, d[0].min_clip_duration) == (True, False, "auto", 45)


def test_srt_files_round_trip(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\r\n00:00:01,500 --> 00:00:02,000\r\nHello\r\nthere\r\n\r\nbroken\r\n\r\n2\r\n00:01:00,000 --> 00:01:01,250\r\nEnd\r\n")
    got = [(r.start_ms, r.end_ms, r.text) for r in transcript.read_srt(spark, f"file://{tmp_path}/*.srt").orderBy("start_ms").collect()]
    assert got == [(1500, 2000, "Hello there"), (60_000, 61_250, "End")]
    words = spark.createDataFrame([(1, 0, "Hi", 0, 400), (1, 1, "you.", 500, 900)], WORDS)
    lines = captions.srt_lines(words, spark.createDataFrame([(7, 1, 0, 2000)], "clip_id long, video_id long, s long, e long"))
    assert captions.srt_files(lines).first().srt == "1\n00:00:00,000 --> 00:00:00,400\nHi\n\n2\n00:00:00,500 --> 00:00:00,900\nyou.\n"


def test_lists_of_ranges(spark):
    df = spark.sql("SELECT array(named_struct('s', 0L, 'e', 10L)) a, array(named_struct('s', 5L, 'e', 15L)) b, CAST(array() AS array<struct<s:bigint,e:bigint>>) c")
    r = df.select(numeric.iou(F.col("a"), F.col("b")), numeric.coverage(F.col("a"), F.col("b")), numeric.iou(F.col("a"), F.col("c")), numeric.ranges_length(F.col("a")), numeric.ranges_overlap(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (1 / 3, 0.5, 0.0, 10, 5)


def test_log_joins_keep_the_newest(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, seq long, v string")
    assert {(r.k, r.v) for r in state.upsert(log, ["k"], ["seq"]).collect()} == {(1, "b"), (2, "c")}
    new = spark.createDataFrame([(1, 9, "n")], "k long, seq long, v string")
    assert sorted((r.k, r.v) for r in state.replace_by(log, new, "k").collect()) == [(1, "n"), (2, "c")]
    plans = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k long, version long, p string")
    more = spark.createDataFrame([(1, "z"), (3, "w")], "k long, p string")
    assert sorted((r.k, r.version, r.p) for r in state.append_version(plans, more, "k").collect()) == [(1, 1, "x"), (1, 2, "y"), (1, 3, "z"), (3, 1, "w")]
