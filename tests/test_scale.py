"""Work that follows the input: tasks by characters, rows that meet in one place, results at ties."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from cuewright import catalogue  # noqa: F401  (registers the queries)
from cuewright.config import Chunking
from cuewright.operators import candidates, captions, segment
from cuewright.operators.captions import on_output_time
from cuewright.operators.editing import caption_lines, speaker_tracks
from cuewright.plans import transcripts, whole_clips
from cuewright.plans.registry import ORACLES, QUERIES
from cuewright.sources import sinks, transcript


def test_a_task_takes_a_bounded_number_of_characters(spark, monkeypatch):
    monkeypatch.setattr(transcript, "TASK_CHARS", 1000)
    docs = spark.createDataFrame([(i, "word and word. " * 40) for i in range(40)], "doc_id long, text string")
    w = transcript.word_timeline(docs).select("video_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.video_id for r in w}) == len(w) == 40  # a timeline is whole in one task
    assert len({r.p for r in w}) > 8  # 24,000 characters; the session's four shuffle partitions, coalesced, were one


def test_texts_may_be_null_or_lack(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one")], "doc_id long, text string")
    assert [tuple(r) for r in transcript.word_timeline(docs).collect()] == [(3, 0, "one", 0, 280)]
    assert transcript.word_timeline(docs.where("false")).count() == 0


def _against_sql(spark, tmp_path, query, **tables):
    """(rows of the query, rows of its SQL) over small tables."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES[query](spark, str(tmp_path))
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[query]})").fetchall()
    key = lambda r: [(x is None, str(x)) for x in r]
    return sorted(map(tuple, got.collect()), key=key), sorted(want, key=key)


def test_scene_cuts_take_pixels_in_single_precision(spark, tmp_path):
    values = [[k / 200 + 0.0] * 16 for k in range(1, 200)]
    e = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "vec_id long, label int, embedding array<float>")
    got, want = _against_sql(spark, tmp_path, "scene_cuts", embeddings=e)
    assert got == want


def test_tracks_at_the_same_place_are_ordered_by_number(spark):
    clips = spark.createDataFrame([(1,)], "clip_id long")
    faces = spark.createDataFrame([(1, t, x) for t, x in ((0, 70), (1, 70), (2, 10), (3, 10))], "clip_id long, track_id long, cx long")
    m = speaker_tracks(clips, clips.withColumn("speaker", F.lit("a")), faces, {"a": "left", "b": "right"})
    assert m.first()["mapping"] == {"a": 2, "b": 1}


def test_a_chunk_whose_words_cancel_out_has_the_similarity_of_its_sql(spark, tmp_path):
    place = lambda w: (h := int(hashlib.md5(w.encode()).hexdigest()[:8], 16)) % 64 * 2 + (h < 1 << 31)
    words = ["x" * 17 + f"{i:03d}" for i in range(1000)]
    a = words[0]
    b = next(w for w in words if place(w) == place(a) ^ 1)
    c = next(w + "." for w in words if place(w + ".") == place(b))
    zero, full = [*[a] * 5, *[b] * 4, c], [*[a] * 9, c]
    docs = spark.createDataFrame([(1, " ".join(zero + full + full + zero))], "doc_id long, text string")
    got, want = _against_sql(spark, tmp_path, "hashed_embeddings", documents=docs)
    same = lambda rows: [tuple("nan" if x != x else x for x in r) for r in rows]
    assert len(got) == 3 and same(got) == same(want)


def _later_exchanges(df) -> int:
    """Shuffles besides those of the texts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("ENSURE_REQUIREMENTS")


def test_words_of_clips_stay_in_the_task_of_their_video(spark):
    for name in ("srt_lines", "clip_cues"):
        assert _later_exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) == 0


def test_a_word_maps_by_the_first_range_of_each_clip(spark):
    words = spark.createDataFrame([(1, i, f"w{i}", i * 1000, i * 1000 + 900) for i in range(130)], "video_id long, pos long, word string, start_ms long, end_ms long")
    ranges = spark.createDataFrame([(7, 1, 0, 3000), (7, 1, 2000, 5000), (8, 1, 1000, 2000), (8, 1, 59_000, 62_000)], "clip_id long, video_id long, s long, e long")
    got = sorted((r.clip_id, r.pos, r.start_ms) for r in on_output_time(words, ranges).collect())
    first = [(7, 0, 0), (7, 1, 1000), (7, 2, 2000), (7, 3, 4000), (7, 4, 5000)]
    assert got == [*first, (8, 1, 0), (8, 59, 1000), (8, 60, 2000), (8, 61, 3000)]


def test_proposals_meet_blocks_of_sentences(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 2)
    known = [1, 2, 4, 5, 6, 9]  # ids may have gaps
    s = spark.createDataFrame([(1, i, i * 10_000, i * 10_000 + 9000, f"t{i}") for i in known], "video_id long, id long, start_ms long, end_ms long, text string")
    p = spark.createDataFrame([(1, 0, 3, 6, [9, 1, 77]), (1, 1, 6, 3, None), (1, 2, 7, 8, None), (1, 3, 40, 50, None)], "video_id long, proposal_id long, start_id long, end_id long, join_ids array<long>")
    got = {r.proposal_id: (r.n_sentences, r.s, r.e, r.first_text, r.n_joins, r.sentence_ids) for r in candidates.validate(p, s).collect()}
    assert got[0] == (3, 40_000, 69_000, "t4", 2, [4, 5, 6, 1, 9])
    assert got[1] == (3, 40_000, 69_000, "t4", 0, [4, 5, 6])
    assert got[2][:2] == got[3][:2] == (0, None)


def test_outline_rows_come_from_one_pass(spark):
    plan = QUERIES["outline_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1  # the sections and the videos' rows were two


def test_outline_rows_of_a_video_and_its_sections(spark):
    w = spark.createDataFrame([(1, 5, 10, 20, "a"), (1, 6, 15, 40, "b"), (2, 0, 0, 9, "c")], "video_id long, window long, start_ms long, end_ms long, title string")
    got = sorted(tuple(r)[:6] for r in sinks.outline_rows(w).collect())
    assert got == [(1, "section", 5, 10, 20, "a"), (1, "section", 6, 15, 40, "b"), (1, "video", 0, 10, 40, "video"), (2, "section", 0, 0, 9, "c"), (2, "video", 0, 0, 9, "video")]


def test_section_windows_work_out_sentences_once(spark):
    plan = QUERIES["section_windows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "posexplode" not in plan  # read from what was written


def test_words_stay_where_they_are_for_a_few_spikes(spark):
    plan = QUERIES["event_cues"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("== Initial Plan ==")[-1].splitlines() if "Join" in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins)


def test_continuations_come_from_one_pass_and_keep_their_columns(spark, tmp_path):
    d = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{d}/documents.parquet")
    clips, more, sents = whole_clips.chunk_clips(spark, d)
    assert {"prev_end", "next_start"} <= set(sents.columns) and "text" not in sents.columns
    assert "Join" not in more._jdf.queryExecution().optimizedPlan().toString()
    at = {(r.video_id, r.clip_id % 10_000_000): (r.s, r.e) for r in clips.collect()}
    want = sorted((v, i, k, *at[v, i + k]) for v, i in at for k in (1, 2, 3) if (v, i + k) in at)
    assert want and sorted((r.video_id, r.clip_id % 10_000_000, r.seg_id, r.s, r.e) for r in more.collect()) == want


def test_texts_stay_out_of_merging_before_selection(spark, monkeypatch):
    seen = []
    merge = candidates.merge_overlaps
    monkeypatch.setattr(candidates, "merge_overlaps", lambda c, cfg: seen.append(c.columns) or merge(c, cfg))
    candidates.select_diverse(cands_of(spark, [(0, "one two"), (1, "one two three")]))
    assert seen and not {"hook", "main_idea", "sentence_ids"} & set(seen[0])


def cands_of(spark, hooks):
    rows = [(1, i, i * 100_000, i * 100_000 + 30_000, h, "idea", "payoff", "", 0.5, "outline", [i]) for i, h in hooks]
    return spark.createDataFrame(rows, "video_id long, cand_id long, s long, e long, hook string, main_idea string, payoff string, required_context string, uncertainty double, source string, sentence_ids array<long>")


def test_similar_pairs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 2)
    hooks = {0: "a b", 1: "b c", 2: "x", 3: "A A b", 4: None, 5: "", 6: "x c"}
    df = candidates.similar_pairs(cands_of(spark, hooks.items()))
    words = {i: set((h or "").lower().split()) for i, h in hooks.items()}
    want = [(1, a, b, round(len(words[a] & words[b]) / len(words[a] | words[b]), 6)) for a in words for b in words if a < b and words[a] & words[b]]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert "explode(ws" not in df._jdf.queryExecution().optimizedPlan().toString()  # not a row for each word


def test_words_of_a_cue_are_grouped_once(spark):
    for name, most in (("caption_cues", 1), ("caption_lines", 1), ("ass_dialogue", 2)):  # dialogue lines meet in their script
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list(") == most


def test_cues_of_a_long_run_and_their_words_give_the_same_lines(spark):
    rows = [(1, i, "w" * (i % 9 + 1) + ("," if i % 5 == 2 else ""), i * 300, i * 300 + 250) for i in range(3000)] + [(2, 0, "One.", 0, 90)]
    words = spark.createDataFrame(rows, "video_id long, pos long, word string, start_ms long, end_ms long")
    key = lambda r: tuple(map(str, r))
    cues, each = captions.cues(words), captions.cue_of_word(words)
    assert each.count() == len(rows)  # the last words of a run are a cue
    lines = sorted(map(tuple, caption_lines(cues).collect()), key=key)
    assert lines == sorted(map(tuple, caption_lines(each).collect()), key=key)
    told = {(v, p): f"{a} {b}".strip() for v, p, a, b in lines}
    assert {(r.video_id, r[1]): r.text for r in cues.selectExpr("video_id", "items[0].pos", "array_join(items.word, ' ') text").collect()} == told
    assert sorted(map(tuple, sinks.ass_scripts(cues).collect())) == sorted(map(tuple, sinks.ass_scripts(each).collect()))


def _columns_written(spark, monkeypatch, module, query):
    seen, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: seen.append(set(df.columns)) or write(df, name))
    QUERIES[query](spark, "/root/testdata/sf0.001")
    return seen


def test_texts_are_not_written_for_clips_bounds(spark, monkeypatch):
    seen = _columns_written(spark, monkeypatch, transcripts, "edit_plans")
    assert len(seen) == 2 and not {"text", "hook", "main_idea", "sentence_ids"} & set.union(*seen)


def test_texts_are_not_written_for_joined_passages(spark, monkeypatch):
    assert _columns_written(spark, monkeypatch, whole_clips, "join_validation") == [{"video_id", "id", "start_ms", "end_ms"}]


def test_candidates_that_are_taken_once_are_not_written(spark, monkeypatch):
    assert len(_columns_written(spark, monkeypatch, transcripts, "editorial_scores")) == 1  # the sentences


def test_words_are_sorted_once_for_each_order(spark):
    """By pos, then by chunks or runs, then as groups; chunks and sentences of a video once, if they are looked at in order."""
    most = {"word_timeline": 1, "silence_chunks": 3, "transcript_text": 3, "clips_analysis": 3, "overlap_chunks": 3, "sentence_units": 2, "outline_windows": 3, "proposed_clips": 3}
    for name, n in most.items():
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("- Sort [") <= n, name
        assert _later_exchanges(df) == 0, name


def test_words_of_silence_chunks_are_collected_once_without_times(spark):
    for name in ("silence_chunks", "transcript_text", "clips_analysis"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list(") == 1 and re.search(r"collect_list\(struct\(pos, pos#\d+L, word, word#\d+\)", plan)


def test_a_text_may_have_more_words_than_its_places_times_a_prime_fit_an_integer(spark):
    n = 272_000
    docs = spark.createDataFrame([(1, "a " * n)], "doc_id long, text string")
    last = transcript.word_timeline(docs).where(F.col("pos") == n - 1).first()
    gaps = [1300 if (i * 7919 + 104729) % 97 == 0 else 60 for i in range(n - 1)]
    assert last.start_ms == sum(gaps) + 120 * (n - 1)


def test_chunks_of_dense_silences_start_where_a_loop_cuts(spark):
    rng, rows, cuts = random.Random(5), [], {}
    for v in range(3):
        t, words = 0, []
        for i in range(400):
            t += rng.choice((60, 60, 1300))
            words.append((v, i, rng.choice(("aaa", "aaa", "aaa", "aaa", "aa.")) if v else "aaa", t, t + 200))
            t += 200
        stop, gap = [w[2].endswith(".") for w in words], [0, *(b[3] - a[4] for a, b in zip(words, words[1:]))]
        for p in range(1, 400):
            if gap[p] >= 1200:
                cuts.setdefault(v, {0}).add(p if stop[p - 1] else next((q + 1 for q in range(p, min(p + 20, 400)) if stop[q]), p))
        rows += words
    words = spark.createDataFrame(rows, "video_id long, pos long, word string, start_ms long, end_ms long")
    got = segment.raw_chunk_of_word(words, Chunking(max_tokens=10**9)).collect()
    assert len(got) == 1200 and all(r.chunk_start == max(c for c in cuts[r.video_id] if c <= r.pos) for r in got)
