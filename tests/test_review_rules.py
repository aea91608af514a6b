"""Anchors, content bounds, glossaries, link marks and dependency closures against their rules."""

import random

from pyspark.sql import functions as F

from cuewright.config import Framing
from cuewright.operators import captions, editing, framing, intervals, state

SMOOTHED = "clip_id long, t long, x double, y double, cut boolean, lost boolean"
POINTS = "clip_id long, point_id long, t long"
PLAN = "clip_id long, scene long, t0 long, t1 long, kind string, cx long, cy long, needs_review boolean"
ROIS = "clip_id long, idx int, t0 long, t1 long, x int, y int, w int, h int"


def loop_centre(samples, t):
    """The rule as a loop over neighbouring samples."""
    if t <= samples[0][0]:
        return samples[0]
    if t >= samples[-1][0]:
        return samples[-1]
    for a, b in zip(samples, samples[1:], strict=False):
        if a[0] <= t <= b[0]:
            if b[3] or a[1] is None:
                return b
            if b[1] is None:
                return a
            f = (t - a[0]) / (b[0] - a[0])
            return (t, a[1] + (b[1] - a[1]) * f, a[2] + (b[2] - a[2]) * f, False, b[4])
    raise AssertionError


def test_centres_and_lost_flags_follow_the_rule(spark):
    rng = random.Random(2)
    samples, points = {}, []
    for clip in range(25):
        n = rng.randint(1, 7)
        samples[clip] = []
        for k in range(n):
            x = None if rng.random() < 0.3 else float(rng.randint(0, 900))
            samples[clip].append((k * 250, x, None if x is None else x / 3, rng.random() < 0.2, rng.random() < 0.4))
        points += [(clip, i, t) for i, t in enumerate(sorted({rng.randint(-300, n * 250) for _ in range(6)} | {k * 250 for k in range(n)}))]
    c = spark.createDataFrame([(clip, *s) for clip, own in samples.items() for s in own], SMOOTHED)
    got = {(r.clip_id, r.point_id): r for r in framing.interpolated(c, spark.createDataFrame(points, POINTS), ["x", "y"], ["lost"]).collect()}
    for clip, i, t in points:
        _, x, y, _, lost = loop_centre(samples[clip], t)
        r = got[clip, i]
        assert r.lost == lost and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-3) for a, b in ((r.x, x), (r.y, y))), (clip, i, t)


def test_a_lost_later_sample_holds_the_anchor_for_review(spark):
    smoothed = spark.createDataFrame([(1, 0, 100.0, 50.0, False, False), (1, 250, 200.0, 60.0, False, True)], SMOOTHED)
    plan = spark.createDataFrame([(1, 0, 0, 500, "face", 7, 8, False)], PLAN)
    points = spark.createDataFrame([(1, 0, 0), (1, 1, 100), (1, 2, 900)], POINTS)
    rois = spark.createDataFrame([], ROIS)
    got = {r.point_id: r for r in framing.resolved_anchors(points, plan, smoothed, rois).collect()}
    assert (got[0].kind, got[0].needs_review) == ("face", False)
    assert (got[1].kind, got[1].cx, got[1].needs_review) == ("retain", 140.0, True)
    assert (got[2].kind, got[2].cx, got[2].cy, got[2].needs_review) == ("center", 640.0, 360.0, True)
    area = framing.resolved_anchors(points, plan, smoothed, rois, work_area=(100, 0, 405, 720)).where("point_id = 2").first()
    assert (area.kind, area.cx, area.cy, area.needs_review) == ("workarea", 302.5, 360.0, True)
    inside = framing.resolved_anchors(points, plan, smoothed, rois, bounds=(100, 20, 800, 600)).where("point_id = 2").first()
    assert (inside.kind, inside.cx, inside.cy) == ("center", 500.0, 320.0)
    manual = spark.createDataFrame([(1, 0, 0, 300, 10, 20, 90, 160), (1, 1, 50, None, 200, 20, 90, 160)], ROIS)
    own = {r.point_id: (r.kind, r.cx) for r in framing.resolved_anchors(points, plan, smoothed, manual).collect()}
    assert own == {0: ("manual", 55.0), 1: ("manual", 245.0), 2: ("manual", 245.0)}


def lines(clip, rows, columns):
    return [(clip, axis, i, v) for axis, own in (("row", rows), ("column", columns)) for i, v in enumerate(own)]


def test_content_bounds_need_half_of_both_axes(spark):
    lit, dark = 90, 3
    rows = lines(1, [dark] * 20 + [lit] * 200 + [dark] * 20, [lit] * 320)  # letterbox: bars of 20 of 240 lines
    rows += lines(2, [lit] * 5 + [dark] * 5, [lit] * 10)  # 4 - 0 is under half of ten
    rows += lines(3, [lit] * 6 + [dark] * 4, [lit] * 10)
    rows += lines(4, [lit] * 10, [dark] * 10) + lines(5, [dark, lit, lit, lit, lit, lit, lit, dark], [dark] * 2 + [lit] * 6)
    rows += [(1, "row", 0, 4), (3, "row", 9, 8)]
    got = {r.clip_id: (r.x, r.y, r.w, r.h) for r in editing.content_bounds(spark.createDataFrame(rows, "clip_id long, axis string, line int, luma int")).collect()}
    assert got == {1: (0, 20, 320, 200), 2: (0, 0, 10, 10), 3: (0, 0, 10, 6), 4: (0, 0, 10, 10), 5: (2, 1, 6, 6)}


def test_narrow_frames_keep_the_ratio(spark):
    x, y, w, h = framing.crop_window(F.lit(300), F.lit(400), Framing(width=540, height=1920))
    assert tuple(spark.range(1).select(w, h).first()) == (540, 960)
    assert spark.range(1).select((x >= 0) & (y >= 0) & (y + h <= 1920)).first()[0]


def loop_glossary(words, entries):
    shown = list(words)
    for parts, replacement in captions.cleaned(entries):
        i, m = 0, len(parts)
        while i <= len(words) - m:
            if tuple((w or "").lower() for w in words[i : i + m]) == parts:
                shown[i : i + m] = [replacement] + [""] * (m - 1)
                i += m
            else:
                i += 1
    return shown


def test_automaton_equals_the_scan_of_every_entry(spark):
    rng = random.Random(6)
    letters = ["a", "B", "c", "a", "É"]
    entries = [(" ".join(rng.choice(letters) for _ in range(rng.randint(1, 4))), f"R{i}") for i in range(40)] + [("", "x"), ("a", "a"), ("a a", "AA"), ("a a a", "T")]
    videos = {v: [rng.choice([*letters, "z", None]) for _ in range(rng.randint(0, 60))] for v in range(12)}
    rows = [(v, i * 3, w, "keep") for v, own in videos.items() for i, w in enumerate(own)]
    rows += [(None, i, "a", "k") for i in range(3)]
    df = spark.createDataFrame(rows, "video_id long, pos long, word string, Lowered string").repartition(7)
    for few, sent, some in ((0, 10**6, entries), (0, 60, entries), (9, 1, entries[-6:])):  # one automaton, several passes, windows
        out = captions.glossary_display(df, some, few, sent)
        assert sorted(out.columns) == sorted([*df.columns, "display"])
        want = {(v, i * 3): t for v, own in videos.items() for i, t in enumerate(loop_glossary(own, some))}
        assert {(r.video_id, r.pos): r.display for r in out.collect() if r.video_id is not None} == want
        if not few:
            assert [r.display for r in out.where("video_id is null").orderBy("pos").collect()] == loop_glossary(["a"] * 3, some)
    assert captions.glossary_display(df.where("false"), entries, 0).count() == 0


def test_ten_thousand_entries_run_in_one_pass(spark):
    entries = [(f"word{i} word{i + 1}", f"E{i}") for i in range(10_000)]
    df = spark.createDataFrame([(1, i, f"Word{i}") for i in range(2000)], "video_id long, pos long, word string")
    out = captions.glossary_display(df, entries)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = [r.display for r in out.orderBy("pos").collect()]
    # every later entry overwrites the first word of the one before by its own first
    assert got[0] == "E0" and got[1:1999] == [f"E{i}" for i in range(1, 1999)] and got[1999] == ""


def test_marks_and_updates_take_nulls_and_any_names(spark):
    links = spark.createDataFrame([(1, True, None, 5), (1, None, None, 6), (2, True, True, 7), (None, None, None, 8), (3, True, False, 9)], "clip_id long, confirmed boolean, stitched boolean, used long")
    got = state.mark_stitched(links, spark.createDataFrame([(1,), (2,)], "clip_id long"))
    assert got.columns == links.columns
    assert {r.used: r.stitched for r in got.collect()} == {5: True, 6: False, 7: True, 8: False, 9: False}
    table = spark.createDataFrame([(1, "a", "mine"), (2, "b", "too")], "k long, x string, new_x string")
    out = state.update(table, spark.createDataFrame([(1, "A"), (3, "C")], "k long, x string"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "A", "mine"), (2, "b", "too")]
    left = spark.createDataFrame([(1, 0, 10, 3)], "v long, a long, b long, Cell long")
    right = spark.createDataFrame([(1, 5, 20)], "v long, c long, d long")
    assert intervals.overlap_join(left, right, "v", ("a", "b"), ("c", "d")).select("Cell").first()[0] == 3


def test_closures_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "b"), (None, "q"), ("d", None)], "stage string, dependent string")
    got = {(r.origin, r.stage): r.steps for r in state.reached(edges, spark.createDataFrame([("a",), ("x",), ("d",), (None,)], "origin string")).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("a", "d"): 3, ("x", "y"): 1}
    log = spark.createDataFrame([(1, "b", 1), (1, "z", 2), (2, "b", 3), (2, "y", 4)], "video_id long, stage string, seq long")
    changes = spark.createDataFrame([(1, "a"), (2, "x")], "video_id long, stage string")
    assert {r.seq for r in state.invalidate_by(log, edges, changes).collect()} == {2, 3}
    none = spark.createDataFrame([], edges.schema)
    assert state.invalidate_by(log, none, changes).count() == 4
