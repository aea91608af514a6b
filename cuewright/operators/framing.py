"""Framing analytics over face samples: layout votes, smoothed centres, scene plans, anchors, crop windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.config import Framing
from cuewright.functions.numeric import half_up, upper_median

from .editing import layout as known_layout
from .intervals import overlap_join

LAYOUTS = ["speaker_crop", "stacked_split", "center_crop"]


def decide_layout(clips: DataFrame, samples: DataFrame, cfg: Framing = Framing(), full_screen: bool = True) -> DataFrame:
    """(clip_id, layout, needs_review) of clips (clip_id, override): a manual layout as it is, else by votes.

    A clip without samples stands at the centre; that, and a centre by votes, is for review."""
    v = layout_votes(samples, cfg).select("clip_id", F.col("layout").alias("voted"))
    wanted = known_layout(F.col("override"), F.lit(None), F.lit("auto"), full_screen)
    j = clips.join(v, "clip_id", "left").withColumn("wanted", wanted)
    manual = F.col("wanted") != "auto"
    layout = F.when(manual, F.col("wanted")).otherwise(F.coalesce("voted", F.lit(LAYOUTS[2])))
    return j.select("clip_id", layout.alias("layout"), (~manual & (layout == LAYOUTS[2])).alias("needs_review"))


def layout_votes(samples: DataFrame, cfg: Framing = Framing()) -> DataFrame:
    """samples (clip_id, pos, n faces) -> clip_id, votes by layout, face_fraction, layout.

    Every sample counts the majority of the trailing window; ties go in the order of LAYOUTS."""
    vote = F.when(F.col("n") == 1, LAYOUTS[0]).when(F.col("n") >= 2, LAYOUTS[1]).otherwise(LAYOUTS[2])
    w = Window.partitionBy("clip_id").orderBy("pos").rowsBetween(-(cfg.stability - 1), 0)
    s = samples.withColumn("v", vote)
    counts = {f"c{i}": F.count(F.when(F.col("v") == name, 1)).over(w) for i, name in enumerate(LAYOUTS)}
    s = s.withColumns(counts)
    best = F.greatest("c0", "c1", "c2")
    s = s.withColumn("m", F.when(F.col("c0") == best, 0).when(F.col("c1") == best, 1).otherwise(2))
    g = s.groupBy("clip_id").agg(
        *[F.count(F.when(F.col("m") == i, 1)).alias(f"votes_{name}") for i, name in enumerate(LAYOUTS)],
        F.count("*").alias("samples"), F.count(F.when(F.col("n") > 0, 1)).alias("faces"),
    )
    a, b, c = (F.col(f"votes_{name}") for name in LAYOUTS)
    layout = F.when(F.col("faces") < F.col("samples") * cfg.min_face_fraction, LAYOUTS[2]).when((a >= b) & (a >= c), LAYOUTS[0]).when(b >= c, LAYOUTS[1]).otherwise(LAYOUTS[2])
    return g.withColumn("face_fraction", half_up(F.col("faces") / F.col("samples"), 3)).withColumn("layout", layout).drop("faces")


def smoothed_centres(samples: DataFrame, cfg: Framing = Framing()) -> DataFrame:
    """samples (clip_id, pos, cx, cy (null: no track), cut) with cam_x, cam_y, missing, lost.

    The camera follows outside a dead zone by exponential smoothing and snaps on jumps; its
    place depends on all places before, so the samples of a clip are folded in order: in
    vectors over each clip's arrays, since a fold that grows its result copies it each time."""
    track_w = int(cfg.height * 9 / 16)
    dead, snap = track_w * cfg.deadzone + cfg.jitter, cfg.width * cfg.snap

    def follow(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        x = y = None
        missing, out = 0, []
        for cx, cy, cut in zip(f["cx"].tolist(), f["cy"].tolist(), f["cut"].tolist(), strict=True):
            if cx is None or cx != cx:
                missing = (0 if cut else missing) + 1
            else:
                fresh, missing = x is None or abs(cx - x) > snap, 0
                dx, dy = (0.0, 0.0) if x is None else (cx - x, cy - y)
                x = float(cx) if fresh else x + dx * cfg.smooth if abs(dx) > dead else x
                y = float(cy) if fresh else y + dy * cfg.smooth if abs(dy) > cfg.jitter else y
            out.append((x, y, missing))
        got = pd.DataFrame(out, columns=["x", "y", "missing"], index=f.index)
        return pd.DataFrame({"clip_id": f["clip_id"], "pos": f["pos"], "x": got["x"].astype(float), "y": got["y"].astype(float), "missing": got["missing"]})

    rows = samples.select("clip_id", "pos", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), "cut")
    out = rows.groupBy("clip_id").applyInPandas(follow, "clip_id long, pos long, x double, y double, missing long")
    return out.select("clip_id", "pos", half_up(F.col("x"), 3).alias("cam_x"), half_up(F.col("y"), 3).alias("cam_y"), "missing", (F.col("missing") > cfg.hold_samples).alias("lost"))


def scene_cuts(frames: DataFrame, threshold: float = 18.0) -> DataFrame:
    """frames (clip_id, pos, pixels array) with ``diff`` (mean absolute difference to the frame before) and ``cut``."""
    before = F.lag("pixels").over(Window.partitionBy("clip_id").orderBy("pos"))
    f = frames.withColumn("before", before)
    total = F.aggregate(F.zip_with("pixels", "before", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    f = f.withColumn("diff", F.when(F.col("before").isNotNull(), half_up(total / F.size("pixels"), 6)))
    return f.withColumn("cut", F.coalesce(F.col("diff") > threshold, F.lit(False))).drop("before")


def associate(samples: DataFrame, cfg: Framing = Framing(), gate: float = 0.12) -> DataFrame:
    """samples (clip_id, pos, cut, boxes [(cx, cy)]) -> (clip_id, pos, box, track_id).

    Within a shot every track of the sample before, in its order, takes the nearest box not
    taken (sum of both distances) within ``gate`` of the width; other boxes get new ids. A
    cut forgets the tracks, ids go on. Samples are folded in order inside each clip."""

    def follow(f: pd.DataFrame) -> pd.DataFrame:
        tracks, fresh, out = [], 0, []
        for clip, pos, cut, boxes in f.sort_values("pos")[["clip_id", "pos", "cut", "boxes"]].itertuples(index=False):
            boxes = [(b["cx"], b["cy"]) for b in (boxes if boxes is not None else [])]
            if cut:
                tracks = []
            of: dict[int, int] = {}
            for track, x, y in tracks:
                free = [(abs(bx - x) + abs(by - y), j) for j, (bx, by) in enumerate(boxes) if j not in of]
                if free and min(free)[0] < cfg.width * gate:
                    of[min(free)[1]] = track
            order = list(of)
            for j in range(len(boxes)):
                if j not in of:
                    of[j], fresh = fresh, fresh + 1
                    order.append(j)
            tracks = [(of[j], *boxes[j]) for j in order]
            out += [(clip, pos, j, of[j]) for j in range(len(boxes))]
        return pd.DataFrame(out, columns=["clip_id", "pos", "box", "track_id"])

    return samples.groupBy("clip_id").applyInPandas(follow, "clip_id long, pos long, box int, track_id int")


def scene_plan(samples: DataFrame, cfg: Framing = Framing(), work_area: tuple[int, int, int, int] | None = None) -> DataFrame:
    """samples (clip_id, pos, track_id, cx, cy, cut) -> one anchor per scene (scenes start at cuts).

    The most frequent track's upper median; ties go to the track seen first. Scenes without a
    face retain the last anchor; before any, they stand at the middle of the work area
    (x, y, w, h), which later scenes then retain, or at the centre."""
    w = Window.partitionBy("clip_id").orderBy("pos")
    s = samples.withColumn("scene", F.sum(F.col("cut").cast("int")).over(w).cast("long"))
    scenes = s.groupBy("clip_id", "scene").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("samples"))
    t = s.where("track_id is not null").groupBy("clip_id", "scene", "track_id").agg(
        F.count("*").alias("seen"), F.min("pos").alias("since"), upper_median(F.collect_list("cx")).alias("cx"), upper_median(F.collect_list("cy")).alias("cy")
    )
    best = t.groupBy("clip_id", "scene").agg(F.max_by(F.struct("track_id", "seen", "cx", "cy"), F.struct("seen", -F.col("since"), -F.col("track_id"))).alias("t"))
    p = scenes.join(best, ["clip_id", "scene"], "left")
    kept = F.last("t", ignorenulls=True).over(Window.partitionBy("clip_id").orderBy("scene").rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("a", kept)
    opening = F.row_number().over(Window.partitionBy("clip_id").orderBy("scene")) == 1
    kind = F.when(F.col("t").isNotNull(), "face").when(F.col("a").isNotNull(), "retain")
    if work_area:
        x, y, w, h = work_area
        p = p.withColumn("opening", opening)
        kind = kind.when(F.col("opening"), "workarea").otherwise("retain")
        middle = (x + w // 2, y + h // 2)
    else:
        kind, middle = kind.otherwise("center"), (cfg.width // 2, cfg.height // 2)
    return p.select(
        "clip_id", "scene", "first_pos", "last_pos", "samples", kind.alias("kind"), F.col("a.track_id").alias("track_id"),
        F.coalesce("a.cx", F.lit(middle[0])).cast("long").alias("cx"), F.coalesce("a.cy", F.lit(middle[1])).cast("long").alias("cy"), (kind != "face").alias("needs_review"),
    )


def interpolated(centres: DataFrame, points: DataFrame, values: list[str], flags: list[str]) -> DataFrame:
    """points (clip_id, point_id, t) with ``values`` and ``flags`` of centres (clip_id, t, cut, ...) at t.

    At or before the first sample and at or after the last that sample counts. Between two, values are
    linear, but across a cut, and where the earlier one's first value is missing, the later sample
    counts, and where the later one's is missing the earlier. Flags are those of the sample
    that counts, of the later one where values are linear. A point at a sample's own time lies
    between it and the one before. As-of both ways by one union and one window order."""
    rows = centres.select("clip_id", F.col("t"), F.struct("t", "cut", *values, *flags).alias("c"), F.lit(None).cast("long").alias("point_id"))
    rows = rows.unionByName(points.select("clip_id", "t", F.lit(None).cast(rows.schema["c"].dataType).alias("c"), F.col("point_id").cast("long")))
    w = Window.partitionBy("clip_id").orderBy("t", F.col("point_id").asc_nulls_last())  # points before samples of their time
    back = F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fore = F.first("c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    end = F.max("c.t").over(Window.partitionBy("clip_id"))
    r = rows.withColumns({"a": back, "b": fore, "end": end}).where("c is null")
    later = F.col("a").isNull() | (F.col("b.t") == F.col("end")) & (F.col("t") == F.col("end")) | F.col("b.cut") | F.col(f"a.{values[0]}").isNull()
    earlier = F.col("b").isNull() | F.col(f"b.{values[0]}").isNull()
    one = F.when(F.col("b").isNull(), F.col("a")).when(later, F.col("b")).when(earlier, F.col("a"))
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    linear = lambda v: F.when(one.isNotNull(), one[v]).otherwise(F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * share)
    return r.select("clip_id", "point_id", "t", *[half_up(linear(v), 3).alias(v) for v in values], *[F.coalesce(one, F.col("b"))[f].alias(f) for f in flags])


def interpolated_anchors(centres: DataFrame, points: DataFrame) -> DataFrame:
    """points (clip_id, point_id, t) with x of centres (clip_id, t, x, cut), see ``interpolated``."""
    return interpolated(centres, points, ["x"], [])


def resolved_anchors(
    points: DataFrame, plan: DataFrame, smoothed: DataFrame, rois: DataFrame, cfg: Framing = Framing(), work_area: tuple[int, int, int, int] | None = None, bounds: tuple[int, int, int, int] | None = None
) -> DataFrame:
    """points (clip_id, point_id, t) -> (clip_id, point_id, t, kind, cx, cy, needs_review): what the crop follows at t.

    rois: (clip_id, idx, t0, t1 (null: open), x, y, w, h), of which the last added that holds t
    wins over all; plan: (clip_id, scene, t0, t1, kind, cx, cy, needs_review), the first segment
    that holds t; smoothed: (clip_id, t, x, y, cut, lost), followed in face scenes and held,
    for review, where the track is lost. Points outside every segment stand, for review, at the middle of
    the work area (x, y, w, h) if one is set, else of the content bounds, else of the frame."""
    last = points.groupBy("clip_id").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"))
    r = rois.join(last, "clip_id").select("clip_id", "idx", F.coalesce("t0", "from_t").alias("r0"), F.coalesce("t1", "to_t").alias("r1"), (F.col("x") + F.col("w") / 2).alias("mx"), (F.col("y") + F.col("h") / 2).alias("my"))
    at = points.select("clip_id", "point_id", "t")
    manual = overlap_join(at, r, "clip_id", ("t", "t"), ("r0", "r1")).groupBy("clip_id", "point_id").agg(F.max_by(F.struct("mx", "my"), "idx").alias("m"))
    g = plan.select("clip_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), F.struct("kind", "cx", "cy", "needs_review").alias("seg"))
    scene = overlap_join(at, g, "clip_id", ("t", "t"), ("s0", "s1")).groupBy("clip_id", "point_id").agg(F.min_by("seg", "s0").alias("seg"))
    follow = interpolated(smoothed, points, ["x", "y"], ["lost"]).select("clip_id", "point_id", F.col("x").alias("fx"), F.col("y").alias("fy"), "lost")
    j = points
    for d in (manual, scene, follow):
        j = j.join(d, ["clip_id", "point_id"], "left")
    x, y, w, h = work_area or bounds or (0, 0, cfg.width, cfg.height)
    nowhere = "workarea" if work_area else "center"
    seen = F.col("fx").isNotNull()
    face, lost = F.col("seg.kind") == "face", F.coalesce("lost", F.lit(False))
    kind = F.when(F.col("m").isNotNull(), "manual").when(face, F.when(seen & ~lost, "face").otherwise("retain")).otherwise(F.coalesce("seg.kind", F.lit(nowhere)))
    pick = lambda m, f, s, d: F.when(F.col("m").isNotNull(), F.col(m)).when(face & seen, F.col(f)).otherwise(F.coalesce(F.col(s).cast("double"), F.lit(float(d))))
    review = F.when(F.col("m").isNotNull(), False).when(face, ~(seen & ~lost)).otherwise(F.coalesce("seg.needs_review", F.lit(True)))
    middle = (x + w / 2, y + h / 2) if work_area else (x + w // 2, y + h // 2)
    return j.select("clip_id", "point_id", "t", kind.alias("kind"), pick("m.mx", "fx", "seg.cx", middle[0]).alias("cx"), pick("m.my", "fy", "seg.cy", middle[1]).alias("cy"), review.alias("needs_review"))


def latest_at(points: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """points (clip_id, point_id, t) with ``columns`` of the latest row (clip_id, t, ...) at or before t, nulls where there is none.

    An as-of lookup by one union and a running window."""
    u = rows.select("clip_id", "t", F.struct(*columns).alias("r"), F.lit(None).cast("long").alias("point_id"))
    u = u.unionByName(points.select("clip_id", "t", F.lit(None).cast(u.schema["r"].dataType).alias("r"), F.col("point_id").cast("long")))
    w = Window.partitionBy("clip_id").orderBy("t", F.col("point_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("point_id is not null").select("clip_id", "point_id", "t", *[F.col("r")[c].alias(c) for c in columns])


def panel_places(points: DataFrame, tracks: DataFrame, samples: DataFrame, cfg: Framing = Framing()) -> DataFrame:
    """(clip_id, point_id, side, cx, cy): where the two panels of a stacked layout look at t.

    tracks: (clip_id, left_track, right_track). A panel takes its track's last known place at
    or before t; before that it looks at three or seven tenths of the width, four tenths of the height."""
    sides = F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"{k}_track").alias("track_id")) for k in ("left", "right")]))
    want = points.join(tracks, "clip_id").select("clip_id", "point_id", "t", sides)
    key = F.struct("clip_id", "track_id")
    rows = samples.where("track_id is not null").select(key.alias("clip_id"), "t", "cx", "cy")
    ask = want.select(key.alias("clip_id"), (F.col("point_id") * 2 + (F.col("side") == "right").cast("int")).alias("point_id"), "t")
    got = latest_at(ask, rows, ["cx", "cy"])
    right = F.col("point_id") % 2 == 1
    blind = F.when(right, 0.7 * cfg.width).otherwise(0.3 * cfg.width)
    return got.select(
        "clip_id.clip_id", F.floor(F.col("point_id") / 2).alias("point_id"), F.when(right, "right").otherwise("left").alias("side"),
        F.coalesce(F.col("cx").cast("double"), blind).alias("cx"), F.coalesce(F.col("cy").cast("double"), F.lit(0.4 * cfg.height)).alias("cy"),
    )


def anchor_shares(anchors: DataFrame) -> DataFrame:
    """(clip_id, kind, n, share): how often each kind of anchor is followed."""
    g = anchors.groupBy("clip_id", "kind").agg(F.count("*").alias("n"))
    return g.withColumn("share", half_up(F.col("n") / F.sum("n").over(Window.partitionBy("clip_id")), 6))


def fill_bars(edges: DataFrame, most_range: float = 3.0, most_std: float = 1.0) -> DataFrame:
    """edges (clip_id, edge, mean, std), one row a sampled frame -> (clip_id, edge, variation, is_bar).

    A bar that a renderer filled is flat in every sample and the same in all; its variation is 0."""
    g = edges.groupBy("clip_id", "edge").agg((F.max("mean") - F.min("mean")).alias("range"), F.max("std").alias("std"))
    bar = (F.col("range") < most_range) & (F.col("std") < most_std)
    return g.select("clip_id", "edge", F.when(bar, 0.0).otherwise(half_up(F.col("range"), 2)).alias("variation"), bar.alias("is_bar"))


def crop_window(cx: Column, cy: Column, cfg: Framing = Framing(), zoom: float = 1.0) -> tuple[Column, ...]:
    """x, y, w, h of the 9:16 window around a centre with headroom, inside the frame; a frame narrower than that shortens it."""
    h = max(480, int(cfg.height / zoom)) if cfg.height >= 480 else cfg.height
    w = int(h * 9 / 16)
    if w > cfg.width:
        w = cfg.width
        h = min(cfg.height, int(w * 16 / 9))
    x = F.least(F.greatest(F.floor(cx - w / 2), F.lit(0)), F.lit(cfg.width - w))
    y = F.least(F.greatest(F.floor(cy - h * 0.35), F.lit(0)), F.lit(cfg.height - h))
    return x, y, F.lit(w), F.lit(h)


def roi_error(x: Column, y: Column, w: Column, h: Column, t0: Column, t1: Column) -> Column:
    """Why a manual region is refused; null if it is fine."""
    return (
        F.when(x.isNull() | y.isNull() | w.isNull() | h.isNull(), "not numeric")
        .when((w <= 0) | (h <= 0) | (x < 0) | (y < 0), "not positive")
        .when(F.abs(w / h - 9 / 16) > 0.03, "not 9:16")
        .when(t0.isNotNull() & t1.isNotNull() & (t0 >= t1), "empty time range")
    )
