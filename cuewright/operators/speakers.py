"""Speaker turns: merging, lookup at a time, change points, switch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.config import Speakers

from .intervals import overlap_join


def stable_turns(segs: DataFrame, cfg: Speakers = Speakers(), keep_short: bool = False) -> DataFrame:
    """(conv_id, speaker, s, e, n): a speaker's neighbouring segments with gaps under join_ms as one turn; short turns go.

    A turn ends when the speaker changes, or when a segment starts join_ms or more after all of the speaker's run so far."""
    w = Window.partitionBy("conv_id").orderBy("s", "e", "speaker")
    t = segs.select("conv_id", "speaker", "s", "e").withColumn("turned", (~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))).cast("int"))
    t = t.withColumn("run", F.sum("turned").over(w))
    r = Window.partitionBy("conv_id", "run").orderBy("s", "e")
    reach = F.max("e").over(r.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("fresh", F.coalesce((F.col("s") - reach >= cfg.join_ms).cast("int"), F.lit(1)))
    t = t.withColumn("part", F.sum("fresh").over(r))
    g = t.groupBy("conv_id", "run", "part", "speaker").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))
    g = g.select("conv_id", "speaker", "s", "e", "n")
    return g if keep_short else g.where(F.col("e") - F.col("s") >= cfg.min_turn_ms)


def speaker_at(points: DataFrame, segs: DataFrame, point_id: str, t: str) -> DataFrame:
    """points with ``speaker``: of the first segment (by seg_id) that holds time t, bounds included; else null."""
    s = segs.select("conv_id", F.col("s").alias("s0"), F.col("e").alias("e0"), F.col("speaker").alias("who"), "seg_id")
    at = points.select("conv_id", *dict.fromkeys([point_id, t]))
    got = overlap_join(at, s, "conv_id", (t, t), ("s0", "e0")).groupBy("conv_id", point_id).agg(F.min_by("who", "seg_id").alias("speaker"))
    return points.join(got, ["conv_id", point_id], "left")


def change_points(spoken: DataFrame, order: str) -> DataFrame:
    """Rows whose speaker differs from the one before (null is a speaker too)."""
    w = Window.partitionBy("conv_id").orderBy(order)
    first = F.row_number().over(w) == 1
    changed = spoken.withColumn("changed", first & F.col("speaker").isNotNull() | ~first & ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)))
    return changed.where("changed").drop("changed")


def switches(turns: DataFrame, tracks: dict[str, int], cfg: Speakers = Speakers()) -> DataFrame:
    """(conv_id, t, speaker, track_id): camera switches at turns of mapped speakers.

    A turn that another speaker's overlaps holds the current one, as does a switch under
    hold_ms ago; the hold depends on earlier switches, so the turns are folded in order."""
    a = turns.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("s", "e", "speaker")))
    b = a.select("conv_id", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("speaker").alias("other"))
    met = overlap_join(a.select("conv_id", "turn", "s", "e", "speaker"), b, "conv_id", ("s", "e"), ("s2", "e2"))
    met = met.where((F.col("other") != F.col("speaker")) & (F.col("s2") < F.col("e")) & (F.col("e2") > F.col("s")))
    crossed = met.select("conv_id", "turn").distinct().withColumn("crossed", F.lit(True))
    t = a.join(crossed, ["conv_id", "turn"], "left").where(F.col("speaker").isin(*tracks))
    xs = F.array_sort(F.collect_list(F.struct("turn", "s", "speaker", F.coalesce("crossed", F.lit(False)).alias("crossed"))))
    g = t.groupBy("conv_id").agg(xs.alias("xs"))
    kind = "array<struct<turn:int,s:bigint,speaker:string,crossed:boolean>>"

    def step(k, x):
        last = F.try_element_at(k, F.lit(-1))
        held = (F.size(k) > 0) & ((x["speaker"] == last["speaker"]) | x["crossed"] | (x["s"] - last["s"] < cfg.hold_ms))
        return F.when(held, k).otherwise(F.concat(k, F.array(x)))

    out = g.select("conv_id", F.inline(F.aggregate("xs", F.array().cast(kind), step)))
    track = F.coalesce(*[F.when(F.col("speaker") == s, F.lit(i)) for s, i in sorted(tracks.items())])
    return out.select("conv_id", F.col("s").alias("t"), "speaker", track.alias("track_id"))
