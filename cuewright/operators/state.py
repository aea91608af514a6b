"""State as append-only logs and views of the latest: plan versions, stage runs, fingerprints, invalidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuewright.functions.text import fingerprint
from cuewright.names import spare
from cuewright.storage import written

#: Which stages a changed stage makes stale.
DEPENDS = {
    "audio_events": ["analyze", "similarity", "refine", "render"],
    "outline": ["analyze", "similarity", "refine", "render"],
    "refine": ["render"],
}


def numbered_versions(plans: DataFrame, key: str, *order: str) -> DataFrame:
    """plans with ``version`` from 1 in order."""
    return plans.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by a partially aggregated maximum: one shuffled row per key and task."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def append_version(plans: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """plans and ``new`` rows, these with the next versions of their keys."""
    top = plans.groupBy(key).agg(F.max("version").alias("top"))
    own = F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key]))
    fresh = new.join(top, key, "left").withColumn("version", (F.coalesce("top", F.lit(0)) + own).cast("long")).drop("top")
    return plans.unionByName(fresh, allowMissingColumns=True)


def stage_status(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current status of each (video, stage) of a run log, with attempts and whether a rerun may skip it."""
    n = log.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count(F.when(F.col("status") == "failed", 1)).alias("failures"))
    now = latest(log.select(*keys, *order, "status"), keys, order).select(*keys, "status")
    return n.join(now, keys).withColumn("skip", F.col("status") == "done")


def upsert(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """An upserted table as the compaction of its append log."""
    return latest(log, keys, order)


def start_stage(log: DataFrame, starts: DataFrame) -> DataFrame:
    """log (video_id, stage, status, seq) after ``starts`` (video_id, stage, seq): rows of them that are not done go, a running one comes."""
    key = ["video_id", "stage"]
    gone = log.join(starts.select(*key).distinct(), key, "left_semi").where("status <> 'done'")
    kept = log.join(gone.select(*key, "seq"), [*key, "seq"], "left_anti")
    return kept.unionByName(starts.select(*key, F.lit("running").alias("status"), "seq"), allowMissingColumns=True)


def finish_stage(log: DataFrame, ends: DataFrame) -> DataFrame:
    """log with the running rows of ``ends`` (video_id, stage, outcome: done or failed) set to the outcome; other rows stay."""
    e = ends.select("video_id", "stage", "outcome")
    hit = (F.col("status") == "running") & F.col("outcome").isNotNull()
    return log.join(e, ["video_id", "stage"], "left").withColumn("status", F.when(hit, F.col("outcome")).otherwise(F.col("status"))).drop("outcome")


def fingerprint_matches(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted (video_id, stage, fingerprint) with ``matches``: whether the stored one is equal; false where none is stored."""
    s = stored.select("video_id", "stage", F.col("fingerprint").alias("had"))
    return wanted.join(s, ["video_id", "stage"], "left").withColumn("matches", F.coalesce(F.col("had") == F.col("fingerprint"), F.lit(False))).drop("had")


#: The settings that each stage's fingerprint covers, besides its inputs.
STAGE_SETTINGS = {
    "outline": ["transcript", "model", "prompt", "window_sentences"],
    "discovery": ["transcript", "outline", "model", "prompt", "target_clips", "max_candidates", "min_span", "max_span", "allow_noncontiguous"],
    "audio_events": ["audio", "win_ms", "baseline_sec", "min_duration", "max_event", "threshold_db", "merge_gap", "pre", "post", "min_cov", "classifier"],
}


def stage_fingerprints(jobs: DataFrame) -> DataFrame:
    """(video_id, stage, fingerprint) of jobs (video_id, stage, settings map): over the stage's own settings in a fixed order."""
    digest = F.lit(None).cast("string")
    for stage, names in STAGE_SETTINGS.items():
        fields = [F.concat(F.lit(f"{n}="), F.coalesce(F.try_element_at("settings", F.lit(n)), F.lit(""))) for n in names]
        digest = F.when(F.col("stage") == stage, fingerprint(F.lit(stage), *fields)).otherwise(digest)
    return jobs.select("video_id", "stage", digest.alias("fingerprint"))


#: Stages whose runs a rerun from the embeddings forgets.
RERUN = ["audio_events", "embed", "outline", "analyze", "similarity", "refine", "render"]


def clean_up(tables: dict[str, DataFrame], videos: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the derived rows of ``videos`` (video_id), and how many rows of each went: (video_id, table, removed).

    tables: related_segments (clip_id), clips (clip_id, video_id), candidates, outlines, and
    pipeline_runs (stage), these by video_id."""
    v = videos.select("video_id").distinct()
    gone = {n: t.join(v, "video_id", "left_semi") for n, t in tables.items() if n != "related_segments"}
    gone["pipeline_runs"] = gone["pipeline_runs"].where(F.col("stage").isin(RERUN))
    links = tables["related_segments"].join(gone["clips"].select("clip_id", "video_id"), "clip_id")
    counts = [t.groupBy("video_id").agg(F.count("*").alias("removed")).select("video_id", F.lit(n).alias("table"), "removed") for n, t in {**gone, "related_segments": links}.items()]
    left = {n: t.join(v, "video_id", "left_anti") for n, t in tables.items() if n not in ("related_segments", "pipeline_runs")}
    left["related_segments"] = tables["related_segments"].join(gone["clips"].select("clip_id"), "clip_id", "left_anti")
    (mark,) = spare(["gone"], tables["pipeline_runs"])
    runs = tables["pipeline_runs"].join(v.withColumn(mark, F.lit(True)), "video_id", "left")
    left["pipeline_runs"] = runs.where(F.col(mark).isNull() | ~F.col("stage").isin(RERUN)).drop(mark)
    return left, reduce(DataFrame.union, counts)


def mark_stitched(links: DataFrame, clips: DataFrame) -> DataFrame:
    """links (clip_id, confirmed, stitched) with the confirmed ones of ``clips`` (clip_id) marked as stitched; a null counts as false."""
    (used,) = spare(["used"], links)
    c = clips.select("clip_id").distinct().withColumn(used, F.lit(True))
    no = lambda x: F.coalesce(F.col(x), F.lit(False))
    return links.join(c, "clip_id", "left").withColumn("stitched", no("stitched") | (no(used) & no("confirmed"))).select(*links.columns)


def replace_by(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with all rows of the keys in ``new`` replaced by new's rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the non-null values of ``changes`` (one row per key) put in."""
    cols = [c for c in changes.columns if c != key]
    new = dict(zip(cols, spare([f"new_{x}" for x in cols], table), strict=True))
    c = changes.select(key, *[F.col(x).alias(n) for x, n in new.items()])
    out = table.join(c, key, "left")
    return out.withColumns({x: F.coalesce(F.col(n), F.col(x)) for x, n in new.items()}).select(*table.columns)


def stale(stage: str) -> list[str]:
    """The stages to run again after ``stage`` changed: the transitive closure of DEPENDS, sorted."""
    seen: set[str] = set()
    todo = [stage]
    while todo:
        for s in DEPENDS.get(todo.pop(), []):
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return sorted(seen)


def reached(edges: DataFrame, starts: DataFrame, most: int = 10_000) -> DataFrame:
    """(origin, stage, steps): all that depends on an origin through edges (stage, dependent), with the fewest steps; cycles end.

    starts: (origin). Breadth first: each round joins the newest stages with the edges and keeps
    what was not reached before, so it ends after the longest shortest path. Every round is
    written to the shared folder; the origin itself is listed where a cycle returns to it."""
    e = written(edges.where("stage is not null and dependent is not null").select("stage", "dependent").distinct(), "edges")
    fresh = written(starts.select("origin", F.col("origin").alias("stage")).where("origin is not null").distinct(), "reached")
    rounds: list[DataFrame] = []
    for step in range(1, most + 1):
        found = fresh.join(e, "stage").select("origin", F.col("dependent").alias("stage")).distinct()
        if rounds:
            found = found.join(reduce(DataFrame.union, rounds), ["origin", "stage"], "left_anti")
        fresh = written(found.withColumn("steps", F.lit(step)), "reached")
        if fresh.isEmpty():
            break
        rounds.append(fresh.select("origin", "stage", "steps"))
        fresh = fresh.drop("steps")
    else:
        raise ValueError(f"paths of over {most} steps")
    return reduce(DataFrame.union, rounds) if rounds else fresh


def invalidate_by(log: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """log (video_id, stage, ...) without the rows of stages that a video's changes (video_id, stage) make stale by edges (stage, dependent)."""
    gone = reached(edges, changes.select(F.col("stage").alias("origin")))
    gone = changes.select("video_id", F.col("stage").alias("origin")).join(gone.select("origin", "stage"), "origin").select("video_id", "stage").distinct()
    return log.join(gone, ["video_id", "stage"], "left_anti").select(*log.columns)


def invalidate(log: DataFrame, changed: list[str], stage: str = "stage") -> DataFrame:
    """log without the rows of stages that the changed ones make stale."""
    gone = sorted({s for c in changed for s in stale(c)})
    return log.where(~F.col(stage).isin(gone)) if gone else log
