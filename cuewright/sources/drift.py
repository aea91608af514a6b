"""Tables whose columns changed over time, and plans of several versions as semi-structured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that clips got over time: their type, and what rows from before have.
CLIP_COLUMNS = {
    "clip_id": ("long", None),
    "video_id": ("long", None),
    "s": ("long", None),
    "e": ("long", None),
    "hook": ("string", ""),
    "layout": ("string", "auto"),
    "refine_status": ("string", "pending"),
    "provenance": ("string", "{}"),
}


def read_drifted(spark: SparkSession, path: str, columns: dict[str, tuple] = CLIP_COLUMNS, keep: list[str] | None = None, merge: bool = False) -> DataFrame:
    """A Parquet table of partitions of several ages with just ``columns`` and the partition columns in ``keep``.

    A column that a file lacks, or no file has, is its default, as is a null in it; numbers that grew wider
    are widened by the reader. With ``merge`` the files' schemas are merged instead, and columns that are
    not listed come too; widths must agree then. Filters on partition columns reach the scan."""
    ddl = ", ".join(f"{n} {kind}" for n, (kind, _) in columns.items())
    raw = spark.read.option("mergeSchema", "true").parquet(path) if merge else spark.read.schema(ddl).parquet(path)
    have = {c.lower(): c for c in raw.columns}

    def column(name: str) -> Column:
        kind, default = columns[name]
        found = F.col(have[name.lower()]).cast(kind) if name.lower() in have else F.lit(None).cast(kind)
        return (F.coalesce(found, F.lit(default).cast(kind)) if default is not None else found).alias(name)

    more = [c for c in raw.columns if c.lower() not in {n.lower() for n in columns} and (merge or c in (keep or []))]
    return raw.select(*[column(n) for n in columns], *more)


def as_variant(plans: DataFrame, column: str = "plan") -> DataFrame:
    """plans with their JSON text as a variant; text that is no JSON becomes null."""
    return plans.withColumn(column, F.try_parse_json(column))


def at(value: Column, path: str, kind: str) -> Column:
    """What lies at a path of a variant, null where the path is absent or of another kind."""
    return F.try_variant_get(value, path, kind)


def plan_fields(plans: DataFrame, column: str = "plan") -> DataFrame:
    """(clip_id, plan_version, output_ms, layout, scene_count, needs_review) of plans of both versions.

    Version 1 kept the length in seconds and the scenes at the top; version 2 has milliseconds and a framing
    object. Plans without a version count as 1, and absent parts as none."""
    v = as_variant(plans, column)
    p = F.col(column)
    version = F.coalesce(at(p, "$.plan_version", "int"), F.lit(1))
    seconds = F.round(at(p, "$.output_duration", "double") * 1000).cast("long")
    scenes = F.coalesce(at(p, "$.framing.scene_crops", "array<variant>"), at(p, "$.scenes", "array<variant>"))
    return v.select(
        "clip_id",
        version.alias("plan_version"),
        F.coalesce(at(p, "$.output_ms", "long"), seconds).alias("output_ms"),
        F.coalesce(at(p, "$.framing.layout", "string"), at(p, "$.layout", "string"), F.lit("auto")).alias("layout"),
        F.coalesce(F.size(scenes), F.lit(0)).alias("scene_count"),
        F.coalesce(at(p, "$.framing.needs_review", "boolean"), F.lit(False)).alias("needs_review"),
    )
