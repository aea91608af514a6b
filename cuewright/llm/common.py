"""Helpers shared by the training-data operators: the shared folder, written
intermediate tables, hold-out folds and ranks without a global sort task."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on a local master only, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="cuewright-")
    return _OWN[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cuewright/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for df, when all that reads it has been written itself."""
    path = _PATHS.pop(df, None)
    if path:
        jvm, jsession = df.sparkSession._jvm, df.sparkSession._jsparkSession
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(jsession.sessionState().newHadoopConf()).delete(folder, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until df has no such column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def id_crc32(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    return (id_crc32(doc_id) % modulus == remainder).alias("held_out")


def label_sample(labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """(doc_id, label) of about max_rows labelled rows that satisfy ``keep``, chosen by a hash of the id.

    Repeated label rows of an id count once (the larger label). The result is small
    enough to broadcast whatever the size of ``labels``: max_rows is its bound in
    expectation, and the hash makes the choice the same on every run."""
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(keep)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    n = rows.count()
    if n > max_rows:
        bound = int(max_rows / n * (1 << 32))
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < bound)
    return rows


def ranked_blocks(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``block``: range partitions over (keys, order), written to the shared folder.

    A key with most of the rows covers many blocks, so later windows are taken per
    (key, block) and joined by one row per (key, block); no task holds a whole key."""
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    out = df.repartitionByRange(n, *[F.col(c) for c in [*keys, *order]])
    return materialize(out.withColumn("block", F.spark_partition_id()), name)


def block_offsets(counts: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` over blocks, per key: one row per (keys, block)."""
    w = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))

