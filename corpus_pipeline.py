"""The corpus pipeline: toxic documents go, then poor ones, near-duplicates and those that
hold benchmark items; what is left is packed into sequences.

Every stage takes the documents its predecessor kept, whole, and writes what it keeps.
All stages take null ids, null, empty and very long texts, repeated rows, empty tables
and further columns of any name; the filters return the columns they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import decontamination, packing, quality, shingles, simhash, toxicity
from cuewright.llm.common import held_out, materialize, release, spare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose toxicity reaches the threshold.

    Null and empty texts have no evidence and stay. Repeated rows fare alike. Where no
    labelled row of both classes is among docs, nothing can be judged and all stay."""
    p, (score,) = toxicity.ToxicityParams(), spare(docs, "score")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2), "toxic", p)
    if not model.fitted:
        return docs
    return toxicity.score(docs, model, p, score).where(F.col(score) < p.threshold).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose quality reaches the threshold.

    Null and empty texts are judged by the bias, that is by the share of good rows. Repeated
    rows fare alike. Where no labelled row of both classes is among docs all stay."""
    p, (score,) = quality.QualityParams(), spare(docs, "score")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0), "quality", p)
    if not model.fitted:
        return docs
    return quality.score(docs, model, p, score).where(F.col(score) >= p.threshold).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: SimHash of five-word shingles within three bits, then, among
    those left, exact Jaccard similarity of five-word shingle sets of 0.8 or more, which
    fingerprints that differ in more bits miss.

    The smallest (id, text hash) of a group stays, null ids last; rows with the same id and
    text are one document; null, empty and wordless texts are one group."""
    distinct = materialize(simhash.keep_one(docs, width=5), "pipeline-distinct")
    return shingles.keep_one(distinct, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold an item of ``benchmark`` within its error budget.

    Null and empty texts hold none and stay; without items all stay."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences (see ``packing.pack``); a null text is the end id alone, every row is packed."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Trained classifiers and tokenizers are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that packing returns, of what all filters kept of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = kept
    return docs
