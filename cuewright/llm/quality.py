"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products.

Each word is seen twice: by its surface hash (uni- and bigrams) and by its shape
(letter case, digits, signs, whether it repeats one of the two tokens before it;
uni-, bi- and trigrams). All n-grams share one hashed weight vector of 2**bits
entries. A text is the mean of its n-grams' one-hot vectors times ``scale``, so its
length does not matter.

Training writes a bounded sample of labelled rows (``max_rows``) once and reads that. Its
shards, by a hash of the id, stream their rows in the order of id and text through FTRL in
parallel, and the accumulators are averaged in the shards' order after every round, so that
runs agree. Only the vectors of 2**bits numbers per shard reach the driver.

Defined cases: null and empty texts have no n-grams and score by the bias alone; very long
texts count whole; ids repeated in ``labels`` count once with the larger label; null ids are
scored, never learnt from; repeated rows score alike; without labelled rows of both classes
every score is the smoothed share of label 1, (ones + 1) / (rows + 2), so 0.5 without any;
an empty table gives no rows; columns of ``docs`` named like an output are replaced."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import held_out, label_sample, materialize, release, require


@dataclass(frozen=True)
class QualityParams:
    bits: int = 18
    max_rows: int = 16_384  # bound of the training sample
    shards: int = 6
    rounds: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    scale: float = 6.0
    threshold: float = 0.3


@dataclass
class QualityModel:
    """Fixed-size state: 2**bits weights and the bias, whatever the corpus."""

    weights: np.ndarray
    fitted: bool = True


def _features(h: np.ndarray, flags: np.ndarray, cap: np.ndarray, doc: np.ndarray, bits: int) -> list[np.ndarray]:
    """Hashed n-gram buckets, one array per kind, all as long as the token stream."""
    p1, p2 = H.previous(doc, h, 1, 0), H.previous(doc, h, 2, 0)
    repeats = (h == p1).astype(np.uint64) + 2 * (h == p2).astype(np.uint64)
    shape = flags.astype(np.uint64) | (cap.astype(np.uint64) << np.uint64(5)) | (repeats << np.uint64(6))
    sign = (flags & (H.SIGN | H.LOWER | H.UPPER | H.DIGIT | H.HIGH)) == H.SIGN
    shape = H.mix(np.where(sign, h, shape + np.uint64(1)))
    s1, s2 = H.previous(doc, shape, 1, 7), H.previous(doc, shape, 2, 7)
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
    kinds = (h, H.mix(h * a + p1), H.mix(shape * b), H.mix(shape * c + s1), H.mix((shape * a + s1) * b + s2))
    return [(k >> np.uint64(64 - bits)).astype(np.int64) for k in kinds]


def _weights(z: np.ndarray, n: np.ndarray, p: QualityParams) -> np.ndarray:
    w = (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    return np.where(np.abs(z) <= p.l1, 0.0, w)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _train_shard(texts: list[str], labels: np.ndarray, z: np.ndarray, n: np.ndarray, p: QualityParams) -> None:
    """One pass of FTRL over these rows, in place. The last entry of z and n is the bias."""
    dims = 1 << p.bits
    for first, count, doc, h, flags, cap, _ in H.batches(texts, fold=False):
        kinds = _features(h, flags, cap, doc, p.bits)
        cuts = np.searchsorted(doc, np.arange(count + 1))
        for i in range(count):
            s, e = cuts[i], cuts[i + 1]
            ids, seen = np.unique(np.concatenate([k[s:e] for k in kinds]), return_counts=True)
            x = np.append(seen * (p.scale / max(1, e - s)), 1.0)
            ids = np.append(ids, dims)
            zi, ni = z[ids], n[ids]
            w = _weights(zi, ni, p)
            g = (_sigmoid(w @ x) - labels[first + i]) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[ids] = zi + g - sigma * w
            n[ids] = ni + g * g


def _one_pass(state, p: QualityParams):
    """One shard's rows -> its accumulators after a pass over them that starts from ``state``."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.astype(np.float64) for x in state.value)
        f = f.assign(text=f["text"].fillna("")).sort_values(["doc_id", "text"])
        _train_shard(f["text"].tolist(), f["label"].to_numpy(), z, n, p)
        return pd.DataFrame({"shard": f["shard"].iloc[:1], "rows": [len(f)], "z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})

    return one


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", params: QualityParams = QualityParams()) -> QualityModel:
    """The model learnt from rows of ``docs`` whose id is labelled and satisfies ``keep``."""
    p = params
    require(docs, "doc_id", "text")
    spark, dims = docs.sparkSession, 1 << p.bits
    sample = label_sample(labels, label, keep, p.max_rows)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(p.shards)).cast("int").alias("shard")
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(shard, "doc_id", "text", "label"), "quality-sample")  # at most about max_rows rows
    count, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, count):
        bias = np.log((ones + 1) / (count - ones + 1))
        release(rows)
        return QualityModel(np.append(np.zeros(dims), bias).astype(np.float32), False)
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)
    for _ in range(p.rounds):
        state = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

        got = sorted(rows.groupBy("shard").applyInPandas(_one_pass(state, p), "shard int, rows long, z binary, n binary").collect(), key=lambda r: r["shard"])  # one row per shard
        state.unpersist()
        share = np.array([r["rows"] for r in got], float)
        share /= share.sum()
        z = sum(s * np.frombuffer(r["z"], np.float32) for s, r in zip(share, got, strict=True)).astype(np.float64)
        n = sum(s * np.frombuffer(r["n"], np.float32) for s, r in zip(share, got, strict=True)).astype(np.float64)
    release(rows)
    return QualityModel(_weights(z, n, p).astype(np.float32))


def score_texts(texts: list[str | None], w: np.ndarray, p: QualityParams) -> np.ndarray:
    out = np.empty(len(texts))
    for first, count, doc, h, flags, cap, _ in H.batches(texts, fold=False):
        per_token = np.zeros(len(h), np.float64)
        for k in _features(h, flags, cap, doc, p.bits):
            per_token += w[k]
        total = np.bincount(doc, weights=per_token, minlength=count)[:count]
        tokens = np.maximum(np.bincount(doc, minlength=count)[:count], 1)
        out[first : first + count] = _sigmoid(total * p.scale / tokens + w[-1])
    return out


def score(docs: DataFrame, model: QualityModel, params: QualityParams = QualityParams(), out: str = "score") -> DataFrame:
    """docs with the probability of label 1 in ``out``; weights are 2**bits numbers, so the broadcast is bounded."""
    held = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), held.value, params))

    return docs.withColumn(out, scored("text"))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, params: QualityParams = QualityParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; learns from the other folds only."""
    fold = held_out("doc_id", modulus, remainder)
    model = train(docs, labels, ~fold, "quality", params)
    return score(docs.select("doc_id", "text"), model, params).select(
        "doc_id", fold, "score", (F.col("score") >= params.threshold).cast("int").alias("predicted")
    )
