"""Toxicity: maximum-scoring passages over token log-odds.

1. Token counts of toxic and other labelled texts give every token a log-odds with a
   Dirichlet prior; the prior of a word is centred on the counts of its leading bytes,
   and that of those on the base rate, so rare words shrink towards what is known of
   their stem. Counts live in 2**bits hashed buckets.
2. A constant is subtracted, so that ordinary text drifts downward, and the
   linear-time scan of Ruzzo and Tompa yields all maximal-scoring segments of a text.
3. Scores of chance segments follow an extreme-value law: lambda solves
   sum(p e^(lambda s)) = 1 over the token scores of non-toxic labelled texts and K is
   read from their number of segments. A segment is significant when its expected
   number by chance, K n exp(-lambda S), is under ``max_expected``.
4. A text's evidence is the sum of the significant segments' log-significance; a
   logistic curve fitted to the labelled sample maps evidence to the score.

The log-odds come from a bounded sample of labelled rows (``max_rows``), written once and
read by every pass of the training; every whole text is scored. Defined cases: null and
empty texts have no segments and get the score of zero evidence; very long texts count whole;
ids repeated in ``labels`` count once with the larger label; null ids are scored, never learnt
from; repeated rows score alike; without labelled rows of both classes every score is the
smoothed share of label 1, (ones + 1) / (rows + 2), so 0.5 without any; an empty table gives
no rows; columns of ``docs`` named like an output are replaced."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import held_out, label_sample, materialize, release, require


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 19
    max_rows: int = 32_768  # bound of the labelled sample
    stem_bytes: int = 5
    prior: float = 6.0  # pseudo-count of a word around its stem, and of a stem around the base rate
    drift: float = 1.0
    max_expected: float = 0.05
    cap: float = 8.0
    threshold: float = 0.3


@dataclass
class ToxicityModel:
    """Fixed-size state: 2**bits numbers a table, whatever the corpus."""

    word: np.ndarray  # score by word bucket; nan where never counted
    stem: np.ndarray  # score by stem bucket, for those words
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = 0.0
    fitted: bool = True


def _words(texts: list[str | None], p: ToxicityParams):
    """(first text, count, text of token, word bucket, stem bucket) of word tokens, ASCII case folded."""
    shift = np.uint64(64 - p.bits)
    for first, count, doc, h, flags, _, stems in H.batches(texts, fold=True, stem=p.stem_bytes):
        word = flags != H.SIGN
        yield first, count, doc[word], (h[word] >> shift).astype(np.int64), (stems[word] >> shift).astype(np.int64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), end exclusive, in linear time.

    Neighbours of one sign are joined first: a maximal segment never cuts such a run. Links to the
    nearest candidate that begins lower skip those that cannot absorb a run, so every link is
    followed once between two changes of the list, whichever way the sums drift."""
    if not len(scores) or scores.max() <= 0:
        return []
    up = scores > 0
    edge = np.flatnonzero(np.diff(up)) + 1
    starts = np.concatenate([[0], edge])
    sums = np.add.reduceat(scores, starts)
    ends = np.append(edge, len(scores))
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after; the candidates of the scan
    lower: list[int] = []  # of each candidate the nearest earlier one with a smaller sum before, or -1
    total = 0.0
    for s, e, x in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        before, total = total, total + x
        if x <= 0:
            continue
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = lower[j]
            if j < 0 or found[j][3] >= total:
                break
            s, before, up_to = found[j][0], found[j][2], lower[j]
            del found[j:], lower[j:]
            j = up_to
        found.append((s, e, before, total))
        lower.append(j)
    return [(int(s), int(e), b - a) for s, e, a, b in found]


def _chance(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root lambda of sum(p exp(lambda s)) = 1; needs a negative mean and some positive score."""
    p = weights / max(1.0, weights.sum())
    if not (p @ scores < 0 and scores[p > 0].max(initial=-1.0) > 0):
        return 1.0
    lo, hi = 1e-3, 1.0
    while p @ np.exp(np.minimum(hi * scores, 500.0)) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p @ np.exp(np.minimum(mid * scores, 500.0)) < 1 else (lo, mid)
    return max(lo, 1e-3)


def passages(texts: list[str | None], m: ToxicityModel, p: ToxicityParams) -> Iterator[tuple[int, list[tuple[int, int, float, float]]]]:
    """(text, [(first word, end word, score, expected number by chance)]) of texts with a significant passage."""
    for first, count, doc, word, stem in _words(texts, p):
        s = m.word[word]
        s = np.where(np.isnan(s), m.stem[stem], s)
        cuts = np.searchsorted(doc, np.arange(count + 1))
        for i in np.unique(doc[s > 0]).tolist():
            a, b = cuts[i], cuts[i + 1]
            found = [
                (start, end, x, expected)
                for start, end, x in segments(s[a:b].astype(np.float64))
                if (expected := m.k * (b - a) * np.exp(-m.lam * x)) <= p.max_expected
            ]
            if found:
                yield first + i, found


def evidence(texts: list[str | None], m: ToxicityModel, p: ToxicityParams) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, found in passages(texts, m, p):
        out[i] = np.log1p(sum(-np.log(max(e, 1e-300)) for *_, e in found))
    return out


def _score(e: np.ndarray, m: ToxicityModel) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m.slope * e + m.bias, -35.0, 35.0)))


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    p = params
    require(docs, "doc_id", "text")
    sc, size = docs.sparkSession.sparkContext, 1 << p.bits
    sample = F.broadcast(label_sample(labels, label, keep, p.max_rows))  # at most about max_rows rows
    rows = materialize(docs.select("doc_id", "text").join(sample, "doc_id").select("text", "label"), "toxicity-sample")
    count, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, count):
        release(rows)
        empty = np.zeros(size, np.float32)
        return ToxicityModel(empty, empty, bias=float(np.log((ones + 1) / (count - ones + 1))), fitted=False)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = np.zeros((4, size), np.int32)  # word and stem, by label
        for f in frames:
            y = f["label"].to_numpy()
            for first, _, doc, word, stem in _words(f["text"].tolist(), p):
                toxic = y[first + doc] > 0
                for row, ids in ((0, word[~toxic]), (1, word[toxic]), (2, stem[~toxic]), (3, stem[toxic])):
                    tables[row] += np.bincount(ids, minlength=size).astype(np.int32)
        kind, bucket = np.nonzero(tables)
        if len(kind):
            yield pd.DataFrame({"kind": kind, "bucket": bucket, "n": tables[kind, bucket].astype(np.int64)})

    sums = rows.mapInPandas(counted, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    t = np.zeros((4, size))
    got = sums.toArrow()  # at most 4 * 2**bits rows of counts
    t[got["kind"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    clean, toxic = t[0].sum(), t[1].sum()
    if not clean or not toxic:  # wordless texts on one side
        clean, toxic = clean + 1, toxic + 1
    base = toxic / (clean + toxic)
    odds = np.log(base / (1 - base))
    stem_share = (t[3] + p.prior * base) / (t[2] + t[3] + p.prior)
    stem = np.log(stem_share / (1 - stem_share)) - odds - p.drift
    # the words' prior is their stem's share; buckets of words and stems differ, so the pairs come with the texts
    pairs = (
        rows.mapInPandas(lambda frames: _pairs(frames, p), "word int, stem int").groupBy("word").agg(F.max("stem").alias("stem")).toArrow()
    )  # at most 2**bits rows
    of = np.full(size, -1, np.int64)
    of[pairs["word"].to_numpy()] = pairs["stem"].to_numpy()
    prior = np.where(of >= 0, stem_share[of], base)
    share = (t[1] + p.prior * prior) / (t[0] + t[1] + p.prior)
    word = np.log(share / (1 - share)) - odds - p.drift
    word[(t[0] + t[1]) == 0] = np.nan
    m = ToxicityModel(np.minimum(word, p.cap).astype(np.float32), np.minimum(stem, p.cap).astype(np.float32))
    m.lam = _chance(np.nan_to_num(m.word.astype(np.float64)), t[0])
    held = sc.broadcast(m)

    def chance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Segments over a low bar in non-toxic texts, and their words: K = segments e^(lambda bar) / words."""
        m, n, words = held.value, 0, 0
        for f in frames:
            for _, count, doc, word, stem in _words(f["text"].tolist(), p):
                s = np.where(np.isnan(m.word[word]), m.stem[stem], m.word[word])
                cuts = np.searchsorted(doc, np.arange(count + 1))
                words += len(doc)
                for i in np.unique(doc[s > 0]).tolist():
                    n += sum(x >= p.drift for *_, x in segments(s[cuts[i] : cuts[i + 1]].astype(np.float64)))
        yield pd.DataFrame({"n": [n], "words": [words]})

    n, words = rows.where("label = 0").mapInPandas(chance, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    m.k = float(max(n or 0, 1) * np.exp(m.lam * p.drift) / max(words or 0, 1))
    held.unpersist()
    held = sc.broadcast(m)

    @F.pandas_udf("double")
    def weighed(texts: pd.Series) -> pd.Series:
        return pd.Series(evidence(texts.tolist(), held.value, p))

    bins = rows.select(F.round(weighed("text"), 1).alias("e"), "label").groupBy("e", "label").count().toPandas()  # tenths of a logarithm
    m.slope, m.bias = _logistic(bins["e"].to_numpy(float), bins["label"].to_numpy(float), bins["count"].to_numpy(float))
    held.unpersist()
    release(rows)
    return m


def _pairs(frames: Iterator[pd.DataFrame], p: ToxicityParams) -> Iterator[pd.DataFrame]:
    of = np.full(1 << p.bits, -1, np.int32)
    for f in frames:
        for _, _, _, word, stem in _words(f["text"].tolist(), p):
            np.maximum.at(of, word, stem.astype(np.int32))
    word = np.flatnonzero(of >= 0)
    if len(word):
        yield pd.DataFrame({"word": word.astype(np.int32), "stem": of[word]})


def _logistic(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Weighted one-feature logistic regression by Newton steps with a little ridge."""
    a = b = 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([(c * (y - q) * x).sum() - 0.1 * a, (c * (y - q)).sum() - 0.1 * b])
        w = c * q * (1 - q)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -4, 4)), b + float(np.clip(step[1], -4, 4))
    return max(a, 0.0), b


def score(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams(), out: str = "score") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2**bits floats

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(_score(evidence(texts.tolist(), held.value, params), held.value))

    return docs.withColumn(out, scored("text"))


def toxic_passages(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, passages: [(first_word, end_word, score, expected)]) of texts that have a significant passage."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<first_word:long,end_word:long,score:double,expected:double>>")
    def found(texts: pd.Series) -> pd.Series:
        out: list = [[] for _ in range(len(texts))]
        for i, spans in passages(texts.tolist(), held.value, params):
            out[i] = [{"first_word": a, "end_word": b, "score": float(x), "expected": float(e)} for a, b, x, e in spans]
        return pd.Series(out)

    return docs.select("doc_id", found("text").alias("passages")).where(F.size("passages") > 0)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; learns from the other folds only."""
    fold = held_out("doc_id", modulus, remainder)
    m = train(docs, labels, ~fold, "toxic", params)
    return score(docs.select("doc_id", "text"), m, params).select(
        "doc_id", fold, "score", (F.col("score") >= params.threshold).cast("int").alias("predicted")
    )
