"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are sequences of words: lower-cased letter and digit runs, and each
character of a script written without spaces (Chinese, Japanese, Thai, Lao, Khmer,
Burmese); signs of any script separate. An item of n words may be hit with k = floor(error_rate * n) word edits. It is cut into
k + 1 pieces, so one piece at least stands unedited in any hit: documents are scanned
for the pieces' hashes (rolling n-gram hashes against a bit table, then exactly), and
around each piece hit Myers' bit-parallel algorithm finds the least edit distance of
the whole item to any stretch of words.

Items are read and sent to the tasks in blocks of bounded bytes, one after the other; each
block scans the documents once and writes what it found, so a larger benchmark costs passes,
not memory. Documents are never shuffled. A match starts where Myers' algorithm, run backwards
from its end, finds the same distance.

Defined cases: null, empty and wordless documents and items match nothing; items of
under ``min_words`` words match unedited only, as a whole word sequence; rows that repeat an item's id and
text are one item, items of one text and other ids each match; null ids are carried."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import materialize, release, require


@dataclass(frozen=True)
class MatchParams:
    error_rate: float = 0.2
    min_words: int = 5
    block_bytes: int = 4 << 20  # of item text sent to the tasks at once


_STEP = 0x9E3779B97F4A7C15
_MATCH = "array<struct<item_id:long,distance:int,start_word:long,end_word:long,n_words:int>>"


def words_of(texts: list[str | None]):
    """(first text, count, text of each word, word hash): letters fold by str.lower, signs are skipped."""
    lowered = [t.lower() if t else t for t in texts]
    for first, count, doc, h, flags, *_ in H.batches(lowered, fold=True):
        word = flags != H.SIGN
        yield first, count, doc[word], h[word]


#: Texts of these characters alone need no look at each: ASCII and Latin letters.
_LATIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]*")
_UNSPACED = [
    (0x0E01, 0x0E4E), (0x0E81, 0x0ECE), (0x1000, 0x103F), (0x1050, 0x109F), (0x1780, 0x17D3), (0x1950, 0x19DF), (0x1A20, 0x1A7F),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303C), (0x3041, 0x3096), (0x3099, 0x309A), (0x309D, 0x309F),
    (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x3105, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA9E0, 0xA9FE), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x16FFF), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFD),
]


class _Apart(dict):
    """What stands for a character: a sign gives a space, a character of an unspaced script stands alone."""

    def __missing__(self, code: int) -> str:
        c = out = chr(code)
        if code > 127:
            kind = unicodedata.category(c)
            if any(lo <= code <= hi for lo, hi in _UNSPACED) and not kind.startswith(("P", "Sc", "N", "Z")) or code in (0x3007, *range(0x3021, 0x302A)):
                out = f" {c} "
            elif kind[0] in "PSZ" or kind == "Cc" or code == 0x200B:
                out = " "
        self[code] = out
        return out


_APART = _Apart()


def passage_words(texts: list[str | None]):
    """As words_of, with unspaced scripts in characters and no signs of any script in words."""
    return words_of([t if not t or _LATIN.fullmatch(t) else t.lower().translate(_APART) for t in texts])


def myers(pattern: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """(least distance of ``pattern`` to any stretch of ``text``, where the first such stretch ends), Myers 1999.

    anchored: to any stretch from the start of ``text`` on."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text.tolist(), 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1 | anchored) & full, mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Index:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], p: MatchParams):
        self.ids, self.words, self.budget = [], [], []
        length, key, item, offset = [], [], [], []
        texts = [t for _, t in items]
        for first, count, doc, h in passage_words(texts):
            cuts = np.searchsorted(doc, np.arange(count + 1))
            for i in range(count):
                w = h[cuts[i] : cuts[i + 1]]
                n = len(w)
                if not n:
                    continue
                k = int(p.error_rate * n) if n >= p.min_words else 0
                bounds = [n * j // (k + 1) for j in range(k + 2)]
                for s, e in zip(bounds, bounds[1:], strict=False):
                    length.append(e - s)
                    key.append(int(_gram(w[s:e])))
                    item.append(len(self.ids))
                    offset.append(s)
                self.ids.append(items[first + i][0])
                self.words.append(w)
                self.budget.append(k)
        order = np.lexsort((np.array(key, np.uint64), np.array(length, np.int64))) if key else np.zeros(0, np.int64)
        self.length, self.key = np.array(length, np.int64)[order], np.array(key, np.uint64)[order]
        self.item, self.offset = np.array(item, np.int64)[order], np.array(offset, np.int64)[order]
        self.lengths = np.unique(self.length).tolist()
        self.bits = {}
        for n in self.lengths:
            table = np.zeros(1 << 18, bool)
            table[(self.key[self.length == n] >> np.uint64(46)).astype(np.int64)] = True
            self.bits[n] = table

    def matches(self, w: np.ndarray) -> list[dict]:
        """One match, the nearest and first, for each item within its budget of the words w of one text."""
        spans: dict[int, list[int]] = {}
        for n, grams in _grams(w, self.lengths):
            likely = np.flatnonzero(self.bits[n][(grams >> np.uint64(46)).astype(np.int64)])
            if not len(likely):
                continue
            own = slice(*np.searchsorted(self.length, [n, n + 1]).tolist())
            keys = self.key[own]
            lo, hi = np.searchsorted(keys, grams[likely], side="left"), np.searchsorted(keys, grams[likely], side="right")
            for at, a, b in zip(likely[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for x in range(own.start + a, own.start + b):
                    spans.setdefault(int(self.item[x]), []).append(at - int(self.offset[x]))
        out = []
        for i, starts in sorted(spans.items()):
            n, k = len(self.words[i]), self.budget[i]
            best, end = n + 1, 0
            starts.sort()
            if k == 0:  # one piece: the whole item
                at = next((x for x in starts if np.array_equal(w[x : x + n], self.words[i])), None)
                if at is not None:
                    out.append({"item_id": self.ids[i], "distance": 0, "start_word": at, "end_word": at + n, "n_words": n})
                continue
            a = 0
            while a < len(starts):  # neighbouring hits share one window
                b = a
                while b + 1 < len(starts) and starts[b + 1] - starts[b] <= n + 2 * k:
                    b += 1
                lo, hi = max(0, starts[a] - k), min(len(w), starts[b] + n + k)
                d, at = myers(self.words[i], w[lo:hi])
                if d < best:
                    best, end = d, lo + at
                a = b + 1
            if best <= k:
                _, back = myers(self.words[i][::-1], w[max(0, end - n - k) : end][::-1], anchored=True)
                out.append({"item_id": self.ids[i], "distance": best, "start_word": end - back, "end_word": end, "n_words": n})
        return out


def _gram(w: np.ndarray) -> np.uint64:
    return next(_grams(w, [len(w)]))[1][0]


def _grams(w: np.ndarray, lengths: list[int]):
    """(n, hashes of all n-grams of w) for each of the ascending lengths."""
    acc, power, n = np.zeros(len(w), np.uint64), _STEP, 0
    for target in lengths:
        if target > len(w):
            return
        while n < target:
            acc = acc[: len(w) - n] + w[n:] * np.uint64(power)
            power = (power * _STEP & (1 << 64) - 1) | 1
            n += 1
        yield target, H.mix(acc)


def _blocks(benchmark: DataFrame, p: MatchParams) -> Iterator[list[tuple]]:
    """Items in lists of about block_bytes of text, one at a time; rows that repeat an item are one."""
    require(benchmark, "item_id", "text")
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // p.block_bytes)
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(key == i).collect()]  # one bounded block


def _matcher(docs: DataFrame, block: list[tuple], p: MatchParams):
    held = docs.sparkSession.sparkContext.broadcast(block)  # at most about block_bytes
    built: list[Index] = []

    @F.pandas_udf(_MATCH)
    def found(texts: pd.Series) -> pd.Series:
        if not built:
            built.append(Index(held.value, p))
        index = built[0]
        out: list = [[] for _ in range(len(texts))]
        for first, count, doc, h in passage_words(texts.tolist()):
            cuts = np.searchsorted(doc, np.arange(count + 1))
            for i in range(count):
                out[first + i] = index.matches(h[cuts[i] : cuts[i + 1]])
        return pd.Series(out)

    return found, held


def contaminated(docs: DataFrame, benchmark: DataFrame, params: MatchParams = MatchParams()) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word, n_words): the nearest match of every item in every document that holds one.

    Repeated rows of docs match each; very long texts are searched whole; an empty table of
    documents or items gives no rows; other columns are ignored."""
    require(docs, "doc_id", "text")
    base = docs.select(F.col("doc_id").cast("long"), "text")
    parts = [base.limit(0).select("doc_id", F.inline(F.lit(None).cast(_MATCH)))]
    for block in _blocks(benchmark, params):
        found, held = _matcher(docs, block, params)
        parts.append(materialize(base.select("doc_id", F.inline(found("text"))), "decontamination-found"))
        held.unpersist()
    return reduce(DataFrame.union, parts[1:] or parts)


def clean(docs: DataFrame, benchmark: DataFrame, params: MatchParams = MatchParams()) -> DataFrame:
    """docs without those that hold a benchmark item; all columns are kept."""
    require(docs, "doc_id", "text")
    own = None  # what the block before left
    for block in _blocks(benchmark, params):
        found, held = _matcher(docs, block, params)
        kept = materialize(docs.where(F.size(found("text")) == 0), "decontamination-clean")
        held.unpersist()
        if own is not None:
            release(own)
        docs = own = kept
    return docs
