"""Source divergence audit: how far every source of a language lies from every other one.

A group is a (lang, source) pair, V the number of a language's kept terms, N a group's
occurrences of them. A term's smoothed weight in a group depends on its count there alone,
p(c) = 1 + floor(SCALE * (c + 1) / (N + V)), and the divergence of g from q sums
f(p, q) = floor((p - q)^2 / q) over all kept terms, those without a count included. Most counts
are zero, so the sum is taken by inclusion and exclusion over the supports:

- all V terms as if both counts were zero: V f(p(0), q(0)), a constant a pair;
- a histogram of each group's counts prices its own terms against a zero on the other
  side, f(p(c), q(0)) - f(p(0), q(0)), and likewise with the sides exchanged;
- terms of both supports meet in a join of the sparse postings and correct the two one-sided
  prices: f(p(c), q(c')) - f(p(c), q(0)) - f(p(0), q(c')) + f(p(0), q(0)).

Terms are counted per task and group before anything is shuffled, so a frequent term or a
large source is a few rows a task. Joins on a language alone deal the larger side by a salt
and repeat the groups, which are few, per salt. Integers throughout; a sum that left
64 bits would raise an error.

Defined cases: null text, lang and source count as empty strings; a language without kept terms
has pairs of value 0 and no term rows; a source alone in its language has no pairs; groups
without terms are listed; repeated rows and ids count as so many documents; very long texts
count whole; an empty table gives no rows; columns other than those named are ignored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, require

SCALE = 1_000_000_000
#: Entries a task counts before it sends them on.
HELD = 400_000
SALTS = 32
_LETTER = [65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
#: ASCII capitals to small letters, every other letter or byte of a non-ASCII character to itself, the rest to blanks.
_FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if _LETTER[b] else 32 for b in range(256))
_COUNTS = "lang string, source string, term binary, n long, docs long"


def terms(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and non-ASCII characters, ASCII capitals folded."""
    return raw.translate(_FOLD).split()


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    for (lang, source), (n, docs) in held.items():
        found = list(n)
        for at in range(0, len(found), 50_000):
            some = found[at : at + 50_000]
            columns = [[lang] * len(some), [source] * len(some), some, [n[t] for t in some], [docs[t] for t in some]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            found = terms(text)
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size >= HELD:
                yield from _rows(held)
                held, size = {}, 0
    yield from _rows(held)


def postings(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in at least min_docs documents of their
    language: occurrences in the source and in the language; first marks one row a term. docs
    has lang and source without nulls."""
    counts = docs.select("lang", "source", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_count, _COUNTS)
    counts = counts.withColumn("term", F.col("term").cast("string"))
    sums = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    found = sums.select("*", F.sum("docs").over(w).alias("df"), F.sum("n").over(w).alias("lang_n"), F.min("source").over(w).alias("least"))
    return found.where(F.col("df") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("least") == F.col("source")).alias("first"))


def weight(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 1) / total), in decimals where the product leaves 64 bits."""
    wide = f"CAST((CAST({n} + 1 AS DECIMAL(19, 0)) * {SCALE}BD) div CAST({total} AS DECIMAL(19, 0)) AS BIGINT)"
    return F.expr(f"1 + CASE WHEN {n} < 9000000000 THEN (({n} + 1) * {SCALE}L) div {total} ELSE {wide} END")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _both(a: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of a with every other group of their language (columns other, other_p0): a dealt by a salt, the groups repeated per salt."""
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keys = [c for c in ("source", "p") if c in a.columns]
    return a.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(others, ["lang", "salt"]).where("source <> other")


def pairs(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language; posted has p and p0 beside the postings."""
    base = _both(groups, groups).selectExpr("lang", "source", "other AS item", f"CASE WHEN V = 0 THEN 0L ELSE V * {_f('p0', 'other_p0')} END AS v")
    histogram = posted.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    one = _both(histogram, groups).groupBy("lang", "source", "other").agg(
        F.expr(f"sum(m * ({_f('p', 'other_p0')} - {_f('p0', 'other_p0')}))").alias("own"),
        F.expr(f"sum(m * ({_f('other_p0', 'p')} - {_f('other_p0', 'p0')}))").alias("theirs"),
    )
    a = posted.select("lang", "term", "source", "p", "p0")
    b = posted.selectExpr("lang", "term", "source AS other", "p AS r", "p0 AS r0")
    shared = a.join(b, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(
        F.expr(f"sum({_f('p', 'r')} - {_f('p', 'r0')} - {_f('p0', 'r')} + {_f('p0', 'r0')})").alias("own"),
        F.expr(f"sum({_f('r', 'p')} - {_f('r', 'p0')} - {_f('r0', 'p')} + {_f('r0', 'p0')})").alias("theirs"),
    )
    two_ways = "inline(array(struct(source AS source, other AS item, own AS v), struct(other AS source, source AS item, theirs AS v)))"
    corrections = one.unionByName(shared).selectExpr("lang", two_ways)
    return base.unionByName(corrections).groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))


def _ranked(rows: DataFrame, part: str, most: int | None) -> DataFrame:
    """Ranks inside a group; with a limit Spark keeps that many rows a group before the shuffle."""
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    return out.where(F.col("rank") <= most) if most else out


def audit(docs: DataFrame, min_docs: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group: part ``pair`` has its divergence from
    each other source of the language, part ``term`` the terms that it uses more than its language does,
    by their share of the divergence from the language, up to ``ranks``."""
    require(docs, "text", "lang", "source")
    docs = docs.select("text", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    kept = materialize(postings(docs, min_docs), "divergence-postings")
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("V"), F.sum("n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("N"))
    found = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    found = found.selectExpr("lang", "source", "coalesce(V, 0L) AS V", "coalesce(N, 0L) + coalesce(V, 0L) AS total", "coalesce(lang_total, 0L) + coalesce(V, 0L) AS lang_total")
    groups = materialize(found.withColumn("p0", F.when(F.col("V") > 0, weight("0L", "total"))), "divergence-groups")
    posted = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "p0", weight("n", "total").alias("p"), weight("lang_n", "lang_total").alias("q"))
    listed = posted.where("p > q").selectExpr("lang", "source", "term AS item", f"{_f('p', 'q')} AS value")
    out = materialize(_ranked(pairs(posted, groups), "pair", None).unionByName(_ranked(listed, "term", ranks)), "divergence")
    release(kept)
    release(groups)
    return out
