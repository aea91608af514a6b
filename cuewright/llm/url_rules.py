"""URL filtering by a list of rules and by mined association rules; DataFrame operations only.

Listed rules name a host (with all its subdomains) and a path prefix; the longest that
fits decides. Other URLs are judged by association rules: every labelled URL is a set of
tokens (host labels, registered name, path words, query keys) and its class, Spark's
FP-growth mines frequent sets, and rules from tokens to the class ``bad`` are kept by
support, confidence, lift and significance: the chance that a set without influence has so large a
share of bad URLs, times the number of sets tried, is at most ``error``, so noise is dropped
and small true rules live at every size. Of tokens that occur in the same labelled URLs only one is
mined, so sets of them are not multiplied; of rules only the shortest are kept, as a rule
whose tokens hold another's fires nowhere else. Rules match by an inverted index from
token to rule: a rule fires when all its tokens are met. What is shuffled goes by the
number of the row, so no token, host or URL makes a hot key.

Defined cases: null URLs and URLs without ``://`` have an empty host and path, no
tokens, and are allowed unless a listed rule with an empty host fits; empty and very long
URLs are taken whole; repeated rows are judged alike, as are null page ids; an empty table
gives no rows; other columns are ignored; without labels, or when no rule passes the bars,
the verdict is allow."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, require

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "class=bad"


@dataclass(frozen=True)
class MiningParams:
    support: float = 0.002  # of the labelled URLs, for tokens and class together
    confidence: float = 0.5
    lift: float = 1.2
    error: float = 0.05  # chance that any rule of a table without true ones is kept
    index_rows: int = 200_000  # entries of the index that are broadcast at once


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str  # host, then the path prefix from its first slash on

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)


def with_listed_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages (with host and path) and the longest fitting rule's text and verdict (else null)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        host = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        fits = host & F.startswith(F.col("path"), F.lit(r.path))
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pages.withColumns({"rule": text, "listed": verdict})


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The sorted set of a URL's tokens; numbers count as one word."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    named = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    words = F.filter(F.split(path, r"[/._-]+"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    parts = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.when(F.size(labels) > 0, F.array(F.concat(F.lit("name="), named))).otherwise(F.array().cast("array<string>")),
        F.transform(words, lambda x: F.concat(F.lit("path="), F.regexp_replace(F.lower(x), r"^\d+$", "#"))),
        F.coalesce(F.transform(query, lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1))), F.array().cast("array<string>")),
    )
    return F.array_sort(F.array_distinct(parts))


def _one_of_each(marked: DataFrame) -> DataFrame:
    """(token): of tokens that occur in the same rows the first, by two sums of hashes over their rows."""
    each = marked.select("row", F.explode("tokens").alias("token"))
    same = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "row").cast("decimal(38,0)")).alias("b"))
    return same.groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token")


def mine(pages: DataFrame, labels: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """(rule_id, antecedent, confidence, lift, support, p) of rules from tokens to the bad class, of pages (row, page_id, tokens).

    A page's label is that of its page_id in ``labels``: bad when quality is 0 or toxic is 1."""
    none = pages.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, lift double, support double, p double")
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
        .where("bad is not null")
    )
    marked = pages.select(F.col("page_id").alias("doc_id"), "row", "tokens").join(known, "doc_id").where(F.size("tokens") > 0)
    marked = materialize(marked.select("row", "tokens", "bad"), "url-marked")
    n, bad = marked.agg(F.count("*"), F.sum("bad")).first()
    if not n or bad in (0, n):  # nothing to mine, or nothing to tell apart
        release(marked)
        return none
    base = bad / n
    single = _one_of_each(marked)
    # sets of fewer bad URLs, and no others, could not pass even if only single tokens were tried
    least = max(2, math.ceil(math.log(params.error / max(single.count(), 1)) / math.log(base)))
    kept = marked.select("row", "bad", F.explode("tokens").alias("token")).join(single, "token")
    items = F.array_sort(F.collect_list("token"))  # of one URL
    baskets = kept.groupBy("row", "bad").agg(items.alias("items"))
    baskets = materialize(baskets.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(params.support, least / n)), minConfidence=params.confidence).fit(baskets)
    tried = model.freqItemsets.where(~F.array_contains("items", BAD)).count()
    rules = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= params.lift))
    rules = rules.withColumn("ln_p", ln_tail(F.col("confidence"), F.col("support") * n / F.col("confidence"), base) + math.log(max(tried, 1)))
    rules = rules.where(F.col("ln_p") <= math.log(params.error))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support", F.exp("ln_p").alias("p")).withColumn("rule_id", F.monotonically_increasing_id())
    rules = materialize(rules.select("rule_id", "antecedent", "confidence", "lift", "support", "p"), "url-rules")
    out = shortest(rules)
    for df in (marked, baskets, rules):
        release(df)
    return out


def ln_tail(share: Column, n: Column, base: float) -> Column:
    """ln of Chernoff's bound on the chance that n draws of chance ``base`` have a share of bad ones as large: -n KL(share, base)."""
    clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(F.lit(0.0))
    return F.when(share > base, -n * (share * F.log(share / base) + clean)).otherwise(F.lit(0.0))


def shortest(rules: DataFrame) -> DataFrame:
    """rules without those whose tokens hold all of another rule's: the other fires wherever they do."""
    index = rules.select(F.col("rule_id").alias("other"), F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    met = rules.select("rule_id", F.size("antecedent").alias("size"), F.explode("antecedent").alias("token")).join(index, "token").where("need < size")
    longer = met.groupBy("rule_id", "other", "need").agg(F.count("*").alias("have")).where("have = need").select("rule_id").distinct()
    return materialize(rules.join(longer, "rule_id", "left_anti"), "url-shortest")


def fired(rows: DataFrame, rules: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """(row) of rows (row, tokens) for which some rule has all its tokens, by an inverted index from token to rule.

    The index is broadcast in parts of about ``index_rows`` entries; only pairs of a row and a token that a rule has are shuffled."""
    size = rules.agg(F.sum(F.size("antecedent"))).first()[0] or 0
    parts = max(1, -(-size // params.index_rows))
    each = rows.select("row", F.explode("tokens").alias("token"))
    met = []
    for i in range(parts):
        own = rules.where(F.pmod(F.xxhash64("rule_id"), F.lit(parts)) == i)
        index = own.select("rule_id", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
        met.append(each.join(F.broadcast(index), "token"))
    whole = reduce(DataFrame.union, met).groupBy("row", "rule_id", "need").agg(F.count("*").alias("have")).where("have = need")
    return whole.select("row").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], params: MiningParams = MiningParams()) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages."""
    require(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    rows = with_listed_rule(pages.select("page_id", "url").withColumns({"host": host, "path": path}), rules)
    rows = rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "url-pages")
    hits = fired(rows.where("rule is null"), mine(rows, labels, params), params).withColumn("fires", F.lit(True))
    mined = F.when(F.col("fires"), "block").otherwise("allow")
    return rows.join(hits, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"))
