"""The driver's queries on the training-data operators: thin uses of them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, filter_audit, packing, quality, search, secret_scan, sharding, simhash, token_store, toxicity, url_rules, warc
from .common import new_path

RULES = [
    url_rules.Rule("allow", "org/"),
    url_rules.Rule("block", "example.org/es/"),
    url_rules.Rule("block", "example.org/en/1"),
    url_rules.Rule("allow", "com/fr/"),
    url_rules.Rule("block", "com/de/"),
]
SHARDS = [f"shard-{i:03d}" for i in range(100)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(pages: DataFrame) -> DataFrame:
    """Three capture records of each page: a full response, and revisits after and before it.

    The later revisit carries the response's entity tag (weakly), but another one where page_id is
    divisible by 3, and only the date where page_id leaves 1 by 3. The earlier one has no validator.
    Where page_id leaves 4 by 5 the response has no tag, so a revisit with a tag alone cannot be checked."""
    rest, tag = F.col("page_id") % 3, F.substring(F.md5("html"), 1, 16)
    ts = F.lit(1_700_000_000) + F.col("page_id") * 7919 % 1_000_003
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    nothing = F.lit(None).cast("string")

    def record(k: int, ts, status: int, etag, modified, more: list, digest):
        names = ["etag", "last-modified", "cache-control", *more[::2]]
        values = [etag, modified, F.lit(f"max-age={k}"), *more[1::2]]
        headers = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values)), lambda _, v: v.isNotNull())
        return F.struct((F.col("page_id") * 4 + k).alias("record_id"), ts.alias("ts"), F.lit(status).alias("status"), headers.alias("headers"), digest.alias("digest"))

    full = record(1, ts, 200, F.when(F.col("page_id") % 5 != 4, F.concat(F.lit('"'), tag, F.lit('"'))), day, ["content-type", F.lit("text/html")], F.md5("html"))
    other = F.when(rest == 0, F.lit('"other"')).when(rest == 2, F.concat(F.lit('W/"'), tag, F.lit('"')))
    later = record(2, ts + 600, 304, other, F.when(rest == 1, day), ["content-type", F.lit("text/plain")], nothing)
    early = record(3, ts - 600, 304, nothing, nothing, [], nothing)
    return pages.select("url", F.inline(F.array(full, later, early)))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    h = F.col("headers")
    return out.select(
        "record_id", "canonical", "outcome", "source_id", "digest",
        h["etag"].alias("etag"), h["cache-control"].alias("cache_control"), h["content-type"].alias("content_type"), h["last-modified"].alias("last_modified"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "n_chunks")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.spans(table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_warc_revisits, op2_quality, op3_token_store, op4_decontamination, op5_sharding,
        op6_url_rules, op7_toxicity, op8_simhash, op9_search, op10_packing,
        op11_filter_audit, op12_secret_scan, op13_source_divergence,
    ]
    return {f.__name__: f for f in found}


_CANONICAL = r"""
  bare AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM pages),
  parts AS (SELECT *,
      regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^(www|m)\.', ''), ':(80|443)$', '') AS h,
      regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '(\.html|/)$', '') AS p,
      array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref)(=|$)'))), '&') AS q FROM bare),
  canon AS (SELECT page_id, html, h || p || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM parts)
"""


_AUDIT = r"""
WITH RECURSIVE
  orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(f) WHERE NOT contains(o, f)),
  steps AS (SELECT o, k, substr(o, k, 1) AS f, 1 << strpos('ABCDE', substr(o, k, 1)) AS bit,
      list_sum(list_transform(range(1, k), lambda i: 1 << strpos('ABCDE', substr(o, i, 1)))) AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5),
  d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
  m AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 2 ELSE 0 END
      + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 4 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 8 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 16 ELSE 0 END + CASE WHEN doc_id > least THEN 32 ELSE 0 END AS mask FROM w),
  lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
  c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN lab USING (doc_id) GROUP BY part, mask),
  r AS (SELECT part, o AS filter_order, k::INT AS step, f,
      coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0)::INT | bit) = 0), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT > 0), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0), 0)::BIGINT AS toxic_lost
    FROM c, steps GROUP BY part, o, k, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS ln FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
  grp AS (SELECT DISTINCT lang, source FROM d),
  cnt AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY lang, source, term),
  dense AS (SELECT g.lang, g.source, k.term, k.ln, coalesce(c.n, 0) AS n
    FROM grp g JOIN kept k USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  p AS (SELECT lang, source, term, n,
      (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p FROM dense),
  q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (ln + 1)) // (sum(ln) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::BIGINT AS q FROM kept),
  summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS v
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
  pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.v, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    slots = ",".join(map(str, sharding.fill(SHARDS)))
    return {
        "op11_filter_audit": _AUDIT,
        "op13_source_divergence": _DIVERGENCE,
        "op5_sharding": f"""
WITH t AS (SELECT [{slots}] AS xs), d AS (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {sharding.TABLE})::INT AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad((SELECT xs FROM t)[slot + 1]::VARCHAR, 3, '0') AS shard FROM d
""",
        "op1_warc_revisits": f"""
WITH {_CANONICAL},
  base AS (SELECT page_id, canonical, md5(html) AS d, substr(md5(html), 1, 16) AS tag, page_id % 3 AS r,
      1700000000 + (page_id * 7919) % 1000003 AS ts, page_id % 5 <> 4 AS tagged, 'day ' || (page_id % 28) AS day FROM canon),
  rec AS (
    SELECT page_id * 4 + 1 AS record_id, canonical, ts, 200 AS status, CASE WHEN tagged THEN '"' || tag || '"' END AS etag, CASE WHEN tagged THEN tag END AS bare_tag, day AS lm, 'max-age=1' AS cc, 'text/html' AS ct, d FROM base
    UNION ALL
    SELECT page_id * 4 + 2, canonical, ts + 600, 304, CASE r WHEN 0 THEN '"other"' WHEN 2 THEN 'W/"' || tag || '"' END,
      CASE r WHEN 0 THEN 'other' WHEN 2 THEN tag END, CASE WHEN r = 1 THEN day END, 'max-age=2', 'text/plain', NULL FROM base
    UNION ALL
    SELECT page_id * 4 + 3, canonical, ts - 600, 304, NULL, NULL, NULL, 'max-age=3', NULL, NULL FROM base),
  numbered AS (SELECT *, count(*) FILTER (WHERE status = 200) OVER (PARTITION BY canonical ORDER BY ts, record_id) AS n FROM rec),
  found AS (
    SELECT v.*, s.record_id AS sid, s.d AS sd, s.etag AS setag, s.bare_tag AS sbare, s.lm AS slm, s.ct AS sct
    FROM numbered v LEFT JOIN numbered s ON s.status = 200 AND s.canonical = v.canonical AND s.n = v.n
    WHERE v.status = 304),
  judged AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_earlier_response'
      WHEN bare_tag IS NOT NULL AND sbare IS NOT NULL THEN CASE WHEN bare_tag = sbare THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN lm IS NOT NULL AND slm IS NOT NULL THEN CASE WHEN lm = slm THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN bare_tag IS NOT NULL OR lm IS NOT NULL THEN 'validator_one_sided'
      ELSE 'no_validator' END AS outcome FROM found)
SELECT record_id, canonical, outcome,
  CASE WHEN outcome IN ('resolved', 'no_validator') THEN sid END AS source_id,
  CASE WHEN outcome IN ('resolved', 'no_validator') THEN sd ELSE d END AS digest,
  CASE WHEN outcome IN ('resolved', 'no_validator') THEN coalesce(etag, setag) ELSE etag END AS etag,
  cc AS cache_control,
  CASE WHEN outcome IN ('resolved', 'no_validator') THEN sct ELSE ct END AS content_type,
  CASE WHEN outcome IN ('resolved', 'no_validator') THEN coalesce(lm, slm) ELSE lm END AS last_modified
FROM judged
""",
    }
