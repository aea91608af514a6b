"""WARC not-modified revisits: an as-of join by canonical URL.

A revisit record (HTTP 304) has no payload. It is held against the latest earlier full
response of the same canonical URL: if their validators agree it gets that response's
payload digest and headers, with the headers that a 304 may change taken from the revisit.

Records are range-sorted by (canonical URL, time, record id), so that one URL with very
many captures spans many partitions. Inside a block the latest response is a running
window; between blocks it is carried by one row per (URL, block). No URL is one task's,
and payloads are not read: only digests travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked_blocks, require

#: Header fields that a 304 response may send anew (RFC 9110, section 15.4.5), and Last-Modified. Fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]

RESOLVED, MISMATCH, UNCHECKED, ORPHAN = "resolved", "validator_mismatch", "no_validator", "no_earlier_response"
#: The revisit has a validator, but the response none of its kind: nothing can be checked, nothing is taken.
ONE_SIDED = "validator_one_sided"


def canonical_url(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters, and a last slash or .html set aside; host lower-cased. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(\.html|/)$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: ~x.rlike("^(utm_[a-z]*|ref)(=|$)") & (x != ""))), "&")
    return F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def _tag(headers: Column) -> Column:
    """The entity tag for weak comparison."""
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve(records: DataFrame, name: str = "warc") -> DataFrame:
    """Every revisit with what it resolves to.

    records: record_id, url, ts, status int, headers map<string,string> (names in lower
    case), digest; other columns are ignored. Returns record_id, canonical, ts, status,
    outcome, source_id (the response; null unless outcome is resolved or no_validator),
    digest, headers (merged; the revisit's own where unresolved).

    A response is a row of status 200. Outcomes: ``resolved`` (entity tags agree weakly,
    or without a tag on both sides the Last-Modified dates agree), ``no_validator`` (the
    revisit has none, so it claims nothing that could be checked: taken), ``validator_mismatch``,
    ``validator_one_sided`` (the revisit has one, the response none of that kind: not taken),
    ``no_earlier_response``. Ties in time go by record_id, null ids first; a response with
    equal time and a smaller id is earlier. A null URL has no canonical form and its
    revisits are orphans; null headers are empty, a null digest stays null; other statuses are
    ignored; repeated revisits are resolved each, a repeated response counts once; empty and very
    long URLs are taken whole; an empty table gives no rows."""
    require(records, "record_id", "url", "ts", "status", "headers", "digest")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.where(F.col("status").isin(200, 304)).select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "status", F.coalesce("headers", none).alias("headers"), "digest"
    )
    rows = ranked_blocks(rows, ["canonical"], ["ts", "record_id"], name)
    own = F.when((F.col("status") == 200) & F.col("canonical").isNotNull(), F.struct("record_id", "headers", "digest"))
    inside = Window.partitionBy("canonical", "block").orderBy("ts", "record_id")
    rows = rows.withColumn("here", F.last(own, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    latest = rows.where((F.col("status") == 200) & F.col("canonical").isNotNull()).groupBy("canonical", "block").agg(
        F.max_by(F.struct("record_id", "headers", "digest"), F.struct("ts", "record_id")).alias("latest")
    )
    # carried into a block: the latest response of the URL's earlier blocks
    blocks = rows.where("status = 304 and here is null and canonical is not null").select("canonical", "block").distinct()
    marks = blocks.select("canonical", "block", F.lit(None).cast(latest.schema["latest"].dataType).alias("latest")).unionByName(latest)
    before = Window.partitionBy("canonical").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.select("canonical", "block", "latest", F.last("latest", ignorenulls=True).over(before).alias("carry")).where("latest is null").select("canonical", "block", "carry")
    found = rows.where("status = 304").join(carried, ["canonical", "block"], "left").withColumn("source", F.coalesce("here", "carry"))
    a, b = F.col("headers"), F.col("source.headers")
    outcome = (
        F.when(F.col("source").isNull(), ORPHAN)
        .when(_tag(a).isNotNull() & _tag(b).isNotNull(), F.when(_tag(a) == _tag(b), RESOLVED).otherwise(MISMATCH))
        .when(a["last-modified"].isNotNull() & b["last-modified"].isNotNull(), F.when(a["last-modified"] == b["last-modified"], RESOLVED).otherwise(MISMATCH))
        .when(_tag(a).isNotNull() | a["last-modified"].isNotNull(), ONE_SIDED)
        .otherwise(UNCHECKED)
    )
    found = found.withColumn("outcome", outcome)
    taken = F.col("outcome").isin(RESOLVED, UNCHECKED)
    fresh = F.map_filter(a, lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    return found.select(
        "record_id", "canonical", "ts", "status", "outcome",
        F.when(taken, F.col("source.record_id")).alias("source_id"),
        F.when(taken, F.col("source.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(taken, merged).otherwise(a).alias("headers"),
    )
