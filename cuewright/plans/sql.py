"""Shared pieces of the DuckDB equivalents: derived tables as common table expressions."""

WORDS = r"""
w0 AS (SELECT doc_id AS video_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents)),
w1 AS (SELECT *, 80 * length(word) + 40 AS dur,
    CASE WHEN regexp_matches(word, '[.!?…]+$') THEN CASE WHEN (pos * 7919 + video_id * 104729) % 5 = 0 THEN 1500 ELSE 600 END
         WHEN (pos * 7919 + video_id * 104729) % 97 = 0 THEN 1300 ELSE 60 END AS gap FROM w0),
w2 AS (SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM w1),
w AS MATERIALIZED (SELECT video_id, pos::BIGINT AS pos, word, start_ms, (start_ms + dur)::BIGINT AS end_ms FROM w2)
"""

#: Sentences: a left-to-right fold per video over a list of (pause or punctuation) marks.
SENTENCES = (
    WORDS
    + r""",
s0 AS (SELECT *, regexp_matches(word, '[.!?…]+$') AS punct,
    coalesce(lead(start_ms) OVER v - end_ms >= 1000, false) AS pause, lead(pos) OVER v IS NULL AS fin FROM w WINDOW v AS (PARTITION BY video_id ORDER BY pos)),
s1 AS (SELECT *, coalesce(max(CASE WHEN punct THEN pos END) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS since FROM s0),
s2 AS (SELECT video_id, since, list(pos ORDER BY pos) AS ps FROM s1 WHERE pause AND NOT punct GROUP BY ALL),
s3 AS (SELECT video_id, unnest(list_reduce(ps, lambda a, x: CASE WHEN x[1] - a[-1] >= 3 THEN list_concat(a, x) ELSE a END)) AS cut
    FROM (SELECT video_id, list_prepend([since], list_transform(ps, lambda p: [p])) AS ps FROM s2)),
s4 AS (SELECT s1.*, punct OR fin OR cut IS NOT NULL AS ends FROM s1 LEFT JOIN s3 ON s1.video_id = s3.video_id AND s1.pos = s3.cut),
s5 AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sid FROM s4),
s AS MATERIALIZED (SELECT video_id, sid AS id, min(pos) AS start_word, max(pos) AS end_word, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
    string_agg(word, ' ' ORDER BY pos) AS text, arg_max(punct, pos) AS ends_with_punctuation FROM s5 GROUP BY ALL)
"""
)

CHUNKS = (
    WORDS
    + r""",
c0 AS (SELECT *, regexp_matches(word, '[.!?]$') AS stop, start_ms - lag(end_ms) OVER v AS gap, count(*) OVER (PARTITION BY video_id) AS n FROM w WINDOW v AS (PARTITION BY video_id ORDER BY pos)),
c1 AS (SELECT *, CASE WHEN gap >= 1200 THEN CASE WHEN lag(stop) OVER v THEN pos ELSE coalesce(min(CASE WHEN stop THEN pos + 1 END) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), pos) END END AS target
    FROM c0 WINDOW v AS (PARTITION BY video_id ORDER BY pos)),
cuts AS (SELECT DISTINCT video_id, target AS pos FROM c1 WHERE target IS NOT NULL),
bounds AS (SELECT video_id, pos AS hi, coalesce(lag(pos) OVER (PARTITION BY video_id ORDER BY pos), 0) AS lo FROM cuts),
budget AS (SELECT b.video_id, lo, hi, (sum(length(word) + 1) - 1) // 4 AS tokens, (lo + hi) // 2 AS mid,
    min(CASE WHEN stop AND c1.pos >= (lo + hi) // 2 THEN c1.pos + 1 END) AS after_mid
    FROM bounds b JOIN c1 ON c1.video_id = b.video_id AND c1.pos >= lo AND c1.pos < hi GROUP BY ALL),
allcuts AS (SELECT video_id, pos FROM cuts UNION SELECT video_id, coalesce(after_mid, mid) FROM budget WHERE tokens > 1000 UNION SELECT DISTINCT video_id, 0 FROM w),
c2 AS (SELECT c1.*, max(a.pos) OVER (PARTITION BY c1.video_id ORDER BY c1.pos) AS chunk_start FROM c1 LEFT JOIN allcuts a ON a.video_id = c1.video_id AND a.pos = c1.pos),
c3 AS (SELECT video_id, chunk_start AS start_word, max(pos) AS end_word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY pos) AS text,
    coalesce(arg_min(gap, pos), 0)::BIGINT AS silence_gap_before_ms FROM (SELECT * REPLACE (coalesce(gap, 0) AS gap) FROM c2) GROUP BY ALL),
c AS MATERIALIZED (SELECT *, greatest(1, length(text) // 4)::BIGINT AS token_count, (row_number() OVER (PARTITION BY video_id ORDER BY start_word) - 1)::BIGINT AS chunk_index
    FROM c3 WHERE end_ms - start_ms >= 15000)
"""
)

PROPOSALS = (
    SENTENCES
    + r""",
p0 AS (SELECT video_id, id AS proposal_id, id AS lo, id + 2 + id % 7 AS hi FROM s WHERE id % 4 = 0
  UNION ALL SELECT video_id, id + 1000000, id + 900000, id + 900003 FROM s WHERE id % 36 = 4),
p1 AS (SELECT p0.video_id, proposal_id, lo, hi, count(s.id) AS n_sentences, min(s.start_ms) AS s, max(s.end_ms) AS e, arg_min(s.text, s.id) AS first_text
  FROM p0 LEFT JOIN s ON s.video_id = p0.video_id AND s.id BETWEEN lo AND hi GROUP BY ALL),
p AS MATERIALIZED (SELECT *, CASE WHEN n_sentences = 0 THEN 'no known sentences' WHEN n_sentences > 120 THEN 'too many sentences' WHEN e <= s THEN 'degenerate'
  WHEN e - s < 15000 THEN 'too short' WHEN e - s > 90000 THEN 'too long' END AS reject_reason FROM p1),
k AS MATERIALIZED (SELECT video_id, proposal_id AS cand_id, s, e,
  array_to_string(list_slice(list_filter(regexp_split_to_array(first_text, '\s+'), lambda x: x <> ''), 1, 8), ' ')[1:300] AS hook,
  array_to_string(list_slice(list_filter(regexp_split_to_array(first_text, '\s+'), lambda x: x <> ''), 9, 20), ' ')[1:600] AS main_idea,
  CASE WHEN proposal_id % 24 = 0 AND proposal_id % 7 > 0 THEN (proposal_id % 7)::DOUBLE END AS energy_increase,
  CASE WHEN proposal_id % 3 = 0 THEN '' ELSE 'payoff' END AS payoff, CASE WHEN proposal_id % 5 = 0 THEN 'context' ELSE '' END AS required_context,
  ((proposal_id * 37 + video_id) % 100) / 100.0::DOUBLE AS uncertainty, CASE WHEN proposal_id % 8 = 0 THEN 'audio_event' ELSE 'outline' END AS source
  FROM p WHERE reject_reason IS NULL)
"""
)

_FILLERS = "('so','and','well','you know','um','uh','like','okay','right','now')"
_PRONOUNS = "('it','this','that','these','those','they','them','he','she','his','her','its','there')"
CAMPAIGN = "the open source review of that and other things"


def scores(source: str, keywords: list[str]) -> str:
    """The score columns of candidates in ``source`` as a SELECT."""
    hits = " + ".join(f"(contains(told, '{w}'))::INT" for w in keywords) or "0"
    relevance = f"least(1.0, ({hits}) / {float(max(1, min(len(keywords), 6)))}::DOUBLE)" if keywords else "0.5::DOUBLE"
    return rf"""
SELECT *, floor((opening * 0.22 + standalone * 0.24 + payoff_score * 0.16 + completeness * 0.16 + relevance * 0.08 + editability * 0.09 + audio_support * 0.05) * 10000 + 0.5) / 10000.0::DOUBLE AS total
FROM (SELECT *,
  floor((CASE WHEN trim(hook) = '' THEN 0.3::DOUBLE ELSE greatest(0, least(1, 0.6::DOUBLE - CASE WHEN first IN {_FILLERS} THEN 0.35::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(trim(hook), '[?!]$') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN nw BETWEEN 3 AND 20 THEN 0.1::DOUBLE ELSE 0 END)) END) * 1000 + 0.5) / 1000.0::DOUBLE AS opening,
  floor(greatest(0, least(1, CASE WHEN trim(required_context) <> '' THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END - CASE WHEN trim(hook) <> '' AND first IN {_PRONOUNS} THEN 0.3::DOUBLE ELSE 0 END)) * 1000 + 0.5) / 1000.0::DOUBLE AS standalone,
  CASE WHEN trim(payoff) <> '' THEN 1.0 ELSE 0.4 END::DOUBLE AS payoff_score,
  floor(greatest(0, least(1, 1.0::DOUBLE - 0.6::DOUBLE * uncertainty - CASE WHEN trim(payoff) <> '' THEN 0 ELSE 0.2::DOUBLE END)) * 1000 + 0.5) / 1000.0::DOUBLE AS completeness,
  floor({relevance} * 1000 + 0.5) / 1000.0::DOUBLE AS relevance,
  floor((CASE WHEN energy_increase <> 0 THEN least(1.0::DOUBLE, edit + 0.1::DOUBLE) ELSE edit END) * 1000 + 0.5) / 1000.0::DOUBLE AS editability,
  CASE WHEN energy_increase <> 0 THEN 0.8 WHEN source = 'audio_event' THEN 0.7 ELSE 0.3 END::DOUBLE AS audio_support
  FROM (SELECT *, CASE WHEN span < 20 THEN greatest(0.2::DOUBLE, span / 20) WHEN span <= 90 THEN 1.0 ELSE greatest(0.2::DOUBLE, 1.0 - (span - 90) / 120) END AS edit,
    lower(coalesce(hook, '') || ' ' || coalesce(main_idea, '')) AS told
  FROM (SELECT *, (e - s) / 1000.0::DOUBLE AS span, lower(trim(coalesce(list_filter(regexp_split_to_array(hook, '\s+'), lambda x: x <> '')[1], ''), ' ,.!?"''')) AS first,
    len(list_filter(regexp_split_to_array(hook, '\s+'), lambda x: x <> '')) AS nw FROM {source})))
"""


def greedy(ranked: str, clash: str, most: int = 1_000_000) -> str:
    """CTEs g_pairs .. g: rows of ``ranked`` (video_id, rk, s, e, hook) kept in rank order; clash is over a (later) and b (earlier)."""
    return rf"""
g_pairs AS (SELECT a.video_id, a.rk, list(b.rk ORDER BY b.rk) AS es FROM
    (SELECT a.video_id, a.rk, b.rk AS brk, greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) AS inter, a.e - a.s AS la, b.e - b.s AS lb, a.hook AS ha, b.hook AS hb
     FROM {ranked} a JOIN {ranked} b ON a.video_id = b.video_id AND b.rk < a.rk AND b.s < a.e AND b.e > a.s) x
    JOIN {ranked} a ON a.video_id = x.video_id AND a.rk = x.rk JOIN {ranked} b ON b.video_id = x.video_id AND b.rk = x.brk
    WHERE {clash} GROUP BY ALL),
g_rows AS (SELECT r.*, coalesce(es, []) AS es FROM {ranked} r LEFT JOIN g_pairs p ON p.video_id = r.video_id AND p.rk = r.rk),
g_fold AS (SELECT video_id, list_reduce(list({{'k': [rk], 'e': es}} ORDER BY rk), lambda a, x: CASE WHEN len(a.k) < {most} AND NOT list_has_any(a.k, x.e) THEN {{'k': list_concat(a.k, x.k), 'e': a.e}} ELSE a END,
    {{'k': []::BIGINT[], 'e': []::BIGINT[]}}).k AS kept_rks FROM g_rows GROUP BY video_id),
g AS (SELECT r.*, list_contains(kept_rks, r.rk) AS kept, list_filter(es, lambda x: list_contains(kept_rks, x))[1] AS winner FROM g_rows r JOIN g_fold f USING (video_id))
"""


JACCARD = r"""(CASE WHEN len(list_distinct(list_concat(wa, wb))) > 0 THEN len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))::DOUBLE ELSE 0 END)"""


def alike() -> str:
    words = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda z: z <> ''))"
    a, b = words.format("x.ha"), words.format("x.hb")
    return f"(len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)::DOUBLE >= 0.92)"
