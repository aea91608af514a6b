"""Proposals that reach far beyond the sentences of their video."""

from cuewright.operators import candidates


def test_known_sentences_of_a_long_span_count(spark):
    sents = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 900, f"s{i}") for i in range(81)] + [(2, i, i * 100, i * 100 + 90, "t") for i in range(3000)], "video_id long, id long, start_ms long, end_ms long, text string")
    rows = [(1, 1, 50, 9999), (1, 2, 9999, 10_000), (2, 3, 0, 2999), (3, 4, 0, 5000), (1, 5, None, None)]
    props = spark.createDataFrame(rows, "video_id long, proposal_id long, start_id long, end_id long")
    got = {r.proposal_id: r for r in candidates.validate(props, sents).collect()}
    assert (got[1].n_sentences, got[1].s, got[1].e, got[1].first_text, got[1].reject_reason) == (31, 50_000, 80_900, "s50", None)
    assert got[2].reject_reason == got[4].reject_reason == "no known sentences"
    assert (got[3].n_sentences, got[3].reject_reason) == (3000, "too many sentences")
    assert got[5].reject_reason == "missing ids"
