"""Made-up inputs of the catalogue's queries: proposals and texts that a model would write, some of them bad on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as X


def proposals(sents: DataFrame) -> DataFrame:
    """Spans of 3 to 9 sentences from every fourth one, some reversed or beyond the end."""
    end = F.col("id") + 2 + F.col("id") % 7
    flip = F.col("proposal_id") % 20 == 0
    p = sents.where("id % 4 = 0").select("video_id", F.col("id").alias("proposal_id"), F.col("id").alias("a"), end.alias("b"))
    p = p.select("video_id", "proposal_id", F.when(flip, F.col("b")).otherwise(F.col("a")).alias("start_id"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("end_id"))
    lost = sents.where("id % 36 = 4").select("video_id", (F.col("id") + 1_000_000).alias("proposal_id"), (F.col("id") + 900_000).alias("start_id"), (F.col("id") + 900_003).alias("end_id"))
    return p.unionByName(lost)


def candidates(valid: DataFrame) -> DataFrame:
    """Accepted proposals with the texts that an editor model would write, derived offline."""
    i = F.col("proposal_id")
    hook = F.array_join(F.slice(X.split_words(F.col("first_text")), 1, 8), " ")
    return valid.where("reject_reason is null").select(
        "video_id", i.alias("cand_id"), "s", "e", X.capped(hook, "hook").alias("hook"), X.capped(F.array_join(F.slice(X.split_words(F.col("first_text")), 9, 12), " "), "text").alias("main_idea"),
        F.when((i % 24 == 0) & (i % 7 > 0), (i % 7).cast("double")).alias("energy_increase"), "sentence_ids",
        F.when(i % 3 == 0, "").otherwise("payoff").alias("payoff"), F.when(i % 5 == 0, "context").otherwise("").alias("required_context"),
        ((i * 37 + F.col("video_id")) % 100 / 100.0).alias("uncertainty"), F.when(i % 8 == 0, "audio_event").otherwise("outline").alias("source"),
    )
