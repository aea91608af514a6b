"""Streaming forms (added surface): sessions by pauses, tumbling energy, stateful caption cues.

All take a streaming (or batch) DataFrame with an event-time column of type timestamp; a
timestamp_ntz column must be cast first, watermarks refuse it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.config import Captions


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn("at", F.col(column).cast("timestamp"))


def sessions(df: DataFrame, key: str, gap: str = "10 hours", late: str = "1 day") -> DataFrame:
    """(key, start, end, n): utterances split by pauses; rows later than ``late`` are dropped by the watermark."""
    g = df.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), F.col(key))
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_energy(df: DataFrame, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(key, start, n, rms): energy of each fixed window."""
    g = df.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), F.col(key))
    return g.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value)) + 1e-12).alias("rms")).select(key, F.col("w.start").alias("start"), "n", "rms")


def cues(words: DataFrame, cfg: Captions = Captions(), idle: str | None = None) -> DataFrame:
    """(video_id, start_ms, end_ms, text): caption cues as words arrive, in order, per video.

    words: video_id, pos, word, start_ms, end_ms. The state of a video is its open cue alone
    (at most max_words words). Within a batch a video's words are ordered by pos. A row
    with a null word marks a video's end: its open cue is given out and its state goes. With
    ``idle`` (such as "10 minutes") so does that of a video that was silent for so long."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ends = ".!?…"
    columns = ["video_id", "start_ms", "end_ms", "text"]
    patience = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n, chars, text = state.get if state.exists else (0, 0, 0, 0, "")
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], start, end, text)] if n else [], columns=columns)
            return
        rows = pd.concat(list(frames)).sort_values("pos")
        over = False
        for word, a, b in zip(rows["word"], rows["start_ms"], rows["end_ms"], strict=True):
            over = word is None or word != word
            if over:
                if n:
                    out.append((key[0], start, end, text))
                start, end, n, chars, text = 0, 0, 0, 0, ""
                continue
            start = int(a) if n == 0 else start
            end, n, chars, text = int(b), n + 1, chars + len(word) + 1, f"{text} {word}".strip()
            dur = end - start
            if n >= cfg.max_words or chars >= cfg.max_chars or dur >= cfg.max_ms or word[-1:] in ends or (n >= 3 and dur * 10 >= cfg.max_ms * 6 and word.endswith(",")):
                out.append((key[0], start, end, text))
                start, end, n, chars, text = 0, 0, 0, 0, ""
        if over:
            state.remove()
        else:
            state.update((start, end, n, chars, text))
            if patience:
                state.setTimeoutDuration(patience)
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return words.groupBy("video_id").applyInPandasWithState(
        step, "video_id long, start_ms long, end_ms long, text string", "start long, end long, n long, chars long, text string", "append", timeout
    )
