"""What a SQL user sees: scalar functions for times, escapes and tokens, and table functions for words and cues.

Scalars are SQL functions, so their bodies are planned with the query; ``running_sums`` is Python over Arrow batches. Table
functions are Python and stream: ``text_words`` runs per row; ``timed_words`` and ``range_cues`` take tables as Arrow batches.
``range_cues`` takes words partitioned by video and ordered by place, and holds one open cue a partition, or a video a row.

    register(spark)
    SELECT * FROM documents d, LATERAL text_words(d.text) t
    SELECT * FROM range_cues(TABLE(words) PARTITION BY video_id ORDER BY pos)
    SELECT * FROM range_cues(TABLE(videos))"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, arrow_udtf, udtf

from cuewright.config import Captions
from cuewright.functions import text as X

#: name: (arguments, result, body)
SCALARS = {
    "clip_clock": ("ms BIGINT", "STRING", "format_string('%02d:%02d:%02d', ms div 3600000, ms div 60000 % 60, ms div 1000 % 60)"),
    # under a hundred hours without format_string, which costs as much as all else of a word
    "srt_clock": (
        "ms BIGINT",
        "STRING",
        "CASE WHEN ms BETWEEN 0 AND 359999999 THEN concat(substr(string(100 + ms div 3600000), 2), ':', substr(string(100 + ms div 60000 % 60), 2), ':', "
        "substr(string(100 + ms div 1000 % 60), 2), ',', substr(string(1000 + ms % 1000), 2)) "
        "ELSE format_string('%02d:%02d:%02d,%03d', ms div 3600000, ms div 60000 % 60, ms div 1000 % 60, ms % 1000) END",
    ),
    "ass_clock": (
        "ms BIGINT",
        "STRING",
        "format_string('%d:%02d:%02d.%02d', greatest(ms, 0) div 3600000, greatest(ms, 0) div 60000 % 60, greatest(ms, 0) div 1000 % 60, greatest(ms, 0) div 10 % 100)",
    ),
    "ass_text": ("t STRING", "STRING", r"translate(t, '\\{}', '￣()')"),
    "token_estimate": ("t STRING", "BIGINT", "greatest(1, length(t) div 4)"),
    "ends_sentence": ("word STRING", "BOOLEAN", f"word rlike '{X.SENTENCE_END}'"),
}


#: Rows that a table function gives at once, about.
OUT = 50_000


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^ \t\n\x0b\f\r]+", text or "")


@udtf(returnType="pos: bigint, word: string")
class TextWords:
    """(pos, word) of a text's white-space separated words; none of a null text."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate(_words(text))


def _numbers(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists in a row, and how many each has; a null list has none."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


@arrow_udf(returnType=T.ArrayType(T.LongType()))
def running_sums(steps: pa.Array) -> pa.Array:
    """In place of each number the sum of those before it in its list; null lists stay null."""
    flat, size = _numbers(steps)
    ends = np.cumsum(size)
    before = np.cumsum(flat) - flat
    full = size > 0
    before -= np.repeat(before[(ends - size)[full]], size[full])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(before, pa.int64()), mask=pc.is_null(steps))


@arrow_udtf(returnType="video_id: bigint, pos: bigint, word: string, start_ms: bigint")
class TimedWords:
    """The words of texts, as text_words has them, with their starts: of rows (video_id, text, start_ms), where start_ms
    lists the starts of the text's words. No word waits for another row's, so the table isn't shuffled."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [_words(t) for t in rows.column("text").to_pylist()]
        starts, size = _numbers(rows.column("start_ms"))
        own = np.array([len(x) for x in found], np.int64)
        if not np.array_equal(own, size):
            raise ValueError("texts have other words than times")
        videos, ends, lo = rows.column("video_id"), np.cumsum(own), 0
        while lo < len(found):  # a batch takes one text at least, and about OUT words
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - own[lo] + OUT, "right")))
            n, at = own[lo:hi], int(ends[lo] - own[lo])
            if total := int(n.sum()):
                row = np.repeat(np.arange(lo, hi), n)
                pos = np.arange(at, at + total) - (ends - own)[row]
                words = pa.array([w for x in found[lo:hi] for w in x], pa.string())
                yield pa.record_batch([videos.take(pa.array(row)), pa.array(pos), words, pa.array(starts[at : at + total], pa.int64())], names=["video_id", "pos", "word", "start_ms"])
            lo = hi


class _OpenCue:
    """The cue rule over words in order: a cue closes at its limits, at a sentence's end, or at a comma when it is long enough."""

    def __init__(self, cfg: Captions = Captions()):
        self.cfg, self.n = cfg, 0

    def add(self, word: str, start: int, end: int) -> bool:
        """Take a word in; whether it closes the cue."""
        if self.n == 0:
            self.start, self.words, self.chars = start, [], 0
        self.n, self.end, self.chars = self.n + 1, end, self.chars + len(word) + 1
        self.words.append(word)
        c, length = self.cfg, end - self.start
        full = self.n >= c.max_words or self.chars >= c.max_chars or length >= c.max_ms
        return full or word[-1:] in ".!?…" or (self.n >= 3 and length * 10 >= c.max_ms * 6 and word.endswith(","))

    def take(self) -> tuple[int, int, int, str]:
        out = (self.start, self.end, self.n, " ".join(self.words))
        self.n = 0
        return out

    def closed(self, words: Iterable, starts: Iterable, ends: Iterable) -> Iterator[tuple]:
        """What add and take give of many words, a few times as fast; words without text or times are skipped."""
        most, letters, longest = self.cfg.max_words, self.cfg.max_chars, self.cfg.max_ms
        n, at, last, chars, own = (self.n, self.start, self.end, self.chars, self.words) if self.n else (0, 0, 0, 0, [])
        for word, start, end in zip(words, starts, ends, strict=True):
            if not word or start is None or end is None:
                continue
            if n == 0:
                at, chars, own = start, 0, []
            own.append(word)
            n += 1
            chars += len(word) + 1
            last, length, stop = end, end - at, word[-1]
            if n >= most or chars >= letters or length >= longest or stop in ".!?…" or (stop == "," and n >= 3 and length * 10 >= longest * 6):
                yield at, end, n, " ".join(own)
                n = 0
        self.n, self.start, self.end, self.chars, self.words = n, at, last, chars, own


def _list(column: pa.Array) -> list:
    """As to_pylist, which makes an object of every place first."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


@arrow_udtf(returnType="video_id: bigint, cue_id: bigint, start_ms: bigint, end_ms: bigint, n_words: bigint, text: string")
class RangeCues:
    """Cues of words (video_id, word, start_ms, end_ms); words without text or times are skipped.

    A row is one word, of a table partitioned by video_id and ordered by place, or a whole video, with its words and times
    as arrays: then the table needs neither and isn't shuffled."""

    def __init__(self):
        self.cue, self.video, self.made, self.out = _OpenCue(), None, 0, []

    def _words(self, words: Iterable, starts: Iterable, ends: Iterable) -> None:
        for cue in self.cue.closed(words, starts, ends):
            self.made += 1
            self.out.append((self.video, self.made, *cue))

    def _close(self) -> None:
        if self.cue.n:
            self.made += 1
            self.out.append((self.video, self.made, *self.cue.take()))

    def _take(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            rows, self.out = self.out, []
            columns = zip(("video_id", "cue_id", "start_ms", "end_ms", "n_words", "text"), zip(*rows, strict=True), strict=True)
            yield pa.RecordBatch.from_pydict({name: pa.array(c, pa.string() if name == "text" else pa.int64()) for name, c in columns})

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, columns = rows.column("video_id"), [rows.column(c) for c in ("word", "start_ms", "end_ms")]
        if pa.types.is_string(columns[0].type) or pa.types.is_large_string(columns[0].type):
            self.video = of[0].as_py() if len(of) else self.video
            self._words(*map(_list, columns))
        else:
            sizes = [pc.fill_null(pc.list_value_length(c), 0).to_pylist() for c in columns]
            if sizes[1:] != sizes[:-1]:
                raise ValueError("words and times differ in number")
            words, starts, ends = (_list(c.flatten()) for c in columns)
            at = 0
            for video, n in zip(of.to_pylist(), sizes[0], strict=True):
                self.cue, self.video, self.made, to = _OpenCue(), video, 0, at + n
                self._words(words[at:to], starts[at:to], ends[at:to])
                self._close()
                at = to
                if len(self.out) >= OUT:
                    yield from self._take()
        yield from self._take()

    def terminate(self) -> Iterator[pa.RecordBatch]:
        self._close()
        yield from self._take()


def register(spark: SparkSession) -> None:
    """Make all functions of this module known to the session's SQL."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udf.register("running_sums", running_sums)
    spark.udtf.register("text_words", TextWords)
    spark.udtf.register("timed_words", TimedWords)
    spark.udtf.register("range_cues", RangeCues)
