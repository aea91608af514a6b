"""Caption cues and camera centres as arbitrary-state streams: rows may arrive in any order.

Both keep the rows that came too early by their place, the next place they wait for, and the open
result (a cue, or the camera's centre) as separate state variables, so a batch touches what
it needs. Rows count once by their place: repeats are ignored. A key's end is a row with a null value; with ``idle_ms`` a key
that gets no row for so long is closed by a timer: what waits is taken in order, gaps
are passed over, and its state goes. Results equal the batch operators' over the same rows.

The session needs a state store that holds several variables a key
(``spark.sql.streaming.stateStore.providerClass`` RocksDBStateStoreProvider)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuewright.config import Captions, Framing
from cuewright.sql_functions import _OpenCue

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a key by place: ``take`` gets each in order, ``finish`` ends the key. Subclasses name their columns and own state."""

    waiting_schema = ""
    columns: list[str] = []

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "pos long", self.waiting_schema)
        self.place = handle.getValueState("place", "next long, end long")
        self.open_state(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        place, end = self.place.get() if self.place.exists() else (0, -1)
        for f in rows:
            for row in f[["pos", *self.columns]].astype(object).where(f.notna(), None).itertuples(index=False, name=None):
                at = int(row[0])
                if row[1] is None:
                    end = at
                elif at >= place:
                    self.waiting.updateValue((at,), self.stored(row[1:]))
        out = []
        while self.waiting.containsKey((place,)):
            out += self.take(key, place, self.waiting.getValue((place,)))
            self.waiting.removeKey((place,))
            place += 1
        if 0 <= end <= place:
            out += self.finish(key)
            self.forget()
        else:
            self.place.update((place, end))
            if self.idle_ms:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for (place,), value in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            out += self.take(key, place, value)
        out += self.finish(key)
        self.forget()
        yield self.frame(out)

    def forget(self) -> None:
        self.waiting.clear()
        self.place.clear()
        self.open.clear()

    def finish(self, key) -> list[tuple]:
        return []


class CueProcessor(InOrder):
    waiting_schema, columns = "word string, start long, end long", ["word", "start_ms", "end_ms"]

    def __init__(self, cfg: Captions, idle_ms: int | None):
        super().__init__(idle_ms)
        self.cfg = cfg

    def open_state(self, handle) -> None:
        self.open = handle.getValueState("open", "start long, end long, n long, chars long, text string")

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["video_id", "start_ms", "end_ms", "text"])

    def stored(self, values: tuple) -> tuple:
        word, start, end = values
        return str(word), int(start), int(end)

    def _cue(self) -> _OpenCue:
        cue = _OpenCue(self.cfg)
        if self.open.exists():
            cue.start, cue.end, cue.n, cue.chars, text = self.open.get()
            cue.words = [text]
        return cue

    def take(self, key, place, value) -> list[tuple]:
        cue = self._cue()
        word, start, end = value
        if cue.add(word, start, end):
            self.open.clear()
            start, end, _, text = cue.take()
            return [(key[0], start, end, text)]
        self.open.update((cue.start, cue.end, cue.n, cue.chars, " ".join(cue.words)))
        return []

    def finish(self, key) -> list[tuple]:
        if not self.open.exists():
            return []
        start, end, _, _, text = self.open.get()
        return [(key[0], start, end, text)]


class CameraProcessor(InOrder):
    """The smoothing of ``framing.smoothed_centres``; a sample's cut is never null, so only a row with a null cut ends a clip."""

    waiting_schema, columns = "cut boolean, cx double, cy double", ["cut", "cx", "cy"]

    def __init__(self, cfg: Framing, idle_ms: int | None):
        super().__init__(idle_ms)
        self.cfg = cfg

    def open_state(self, handle) -> None:
        self.open = handle.getValueState("open", "x double, y double, missing long")

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(out, columns=["clip_id", "pos", "cam_x", "cam_y", "missing", "lost"])
        return f.astype({"cam_x": float, "cam_y": float})

    def stored(self, values: tuple) -> tuple:
        cut, cx, cy = values
        return bool(cut), None if cx is None else float(cx), None if cy is None else float(cy)

    def take(self, key, place, value) -> list[tuple]:
        c = self.cfg
        dead, snap = int(c.height * 9 / 16) * c.deadzone + c.jitter, c.width * c.snap
        x, y, missing = self.open.get() if self.open.exists() else (None, None, 0)
        cut, cx, cy = value
        if cx is None:
            missing = (0 if cut else missing) + 1
        else:
            fresh, missing = x is None or abs(cx - x) > snap, 0
            dx, dy = (0.0, 0.0) if x is None else (cx - x, cy - y)
            x = cx if fresh else x + dx * c.smooth if abs(dx) > dead else x
            y = cy if fresh else y + dy * c.smooth if abs(dy) > c.jitter else y
        self.open.update((x, y, missing))
        short = lambda v: None if v is None else int(v * 1000 + 0.5) / 1000
        return [(key[0], place, short(x), short(y), missing, missing > c.hold_samples)]


def cues(words: DataFrame, cfg: Captions = Captions(), idle_ms: int | None = None) -> DataFrame:
    """(video_id, start_ms, end_ms, text) of words (video_id, pos from 0, word, start_ms, end_ms) in any order."""
    schema = "video_id long, start_ms long, end_ms long, text string"
    mode = "ProcessingTime" if idle_ms else "None"
    return words.groupBy("video_id").transformWithStateInPandas(CueProcessor(cfg, idle_ms), schema, "Append", mode)


def centres(samples: DataFrame, cfg: Framing = Framing(), idle_ms: int | None = None) -> DataFrame:
    """(clip_id, pos, cam_x, cam_y, missing, lost) of samples (clip_id, pos from 0, cx, cy, cut) in any order."""
    schema = "clip_id long, pos long, cam_x double, cam_y double, missing long, lost boolean"
    mode = "ProcessingTime" if idle_ms else "None"
    return samples.groupBy("clip_id").transformWithStateInPandas(CameraProcessor(cfg, idle_ms), schema, "Append", mode)
