"""``spark.read.format("subtitles")`` and ``df.write.format("subtitles")``: SRT and transcript files as a data source.

Reading gives (video_id, cue, start_ms, end_ms, text) of ``.srt`` files and of ``.json`` transcripts (a word
is a cue), a partition per file; equality and IN filters on video_id are taken over and choose the files. Writing
takes (clip_id, cue, start_ms, end_ms, text) and makes one SRT (or, with option kind=ass, ASS) file
a clip. Tasks write under a name of their own below ``_pending`` and files move into place when all tasks
have ended; after a failure nothing is left. A clip's rows must be in one task, as after
``repartition("clip_id")``; a clip in two tasks fails the commit. Paths are those that Arrow's file systems know.

    formats.register(spark)"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .sinks import ASS_HEAD

SCHEMA = "video_id string, cue bigint, start_ms bigint, end_ms bigint, text string"
_TIME = re.compile(r"(\d+):(\d+):(\d+)[,.](\d{1,3})$")


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _ms(text: str) -> int | None:
    m = _TIME.match(text.strip())
    return None if m is None else ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(m[4].ljust(3, "0"))


def srt_rows(text: str) -> Iterator[tuple]:
    """(cue, start_ms, end_ms, text) of an SRT file; blocks of under three lines or without readable times are skipped but numbered."""
    blocks = re.split(r"\n\s*\n", text.replace("\r", "").strip(" \n\t"))
    for cue, block in enumerate(blocks):
        lines = block.strip(" \n\t").split("\n")
        times = lines[1].split(" --> ") if len(lines) >= 3 else []
        a, b = (_ms(t) for t in times) if len(times) == 2 else (None, None)
        if a is not None and b is not None:
            yield cue, a, b, " ".join(lines[2:])


def transcript_rows(text: str) -> Iterator[tuple]:
    """Words of a transcript, of its segments, or a list; those without text or times are skipped but numbered."""
    data = json.loads(text)
    words = data if isinstance(data, list) else [w for s in data.get("segments") or [] for w in s.get("words") or []] or data.get("word_segments") or []
    for cue, w in enumerate(words):
        try:
            yield cue, round(float(w["start"]) * 1000), round(float(w["end"]) * 1000), str(w["word"]).strip()
        except (KeyError, TypeError, ValueError):
            continue


@dataclass
class OneFile(InputPartition):
    path: str
    video_id: str


class SubtitleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("video_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f  # Spark's to do

    def partitions(self) -> list[OneFile]:
        system, root = _system(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        names = [(f.path, unquote(f.base_name.rsplit(".", 1)[0])) for f in found if f.is_file and f.extension in ("srt", "json") and "/_" not in f.path[len(root) :]]
        return [OneFile(p, v) for p, v in sorted(names) if self.wanted is None or v in self.wanted] or [OneFile("", "")]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if partition.path:
            with _system(self.path)[0].open_input_stream(partition.path) as f:
                text = f.read().decode("utf-8", "replace")
            rows = srt_rows(text) if partition.path.endswith(".srt") else transcript_rows(text)
            yield from ((partition.video_id, *r) for r in rows)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _clock(ms: int, form: str) -> str:
    if form == "ass":
        cs = max(ms // 10, 0)
        return f"{cs // 360_000}:{cs // 6000 % 60:02d}:{cs // 100 % 60:02d}.{cs % 100:02d}"
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def script(rows: list[tuple], form: str) -> str:
    """A clip's file of its (cue, start_ms, end_ms, text), in order."""
    rows = sorted(rows)
    if form == "ass":
        lines = [f"Dialogue: 0,{_clock(a, form)},{_clock(b, form)},Default,,0,0,0,,{(t or '').translate(str.maketrans(dict(zip('{}', '()', strict=True)) | {chr(92): '￣'}))}" for _, a, b, t in rows]
        return ASS_HEAD + "\n".join(lines) + "\n"
    return "\n".join(f"{n}\n{_clock(a, form)} --> {_clock(b, form)}\n{t}\n" for n, (_, a, b, t) in enumerate(rows, 1))


class SubtitleWriter(DataSourceWriter):
    def __init__(self, path: str, form: str, overwrite: bool):
        self.path, self.form, self.overwrite = path, form, overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = _system(self.path)
        clips: dict[str, list[tuple]] = {}
        for r in rows:
            clips.setdefault(str(r["clip_id"]), []).append((r["cue"], r["start_ms"], r["end_ms"], r["text"]))
        folder = f"{root}/{self.pending}/{uuid.uuid4().hex}"  # an attempt's own: a retried task meets nothing of the first
        system.create_dir(folder, recursive=True)
        files = []
        for clip, own in clips.items():
            files.append(f"{folder}/{quote(clip, safe='')}.{self.form}")
            with system.open_output_stream(files[-1]) as f:
                f.write(script(own, self.form).encode())
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [f.rsplit("/", 1)[1] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one clip came to several tasks; repartition by clip_id")
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(root)):
                if f.is_file and f.extension == self.form and f.base_name not in names:
                    system.delete_file(f.path)
        for f, name in zip(files, names, strict=True):
            system.move(f, f"{root}/{name}")
        self.abort(messages)  # the empty folders

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.pending}").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/{self.pending}")


class Subtitles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SubtitleReader:
        return SubtitleReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SubtitleWriter:
        form = self.options.get("kind", "srt")
        if form not in ("srt", "ass"):
            raise ValueError("kind is srt or ass")
        return SubtitleWriter(self.options["path"], form, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Subtitles)
