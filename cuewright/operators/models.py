"""A place for real models: batch embedding that loads once a worker, and calls to outside models with retries.

Nothing here is a model; a job passes a loader or a client, which must be picklable."""

from __future__ import annotations

import fcntl
import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.names import spare

#: Models of this Python process by name: a worker that is used again finds its model loaded.
_LOADED: dict[str, Callable] = {}


def loaded(name: str, loader: Callable[[], Callable]) -> Callable:
    if name not in _LOADED:
        _LOADED[name] = loader()
    return _LOADED[name]


def encode(texts: list[str | None], model: Callable, prompt: str, batch: int, head: int | None) -> list[np.ndarray | None]:
    """Vectors in the order of texts: batches hold texts of like length, so little is padded; null and blank texts have none."""
    order = sorted((i for i, t in enumerate(texts) if t and t.strip()), key=lambda i: (len(texts[i]), i))
    out: list[np.ndarray | None] = [None] * len(texts)
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        found = np.asarray(model([texts[i] for i in own], prompt), dtype=np.float32)
        if head:
            found = found[:, :head]
            length = np.linalg.norm(found, axis=1, keepdims=True)
            found = found / np.where(length > 0, length, 1)
        for i, v in zip(own, found, strict=True):
            out[i] = v
    return out


def embed_with(
    texts: DataFrame, name: str, loader: Callable[[], Callable], text: str = "text", out: str = "embedding", prompt: str = "", batch: int = 64, head: int | None = None
) -> DataFrame:
    """texts with ``out`` by a model: loader() gives model(texts, prompt name) -> vectors, once a worker and ``name``.

    With ``head`` vectors are cut to so many entries and scaled to length one again. Rows that
    have a vector keep it and are not encoded; null and blank texts get none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for b in batches:
            if b.notna().any():
                model = model or loaded(name, loader)
            yield pd.Series(encode(b.where(b.notna(), None).tolist(), model, prompt, batch, head), dtype=object)

    if out not in texts.columns:
        return texts.withColumn(out, run(F.col(text)))
    has = F.size(out) > 0
    return texts.withColumn(out, F.when(has, F.col(out)).otherwise(run(F.when(~F.coalesce(has, F.lit(False)), F.col(text)))))


class Busy(Exception):
    """The service asks to wait (429); ``after`` seconds if it said so."""

    def __init__(self, after: float | None = None):
        super().__init__("busy")
        self.after = after


@dataclass(frozen=True)
class CallParams:
    tries: int = 4
    first_wait: float = 1.0  # seconds before the second try; each further wait is twice as long
    per_second: float | None = None  # calls of all tasks of an executor's host together


class Rate:
    """Turns shared by the processes of one host: a locked file holds the time of the next free turn."""

    def __init__(self, name: str, per_second: float):
        self.path, self.gap = os.path.join(tempfile.gettempdir(), f"cuewright-rate-{name}"), 1 / per_second

    def turn(self) -> None:
        with open(self.path, "a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            at = max(time.time(), float(f.read() or 0))
            f.seek(0)
            f.truncate()
            f.write(repr(at + self.gap))
        time.sleep(max(0.0, at - time.time()))


def _answer(client: Callable[[str], str], prompt: str, p: CallParams, rate: Rate | None) -> tuple[str | None, str | None, int]:
    """(reply, error, tries): a busy service is asked again after growing waits, any other failure is the row's error."""
    wait = p.first_wait
    for n in range(1, p.tries + 1):
        if rate:
            rate.turn()
        try:
            return client(prompt), None, n
        except Busy as e:
            if n < p.tries:
                time.sleep(e.after if e.after is not None else wait)
                wait *= 2
        except Exception as e:  # noqa: BLE001  (what a service raises is data)
            return None, f"{type(e).__name__}: {e}"[:300], n
    return None, f"busy after {p.tries} tries", p.tries


def ask(requests: DataFrame, client: Callable[[str], str], store: str, prompt: str = "prompt", p: CallParams = CallParams()) -> DataFrame:
    """requests with ``reply`` and ``error``: every distinct prompt is asked once, over all jobs that share the store.

    A reply is written below ``store`` (a path that Arrow's file systems know) under its prompt's SHA-256 as soon as it comes, and
    looked for before a call, so a task that is tried again repeats no answered call. Errors
    are not kept: the next job asks again. A null prompt has neither reply nor error."""
    digest, reply_, error_ = spare(["digest", "reply", "error"], requests)
    asked = requests.where(F.col(prompt).isNotNull()).select(F.sha2(prompt, 256).alias(digest), F.col(prompt).alias("prompt")).distinct()
    schema = T.StructType().add(digest, T.StringType()).add(reply_, T.StringType()).add(error_, T.StringType())
    job = uuid.uuid4().hex if p.per_second is None else requests.sparkSession.sparkContext.applicationId

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(store)
        rate = Rate(job, p.per_second) if p.per_second else None
        for f in frames:
            rows = []
            for key, text in zip(f[digest], f["prompt"], strict=True):
                path = f"{root}/{key[:2]}/{key}.json"
                if system.get_file_info(path).type == pafs.FileType.File:
                    with system.open_input_stream(path) as s:
                        rows.append((key, json.loads(s.read())["reply"], None))
                    continue
                reply, error, _ = _answer(client, text, p, rate)
                if reply is not None:
                    system.create_dir(f"{root}/{key[:2]}", recursive=True)
                    part = f"{path}.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as s:
                        s.write(json.dumps({"reply": reply}).encode())
                    system.move(part, path)  # whole or not at all
                rows.append((key, reply, error))
            yield pd.DataFrame(rows, columns=[digest, reply_, error_])

    found = asked.mapInPandas(run, schema)
    return requests.withColumn(digest, F.sha2(prompt, 256)).join(found, digest, "left").drop(digest)
