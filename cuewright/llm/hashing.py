"""Vectorised token hashing over UTF-8 bytes (numpy, inside tasks).

A token is a maximal run of word bytes (ASCII letters, digits, underscore and every
byte of a non-ASCII character) or a maximal run of other printable ASCII; ASCII
white space and control bytes separate. Every token gets a 64-bit hash that depends
only on its bytes, so batches, partitions and retries agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE, WORD, PUNCT = 0, 1, 2
LOWER, UPPER, DIGIT, HIGH, SIGN = 1, 2, 4, 8, 16
#: Texts are hashed in buffers of about this many bytes, longer ones alone and in slices.
SLICE = 1 << 20

_b = np.arange(256)
_alpha_l = (_b >= 97) & (_b <= 122)
_alpha_u = (_b >= 65) & (_b <= 90)
_digit = (_b >= 48) & (_b <= 57)
_high = _b >= 128
_word = _alpha_l | _alpha_u | _digit | _high | (_b == 95)
CLASS = np.where(_b <= 32, SPACE, np.where(_word, WORD, PUNCT)).astype(np.uint8)
CLASS[127] = SPACE
FLAG = (_alpha_l * LOWER + _alpha_u * UPPER + _digit * DIGIT + _high * HIGH + ((CLASS == PUNCT) | (_b == 95)) * SIGN).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping uint64 arithmetic)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_VALUE[CLASS == SPACE] = 0
_VALUE_FOLD = _VALUE.copy()
_VALUE_FOLD[65:91] = _VALUE[97:123]
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _factors(place: np.ndarray) -> np.ndarray:
    """An odd factor for each place in a token, another for every place."""
    out = _PLACE[place & 63]
    far = np.flatnonzero(place > 63)
    out[far] = mix(place[far].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return out


def _tokens(buf: np.ndarray, fold: bool, stem: int = 0) -> tuple[np.ndarray, ...]:
    """starts, hashes, flags, whether the first byte is an ASCII capital, and (stem > 0) the hashes of the first ``stem`` bytes, of one buffer's tokens."""
    cls = CLASS[buf]
    change = np.empty(len(buf), bool)
    if len(buf):
        change[0] = True
        np.not_equal(cls[1:], cls[:-1], out=change[1:])
    starts = np.flatnonzero(change & (cls != SPACE))
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, bool), np.zeros(0, np.uint64)
    first = starts[0]
    span = np.diff(np.append(starts, len(buf)))
    place = np.arange(first, len(buf)) - np.repeat(starts, span)
    value = (_VALUE_FOLD if fold else _VALUE)[buf[first:]] * _factors(place)
    h = mix(np.add.reduceat(value, starts - first))
    flags = np.bitwise_or.reduceat(FLAG[buf[first:]], starts - first)
    head = buf[starts]
    stems = h
    if stem:
        value[place >= stem] = 0
        stems = mix(np.add.reduceat(value, starts - first) ^ np.uint64(0x5DEECE66D))
    return starts, h, flags, (head >= 65) & (head <= 90), stems


def _slices(buf: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(buf):
        end = min(at + SLICE, len(buf))
        if end < len(buf):
            gaps = np.flatnonzero(CLASS[buf[at:end]] == SPACE)
            if len(gaps) and gaps[-1] > 0:
                end = at + int(gaps[-1])
        yield buf[at:end]
        at = end


def batches(texts: list[str | None], fold: bool, stem: int = 0) -> Iterator[tuple]:
    """Yields (first text, number of texts, text of each token, hashes, flags, capital, stem hashes), texts in order.

    A null text is empty. Memory is bounded by SLICE bytes of text plus the tokens of
    one text; a token of over SLICE bytes is cut at multiples of SLICE from its text's start."""
    group: list[bytes] = []
    size = at = 0

    def done(first: int, own: list[bytes]):
        joined = np.frombuffer(b"\n".join(own) + b"\n", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in own])
        starts, *rest = _tokens(joined, fold, stem)
        return first, len(own), np.searchsorted(ends, starts, side="right"), *rest

    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) > SLICE:
            if group:
                yield done(at, group)
            parts = [_tokens(part, fold, stem)[1:] for part in _slices(np.frombuffer(raw, np.uint8))]
            rest = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield i, 1, np.zeros(len(rest[0]), np.int64), *rest
            group, size, at = [], 0, i + 1
            continue
        group.append(raw)
        size += len(raw) + 1
        if size >= SLICE:
            yield done(at, group)
            group, size, at = [], 0, i + 1
    if group:
        yield done(at, group)


def previous(doc: np.ndarray, values: np.ndarray, back: int, missing: int) -> np.ndarray:
    """values shifted by ``back`` tokens inside each text; ``missing`` where the text has none."""
    out = np.full(len(values), missing, dtype=values.dtype)
    if len(values) > back:
        same = doc[back:] == doc[:-back]
        out[back:][same] = values[:-back][same]
    return out
