"""Token ids of whole texts by a public byte-level BPE vocabulary, inside tasks.

Byte-level BPE never merges over the borders of its pre-tokens, and a space that
precedes a non-space always opens one; so does the punctuation after a letter or
digit. Texts are cut there, each distinct word is encoded once by the tokenizers
library, and texts are assembled from the words' ids (Arrow finds the distinct words
of a batch, numpy looks them up and gathers). A worker keeps a bounded number of words
(``WORDS``) under 128-bit hashes of their bytes; results do not depend on it."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import mix

END = 2  # appended to every document
WORDS = 1_600_000
#: Texts are encoded in batches of about this many characters.
BATCH = 6 << 20
#: White space on which the library and Python may differ: such texts are encoded as a whole.
_ODD = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff]")
#: What may follow a word and is a pre-token of its own after a letter or digit; an apostrophe may not.
_AFTER = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain(text: str) -> bool:
    """Whether every space of the text opens a pre-token: a word follows it."""
    return not (text[-1] == " " or "  " in text or " \n" in text or " \t" in text or " \r" in text or _ODD.search(text))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PLACE = mix(np.arange(1, 129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 64) | np.uint64(1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
LONG = 60  # words of more bytes are encoded each time


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of byte strings of 1 to LONG bytes."""
    skip = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(skip, size)
    value = _BYTE[data[place + np.repeat(start, size)]]
    if not len(skip):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (mix(np.add.reduceat(value * row[place], skip) + size.astype(np.uint64) * np.uint64(2 * salt + 1)) for row in _PLACE)
    return a, b


class Encoder:
    """ids of texts; one per worker and vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")  # texts that hold one are encoded as a whole
        self.width = np.zeros(self.library.get_vocab_size(), np.int64)  # bytes of each id: one letter stands for each
        for token, i in self.library.get_vocab().items():
            self.width[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.slots = np.full(1 << 22, -1, np.int32)  # open addressing: word number by hash
        self.known = 0
        self.key = np.zeros((2, WORDS // 8), np.uint64)
        self.start = np.zeros(WORDS // 8, np.int64)
        self.size = np.zeros(WORDS // 8, np.int32)
        self.ids = np.zeros(1 << 20, np.int32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes; -1 where unknown."""
        out = np.full(len(a), -1, np.int64)
        live, slot = np.arange(len(a)), (a & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(live):
            got = self.slots[slot]
            full = got >= 0
            live, slot, got = live[full], slot[full], got[full]
            same = (self.key[0, got] == a[live]) & (self.key[1, got] == b[live])
            out[live[same]] = got[same]
            live, slot = live[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _keep(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers for new, distinct words with these hashes, numbers of ids, and ids in a row."""
        n, first = len(a), self.known
        while first + n > len(self.start):
            self.key = np.concatenate([self.key, np.zeros_like(self.key)], axis=1)
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        number = np.arange(first, first + n)
        self.key[0, number], self.key[1, number] = a, b
        self.size[number] = size
        self.start[number] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known += n
        todo, slot = number, (a & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & (len(self.slots) - 1)
        return number

    def _numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, space: str) -> np.ndarray:
        """Numbers of the words data[start : start + size] with ``space`` before them; new ones are encoded."""
        a, b = _hashes(data, start, size, len(space))
        out = self._find(a, b)
        new = np.flatnonzero(out < 0)
        if len(new):
            by = new[np.lexsort((b[new], a[new]))]
            fresh = np.append(True, (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]]))
            new = np.sort(by[fresh])
            for lo in range(0, len(new), 4096 if space else 1):  # a word's space opens a pre-token: words are encoded in a row, and cut by their bytes
                some = new[lo : lo + (4096 if space else 1)]
                each = [data[s : s + n].tobytes() for s, n in zip(start[some].tolist(), size[some].tolist(), strict=True)]
                ids = self.whole((space + space.join(x.decode() for x in each)) if space else each[0].decode())
                cut = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[some] + len(space)), side="left") + 1
                self._keep(a[some], b[some], np.diff(cut, prepend=0), ids)
            out = self._find(a, b)
        return out

    def _gather(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        skip = np.cumsum(size) - size
        return ids[np.arange(int(size.sum())) + np.repeat(start - skip, size)]

    def _batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Plain texts, not empty."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        if self.known > WORDS:
            self._reset()
        at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        start, full = at[:-1], np.diff(at)
        short = pc.binary_length(pc.utf8_rtrim(words, _AFTER)).to_numpy()
        # the rest is a pre-token of its own only after a letter or digit: ASCII, or Latin of two bytes
        last = data[np.maximum(start + short - 1, 0)] if len(data) else np.zeros(len(start), np.uint8)
        prior = data[np.maximum(start + short - 2, 0)] if len(data) else last
        latin = (prior == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) | (prior >= 0xC4) & (prior <= 0xC5) & (last >= 0x80)
        ascii_ = (last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 48) & (last <= 57)
        apart = (short > 0) & (short < full) & (ascii_ | latin)
        size = np.where(apart, short, full)
        begin, each = np.zeros(len(full), np.int64), np.zeros(len(full), np.int64)
        usual = (size > 0) & (full <= LONG)
        number = self._numbers(data, start[usual], size[usual], " ")
        tail = self._numbers(data, (start + short)[apart & usual], (full - short)[apart & usual], "")
        pair = np.zeros((int(usual.sum()), 2), np.int64)
        sizes = pair.copy()
        pair[:, 0], sizes[:, 0] = self.start[number], self.size[number]
        both = apart[usual]
        pair[both, 1], sizes[both, 1] = self.start[tail], self.size[tail]
        local = self._gather(self.ids, pair.ravel(), sizes.ravel())
        each[usual] = sizes.sum(axis=1)
        rare = np.flatnonzero((full > LONG)).tolist()
        if rare:  # long words
            more = [self.whole(" " + data[at[k] : at[k + 1]].tobytes().decode()) for k in rare]
            each[rare] = [len(x) for x in more]
        begin = np.cumsum(each) - each
        if rare:
            order = np.argsort(np.concatenate([np.flatnonzero(usual), rare]), kind="stable")
            parts = [*np.split(local, np.cumsum(each[usual])[:-1]), *more] if usual.any() else more
            local = np.concatenate([parts[i] for i in order.tolist()])
        size = each[which]
        size[offsets[:-1]] = 0  # the first word of a text has no space before it
        flat = self._gather(local, begin[which], size)
        ends = np.append(0, np.cumsum(size))[offsets]
        for i, text in enumerate(texts):
            yield np.concatenate([self.whole(text.split(" ", 1)[0]), flat[ends[i] : ends[i + 1]]])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of whole texts in order, without end ids; null texts are empty."""
        held: list[str] = []
        size = 0
        for t in texts:
            plain = bool(t) and _plain(t) and not self.added.search(t)
            if plain:
                held.append(t)
                size += len(t)
            if held and (not plain or size >= BATCH):
                yield from self._batch(held)
                held, size = [], 0
            if not plain:
                yield self.whole(t) if t else np.zeros(0, np.int32)
        if held:
            yield from self._batch(held)

    def documents(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of whole texts, each with the end id."""
        for ids in self.encode(texts):
            yield np.append(ids, np.int32(END))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
