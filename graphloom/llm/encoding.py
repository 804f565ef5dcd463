"""Encoding of whole texts by public tokenizers, each different stretch between spaces only once per worker."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np

from .common import keep


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


ENTRIES = 450_000  # stretches of a generation


class _Places(dict):
    """A number for every key, given on first sight; new holds the keys since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = n = len(self)
        return n


class StretchEncoder:
    """Ids of texts, put together from ids of stretches that the tokenizer treats independently of each other.

    cut(text) gives the stretches of a text; a tuple is a stretch as it stands, a string one that lead stands before. encode(list of
    strings) gives their ids in a row and where each string's begin. Results are kept in two generations of at most about `entries`
    stretches: when the young one is full it becomes the old one, and what is met again moves over, so common stretches stay and memory
    is bounded.
    """

    def __init__(self, cut: Callable[[str], list], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], lead: str = "", entries: int = ENTRIES):
        self.cut, self.encode, self.lead, self.entries = cut, encode, lead, entries
        self._begin()
        self.old: tuple[dict, np.ndarray, np.ndarray, np.ndarray] = ({}, self.flat[:0], self.start[:0], self.length[:0])

    def _begin(self) -> None:
        self.place = _Places()
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.used = 0
        self.start, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)

    def _age(self) -> None:
        n = len(self.place)
        self.old = self.place, self.flat[: self.used].copy(), self.start[:n].copy(), self.length[:n].copy()
        self._begin()

    def _store(self, at: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), dtype=np.uint32)])
        self.flat[self.used : self.used + total] = ids
        self.start[at] = self.used + np.cumsum(lengths) - lengths
        self.length[at] = lengths
        self.used += total

    def _learn(self) -> None:
        """Ids of the new stretches, from the old generation or by encoding; their places are the last ones."""
        new, self.place.new = self.place.new, []
        n = len(self.place) - len(new)
        while n + len(new) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(len(x), dtype=x.dtype)]) for x in (self.start, self.length))
        place, flat, start, length = self.old
        if place:
            was = np.fromiter((place.get(k, -1) for k in new), dtype=np.int64, count=len(new))
            known = np.flatnonzero(was >= 0)
            lengths = length[was[known]].astype(np.int64)
            ends = np.cumsum(lengths)
            self._store(n + known, flat[np.repeat(start[was[known]] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths)
            fresh = np.flatnonzero(was < 0)
        else:
            fresh = np.arange(len(new))
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            ids, begin = self.encode([k[0] if type(k) is tuple else self.lead + k for k in map(new.__getitem__, part.tolist())])
            self._store(n + part, ids, np.diff(begin))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more entry than texts)."""
        if len(self.place) > self.entries:
            self._age()
        parts = list(map(self.cut, texts))
        counts = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)), out=counts[1:])
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(counts[-1]))
        if self.place.new:
            self._learn()
        lengths = self.length[place]
        ends = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=ends[1:])
        shift = self.start[place] - ends[:-1]
        ids = self.flat[np.repeat(shift, lengths) + np.arange(ends[-1])]
        return ids, ends[counts]


def in_a_row(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    begin = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)), out=begin[1:])
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(begin[-1])), begin


def _joined(path: str, join: str, size: Callable[[str], int], easy: Callable[[str], bool], end: str = "") -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """An encoder of many stretches in one call: the tokenizer gets them joined, and the bytes that each id stands for tell where each
    stretch's ids end. Stretches that aren't easy are encoded one by one, and all are where an end isn't met.

    size(stretch) gives the bytes that its ids stand for; end is what ids at the end of a word have in their name besides.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    vocabulary = t.get_vocab()
    of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for name, i in vocabulary.items():
        of[i] = len(name.removesuffix(end) if end else name)  # the names write every byte as one character

    def single(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return in_a_row([e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)])

    def encode(stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        mask = np.fromiter(map(easy, stretches), dtype=bool, count=len(stretches))
        some = [s for s, m in zip(stretches, mask.tolist(), strict=True) if m]
        if not some:
            return single(stretches)
        ids = np.array(t.encode_batch_fast([join.join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.concatenate(([0], np.cumsum(of[ids])))
        wanted = np.cumsum(np.fromiter(map(size, some), dtype=np.int64, count=len(some)))
        at = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
        if (ends[at] != wanted).any() or at[-1] != len(ids):
            return single(stretches)
        rest, begin = single([s for s, m in zip(stretches, mask.tolist(), strict=True) if not m])
        start, length = np.zeros(len(stretches), np.int64), np.zeros(len(stretches), np.int64)
        length[mask], length[~mask] = np.diff(at, prepend=0), np.diff(begin)
        start[mask], start[~mask] = at - length[mask], len(ids) + begin[:-1]
        out = np.concatenate(([0], np.cumsum(length)))
        return np.concatenate([ids, rest])[np.repeat(start - out[:-1], length) + np.arange(out[-1])], out

    return encode


# Added tokens of these tokenizers begin so. They are taken out of a text before its pattern applies, so a stretch that may hold one
# is encoded by itself; none holds or takes in white space, so texts may still be cut at spaces.
ADDED = "<|"


def _cut_at_spaces(text: str) -> list:
    """A byte-level pattern never joins a single space to what stands before it, so a text falls apart before each one.

    Runs of spaces may become one token, and so may white space before an added token, so a text with either is one stretch.
    """
    if not text:
        return []
    if "  " in text or ADDED in text:
        return [(text,)]
    parts: list = text.split(" ")
    parts[0] = (parts[0],)
    return parts


def _cut_dropping_spaces(text: str) -> list:
    return [w for w in text.replace("\n", " ").split(" ") if w]


def byte_level(path: str, entries: int = ENTRIES) -> StretchEncoder:
    """Byte-level BPE: a stretch begins with the space before it, so joined ones fall apart before each space as a text does."""
    easy = lambda s: len(s) > 1 and s[0] == " " and not s[1].isspace() and not s[-1].isspace() and ADDED not in s
    size = lambda s: len(s) if s.isascii() else len(s.encode())
    return StretchEncoder(_cut_at_spaces, _joined(path, "", size, easy), lead=" ", entries=entries)


def word_level(path: str, entries: int = ENTRIES) -> StretchEncoder:
    """For a tokenizer that normalises to NFC and lower case, drops white space and never joins words."""

    def size(s: str) -> int:
        if s.isascii():
            return len("".join(s.split()))
        return len("".join(unicodedata.normalize("NFC", s).lower().split()).encode())

    # Python lowers a sigma by its place in the word, the tokenizer doesn't.
    easy = lambda s: s.isascii() and ADDED not in s or "\u03a3" not in s and ADDED not in s
    return StretchEncoder(_cut_dropping_spaces, _joined(path, " ", size, easy, "</w>"), entries=entries)


KINDS: dict[str, Callable[[str, int], StretchEncoder]] = {"byte": byte_level, "word": word_level}
_OPEN: dict[tuple[str, str, int], StretchEncoder] = {}


def encoder(kind: str, path: str, entries: int = ENTRIES) -> StretchEncoder:
    """One encoder per worker process. entries bounds its memory, by some 150 bytes a stretch in each of four stores."""
    keep("encoders", _OPEN.clear)
    if (kind, path, entries) not in _OPEN:
        _OPEN.clear()
        _OPEN[kind, path, entries] = KINDS[kind](path, entries)
    return _OPEN[kind, path, entries]
