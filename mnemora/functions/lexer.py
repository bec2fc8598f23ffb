"""Keywords of whole texts by numpy, for the Arrow functions of ``functions.text``.

Words are lower-cased runs of letters.  Which words contain which is found once for the vocabulary of
a slice of texts, by the hashes of all parts of its words as long as one of them, and then applied
to the texts, so the cost follows the vocabulary rather than the texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from mnemora.functions.spans import Spans, code_points, flags, runs, slices

WORDS = pa.list_(pa.string())
COUNTS = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
#: Entries of the filter that parts of words are looked up in first.
_FILTER = 1 << 20


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; by a plain sort, which is faster than hashing or sorting rows."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Lexed(Spans):
    """The words of a slice of texts: of each distinct one (``word``) its string and place, and of each text its words."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int):
        super().__init__(code_points(text))
        self.owner, self.n = owner, n
        h = self.span_hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.hash, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.end = starts[first], ends[first]
        self.strings = [text[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]

    @classmethod
    def of_texts(cls, texts: Sequence[str | None]) -> Lexed:
        lowered = [t.lower() if t else "" for t in texts]
        text = "\n".join(lowered)
        starts, ends = runs(flags("L")[code_points(text)])
        begin = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        return cls(text, starts, ends, np.searchsorted(begin, starts, side="right") - 1, len(texts))

    @classmethod
    def of_lists(cls, lists: Sequence[list[str | None] | None]) -> Lexed:
        given = [(i, w) for i, ws in enumerate(lists) for w in ws or () if w is not None]
        lengths = np.array([len(w) for _, w in given], np.int64)
        ends = np.cumsum(lengths + 1) - 1 if len(given) else np.zeros(0, np.int64)
        return cls("\n".join(w for _, w in given), ends - lengths, ends, np.array([i for i, _ in given], np.int64), len(lists))

    def usable(self, min_len: int, stop: frozenset[str]) -> np.ndarray:
        """Whether each distinct word is long enough and no stop word."""
        return np.array([len(s) >= min_len and s not in stop for s in self.strings], bool)

    def contained(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, part): all pairs of distinct words in ``use`` of which the first strictly contains the second, by word."""
        which = np.flatnonzero(use)
        length = (self.end - self.start)[which]
        owner = np.repeat(which, length)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.start[which], length)
        room, whole = self.end[owner] - place, (self.end - self.start)[owner]
        v = max(len(self.strings), 1)
        found = [np.zeros(0, np.int64)]
        for n in np.unique(length):
            own = which[length == n]
            keys = self.hash[own]  # in order, as distinct words are
            bits = np.zeros(_FILTER, bool)
            bits[keys & np.uint64(_FILTER - 1)] = True
            at = np.flatnonzero((room >= n) & (whole > n))
            h = self.span_hash(place[at], place[at] + n)
            at, h = (x[maybe] for maybe in [np.flatnonzero(bits[h & np.uint64(_FILTER - 1)])] for x in (at, h))
            j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[j] == h
            found.append(owner[at[hit]] * v + own[j[hit]])
        pairs = distinct(np.concatenate(found))
        return pairs // v, pairs % v

    def pairs(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes text * words + word, occurrences) of the distinct words in ``use`` of each text, in order."""
        mine = use[self.word] if len(self.word) else np.zeros(0, bool)
        return np.unique(self.owner[mine] * max(len(self.strings), 1) + self.word[mine], return_counts=True)

    def maximal(self, codes: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Which of these (text, word) codes no other word of the same text contains."""
        holder, part = self.contained(use)
        v = max(len(self.strings), 1)
        word = codes % v
        low, high = np.searchsorted(holder, word), np.searchsorted(holder, word, side="right")
        many = high - low
        inner = part[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
        drop = distinct(np.repeat(codes - word, many) + inner)
        at = np.minimum(np.searchsorted(drop, codes), max(len(drop) - 1, 0))
        return drop[at] != codes if len(drop) else np.ones(len(codes), bool)

    def lists(self, codes: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """(offsets, words) of codes that are sorted by text."""
        v = max(len(self.strings), 1)
        offsets = np.searchsorted(codes // v, np.arange(self.n + 1)).astype(np.int32)
        return pa.array(offsets), pa.array(self.strings, pa.string()).take(pa.array(codes % v))

    def by_length(self, codes: np.ndarray) -> np.ndarray:
        """Codes by text, longer words first, then alphabetical."""
        v = max(len(self.strings), 1)
        rank = np.empty(v, np.int64)
        alphabetical = np.array(sorted(range(len(self.strings)), key=self.strings.__getitem__), np.int64)
        rank[alphabetical[np.argsort((self.start - self.end)[alphabetical], kind="stable")]] = np.arange(len(self.strings))
        return codes[np.lexsort((rank[codes % v], codes // v))]


def _by_slices(texts: pa.Array, kind: pa.DataType, step) -> pa.Array:
    rows = texts.to_pylist()
    sizes = rows if not pa.types.is_list(texts.type) else ["x" * sum(len(w or "") + 1 for w in ws or ()) for ws in rows]
    parts = [step(rows[a:b]) for a, b in slices(sizes)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def keyword_lists(texts: pa.Array, min_len: int, stop: frozenset[str]) -> pa.Array:
    """The distinct usable words of each text that no other one contains, longest first, then alphabetical."""

    def step(rows):
        x = Lexed.of_texts(rows)
        use = x.usable(min_len, stop)
        codes, _ = x.pairs(use)
        return pa.ListArray.from_arrays(*x.lists(x.by_length(codes[x.maximal(codes, use)])), type=WORDS)

    return _by_slices(texts, WORDS, step)


_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]{2,}")
_LETTERS = re.compile(r"[^\W\d_]+")


def learnable(texts: Sequence[str | None], min_len: int, stop: frozenset[str]) -> list[list[str]]:
    """What each text teaches: its keywords, or if it has Han runs their bigrams and its other words, in order."""
    plain = keyword_lists(pa.array([None if t is None or _HAN.search(t) else t for t in texts], pa.string()), min_len, stop).to_pylist()
    for i, t in enumerate(texts):
        if t is not None and _HAN.search(t):
            pairs = [r[j : j + 2] for r in _HAN.findall(t) for j in range(len(r) - 1)]
            others = [w for w in _LETTERS.findall(t.lower()) if not any("\u3400" <= c for c in w)]
            plain[i] = [w for w in dict.fromkeys(pairs + others) if len(w) >= min_len and w not in stop]
    return plain


def learnable_lists(texts: pa.Array, min_len: int, stop: frozenset[str]) -> pa.Array:
    return pa.array(learnable(texts.to_pylist(), min_len, stop), WORDS)


def word_counts(texts: pa.Array) -> pa.Array:
    """All distinct words of each text with their numbers of occurrences."""

    def step(rows):
        x = Lexed.of_texts(rows)
        codes, n = x.pairs(np.ones(len(x.strings), bool))
        offsets, words = x.lists(codes)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([words, pa.array(n.astype(np.int32))], ["word", "n"]), type=COUNTS)

    return _by_slices(texts, COUNTS, step)


def maximal_lists(lists: pa.Array) -> pa.Array:
    """The words of each list, in its order, that aren't strictly contained in another one of it; nulls are left out."""

    def step(rows):
        x = Lexed.of_lists(rows)
        v = max(len(x.strings), 1)
        use = np.array([len(s) > 0 for s in x.strings], bool)
        codes = x.owner * v + x.word
        keep = x.maximal(codes, use) if len(codes) else np.zeros(0, bool)
        offsets = np.searchsorted(x.owner[keep], np.arange(x.n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.strings, pa.string()).take(pa.array(x.word[keep])), type=WORDS)

    return _by_slices(lists, WORDS, step)
