"""Vectorised tokenisation and hashing of whole texts, shared by the text operators.

Texts are processed in bounded slices of code points with numpy, so a worker's memory depends on
the slice size (or the one longest text), never on the size of the partition.  Nothing here
truncates a text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from mnemora.functions.spans import Spans, code_points, flags, hash_text, mix, runs, slices  # noqa: F401

_Q = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower-case map of code points (those with a single one)."""
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        s = chr(c)
        low = s.lower()
        if low != s and len(low) == 1:
            lower[c] = ord(low)
    return lower


class Words(Spans):
    """The words (runs of letters, digits and marks, lower-cased) of a slice of texts.

    ``cps`` lower-cased code points of all texts joined by line feeds; ``starts``/``ends`` of each
    word in them; ``doc`` the text's index; ``first`` the index of each text's first word, with
    one more entry for the end; ``begin`` where each text begins in ``cps``, likewise.
    """

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.raw = code_points("\n".join(texts))
        super().__init__(_lower()[self.raw])
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.begin = np.concatenate(([0], np.cumsum(lengths)))
        self.starts, self.ends = runs(flags("LNM")[self.raw])
        self.first = np.searchsorted(self.starts, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.n_docs = len(texts)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def shingles(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` consecutive words in a text, and that text's index.

        A text of fewer words (but at least one) gives a single shingle of all its words.
        """
        h = self.hashes() if hashes is None else hashes
        n = len(h)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        count = np.diff(self.first)
        stop = self.first[1:][self.doc]  # where the word's text ends
        with np.errstate(over="ignore"):
            for j in range(min(width, n)):
                m = n - j
                inside = (np.arange(m) + j) < stop[:m]
                out[:m] = np.where(inside, out[:m] * _Q + h[j:] + np.uint64(j + 1), out[:m])
        position = np.arange(n) - self.first[:-1][self.doc]
        keep = (position + width <= count[self.doc]) | (position == 0)
        return mix(out[keep]), self.doc[keep]


def hash_word(word: str) -> int:
    """The hash that ``Words.hashes`` gives this one (lower-cased) word."""
    return hash_text(word.lower())
