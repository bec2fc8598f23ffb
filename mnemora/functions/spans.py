"""Hashes of spans of code points, for whole texts in bounded slices.

Prefix sums make the hash of any span a difference of two numbers, so all words, shingles or
substrings of a slice are hashed by numpy at once.  A slice holds a bounded number of code points (or
one longer text), so a worker's memory doesn't depend on its partition; nothing truncates a text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points per slice; a longer text makes a slice of its own.
SLICE_CHARS = 1_000_000
#: No letters, numbers or marks are assigned beyond this code point.
_ASSIGNED = 0x32400
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def codes() -> np.ndarray:
    """A random 64-bit code for each code point."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 0x110001, dtype=np.uint64) * _P)


@lru_cache(maxsize=4)
def flags(kinds: str) -> np.ndarray:
    """Whether each code point's general category begins with one of these letters."""
    out = np.zeros(0x110000, dtype=bool)
    out[:_ASSIGNED] = [unicodedata.category(chr(c))[0] in kinds for c in range(_ASSIGNED)]
    return out


@lru_cache(maxsize=1)
def blanks() -> np.ndarray:
    """Whether each code point is white space."""
    out = np.zeros(0x110000, dtype=bool)
    out[:0x3001] = [chr(c).isspace() for c in range(0x3001)]
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power(kind: str, n: int) -> np.ndarray:
    """First n powers of the hash base ("up") or of its inverse ("down"), modulo 2**64."""
    if len(_powers[kind]) < n:
        m = 1 << (n - 1).bit_length()
        base = np.full(m, _P if kind == "up" else _PINV, np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


class Spans:
    """Code points whose spans can be hashed; equal spans have equal hashes wherever they are."""

    def __init__(self, cps: np.ndarray):
        self.cps = cps
        self._prefix: np.ndarray | None = None

    def prefix(self) -> np.ndarray:
        """Prefix sums of code * base**position."""
        if self._prefix is None:
            n = len(self.cps)
            out = np.zeros(n + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(codes()[self.cps] * power("up", max(n, 1))[:n], out=out[1:])
            self._prefix = out
        return self._prefix

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = self.prefix()
        with np.errstate(over="ignore"):
            return mix((p[ends] - p[starts]) * power("down", max(len(self.cps), 1))[starts])


def hash_text(text: str) -> int:
    """The hash that ``span_hash`` gives a span with this text."""
    cps = code_points(text)
    with np.errstate(over="ignore"):
        total = (codes()[cps] * power("up", max(len(cps), 1))[: len(cps)]).sum(dtype=np.uint64)
    return int(mix(np.array([total], np.uint64))[0])


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True."""
    padded = np.zeros(len(flag) + 2, np.int8)
    padded[1:-1] = flag
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[0::2], edge[1::2]


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with at most ``chars`` code points (or one text)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if i > at and total + n > chars:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)
