"""Which words contain which, against brute force and without sorting rows."""

import random

import numpy as np

from mnemora.functions.lexer import Lexed, distinct


def test_contained_by_brute_force(monkeypatch):
    unique = np.unique

    def flat(x, *args, axis=None, **how):
        assert axis is None, "sorting rows of pairs took more than half the time of keyword extraction"
        return unique(x, *args, **how)

    monkeypatch.setattr(np, "unique", flat)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcß") for _ in range(rng.randrange(1, 7))) for _ in range(40)) for _ in range(5)]
    x = Lexed.of_texts([*texts, None, ""])
    use = x.usable(2, frozenset(["ab"]))
    whole, part = x.contained(use)
    got = [(x.strings[a], x.strings[b]) for a, b in zip(whole, part)]
    words = [w for w, u in zip(x.strings, use) if u]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a != b and b in a}
    assert sorted(whole) == list(whole)
    codes, _ = x.pairs(use)
    named = [x.strings[c % len(x.strings)] for c in x.by_length(codes[codes // len(x.strings) == 0])]
    assert named == sorted(named, key=lambda w: (-len(w), w))


def test_distinct():
    assert distinct(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3] and len(distinct(np.zeros(0, np.int64))) == 0
