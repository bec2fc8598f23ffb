import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm.textkit import Words, hash_word, slices

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB cé\n.1_ßÉ", max_size=40), min_size=1, max_size=5))
def test_words_equal_regex(texts):
    w = Words(texts)
    lower = "".join(map(chr, w.cps))
    got = [[] for _ in texts]
    for s, e, d in zip(w.starts, w.ends, w.doc):
        got[d].append(lower[s:e])
    assert got == [[x.lower() for x in WORD.findall(t)] for t in texts]
    assert list(w.hashes()) == [hash_word(x) for ws in got for x in ws]


def test_shingles_depend_on_order_only_within_text():
    w = Words(["a b c", "b a c", "a b c d", "x", ""])
    s, d = w.shingles(3)
    by = [set(s[d == i]) for i in range(5)]
    assert by[0] != by[1] and by[0] < by[2] and len(by[2]) == 2 and len(by[3]) == 1 and not by[4]


def test_none_and_long_text():
    w = Words([None, "word " * 300_000, "end"])
    assert list(np.diff(w.first)) == [0, 300_000, 1]
    assert list(slices([None, "x" * 10, "y" * 3], 8)) == [(0, 1), (1, 2), (2, 3)]
