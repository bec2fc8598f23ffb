import random
import re

import pytest

from mnemora.llm import decontamination as D

WORD = re.compile(r"[^\W_]+")


def shingles(text, k):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items, share=0.5, width=5):
    out = set()
    for i, t in docs:
        for j, x in items:
            n = len(WORD.findall((x or "").lower()))
            if n:
                k = min(width, n)
                own = shingles(x, k)
                c = len(own & shingles(t, k)) / len(own)
                if c >= share:
                    out.add((i, j, round(c, 6)))
    return out


def fixture(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "er", "ing", "ou", "ti", "ea")]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(j, text(rng.choice([1, 2, 3, 4, 5, 8, 17, 40, 90]))) for j in range(60)] + [(60, None), (61, ""), (62, "?!")]
    docs = []
    for i in range(150):
        words = text(rng.choice([3, 50, 400])).split()
        if i % 2:
            passage = items[rng.randrange(60)][1].split()
            a = rng.randrange(len(passage))
            part = passage[a:] if i % 4 == 1 else passage
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((i, ", ".join(words) + "."))
    return docs, items


def test_equals_exact_containment(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    got = {(r.doc_id, r.item_id, round(r.containment, 6)) for r in D.find_contamination(spark, d, b).collect()}
    assert len(expected) > 60 and got <= expected and len(got) >= 0.99 * len(expected)
    sliced = {(r.doc_id, r.item_id, round(r.containment, 6)) for r in D.find_contamination(spark, d, b, slice_chars=500).collect()}
    assert sliced == got
    kept = D.drop_contaminated(spark, d, b)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {i for i, _, _ in got})


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, None), (2, ""), (None, f"x {item} y"), (3, item.upper()), (3, item.upper()), (4, "word " * 200_000 + item)]
    d = spark.createDataFrame([(*r, 7, "z") for r in docs], "doc_id long, text string, item_id long, containment string")
    b = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None)], "item_id long, text string")
    got = sorted(((r.doc_id or 0), (r.item_id or 0)) for r in D.find_contamination(spark, d, b).collect())
    assert got == sorted([(i, j) for i in (0, 3, 3, 4) for j in (0, 1, 1)])
    kept = D.drop_contaminated(spark, d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


@pytest.mark.parametrize("which", ["docs", "items"])
def test_empty(spark, which):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    d, b = (d.limit(0), b) if which == "docs" else (d, b.limit(0))
    assert D.find_contamination(spark, d, b).count() == 0
    assert D.drop_contaminated(spark, d, b).count() == d.count()
