import math
import re

import numpy as np

from mnemora.llm import language as L
from mnemora.llm.textkit import Words, hash_word


def corpus(n=120):
    rng = np.random.default_rng(7)
    words = {"en": "the and walking thing other house with".split(), "de": "der und gehen ding ander haus mit".split(), "fr": "le et marcher chose autre maison avec".split()}
    return [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(rng.choice(sorted(words), n))]


def brute(model_rows, text, least):
    """Scores of one text from plain dictionaries, by the stated rules."""
    langs = sorted({lang for _, _, lang in model_rows})
    tables, size = [{} for _ in range(L.LONGEST + 1)], [dict.fromkeys(langs, 0) for _ in range(L.LONGEST + 1)]

    def pieces(word, k):
        if not k:
            return [word]
        return [(word[i : i + k], i == 0, i == len(word) - k) for i in range(len(word) - k + 1)]

    for _, t, lang in model_rows:
        for w in re.findall(r"\w+", t.lower()):
            for k in range(L.LONGEST + 1):
                for p in pieces(w, k):
                    tables[k].setdefault(p, dict.fromkeys(langs, 0))[lang] += 1
                    size[k][lang] += 1
    tables = [{p: c for p, c in t.items() if sum(c.values()) >= least} for t in tables]
    f = lambda k, p, lang: math.log((tables[k][p][lang] + 0.5) / (size[k][lang] + 0.5 * len(tables[k])))
    score = dict.fromkeys(langs, 0.0)
    for w in re.findall(r"\w+", text.lower()):
        for k in (0, *range(L.LONGEST, 0, -1)):
            known = [p for p in pieces(w, k) if p in tables[k]]
            if known:
                for lang in langs:
                    score[lang] += np.mean([f(k, p, lang) for p in known]) * (L._WEIGHT if k else 1)
                break
    return [score[lang] for lang in langs]


def test_scores_equal_brute_force(spark):
    rows = corpus()
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least=2)
    texts = ["the walking und", "walkings houses thandere", "zzz 777", "maisonette avecx q", ""]
    got, _ = model.scores(texts)
    assert np.allclose(got, [brute(rows, t, 2) for t in texts])


def test_held_out_accuracy(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, lang if i % 2 else None) for i, t, lang in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.language for r in L.identify(spark, docs).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.98


def test_hashes_agree():
    w = Words(["word x"])
    owner, g = L.grams(w, np.array([0, 1]), 1)
    assert list(owner) == [0, 0, 0, 0, 1] and len(set(g)) == 5 and w.hashes()[0] == hash_word("word")


def test_odd_rows_and_empty(spark):
    odd = [(None, "the house", None), (500, None, "en"), (501, "", "de"), (502, "!!", "fr"), (0, corpus()[0][1], "en"), (503, "the and " * 100_000, None)]
    docs = spark.createDataFrame([(*r, 1) for r in corpus() + odd], "doc_id long, text string, lang string, language int")
    got = {r.doc_id: r for r in L.identify(spark, docs).collect()}
    assert got[None].language == "en" and got[503].language == "en"
    assert all(got[i].language is None and got[i].confidence == 0 for i in (500, 501, 502))
    assert L.identify(spark, docs.limit(0)).count() == 0
    nothing = L.identify(spark, docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()
    assert len(nothing) == docs.count() and all(r.language is None for r in nothing)


def test_of_equal_scores_the_first_language_in_the_alphabet_wins(spark):
    rows = [(i, "one two three four", lang) for i, lang in enumerate(["fr", "de", "en"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(spark, docs).collect()
    assert {r.language for r in got} == {"de"} and all(abs(r.confidence - 1 / 3) < 1e-6 for r in got)
