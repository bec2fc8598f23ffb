"""Cells counted by tiles against brute force, with many blocks and with words counted in pieces."""

import itertools
import math
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.operators import cooc, tiles
from mnemora.plans import queries as Q


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    words = [f"{c}{chr(97 + i)}z" for c in "aéж" for i in range(12)]
    return [rng.sample(words, rng.choice((1, 3, 20))) for _ in range(80)] + [["once", "aaz"], ["twice", "abz"], ["twice", "écz"], [], None]


def _cells(docs, least):
    n = {}
    for d in docs:
        for p in itertools.combinations_with_replacement(sorted(set(d or ())), 2):
            n[p] = n.get(p, 0) + 1
    return {p: c for p, c in n.items() if c >= least}


def _got(df):
    rows = [tuple(r) for r in df.collect()]
    got = {r[:-1]: r[-1] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("width, piece", [(None, 1 << 19), (7, 1 << 19), (7, 40), (1, 5)])
def test_cells_and_scores(spark, docs, monkeypatch, width, piece):
    monkeypatch.setattr(tiles, "_PIECE", piece)
    terms = spark.createDataFrame([(d,) for d in docs], "words array<string>").repartition(3)
    t = tiles.tiles(terms, 3, width=width)
    c = _cells(docs, 3)
    assert _got(t.cells()) == c
    ppmi = {(a, b): math.log2(n * len(docs) / (c[a, a] * c[b, b])) for (a, b), n in c.items() if a != b}
    ppmi = {p: s for p, s in ppmi.items() if s > 0}
    assert _got(t.ppmi()) == pytest.approx(ppmi)
    some = spark.createDataFrame([("adz",), ("жfz",), ("abz",), ("none",)], "w string")
    assert {tuple(sorted(p)): s for p, s in _got(t.ppmi_of(some)).items()} == pytest.approx({p: s for p, s in ppmi.items() if {*p} & {"adz", "жfz", "abz"}})
    both = {(x, y): n / c[x, x] for (a, b), n in c.items() for x, y in {(a, b), (b, a)}}
    assert _got(t.conditional()) == pytest.approx(both)
    assert _got(t.conditional_of(some)) == pytest.approx({p: v for p, v in both.items() if p[0] in ("adz", "жfz", "abz")})
    sums = {r.w: (r.cells, r.total) for r in t.sums().collect()}
    mirrored = {(x, y): n for (a, b), n in c.items() for x, y in {(a, b), (b, a)}}
    for w in {a for a, _ in mirrored}:
        own = [n for (a, _), n in mirrored.items() if a == w]
        assert sums[w] == (len(own), sum(own))


def test_no_table_of_cells(spark, docs, monkeypatch, tmp_path):
    """Sums, stats and rows of some words are had without a row for each pair or cell."""
    for f in ("pairs", "build", "mirror"):
        monkeypatch.setattr(cooc, f, lambda *a, **k: pytest.fail("pairs of words became rows"))
    monkeypatch.setattr(tiles.Tiles, "cells", lambda *a: pytest.fail("cells became rows"))
    told = [(i, " ".join(d or ()), "en", "s") for i, d in enumerate(docs)]
    spark.createDataFrame(told, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = Q._doc_terms(spark, str(tmp_path)).collect()
    c = _cells([r.words for r in kept], 1)
    got = {r.word: (r.cells, r.total) for r in Q.cooc_build_documents(spark, str(tmp_path)).collect()}
    rows = {}
    for (a, b), n in c.items():
        for w in {a, b}:
            k, s = rows.get(w, (0, 0))
            rows[w] = (k + 1, s + n)
    assert got == rows
    assert Q.cooc_stats_documents(spark, str(tmp_path)).first().nnz == sum(k for k, _ in rows.values())
    assert isinstance(Q.cleanup_vocab_documents(spark, str(tmp_path)), DataFrame)
    assert Q.remove_words_documents(spark, str(tmp_path)).where(F.col("cells") > 0).count() > 0


def test_evidence_without_window(spark):
    """The best entry for a word is found by sums before the shuffle; a window held all hits of a word in one task."""
    from mnemora.operators import search

    index = spark.createDataFrame([("ab", "2"), ("ab", "10"), ("abc", "1"), ("cd", "3")], "keyword string, entry_id string")
    entries = spark.createDataFrame([(i, "t", "s") for i in ("1", "2", "3", "10")], "id string, topic string, summary string")
    got = search.evidence(spark.createDataFrame([("ab",), ("bc",), ("zz",)], "word string"), index, entries)
    assert sorted((r.word, r.entry_id) for r in got.collect()) == [("ab", "10"), ("bc", "1")]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_texts_of_contenders_alone(spark, monkeypatch):
    from mnemora.operators import search

    hits = spark.createDataFrame([("q", str(i), float(i), 0.0, 0.0) for i in range(40)], "query_id string, entry_id string, exact double, fuzzy double, assoc double")
    entries = spark.createDataFrame([(str(i), 0.0, 3, [], "word" if i in (30, 36) else "", "") for i in range(40)], "id string, timestamp double, importance int, keywords array<string>, summary string, body string")
    supplement = spark.createDataFrame([("q", ["word"])], "query_id string, words array<string>")
    near = search._contenders(hits, entries.withColumnRenamed("id", "entry_id"), 0.0, 3, 0.1)
    assert {int(r.entry_id) for r in near.collect()} == set(range(25, 40))
    got = search.score(hits, entries, 0.0, 3, supplement=supplement).orderBy("rank").collect()
    assert [(r.entry_id, r.final_score) for r in got] == [("36", 54.0), ("30", 45.0), ("39", 39.0)]


def test_graph_of_tiles(spark, docs, monkeypatch):
    """Ranks, components and paths over many tiles are those of the operators over a table of edges, which they don't make."""
    from mnemora.operators import assoc, graph

    terms = spark.createDataFrame([(d,) for d in docs], "words array<string>")
    t = tiles.tiles(terms, 3, width=7)
    table = spark.createDataFrame([(*p, float(n)) for p, n in _cells(docs, 3).items()], "a string, b string, n double")
    plain = graph.edges(spark.createDataFrame(assoc.ppmi(table, t.docs).collect()))
    anchors = sorted(r.src for r in plain.select("src").distinct().collect())[:3]
    ranks, paths = _got(graph.pagerank(plain, anchors)), sorted(map(tuple, graph.shortest_paths(plain, anchors, anchors).collect()))
    monkeypatch.setattr(graph, "edges", lambda *a: pytest.fail("the graph became a table"))
    g = tiles.Edges.of(t, 0.1)
    number = g.numbers(anchors)
    assert _got(g.vector("rank", *graph.tiled_pagerank(g, list(number.values())))) == pytest.approx(ranks)
    got = sorted(map(tuple, graph.tiled_paths(g, anchors).collect()))
    assert len(got) == len(paths) and [p[3] for p in got] == [p[3] for p in paths]
    assert [p[2] for p in got] == pytest.approx([p[2] for p in paths]) and [p[4:] for p in got] == [p[4:] for p in paths]
    assert set(_got(g.vector("near", *[graph.tiled_reachable(g, [number[anchors[0]]])] * 2).select("node", F.lit(1)))) <= set(ranks)


def test_decay_drops_and_waits(spark):
    """A cell that falls under 0.5 in a long gap begins anew, in tiles as in the table of epochs; pairs are summed up by batch."""
    import numpy as np

    rng = random.Random(2)
    every, done, most = [], 900, 1000
    for cell in range(30):
        for e in rng.sample(range(1, 902), rng.choice((1, 2, 5, 60))):
            every += [(cell, e)] * rng.choice((1, 1, 3))
    expected = {}
    for cell in range(30):
        own = [e for c, e in every if c == cell]
        v = 0.0
        for e in range(1, done + 2):
            v += own.count(e)
            if e <= done:
                v *= 0.995
                v = 0.0 if v < 0.5 else v
        if len(own) >= 2 and v > 0:
            expected[cell] = v
    key, value = tiles._folded(np.array([c * most + e for c, e in every]), most, 2, 0.005, done)
    assert dict(zip(key.tolist(), value.tolist())) == pytest.approx(expected)
    terms = spark.createDataFrame([(1, ["b", "a", "a"]), (1, ["a", "b", "c"]), (2, ["c"]), (2, None)], "e int, words array<string>").coalesce(1)
    assert _got(tiles.pairs_by_epoch(terms)) == {("a", "a", 1): 2, ("a", "b", 1): 2, ("b", "b", 1): 2, ("a", "c", 1): 1, ("b", "c", 1): 1, ("c", "c", 1): 1, ("c", "c", 2): 1}
