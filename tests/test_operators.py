import itertools
import math

import pytest
from pyspark.sql import functions as F

from mnemora.functions import scoring, text
from mnemora.operators import assoc, cooc, episodic, graph, hops, search, store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def terms(spark):
    data = [(1, "doc", ["a", "b"]), (2, "doc", ["a", "b", "c"]), (3, "doc", ["c", "d"])]
    return spark.createDataFrame(data, "doc_seq long, channel string, words array<string>")


@pytest.fixture(scope="module")
def cells(spark, terms):
    return spark.createDataFrame(cooc.build(terms).collect(), "a string, b string, n double")


def test_cooccurrence(terms, cells):
    assert rows(cells) == [("a", "a", 2), ("a", "b", 2), ("a", "c", 1), ("b", "b", 2), ("b", "c", 1), ("c", "c", 2), ("c", "d", 1), ("d", "d", 1)]
    assert cooc.total_docs(terms) == 3
    assert rows(cooc.prune(cells, 2)) == [("a", "a", 2), ("a", "b", 2), ("b", "b", 2), ("c", "c", 2)]
    assert rows(cooc.prune(cooc.build(cooc.prefilter(terms, 2)), 2)) == rows(cooc.prune(cells, 2))
    s = cooc.stats(cells, 3).first()
    assert (s.total_docs, s.vocab_size, s.nnz, s.density) == (3, 4, 12, 0.75)


def test_ppmi_and_conditional(cells):
    got = rows(assoc.ppmi(cells, 3))
    assert [r[:2] for r in got] == [("a", "b"), ("c", "d")] and all(abs(r[2] - math.log2(1.5)) < 1e-9 for r in got)
    assert rows(assoc.ppmi(cells, 0)) == rows(cells)
    p = {r[:2]: r[2] for r in rows(assoc.conditional(cells))}
    assert (p["a", "b"], p["c", "a"], p["d", "c"], p["c", "d"], p["a", "a"]) == (1.0, 0.5, 1.0, 0.5, 1.0)
    assert [r.a + r.b for r in assoc.top_associations(assoc.ppmi(cells, 3), 0, 9, 3).collect()] == ["ab", "ba", "cd"]


def test_cleanup(cells):
    assert rows(cooc.word_frequency(cells)) == [("a", 10), ("b", 10), ("c", 10), ("d", 4)]
    assert rows(cooc.cleanup(cells, 5)) == [("d",)]
    assert rows(cooc.cleanup(cells, 5, 2)) == [("c",), ("d",)]
    assert rows(cooc.remove_words(cells, cooc.cleanup(cells, 5, 2))) == [("a", "a", 2), ("a", "b", 2), ("b", "b", 2)]


def brute_decay(terms, rate, interval):
    v, docs = {}, 0
    for seq, channel, ws in terms:
        for a, b in itertools.combinations_with_replacement(sorted(set(ws)), 2):
            v[a, b] = v.get((a, b), 0) + 1
        if channel == "doc":
            docs += 1
            if docs % interval == 0:
                v = {k: x * (1 - rate) for k, x in v.items() if x * (1 - rate) >= 0.5}
    return v, docs


def test_decay_equals_step_by_step(spark):
    terms, docs = [], 0
    for i in range(60):
        if i % 7 == 3:
            terms.append((docs, "kw", ["a", "x"]))
        else:
            docs += 1
            terms.append((docs, "doc", [["a", "b"], ["b", "c", "d"], ["d", "e"]][i * i % 3] if i % 11 else ["z", "y"]))
    for rate, interval in ((0.5, 2), (0.3, 5), (0.05, 7)):
        expected, n = brute_decay(terms, rate, interval)
        got = cooc.decayed(spark.createDataFrame(terms, "doc_seq long, channel string, words array<string>"), rate, interval, n)
        assert {(r.a, r.b): round(r.n, 9) for r in got.collect()} == {k: round(x, 9) for k, x in expected.items()}


def test_substring_dedupe_and_keywords(spark):
    df = spark.createDataFrame([(["特斯", "斯拉", "特斯拉", "市场"],), (["ab", "abc", "x" * 60, "xxx", "yy"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(text.drop_contained(F.col("w"))).collect()]
    assert got == [["特斯拉", "市场"], ["abc", "x" * 60, "yy"], []]
    k = spark.createDataFrame([("The cat's catalog: CAT logs",), (None,), ("",)], "t string").select(text.keywords("t")).collect()
    assert [r[0] for r in k] == [["catalog", "logs"], [], []]


def test_numbering(spark):
    df = cooc.number_documents(spark.createDataFrame([(i * 3 % 101,) for i in range(101)], "k long"), "k")
    assert rows(df, "k", "doc_seq") == [(i, i + 1) for i in range(101)]


INDEX = [("贸易战", "1"), ("国际贸易", "2"), ("贸易", "3"), ("战", "4")]


def test_fuzzy_equals_brute_force(spark):
    index = spark.createDataFrame(INDEX, "keyword string, entry_id string")
    words = ["贸易", "贸易战", "战", "贸易战争", "无"]
    q = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "query_id int, word string")
    expected = []
    for i, w in enumerate(words):
        for k, e in INDEX:
            if w != k and (w in k or k in w):
                expected.append((i, e, round(len(w) / len(k) if w in k else len(k) / len(w) * 0.8, 6)))
    assert rows(search.fuzzy(q, index).withColumn("score", F.round("score", 6))) == sorted(expected)
    assert (0, "1", round(2 / 3, 6)) in expected and (1, "3", round(2 / 3 * 0.8, 6)) in expected
    assert rows(search.exact(q, index)) == [(0, "3", 1), (1, "1", 1), (2, "4", 1)]


def test_scores(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(scoring.merge_association(F.lit(2.0), F.lit(0.9), F.lit(1.0), F.lit(0.5))) == pytest.approx(1.4)
    assert v(scoring.final_score(F.lit(2.2), F.lit(1.0), F.lit(1.0), F.lit(5))) == pytest.approx(3.6667)
    table = {3: [1.00, 0.91, 0.59, 0.25, 0.09, 0.027], 5: [1.00, 0.94, 0.70, 0.36, 0.14, 0.044]}
    for imp, ws in table.items():
        for d, w in zip((0, 1, 7, 30, 100, 365), ws):
            assert v(scoring.time_weight(F.lit(-86400.0 * d), F.lit(imp), 0.0)) == pytest.approx(w, abs=0.012)
    bonus = scoring.supplement_bonus(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("x")), F.lit("none"), F.lit(None).cast("string"))
    assert v(bonus) == 1.25


def test_entries_fold(spark):
    p = lambda imp: ("knowledge", "t", None, None, "s", None, ["k", "t"], 1.0, "1970-01-01", imp, None, False)
    ops = [(1, "add", "m", 0.0, None, p(3)), (2, "demote", "m", 0.0, None, None), (3, "set_imp", "m", 0.0, 9, None), (4, "demote", "m", 0.0, None, None), (5, "access", "m", 7.0, None, None), (6, "access", "m", 5.0, None, None), (7, "add", "n", 0.0, None, p(1)), (8, "demote", "n", 0.0, None, None), (9, "demote", "ghost", 0.0, None, None), (10, "add", "r", 0.0, None, p(3)), (11, "remove", "r", 0.0, None, None)]
    from mnemora import schema

    e = store.current_entries(spark.createDataFrame(ops, schema.OPS))
    assert rows(e, "id", "importance", "access_count") == [("m", 4, 2), ("n", 1, 0)]
    assert e.where("id = 'm'").first().last_accessed == 7.0
    assert rows(store.keyword_index(e)) == [("k", "m"), ("k", "n"), ("t", "m"), ("t", "n")]


EDGES = [("a", "b", 1.0), ("b", "c", 3.0), ("a", "c", 0.5), ("c", "d", 0.2), ("x", "y", 1.0)]


def test_shortest_paths_and_components(spark):
    g = graph.edges(spark.createDataFrame(EDGES, "a string, b string, ppmi double"), 0.1)
    (r,) = graph.shortest_paths(g, ["a"], ["c"]).collect()
    assert (r.path, r.total_weight, r.hops) == (["a", "b", "c"], 4.0, 2) and abs(r.distance - 4 / 3) < 1e-6
    assert graph.connected(g, ["a", "d"]) and not graph.connected(g, ["a", "x"])
    assert graph.shortest_paths(g, ["a"], ["x"]).count() == 0


def test_pagerank_equals_dense(spark):
    g = graph.edges(spark.createDataFrame(EDGES, "a string, b string, ppmi double"), 0.1)
    nodes = list("abcdxy")
    w = {n: {} for n in nodes}
    for a, b, v in EDGES:
        w[a][b] = w[b][a] = v
    rank = dict.fromkeys(nodes, 1 / 6)
    for _ in range(9):
        rank = {n: 0.15 * (n in "ad") / 2 + 0.85 * sum(rank[m] * w[m][n] / sum(w[m].values()) for m in w[n]) for n in nodes}
    got = {r.node: r.rank for r in graph.pagerank(g, ["a", "d"], rounds=9, tolerance=None).collect()}
    assert got == pytest.approx(rank)


def test_hidden_chain(spark):
    scores = spark.createDataFrame(EDGES, "a string, b string, ppmi double")
    words, chains, error = graph.hidden_chain(scores, None, ["a", "d"])
    assert error is None and {r.word for r in words.collect()} == {"b", "c"}
    assert words.first().word == "c" and [r.path for r in chains.collect()] == [["a", "b", "c", "d"]]
    assert graph.hidden_chain(scores, None, ["a", "nowhere"])[2]
    counts = spark.createDataFrame([("d", "x", 2.0)], "a string, b string, n double")
    words, chains, error = graph.hidden_chain(scores, counts, ["a", "y"])
    assert [r.path for r in chains.collect()] == [["a", "b", "c", "d", "x", "y"]]


STRENGTH = [("u", "m", 0.5), ("u", "n", 0.4), ("v", "m", 0.3), ("m", "z", 0.6), ("n", "z", 0.5), ("m", "n", 0.2), ("n", "y", 0.9), ("z", "y", 0.4), ("v", "z", 0.2), ("u", "z", 0.1), ("y", "w", 0.7), ("z", "w", 0.3)]


def brute_beam(words, depth, width, least, hop=0.5, div=0.6, pct=0.95):
    import numpy as np

    edge, degree = {}, {}
    for a, b, p in STRENGTH:
        if p > least:
            degree[a] = degree.get(a, 0) + 1
            if b not in words:
                edge.setdefault(a, []).append((b, p))
    limit = np.percentile(list(degree.values()), 100 * pct)
    reached = {}
    for w in words:
        beam = [(1.0, [w])]
        for d in range(depth):
            step = [(c * p * hop**d * (0.3 if degree.get(path[-1], 0) > limit else 1), path + [b]) for c, path in beam for b, p in edge.get(path[-1], []) if b not in path]
            step = [(c, path) for c, path in step if c >= 0.1 * least]
            if d == depth - 1:
                for c, path in step:
                    reached.setdefault(path[-1], []).append((c, w, path[1] if len(path) > 2 else None))
            beam = sorted(step, key=lambda s: (-round(s[0], 12), s[1]))[:width]
    out = {}
    for t, paths in reached.items():
        sources = {w for _, w, _ in paths}
        near = sum(any(a == w and b == t and p > 0 for a, b, p in STRENGTH) for w in words) / len(words)
        if not (len(sources) == len(words) or near == 1) if len(words) > 1 else not near:
            continue
        s = sum(c for c, _, _ in paths) * math.sqrt(near)
        s *= 1.5 if len(words) > 1 and len(sources) == len(words) else 1 + 0.2 * (len(sources) - 1) if len(sources) > 1 else 1
        s *= div if len({b for _, _, b in paths if b}) <= 1 else 1
        out[t] = round(s, 6)
    return out


@pytest.mark.parametrize(("words", "depth", "width"), [(["u"], 2, 20), (["u", "v"], 2, 2), (["u", "v"], 3, 20), (["u"], 3, 1)])
def test_beam_equals_brute_force(spark, words, depth, width):
    s = spark.createDataFrame(STRENGTH, "a string, b string, p double")
    got = {r.target: r.score for r in hops.beam_search(s, words, depth, width).collect()}
    assert got == pytest.approx(brute_beam(words, depth, width, 0.01))


def test_group_and_merge(spark):
    s = spark.createDataFrame(STRENGTH, "a string, b string, p double")
    got = {r.target: r.confidence for r in hops.group_inference(s, ["u", "v"]).collect()}
    assert got["z"] == pytest.approx(0.5 * 0.6 + 0.4 * 0.5 + 0.3 * 0.6)
    assert hops.merge_substrings([("ab", 1.0, ["x"]), ("abc", 0.5, ["y"]), ("d", 0.7, [])], 2) == [("abc", 1.5, ["y", "x"]), ("d", 0.7, [])]
    assert hops.two_hop(s, "u", 1).first().asDict() == {"mid": "n", "target": "y", "score": 0.36}


def test_episodic(spark):
    days = ["2026-02-05"] * 2 + ["2026-02-06", "2026-02-07"] * 2 + ["2026-02-08"] * 2
    kinds = ["工作", "生活", "工作", "工作", "生活", "运动", "工作", "学习"]
    logs = spark.createDataFrame([(str(i), True, d, k, "dev" if i < 3 else "me", "fix bug" if i == 2 else "s", None, [], float(i)) for i, (d, k) in enumerate(zip(days, kinds))], "id string, is_episodic boolean, date_str string, topic string, source string, summary string, body string, keywords array<string>, timestamp double")
    n = lambda *a, **k: episodic.recall(logs, *a, **k).count()
    assert (n("2026-02-05", "2026-02-08"), n("2026-02-06", "2026-02-07"), n("2030-01-01")) == (8, 4, 0)
    assert (n("2026-02-05", "2026-02-08", category="工作"), n("2026-02-05", "2026-02-08", source="dev"), n("2026-02-05", "2026-02-08", keyword="bug")) == (4, 3, 1)
    s = episodic.summarize(logs, "week", "2026-02-08").collect()
    assert {r.category: r.n for r in s if r.date_str is None} == {None: 8, "工作": 4, "生活": 2, "运动": 1, "学习": 1}
    with pytest.raises(ValueError):
        episodic.summarize(logs, "year", "2026-02-08")
