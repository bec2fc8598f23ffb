import numpy as np
import pytest

from mnemora.llm import quality as Q

GOOD = "The quick brown fox walks over many different hills, and then it rests near the quiet river for a while. It is {}."
BAD = "BUY!! {} NOW!! | $$$ | ### | BUY!! NOW!! {}"


def rows(n):
    return [(i, (GOOD if i % 3 else BAD).replace("{}", f"item{i}"), int(i % 3 > 0)) for i in range(n)]


def tables(spark, n=60):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows(n) if i % 2 == 0], "doc_id long, quality int")
    return docs, labels


def test_held_out_accuracy_and_filter(spark):
    docs, labels = tables(spark)
    got = {r.doc_id: r.keep for r in Q.score_quality(spark, docs, labels).collect()}
    assert got == {i: bool(q) for i, _, q in rows(60)}
    kept = Q.filter_quality(spark, docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _, q in rows(60) if q]


def test_level_is_an_exact_quantile(spark):
    docs, labels = tables(spark)
    got = Q.score_quality(spark, docs, labels, level=0.5).toPandas()
    scores = np.sort(got.score)
    cut = max((s for s in np.unique(scores) if (scores <= s).mean() <= 0.5), default=-np.inf)
    assert (got.keep == (got.score > cut)).all()


def test_bradley_terry_minimises_pair_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    good = x @ np.array([1.0, -2.0, 0.0]) + rng.normal(size=80) > 0
    w = Q.fit_bradley_terry(x, good)
    s = x @ w
    assert np.mean(s[good][:, None] > s[~good][None, :]) > 0.9


def test_odd_rows(spark):
    docs, labels = tables(spark, 30)
    odd = spark.createDataFrame([(None, "plain words here"), (100, None), (101, ""), (1, rows(30)[1][1]), (102, "long " * 100_000)], "doc_id long, text string")
    both = docs.unionByName(odd).selectExpr("doc_id", "text", "1 as score", "2 as keep", "3 as quality")
    bad_labels = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (0, 0)], "doc_id long, quality int"))
    got = Q.score_quality(spark, both, bad_labels)
    assert got.count() == 35 and got.columns == ["doc_id", "score", "keep"]
    kept = Q.filter_quality(spark, both, bad_labels)
    assert kept.columns == both.columns


@pytest.mark.parametrize("which", ["docs", "labels", "one kind"])
def test_empty(spark, which):
    docs, labels = tables(spark, 12)
    if which == "docs":
        assert Q.score_quality(spark, docs.limit(0), labels).count() == 0
        assert Q.filter_quality(spark, docs.limit(0), labels).count() == 0
    else:
        labels = labels.limit(0) if which == "labels" else labels.where("quality = 1")
        assert Q.filter_quality(spark, docs, labels).count() == 12


def test_ranker_equals_plain_gradient_steps_over_all_its_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    good = x @ np.array([1.5, -1.0, 0.2]) + rng.normal(size=40) > 0
    w = Q.fit_bradley_terry(x, good, pairs_each=6)
    top, low = np.flatnonzero(good), np.flatnonzero(~good)
    left = np.random.default_rng(11).choice(top, size=len(low) * 6)
    pairs = [(x[a] - x[b]) / x.std(axis=0) for a, b in zip(left, np.repeat(low, 6))]
    v = np.zeros(3)
    for _ in range(4000):
        v -= 0.005 * (v - sum(d / (1 + np.exp(d @ v)) for d in pairs))
    assert np.allclose(w, v / x.std(axis=0), atol=1e-4)
