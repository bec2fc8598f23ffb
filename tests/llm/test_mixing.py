import numpy as np
import pytest

from mnemora.llm import mixing as M


def docs(spark, n=200):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 40)), f"s{i % 3 if i % 2 else 0}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def brute(rows, targets):
    """The dual minimised by damped Newton steps over single documents."""
    t = np.array([len(r[1].split()) for r in rows], float)
    names = sorted(targets)
    x = np.array([[t[i] * (r[2] == s) for s in names] for i, r in enumerate(rows)]) / t.mean()
    goal = np.array([targets[s] for s in names])
    a = np.zeros(len(names))
    for _ in range(200):
        w = np.exp(x @ a)
        w /= w.sum()
        g = x.T @ w - goal
        h = (x * w[:, None]).T @ x - np.outer(x.T @ w, x.T @ w)
        a -= 0.5 * np.linalg.solve(h + 1e-12 * np.eye(len(a)), g)
    return w * len(rows), t


def test_rates_equal_brute_force_and_meet_targets(spark):
    rows, d = docs(spark)
    targets = {"s0": 0.5, "s1": 0.2, "s2": 0.3}
    got = M.mix_rates(spark, d, targets).orderBy("doc_id").toPandas()
    expected, t = brute(rows, targets)
    assert np.allclose(got.rate, expected, rtol=1e-6)
    assert np.isclose(got.rate.sum(), len(rows))
    for s, v in targets.items():
        assert np.isclose((got.rate * got.tokens)[got.source == s].sum() / t.sum(), v, atol=1e-8)
    assert (abs(got.copies - got.rate) <= 1).all() and abs(got.copies.sum() - len(rows)) < 30


def test_documents_are_copied(spark):
    _, d = docs(spark)
    n = {r.doc_id: r.copies for r in M.mix_rates(spark, d, smoothing=0.0).collect()}
    mixed = M.mix_documents(spark, d, smoothing=0.0)
    assert mixed.columns == ["doc_id", "text", "source", "copy"]
    got = {}
    for r in mixed.collect():
        got.setdefault(r.doc_id, []).append(r.copy)
    assert {i: len(c) for i, c in got.items()} == {i: c for i, c in n.items() if c}
    assert all(sorted(c) == list(range(len(c))) for c in got.values())


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", "x"), (2, None, "x"), (3, "", None), (4, "q " * 300_000, None), (5, "a", "y"), (6, "", "z")]
    d = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, rate double, copy int")
    got = M.mix_rates(spark, d).toPandas()
    assert len(got) == len(rows) and np.isfinite(got.rate).all() and (got.rate > 0).all()
    mixed = M.mix_documents(spark, d)
    assert mixed.columns == ["doc_id", "text", "source", "rate", "copy", "copy_1"] and {r.copy for r in mixed.collect()} == {2}
    assert M.mix_documents(spark, d.drop("copy").withColumnRenamed("rate", "Copy")).columns == ["doc_id", "text", "source", "Copy", "copy_1"]


@pytest.mark.parametrize("texts", [[], ["", None]])
def test_no_tokens(spark, texts):
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = M.mix_rates(spark, d).collect()
    assert len(got) == len(texts) and all(r.copies == 1 for r in got)


def rare(spark):
    """Two sources of long documents and a rare one of short documents, as counts."""
    rows = [("a", 300 + 2 * i, 8000) for i in range(100)] + [("b", 300 + 2 * i, 2000) for i in range(100)] + [("c", i, 200) for i in range(3, 8)]
    return rows, spark.createDataFrame(rows, f"{M._S} string, {M._T} long, n long").coalesce(1).cache()


def test_rare_source_of_short_documents_meets_its_target(spark):
    rows, counts = rare(spark)
    tilt, log_z, scale = M.solve(counts)
    total = sum(t * n for _, t, n in rows)
    present = {s: sum(t * n for x, t, n in rows if x == s) / total for s in "abc"}
    got = {s: sum(n * t * np.exp(tilt[s] * t / scale - log_z) for x, t, n in rows if x == s) / total for s in "abc"}
    for s, v in M.default_targets(present).items():
        assert np.isclose(got[s], v, rtol=1e-5)


def test_targets_out_of_reach(spark):
    _, counts = rare(spark)
    with pytest.raises(ValueError):
        M.solve(counts, {"a": 0.3, "b": 0.2, "c": 0.5})
    with pytest.warns(UserWarning):
        tilt, log_z, _ = M.solve(counts, smoothing=0.0)
    assert np.isfinite([*tilt.values(), log_z]).all()
