import numpy as np

from mnemora.llm import toxicity as X


def corpus(n=400, seed=5):
    rng = np.random.default_rng(seed)
    clean = [f"w{i}ord" for i in range(300)]
    rows = []
    for i in range(n):
        words = list(rng.choice(clean, 30))
        toxic = i % 4 == 0
        for _ in range(int(rng.integers(1, 8)) if toxic else 0):
            words.insert(int(rng.integers(len(words))), ["scum", "moron", "trash" + rng.choice(list("abcde"))][int(rng.integers(3))])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_order(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, toxic int")
    got = X.score_toxicity(spark, docs, labels).toPandas().set_index("doc_id")
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([got.toxic[i] == bool(t) for i, _, t in held]) > 0.97
    insults = np.array([sum(w in ("scum", "moron") or w.startswith("trash") for w in t.split()) for _, t, _ in rows])
    severity = np.array([got.expected_severity[i] for i, _, _ in rows])
    assert severity[insults >= 6].mean() > severity[(insults > 0) & (insults < 3)].mean() > severity[insults == 0].mean()


def test_cumulative_link_recovers_thresholds():
    rng = np.random.default_rng(6)
    n = 4000
    z = rng.integers(0, 2, (n, 3))
    doc, column = np.nonzero(z)
    latent = z @ np.array([2.0, 1.0, 0.0]) + rng.logistic(size=n)
    grade = np.searchsorted([0.5, 2.0], latent)
    w, theta = X.fit_cumulative(doc, column, grade, 3, steps=1500)
    assert np.allclose(w, [2, 1, 0], atol=0.25) and np.allclose(theta, [0.5, 2.0], atol=0.25) and (np.diff(theta) > 0).all()


def test_odd_rows(spark):
    rows = corpus(80)
    odd = [(None, "some scum here"), (900, None), (901, ""), (0, rows[0][1]), (902, "scum " * 100_000)]
    docs = spark.createDataFrame([(*r[:2], 3) for r in rows] + [(*r, 4) for r in odd], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None), (0, 0)], "doc_id long, toxic int")
    got = X.score_toxicity(spark, docs, labels)
    assert got.columns == ["doc_id", "expected_severity", "grade", "toxic"] and got.count() == 85


def test_empty(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert X.score_toxicity(spark, docs.limit(0), labels).count() == 0
    for some in (labels, labels.limit(0)):
        (r,) = X.score_toxicity(spark, docs, some).collect()
        assert r.expected_severity == 0 and not r.toxic


def test_fit_equals_plain_gradient_steps_on_a_dense_matrix():
    rng = np.random.default_rng(1)
    z = (rng.random((300, 5)) < 0.3).astype(float)
    grade = np.searchsorted([0.3, 1.0, 2.5], z @ np.array([2.0, 1.0, -1.0, 0.5, 0.0]) + rng.logistic(size=300))
    doc, column = np.nonzero(z)
    w, theta = X.fit_cumulative(doc, column, grade, 5, ridge=1.0, steps=4000)

    def loss(p):
        cut = np.concatenate(([-np.inf], p[5:], [np.inf]))
        f = lambda t: 1 / (1 + np.exp(-t))
        return -np.log(f(cut[grade + 1] - z @ p[:5]) - f(cut[grade] - z @ p[:5])).mean() + 0.5 / 300 * (p[:5] ** 2).sum()

    p = np.concatenate((np.zeros(5), [0.0, 1.0, 2.0]))
    for _ in range(4000):
        g = np.array([(loss(p + h) - loss(p - h)) / 2e-5 for h in 1e-5 * np.eye(8)])
        p = p - 1.0 * g
    assert np.allclose(np.concatenate((w, theta)), p, atol=0.02) and abs(loss(np.concatenate((w, theta))) - loss(p)) < 1e-4


def test_signal_and_discoveries(spark):
    import math

    from pyspark.sql import functions as F

    rows = [(3.0, 3.0), (0.0, 9.0), (5.0, 20.0), (2.0, 12.0), (10.0, 10.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "bad double, n double").coalesce(1).select(X.likelihood_ratio(F.col("bad"), F.col("n"), 10, 60)).collect()]
    for z, (bad, n) in zip(got, rows):
        seen = [bad, n - bad, 10 - bad, 50 - n + bad]
        expected = [n / 6, n * 5 / 6, (60 - n) / 6, (60 - n) * 5 / 6]
        g = 2 * sum(a * math.log(a / b) for a, b in zip(seen, expected) if a)
        assert abs(z - math.copysign(math.sqrt(g), bad - n / 6)) < 1e-9
    # p-values 6e-7, 3e-4 and 0.012 against 1/40, 2/40 and 3/40 of 0.05
    assert list(X.discoveries(np.array([3.6, -5.0, 2.51]), 40)) == [True, True, False]
    assert not X.discoveries(np.zeros(0), 5).any()


def test_a_word_has_one_marker():
    names = np.unique(X.sparse_features(["insults"])[1])
    names = names[names >= 0]
    doc, at = X.place_markers(*X.sparse_features(["insults insult Insulting in", "insure", "x"]), names)
    word, seven, six, five, four = X.sparse_features(["insults"])[1][0]
    # insults by itself (it has no beginning of 7), insult and insulting by "insul" and "insult", insure by none: "insu" is one
    assert seven == -1
    assert sorted(zip(doc.tolist(), names[at].tolist())) == sorted([(0, int(word)), (0, int(five)), (0, int(six)), (1, int(four))])


def test_query_equals_brute_force(spark, tmp_path):
    """Scores from word lists and dictionaries with the fitted markers, weights and thresholds."""
    rows = corpus(120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = X.train(spark, docs, labels)
    weight = dict(zip(model.names.tolist(), model.weights.tolist()))
    got = {r.doc_id: r for r in X.op1_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 120 and len(weight) >= 3
    for i, text, _ in rows:
        marks = set()
        for word in set(text.split()):
            (features,) = X.sparse_features([word])[1].tolist()
            marks |= {next((f for f in features if f in weight), None)} - {None}
        s = sum(weight[m] for m in marks)
        below = [1 / (1 + np.exp(s - t)) for t in model.thresholds]
        p = np.diff([0, *below, 1])
        assert abs(got[i].expected_severity - sum(g * x for g, x in enumerate(p))) < 1e-5
        assert got[i].toxic == (below[0] < 0.5) and abs(p[got[i].grade] - max(p)) < 1e-9
