import numpy as np

from mnemora.llm import pii as P

TEXTS = [
    "Write to ann.lee{i}@mail.example.com soon.", "Call +1 (555) 555-01{i:02d} today.", "The host 10.2.{i}.7 is down.",
    "He paid with {card} in May.", 'Set token = "{hex}" there.', "Released under version 2.{i} of it.", "No number here at all.",
]


def card(i):
    body = f"4{i:014d}"
    return next(body + str(c) for c in range(10) if P.luhn(body + str(c)))


def corpus(n=140):
    rng = np.random.default_rng(0)
    out = []
    for i in range(n):
        t = TEXTS[i % 7].format(i=i % 90, card=card(i), hex="".join(rng.choice(list("0123456789abcdef"), 40)))
        out.append((i, t))
    return out


def test_kinds_and_redaction(spark):
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in corpus()], "doc_id long, text string, n_chars long")
    got = {}
    for r in P.find_pii(docs).collect():
        got.setdefault(r.doc_id, []).append((r.kind, dict(corpus())[r.doc_id][r.start : r.end]))
    kinds = ["EMAIL", "PHONE", "IP", "CARD", "SECRET"]
    assert {i: [k for k, _ in v] for i, v in got.items()} == {i: [kinds[i % 7]] for i in range(140) if i % 7 < 5}
    assert got[0] == [("EMAIL", "ann.lee0@mail.example.com")] and got[3][0][1] == card(3)
    red = {r.doc_id: r for r in P.redact(spark, docs).collect()}
    assert red[0].text == "Write to [EMAIL] soon." and red[0].n_chars == len(red[0].text)
    assert red[4].text == 'Set token = "[SECRET]" there.'
    assert all(red[i].text == t for i, t in corpus() if i % 7 >= 5)


def test_em_learns_that_a_labeler_is_wrong():
    e, n = P._K["EMAIL"], P._K["NONE"]
    pattern = np.full((3, len(P.LABELERS)), -1)
    pattern[0, :3] = [e, e, e]
    pattern[1, :3] = [n, n, e]  # the third cries wolf
    pattern[2, 2] = e
    prior, confusion, post = P.fit_em(pattern, np.array([100.0, 300.0, 5.0]))
    assert post[0].argmax() == e and post[1].argmax() == n
    assert np.allclose(post.sum(1), 1) and np.allclose(confusion.sum(2), 1) and prior[n] > prior[e]


def test_odd_rows(spark):
    long = "word " * 100_000 + "bob@site.org"
    rows = [(None, "mail bob@site.org now"), (1, None), (2, ""), (3, "mail bob@site.org now"), (3, "mail bob@site.org now"), (4, long), (5, "9" * 5_000), (6, "@" * 5_000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows] + [(i + 10, t, 1) for i, t in corpus(70)], "doc_id long, text string, start int")
    got = [(r.doc_id, r.start) for r in P.find_pii(docs).collect() if r.doc_id is None or r.doc_id < 7]
    assert sorted(got, key=str) == sorted([(None, 5), (3, 5), (3, 5), (4, 500_000)], key=str)
    red = P.redact(spark, docs)
    assert red.columns == docs.columns and red.count() == docs.count()


def test_empty_and_nothing_found(spark):
    docs = spark.createDataFrame([(1, "no data at all")], "doc_id long, text string")
    for d in (docs, docs.limit(0)):
        assert P.find_pii(d).count() == 0 and P.redact(spark, d).count() == d.count()


def test_long_keys_and_foreign_numbers(spark):
    long = ("a1B2c3D4e5" * 6000)[:-1]
    phones = ["+33 6 12 34 56 78", "06 12 34 56 78", "+49 30 1234567", "+15551234567", "+34 612 34 56 78", "612 34 56 78"]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "ES91 2100 0418 4502 0005 1332"]
    shapes = {long[:600]: "key", long: "key", "x" * 300 + "1" + "y" * 300: "key"} | dict.fromkeys(phones, "phone") | dict.fromkeys(ibans, "iban")
    for s, shape in shapes.items():
        assert P.candidates(f"see {s} 2024 there")[0] == (4, 4 + len(s), shape), s
    assert all(shape != "iban" for *_, shape in P.candidates("DE88 3704 0044 0532 0130 00"))
    rows = [(i, f"see {s} there, chapter {i + 10}") for i, s in enumerate([long[:600], long, *phones, *ibans] * 5)]
    out = [r.text for r in P.redact(spark, spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    kinds = (["SECRET"] * 2 + ["PHONE"] * 6 + ["IBAN"] * 3) * 5
    assert out == [f"see [{k}] there, chapter {i + 10}" for i, k in enumerate(kinds)]


def brute_em(rows, rounds=60, smooth=0.1):
    """Dawid-Skene over single spans with plain loops: posteriors by span."""
    k, m = len(P.KINDS), len(P.LABELERS)
    post = []
    for votes in rows:
        p = [0.01 + sum(v == c for v in votes) for c in range(k)]
        post.append([x / sum(p) for x in p])
    for _ in range(rounds):
        prior = [(sum(p[c] for p in post) + smooth) / (len(rows) + smooth * k) for c in range(k)]
        said = [[[smooth + 2 * smooth * (c == v) for v in range(k + 1)] for c in range(k)] for _ in range(m)]
        for votes, p in zip(rows, post):
            for j, v in enumerate(votes):
                for c in range(k):
                    said[j][c][k if v < 0 else v] += p[c]
        new = []
        for votes in rows:
            p = list(prior)
            for j, v in enumerate(votes):
                for c in range(k):
                    p[c] *= said[j][c][k if v < 0 else v] / sum(said[j][c])
            new.append([x / sum(p) for x in p])
        post = new
    return np.array(post)


def spans_of(rows):
    return [(i, *c, t) for i, t in rows for c in P.candidates(t)]


def test_em_equals_brute_force():
    rows = [P.votes(t, a, b, shape) for _, a, b, shape, t in spans_of(corpus(70))]
    patterns = sorted(set(map(tuple, rows)))
    counts = [sum(tuple(r) == p for r in rows) for p in patterns]
    _, _, post = P.fit_em(np.array(patterns), np.array(counts, float))
    assert np.allclose(post[[patterns.index(tuple(r)) for r in rows]], brute_em(rows), atol=1e-6)


def test_query_equals_brute_force(spark, tmp_path):
    """Every span's kind by a posterior over single spans and a softmax fitted with small plain steps."""
    rows = corpus(105)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spans = spans_of(rows)
    post = brute_em([P.votes(t, a, b, shape) for _, a, b, shape, t in spans])
    x = np.array([P.span_features(t, a, b, shape) for _, a, b, shape, t in spans])
    w = np.zeros((x.shape[1], len(P.KINDS)))
    for _ in range(6000):
        p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 0.5 / (x * x).sum(1).mean() * (x.T @ (p - post) / len(x) + 1e-3 * w)
    kinds = (x @ w).argmax(1)
    expected = {(i, a, b, P.KINDS[k]) for (i, a, b, _, _), k in zip(spans, kinds) if k}
    assert {(r.doc_id, r.start, r.end, r.kind) for r in P.op2_pii(spark, str(tmp_path)).collect()} == expected and len(expected) == 75


def test_hostile_long_texts_take_linear_time():
    import time

    began = time.perf_counter()
    for s in ("a", "漢字", "1", "a1", "x@", "a.b@", "1.2.", "ABCD ", "1 ABCD ", "+1 ", "é-", "Aa1/", "1" + " " * 999):
        P.candidates(s * (1_000_000 // len(s)))
    assert time.perf_counter() - began < 60
