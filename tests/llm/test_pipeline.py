"""The pipeline against brute force on the smallest tables, and on odd documents."""

import numpy as np
from test_decontamination import brute as brute_containment
from test_mixing import brute as brute_rates
from test_simhash import brute_groups

import corpus_pipeline
from mnemora.llm import mixing, pii, quality, simhash  # noqa: F401


def test_equals_brute_force(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    docs = t("documents").orderBy("doc_id").toPandas()
    # quality: the same fitted weights, an exact quantile over single scores
    w, level = quality.train(spark, t("documents"), t("labels"))
    scores = np.round(quality.features(docs.text.tolist()) @ w / quality.GRID).astype(int)
    below = [s for s in np.unique(scores) if (scores <= s).mean() <= level]
    docs = docs[scores > (max(below) if below else -(10**12))].reset_index(drop=True)
    # near-duplicates: all pairs
    gone = {i for members in brute_groups(docs.text.tolist()).values() for i in sorted(members)[1:]}
    docs = docs.drop(index=list(gone)).reset_index(drop=True)
    # decontamination: exact containment
    items = [(r.item_id, r.text) for r in t("benchmark").collect()]
    found = {i for i, _, _ in brute_containment(list(zip(docs.doc_id, docs.text)), items)}
    docs = docs[~docs.doc_id.isin(found)].reset_index(drop=True)
    # personal data: span by span with the same fitted weights
    weights = pii.train(pii._spans(spark.createDataFrame(docs)))
    for i, text in enumerate(docs.text):
        for start, end, shape in reversed(pii.candidates(text)):
            kind, _ = pii._decide(np.array([pii.span_features(docs.text[i], start, end, shape)]), weights)
            if kind[0]:
                text = f"{text[:start]}[{pii.KINDS[kind[0]]}]{text[end:]}"
        docs.loc[i, "text"] = text
    # mixing: the dual over single documents; rates that round within 1e-6 of a whole number are left open
    rows = list(zip(docs.doc_id, docs.text, docs.source))
    share = {s: sum(len(x.split()) for _, x, y in rows if y == s) for s in set(docs.source)}
    total = sum(share.values())
    rates, _ = brute_rates(rows, mixing.default_targets({s: v / total for s, v in share.items()}))
    u = {r.doc_id: r.u for r in spark.createDataFrame([(int(i), len(x)) for i, x, _ in rows], "doc_id long, n int").selectExpr("doc_id", f"pmod(xxhash64(23, doc_id, n), {1 << 30}) / {1 << 30}D u").collect()}
    expected = {int(i): (x, int(np.floor(r + u[i]))) for (i, x, _), r in zip(rows, rates)}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.copy))
    close = {int(i) for (i, _, _), r in zip(rows, rates) if abs(r + u[i] - round(r + u[i])) < 1e-6}
    assert {i: sorted(v) for i, v in got.items() if i not in close} == {i: [(x, c) for c in range(n)] for i, (x, n) in expected.items() if n and i not in close}


def test_stages_keep_columns_and_survive_odd_rows(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]
    data = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "some text of words", "en", "s", 18), (2, "some text of words", "en", "s", 18), (3, "mail me@site.org " * 9, "xx", None, 5)]
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long, copy int")
    for kind in ("full", "empty"):
        df = docs if kind == "full" else docs.limit(0)
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, sf)
            path = str(tmp_path / f"{kind}-{name}")
            df.write.parquet(path)
            df = spark.read.parquet(path)
            assert set(df.columns) == set(docs.columns) | ({"copy_1"} if name == "mixing" else set())


def test_only_the_result_stays_in_the_shared_folder(spark, sf):
    import os

    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), "mnemora")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    n = corpus_pipeline.run(spark, sf).count()
    (left,) = set(os.listdir(folder)) - before
    assert n and left.endswith("-mixing")
