import random

import numpy as np

from mnemora.llm import simhash as S
from mnemora.llm.bktree import Forest


def brute(fp, shard, radius):
    return {(i, j) for i in range(len(fp)) for j in range(i) if shard[i] == shard[j] and bin(int(fp[i] ^ fp[j])).count("1") <= radius}


def test_forest_equals_brute_force():
    rng = np.random.default_rng(1)
    for n, radius in ((0, 3), (1, 3), (300, 20), (400, 8)):
        fp = rng.integers(0, 2**64, n, np.uint64)
        if n > 200:
            fp[100:200] = fp[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
            fp[200:210] = fp[0]
        shard = np.sort(rng.integers(0, 3, n))
        got = {(int(i), int(j)) for a, b in Forest(shard, fp).within(radius) for i, j in zip(a, b)}
        assert got == brute(fp, shard, radius)


def test_blocks_cover_every_pair_within_radius():
    rng = random.Random(2)
    for n in (10, 10**6, 10**9):
        masks = S.plan_blocks(n, 5)
        for _ in range(200):
            flip = sum(1 << b for b in rng.sample(range(64), 5))
            assert any(not flip & m for m in masks)


def texts(seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    out = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(80, 200))
        out.append(" ".join(words))
        for _ in range(i % 3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return out


def brute_groups(ts):
    a, b, some = S.fingerprints(ts)
    low = list(range(len(ts)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(ts)):
        for j in range(i):
            if some[i] and some[j] and bin(int(a[i] ^ a[j])).count("1") <= S.RADIUS and bin(int(b[i] ^ b[j])).count("1") <= S.CONFIRM:
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(ts)):
        groups.setdefault(find(i), []).append(i)
    return {g: m for g, m in groups.items() if len(m) > 1}


def test_groups_equal_brute_force(spark):
    ts = texts()
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {}
    for r in S.find_near_duplicates(docs).collect():
        got.setdefault(r.group_id, []).append(r.doc_id)
        assert r.keep == (r.doc_id == r.group_id)
    expected = brute_groups(ts)
    assert {g: sorted(m) for g, m in got.items()} == expected and expected
    kept = sorted(r.doc_id for r in S.drop_duplicates(docs).collect())
    assert kept == sorted(set(range(len(ts))) - {i for g, m in expected.items() for i in m if i != g})
    assert kept == sorted(r.doc_id for r in S.drop_duplicates(docs, filter_words=1).collect())


def planted_nodes(n, seed=4):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2**64, n, np.uint64)
    for i in range(n // 3, n):  # 0 to 10 bits from another one, at any place
        fp[i] = fp[rng.integers(0, i)]
        for bit in rng.choice(64, rng.integers(0, 11), replace=False):
            fp[i] ^= np.uint64(1) << np.uint64(bit)
    return [(int(x), i, bytes(S.SKETCH // 8)) for i, x in enumerate(fp.view(np.int64))]


def test_copies_of_a_fingerprint_dont_grow_with_the_choices(spark):
    nodes = spark.createDataFrame(planted_nodes(200), f"{S.A} long, {S.B} long, {S.C} binary")
    for n in (200, 250_000, 3_000_000, 100_000_000):
        sent = S._routed(nodes, S.Choices(n, S.RADIUS), np.zeros(0, np.uint64), 40).selectExpr("sum(length(blob))").first()[0]
        assert sent == 200 * (S.RADIUS + 1) * (18 + S.SKETCH // 8)


def test_search_is_exact_at_any_size_and_where_shards_are_cut(spark, monkeypatch):
    rows = planted_nodes(400)
    nodes = spark.createDataFrame(rows, f"{S.A} long, {S.B} long, {S.C} binary")
    expected = brute([x & (2**64 - 1) for x, _, _ in rows], [0] * len(rows), S.RADIUS)
    low = list(range(len(rows)))
    for _ in rows:
        for i, j in expected:
            low[i] = low[j] = min(low[i], low[j])
    assert 100 < len(set(low)) < 300
    monkeypatch.setattr(S, "PAIRS", 5)
    for n, most in ((200, 10**6), (250_000, 10**6), (3_000_000, 10**6), (3_000_000, 4), (100_000_000, 1)):
        choices = S.Choices(n, S.RADIUS)
        assert [int(x) for x in choices.masks[choices.leaf[0] :]] == S.plan_blocks(n)
        if most < len(rows):
            cut, copies = S._to_cut(nodes, len(rows), choices, most)
            a = np.array([x for x, _, _ in rows]).view(np.uint64)
            assert len(cut) and copies == len(choices.shards(a, cut)[0]) > 9 * len(rows)
        got = list(range(len(rows)))
        at = {r: i for i, r in enumerate(rows)}
        edges = [(at[e.a1, e.b1, bytes(e.c1)], at[e.a2, e.b2, bytes(e.c2)]) for e in S._edges(nodes, n, S.RADIUS, S.CONFIRM, most).collect()]
        for _ in rows:
            for i, j in edges:
                got[i] = got[j] = min(got[i], got[j])
        assert got == low


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200 + i, 260) for i in range(20)]
    got = S.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == 41 + 3 + 21
    assert all(r.low == (0 if r.node < 50 else 100 if r.node < 150 else 200) for r in got)


def test_odd_rows(spark):
    a, b = "one two three four five six seven words here", "something else entirely different from the others"
    data = [(1, a), (1, a), (2, a), (None, a), (3, None), (4, None), (5, ""), (6, ""), (7, "..."), (8, b), (None, b), (9, "long words again " * 50_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, group_id string, keep int")
    found = S.find_near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.group_id, r.keep) for r in found) == [(0, 1, False), (0, 8, False), (1, 1, True), (1, 1, True), (2, 1, False), (8, 8, True)]
    kept = S.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 9]
    # even a filter that nearly every row hits changes nothing
    assert sorted(r.doc_id for r in S.drop_duplicates(docs, filter_words=1).collect()) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_all_ids_null_and_empty(spark):
    docs = spark.createDataFrame([(None, "same words in this text"), (None, "same words in this text")], "doc_id long, text string")
    assert S.drop_duplicates(docs).count() == 1
    assert S.find_near_duplicates(docs).count() == 2
    assert S.find_near_duplicates(docs.limit(0)).count() == 0 and S.drop_duplicates(docs.limit(0)).count() == 0


def test_long_unrelated_texts_stay_apart(spark):
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 5, 17)) + str(i) for i in range(3000)])
    share = 1 / np.arange(1, 3001)
    long = [" ".join(rng.choice(vocabulary, n, p=share / share.sum())) for n in (20_000, 20_000, 50_000, 50_000, 100_000, 100_000)]
    a, b, _ = S.fingerprints(long)
    assert any(np.bitwise_count(a[i] ^ a[j]) <= S.RADIUS and np.bitwise_count(b[i] ^ b[j]) <= S.CONFIRM for i in range(6) for j in range(i))
    words = long[0].split()
    copy = " ".join([*words[:9000], "changed", *words[9001:]])
    docs = spark.createDataFrame(list(enumerate([*long, copy])), "doc_id long, text string")
    assert sorted((r.doc_id, r.group_id) for r in S.find_near_duplicates(docs).collect()) == [(0, 0), (6, 0)]
    assert sorted(r.doc_id for r in S.drop_duplicates(docs).collect()) == list(range(6))
