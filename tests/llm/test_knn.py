import numpy as np

from mnemora.llm import knn as N


def brute(ids, x, k):
    out = {}
    for i in range(len(ids)):
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])
        out[int(ids[i])] = [(j, round(v, 9)) for v, j in d[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append((r.neighbour_id, round(r.distance, 9)))
    return out


def test_equals_brute_force_with_ties_in_many_groups(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, (120, 6)) for c in (0, 5, 10, -7)])
    x[50:60] = x[40:50]
    x[100:110] = 0
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(e) for e in v], 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, rank int")
    for k, group in ((10, 60), (3, 6000), (1, 100)):
        assert result(N.knn_join(spark, df, k, group)) == brute(ids, x, k)
    some = {i: v for i, v in brute(ids, x, 10).items() if i % 50 == 0}
    assert result(N.knn_join(spark, df, 10, 4, "vec_id % 50 = 0", slice_rows=90)) == some  # cells and groups are divided


def test_blocks_left_out_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(N, "_BLOCK", 16)
    x = np.concatenate([rng.normal(c, 0.2, (60, 3)) for c in (0, 4, -9)])
    ids, pivots = np.arange(len(x)), x[[0, 20, 70, 130]]
    cell = N._distances(x, pivots).argmin(1)
    q = np.arange(0, len(x), 7)
    row, own, near_id, near = N.solve_local(q, ids[q], x[q], ids, x, 4, cell, pivots)
    assert (own == row).all()
    got = {int(i): [(int(j), round(float(d), 9)) for j, d in zip(near_id[row == i], near[row == i])] for i in q}
    assert got == {i: v for i, v in brute(ids, x, 4).items() if i in got} and len(got) == len(q)


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [float("nan"), 0.0]), (7, [None, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(N.knn_join(spark, df, 10)) == {1: [(2, 1.0), (3, 1.0)], 2: [(1, 1.0), (3, round(2**0.5, 9))], 3: [(1, 1.0), (2, round(2**0.5, 9))]}
    assert N.knn_join(spark, df.limit(0)).count() == 0
    assert N.knn_join(spark, df.where("vec_id = 2")).count() == 0


def test_many_close_vectors_of_one_id(spark):
    rng = np.random.default_rng(9)
    rows = [(0, (0.01 * rng.normal(size=2)).tolist()) for _ in range(40)]
    rows += [(i, (np.array([10.0 * (i % 3 + 1), 10.0]) + rng.normal(size=2)).tolist()) for i in range(1, 61)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(round(r.distance, 6) for r in N.knn_join(spark, df, k=3, group=20).where("vec_id = 0").collect())
    x = np.array([v for _, v in rows])
    far = np.sort(np.sqrt(((x[:40, None] - x[None, 40:]) ** 2).sum(2)), axis=1)[:, :3]
    assert len(got) == 120 and np.allclose(got, np.sort(far.ravel()), atol=1e-5)
