"""Exact k nearest neighbours of query vectors among all vectors: a Voronoi join with bounds from summaries.

Queries and data are assigned to their nearest pivots.  Only summaries come to the driver: the radius
of each cell's queries, and the distances of its k+m vectors nearest to the pivot (m: most vectors of
one ``vec_id``).  From these the triangle inequality gives each query cell an upper bound on its k-th
neighbour distance.  Neighbouring query cells form groups of bounded size (a greater cell is divided),
and a vector is replicated to a group only if its lower bound on the distance to a query of some cell
of the group is within that cell's upper bound.  Groups are cut into slices of bounded size, each is
solved locally and exactly, block by block in rising order of their lower bounds, leaving out blocks
beyond the k-th distance so far, and the slices' results are merged.

Distances are Euclidean; neighbours have another ``vec_id``; ties are broken by ``vec_id``.

Defined cases: rows with a null ``vec_id``, a null vector or one with null, infinite or NaN elements
take no part; the length that most vectors have is the space (of equals the greater), others take
no part; equal rows count once; an id with several vectors has neighbours for each; with fewer than k
others all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.llm.common import pick, settle, table

K = 10
#: Most pivots; their matrix is broadcast.
MOST_PIVOTS = 4096
#: Queries of one local problem, at most.
GROUP = 6_000
#: Vectors of one slice of a group's data, about.
SLICE = 100_000
#: Vectors that are compared with a block of queries at once.
_BLOCK = 4_096


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """sqrt(n) vectors by hash, spread further by keeping the distant ones of twice as many."""
    p = int(min(MOST_PIVOTS, max(1, math.sqrt(n))))
    share = min(1.0, (4 * p + 64) / n)
    rows = vectors.where(F.pmod(pick("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("id", "v").orderBy(pick("id"), "id").limit(2 * p)
    x = np.array([r.v for r in rows.collect()], np.float64)
    if len(x) <= p:
        return x
    near = np.full(len(x), np.inf)
    chosen = []
    at = 0
    for _ in range(p):
        chosen.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(1))
        at = int(near.argmax())
    return x[np.unique(chosen)]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """More than the rounding error of any of ``_distances``."""
    return 1e-6 * math.sqrt((a * a).sum(1).max(initial=0) + (b * b).sum(1).max(initial=0)) + 1e-12


def _group_cells(between: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Neighbouring cells to groups of at most ``most`` members (or one cell), nearest first."""
    group = np.full(len(size), -1)
    g = 0
    while (group < 0).any():
        free = group < 0
        seed = int(np.flatnonzero(free)[np.argmax(between[free].min(1) if g == 0 else between[np.ix_(free, ~free)].min(1))])
        total = 0
        for c in np.argsort(between[seed], kind="stable"):
            if group[c] < 0 and (total == 0 or total + size[c] <= most):
                group[c] = g
                total += size[c]
        g += 1
    return group


def solve_local(
    q_row: np.ndarray, q_id: np.ndarray, q: np.ndarray, s_id: np.ndarray, s: np.ndarray, k: int, cell: np.ndarray | None = None, pivots: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, query id, neighbour id, distance): the k nearest of each query.

    The data is cut into blocks of neighbouring cells, whose pivots and radii bound their distances from
    below; a running k-th distance leaves blocks out.  Block products find candidates, whose distances
    are then computed exactly.
    """
    if not len(s) or not len(q):
        return tuple(np.zeros(0) for _ in range(4))
    order = np.lexsort((s_id, cell)) if cell is not None else np.argsort(s_id, kind="stable")
    s_id, s = s_id[order], s[order]
    starts = list(range(0, len(s), _BLOCK))
    lower = None
    if cell is not None:
        cell = cell[order]
        far = np.sqrt(((s - pivots[cell]) ** 2).sum(1))
    norm = (s * s).sum(1)
    out: list[tuple] = []
    for a in range(0, len(q), 256):
        x, ids = q[a : a + 256], q_id[a : a + 256]
        xx = (x * x).sum(1)
        visit = starts
        if cell is not None:
            to_pivot = _distances(x, pivots).astype(np.float64)
            # of each block and query: the least lower bound over the block's cells
            edge = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (np.arange(1, len(cell)) % _BLOCK == 0))))
            radius = np.maximum.reduceat(far, edge)
            each = to_pivot[:, cell[edge]] - radius
            lower = np.minimum.reduceat(each, np.searchsorted(edge, starts), axis=1) - _slack(x, pivots)
            visit = [starts[i] for i in np.argsort(lower.min(0), kind="stable")]
        row = np.zeros(0, np.int64)
        near_id, near = np.zeros(0, s_id.dtype), np.zeros(0)
        kth = np.full(len(x), np.inf)
        for b in visit:
            use = np.arange(len(x)) if lower is None else np.flatnonzero(lower[:, b // _BLOCK] <= kth)
            if not len(use):
                continue
            y, y_id = s[b : b + _BLOCK], s_id[b : b + _BLOCK]
            d = xx[use, None] + norm[b : b + _BLOCK] - 2 * (x[use] @ y.T)
            d[ids[use][:, None] == y_id[None, :]] = np.inf
            limit = kth[use] ** 2
            if d.shape[1] > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            slack = 1e-10 * (xx[use] + norm[b : b + _BLOCK].max()) + 1e-12
            r, c = np.nonzero(d <= np.where(np.isfinite(limit), limit + slack, np.finfo(np.float64).max)[:, None])
            exact = np.sqrt(((x[use][r] - y[c]) ** 2).sum(1))
            row, near_id, near = np.concatenate((row, use[r])), np.concatenate((near_id, y_id[c])), np.concatenate((near, exact))
            by = np.lexsort((near_id, near, row))
            row, near_id, near = row[by], near_id[by], near[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, near_id, near = row[keep], near_id[keep], near[keep]
            last = np.searchsorted(row, np.arange(len(x)), side="right")
            full = last - np.searchsorted(row, np.arange(len(x))) == k
            kth[full] = near[last[full] - 1]
        out.append((q_row[a : a + 256][row], ids[row], near_id, near))
    return tuple(np.concatenate(c) for c in zip(*out))


def knn_join(spark: SparkSession, vectors: DataFrame, k: int = K, group: int = GROUP, queries: str = "true", slice_rows: int = SLICE) -> DataFrame:
    """(vec_id, neighbour_id, distance, rank) for every vector whose ``vec_id`` meets the condition ``queries``, among all vectors."""
    result = "vec_id long, neighbour_id long, distance double, rank long"
    good = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    clean = clean.where(good).distinct()
    length = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], result)
    # Row numbers identify vectors from here on: the table is written, so they don't change.
    clean = settle(clean.where(F.size("v") == length.d).withColumn("row", F.monotonically_increasing_id()))
    n = length["count"]
    pivots = choose_pivots(clean, n)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cell = _distances(x, shared.value).argmin(1)
                exact = np.sqrt(((x - shared.value[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(exact)], ["id", "v", "row", "query", "cell", "far"])

    asked = F.expr(queries.replace("vec_id", "id"))
    placed = settle(clean.withColumn("query", F.coalesce(asked, F.lit(False))).mapInArrow(assign, "id long, v array<double>, row long, query boolean, cell int, far double"))
    # So many members may have a query's own id.
    own = placed.groupBy("id").count().agg(F.max("count")).first()[0]
    # Summaries: the k+own smallest pivot distances of each cell, number and radius of its queries.
    first = F.row_number().over(Window.partitionBy("cell").orderBy("far", "row"))
    nearest = placed.select("cell", "far", first.alias("i")).where(F.col("i") <= k + own).groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near")).collect()
    rows = sorted(placed.where("query").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect(), key=lambda r: r.cell)
    if not rows:
        return spark.createDataFrame([], result)
    cells, size, radius = np.array([r.cell for r in rows]), np.array([r.n for r in rows]), np.array([r.r for r in rows])
    between = _distances(pivots[cells], pivots)
    near_far = np.concatenate([r.near for r in nearest])
    near_cell = np.repeat([r.cell for r in nearest], [len(r.near) for r in nearest])
    # theta[i]: no query of cell i has its k-th neighbour farther off (k+own, as so many may have its id).
    theta = np.full(len(cells), np.inf)
    if len(near_far) >= k + own:
        for i in range(len(cells)):
            theta[i] = np.partition(radius[i] + between[i][near_cell] + near_far, k + own - 1)[k + own - 1]
    groups = _group_cells(between[:, cells], size, group)
    in_group = np.bincount(groups, weights=size).astype(np.int64)
    parts = -(-in_group // group)  # a cell of more queries than a group is divided
    base = np.cumsum(parts) - parts
    of_cell = np.full(len(pivots), -1)
    of_cell[cells] = groups
    plan = spark.sparkContext.broadcast((cells, radius, theta, groups, parts, base, of_cell))
    slices = max(1, math.ceil(n / slice_rows))

    def replicate(batches):
        cells, radius, theta, groups, parts, base, of_cell = plan.value
        order = np.argsort(groups, kind="stable")
        starts = np.searchsorted(groups[order], np.arange(len(parts)))
        centre = shared.value[cells[order]]
        spare = theta[order] + radius[order]
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                row = part.column(2).to_numpy()
                # The lower bound on the distance to a cell's queries is that to its pivot less their radius.
                x = _matrix(part.column(1))
                need = np.logical_or.reduceat(_distances(x, centre) <= spare + 2 * _slack(x, centre), starts, axis=1)
                at, g = np.nonzero(need)
                many = parts[g]
                at, sub = np.repeat(at, many), np.repeat(base[g], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                data = (at, sub, row[at] % slices, np.zeros(len(at), bool))
                asked = np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False))
                own = of_cell[part.column(4).to_numpy()[asked]]
                mine = base[own] + row[asked] % parts[own]
                query = (np.repeat(asked, slices), np.repeat(mine, slices), np.tile(np.arange(slices), len(asked)), np.ones(len(asked) * slices, bool))
                at, sub, cut, is_query = (np.concatenate(x) for x in zip(data, query))
                took = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sub.astype(np.int32)), pa.array(cut.astype(np.int32)), took.column(0), took.column(1), took.column(2), took.column(4), pa.array(is_query)],
                    ["g", "slice", "id", "v", "row", "cell", "query"],
                )

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["query"].to_numpy(bool)
        v, data = np.stack(pdf["v"].to_numpy()), ~asked
        ids, row, cell = (pdf[c].to_numpy() for c in ("id", "row", "cell"))
        got = solve_local(row[asked], ids[asked], v[asked], ids[data], v[data], k, cell[data], shared.value)
        return pd.DataFrame({"row": got[0], "vec_id": got[1], "neighbour_id": got[2], "distance": got[3]})

    copies = placed.mapInArrow(replicate, "g int, slice int, id long, v array<double>, row long, cell int, query boolean")
    found = copies.groupBy("g", "slice").applyInPandas(local, "row long, vec_id long, neighbour_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "neighbour_id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("row")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def op5_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 50, among all vectors."""
    return knn_join(spark, table(spark, sf_dir, "embeddings"), queries="vec_id % 50 = 0").withColumn("distance", F.round("distance", 6))


#: Brute force over all pairs of a query and a vector.
OP5_SQL = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.v, b.v) AS d
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS rank FROM p)
SELECT vec_id, neighbour_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 10
"""
