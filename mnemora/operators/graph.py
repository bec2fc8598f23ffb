"""Reasoning over the association graph: personalised PageRank, components and shortest paths.

Edges are (src, dst, weight, distance) in both directions.  Every iteration is one join and one
aggregation; results are written to the shared folder every few rounds, which bounds the lineage
and survives the loss of executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.operators.tiles import Edges, Tiles
from mnemora.session import settle

_EVERY = 4


def edges(scores: DataFrame, least: float = 0.1, value: str = "ppmi") -> DataFrame:
    kept = scores.where((F.col("a") != F.col("b")) & (F.col(value) >= least) & (F.col(value) > 0))
    w = F.col(value).alias("weight"), (1.0 / (F.col(value) + 1e-8)).alias("distance")
    return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), *w).unionByName(kept.select(F.col("b").alias("src"), F.col("a").alias("dst"), *w))


def reachable(graph: DataFrame, start: DataFrame) -> DataFrame:
    """(node,): everything connected to the start nodes, by a growing frontier."""
    seen = settle(start.select("node").distinct())
    front = seen
    while True:
        front = settle(graph.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = settle(seen.unionByName(front))


def connected(graph: DataFrame, anchors: list[str]) -> bool:
    """Whether all anchors are in the first one's component."""
    spark = graph.sparkSession
    seen = reachable(graph, spark.createDataFrame([(anchors[0],)], "node string"))
    return seen.where(F.col("node").isin(anchors)).count() == len(set(anchors))


def pagerank(graph: DataFrame, anchors: list[str], alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, rank) personalised to the anchors, weighted transitions, from a uniform start.

    It stops after ``rounds``, or when the ranks' total change is under nodes * tolerance.  Nodes
    of a symmetric graph always have an edge, so no rank is lost.
    """
    spark = graph.sparkSession
    out = graph.groupBy("src").agg(F.sum("weight").alias("total"))
    step = settle(graph.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    nodes = settle(out.select(F.col("src").alias("node"), F.col("src").isin(anchors).alias("anchor")))
    n, k = nodes.count(), nodes.where("anchor").count()
    if not k:
        return spark.createDataFrame([], "node string, rank double")
    seed = F.when(F.col("anchor"), (1 - alpha) / k).otherwise(0.0)
    rank = nodes.select("node", F.lit(1.0 / n).alias("rank"))
    for i in range(1, rounds + 1):
        came = step.join(rank.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("came"))
        new = nodes.join(came.withColumnRenamed("dst", "node"), "node", "left").select("node", (seed + alpha * F.coalesce("came", F.lit(0.0))).alias("rank"))
        if i % _EVERY == 0 or i == rounds:
            new = settle(new)
            if tolerance is not None and i < rounds:
                last = rank.withColumnRenamed("rank", "old")
                moved = new.join(last, "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if moved < n * tolerance:
                    return new
        rank = new
    return rank


def shortest_paths(graph: DataFrame, sources: list[str], targets: list[str]) -> DataFrame:
    """(source, target, distance, path, total_weight, hops) for each pair that is connected.

    Relaxation from all sources at once; only improved nodes are expanded, and of equally short
    paths the alphabetically first one is kept.
    """
    spark = graph.sparkSession
    best = settle(spark.createDataFrame([(s, s, 0.0, 0.0, [s]) for s in sorted(set(sources))], "source string, node string, distance double, total_weight double, path array<string>"))
    front = best
    while not front.isEmpty():
        g = graph.withColumnRenamed("distance", "d")
        longer = front.join(g, front.node == g.src).where(~F.array_contains("path", F.col("dst"))).select(
            "source", F.col("dst").alias("node"), (F.col("distance") + F.col("d")).alias("distance"),
            (F.col("total_weight") + F.col("weight")).alias("total_weight"), F.concat("path", F.array("dst")).alias("path"),
        )
        least = F.min(F.struct(F.round("distance", 12).alias("r"), "path", "distance", "total_weight")).alias("m")
        new = longer.groupBy("source", "node").agg(least).select("source", "node", "m.distance", "m.total_weight", "m.path")
        old = best.select("source", "node", F.round("distance", 12).alias("od"), F.col("path").alias("op"))
        r = F.round("distance", 12)
        better = new.join(old, ["source", "node"], "left").where(F.col("od").isNull() | (r < F.col("od")) | ((r == F.col("od")) & (F.col("path") < F.col("op")))).drop("od", "op")
        front = settle(better)
        best = settle(best.join(front, ["source", "node"], "left_anti").unionByName(front))
    return best.where(F.col("node").isin(targets) & (F.col("node") != F.col("source"))).select(
        "source", F.col("node").alias("target"), "distance", "path", F.round("total_weight", 4).alias("total_weight"), (F.size("path") - 1).alias("hops")
    )


def hidden_chain(
    scores: DataFrame, counts: DataFrame | None, anchors: list[str], top_k: int = 50, alpha: float = 0.85, least: float = 0.1, n: int = 10, tolerance: float = 1e-6
) -> tuple[DataFrame, DataFrame, str | None]:
    """(hidden words, chains, error): words that tie the anchors together.

    If the anchors aren't connected, lower thresholds are tried, then edges from the co-occurrence
    counts are added at a tenth of their strength.  Candidates are ranked by PageRank times one
    plus the shortest paths between anchors that they are on.
    """
    spark: SparkSession = scores.sparkSession
    nothing = spark.createDataFrame([], "word string, ppr_score double, path_count long, combined_score double"), spark.createDataFrame([], "source string, target string, path array<string>, total_weight double, hops int")
    graph = settle(edges(scores, least))
    found = [r.src for r in graph.where(F.col("src").isin(anchors)).select("src").distinct().orderBy("src").collect()]
    if len(found) < 2:
        return *nothing, "fewer than two anchors are in the graph"
    if not connected(graph, found):
        for threshold in (0.5 * least, 0.05, 0.01, 0.001, 0.0):
            wider = settle(edges(scores, threshold))
            if threshold < least and connected(wider, found):
                graph = wider
                break
        else:
            if counts is not None:
                weak = edges(counts.where("n >= 0.5"), 0.0, "n").select("src", "dst", (F.col("weight") * 0.1).alias("weight"), (F.col("distance") * 10).alias("distance"))
                graph = settle(graph.unionByName(weak.join(graph.select("src", "dst"), ["src", "dst"], "left_anti")))
    near = reachable(graph, spark.createDataFrame([(a,) for a in found], "node string"))
    ranks = pagerank(graph, found, alpha, tolerance=tolerance).join(near, "node", "left_semi").where(~F.col("node").isin(found))
    top = ranks.orderBy(F.desc("rank"), "node").limit(top_k)
    paths = shortest_paths(graph, found, found).where(F.col("source") < F.col("target"))
    votes = paths.select(F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("node")).where(~F.col("node").isin(found)).groupBy("node").agg(F.count("*").alias("c"))
    both = top.join(votes, "node", "full").select(F.col("node").alias("word"), F.coalesce("rank", F.lit(0.0)).alias("p"), F.coalesce("c", F.lit(0)).alias("c"))
    score = F.when(F.col("p") > 0, F.col("p") * (1 + F.col("c"))).otherwise(0.001 * F.col("c"))
    words = both.select("word", F.round("p", 6).alias("ppr_score"), F.col("c").alias("path_count"), F.round(score, 6).alias("combined_score"))
    return words.orderBy(F.desc("combined_score"), "word").limit(n), paths.select("source", "target", "path", "total_weight", "hops"), None


# ---- the same over edges of tiles: the graph is read in each round, and only vectors of its nodes are moved ----


def tiled_reachable(g: Edges, starts: list[int]) -> np.ndarray:
    """Whether each node is connected to one of these."""
    seen = np.zeros(g.tiles.words)
    seen[starts] = 1.0
    while True:
        new = np.maximum(seen, g.spread({"seen": seen}, lambda v, a, b, s: v["seen"][a], 0.0, np.maximum))
        if (new == seen).all():
            return seen > 0
        seen = new


def tiled_pagerank(g: Edges, anchors: list[int], alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, whether a node has edges), as ``pagerank`` has them; no node if no anchor has edges."""
    total = g.spread({}, lambda v, a, b, s: s, 0.0, np.add)
    node = total > 0
    own = [a for a in anchors if node[a]]
    if not own:
        return np.zeros(len(node)), np.zeros(len(node), bool)
    seed = np.zeros(len(node))
    seed[own] = (1 - alpha) / len(own)
    n = int(node.sum())
    rank = np.where(node, 1.0 / n, 0.0)
    for i in range(1, rounds + 1):
        share = np.divide(rank, total, out=np.zeros(len(node)), where=node)
        new = seed + alpha * g.spread({"share": share}, lambda v, a, b, s: v["share"][a] * s, 0.0, np.add)
        moved, rank = np.abs(new - rank).sum(), new
        if tolerance is not None and i % _EVERY == 0 and i < rounds and moved < n * tolerance:
            break
    return rank, node


def tiled_shortest_paths(g: Edges, anchors: list[str]) -> list[tuple[str, str, float, list[str], float]]:
    """(source, target, distance, path, total_weight) of each pair of connected anchors, as ``shortest_paths`` has them.

    Distances are relaxed over the whole graph; the paths are then found from the targets back, and
    of equally short ones (to 12 places) the alphabetically first, whose numbers are the least.
    """
    number = g.numbers(anchors)
    found, used = [], set()
    for source in sorted(number):
        far = np.full(g.tiles.words, np.inf)
        far[number[source]] = 0.0
        while True:
            new = np.minimum(far, g.spread({"far": far}, lambda v, a, b, s: v["far"][a] + 1.0 / (s + 1e-8), np.inf, np.minimum))
            if (new == far).all():
                break
            far = new
        ends = [number[x] for x in number if x != source and np.isfinite(far[number[x]])]
        before: dict[int, list[tuple[int, float]]] = {}
        front = set(ends)
        while front:
            for x, near in g.into(np.array(sorted(front))).items():
                before[x] = [(y, w) for y, w in near if far[y] < far[x] and round(float(far[y] + 1.0 / (w + 1e-8)), 12) == round(float(far[x]), 12)]
            front = {y for x in front for y, _ in before[x]} - before.keys() - {number[source]}
        best: dict[int, tuple] = {number[source]: ([number[source]], 0.0, 0.0)}
        for x in sorted(before, key=lambda x: far[x]):
            path, y, w = min((best[y][0], y, w) for y, w in before[x])
            best[x] = ([*path, x], best[y][1] + 1.0 / (w + 1e-8), best[y][2] + w)
        found += [(source, best[e]) for e in ends]
        used |= {x for e in ends for x in best[e][0]}
    name = g.names(used) if used else {}
    return [(s, name[p[-1]], d, [name[x] for x in p], round(w, 4)) for s, (p, d, w) in found]


def tiled_paths(g: Edges, anchors: list[str]) -> DataFrame:
    rows = [(*p, len(p[3]) - 1) for p in tiled_shortest_paths(g, anchors)]
    return g.tiles.spark.createDataFrame(rows, "source string, target string, distance double, path array<string>, total_weight double, hops int")


def tiled_hidden_chain(t: Tiles, anchors: list[str], top_k: int = 50, least: float = 0.1, n: int = 10) -> DataFrame:
    """The hidden words of ``hidden_chain``; anchors that aren't connected are left to it, as it then tries other edges."""
    g = Edges.of(t, least)
    number = g.numbers(anchors)
    rank, node = tiled_pagerank(g, list(number.values()))
    found = sorted(w for w, k in number.items() if node[k])
    near = tiled_reachable(g, [number[found[0]]]) if found else node
    if len(found) < 2 or not all(near[number[w]] for w in found):
        return hidden_chain(settle(t.ppmi()), t.cells(), anchors, top_k, least=least, n=n)[0]
    own = [number[w] for w in found]
    rest = node & near
    rest[own] = False
    at = np.flatnonzero(rest)
    top = at[np.lexsort((at, -rank[at]))][:top_k]
    score = {x: (float(rank[k]), 0) for k, x in g.names(top).items()} if len(top) else {}
    for s, e, _, path, _ in tiled_shortest_paths(g, found):
        for w in path[1:-1] if s < e else ():
            if w not in found:
                p, c = score.get(w, (0.0, 0))
                score[w] = (p, c + 1)
    rows = [(w, p, c) for w, (p, c) in score.items()]
    both = t.spark.createDataFrame(rows, "word string, p double, c long")
    s = F.when(F.col("p") > 0, F.col("p") * (1 + F.col("c"))).otherwise(0.001 * F.col("c"))
    words = both.select("word", F.round("p", 6).alias("ppr_score"), F.col("c").alias("path_count"), F.round(s, 6).alias("combined_score"))
    return words.orderBy(F.desc("combined_score"), "word").limit(n)
