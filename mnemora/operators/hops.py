"""Multi-hop inference over directed strengths (a, b, p)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.operators.tiles import Tiles
from mnemora.session import settle


def two_hop(strength: DataFrame, word: str, n: int = 5) -> DataFrame:
    """The strongest paths word -> mid -> target over distinct words, by the product."""
    s = strength.where("a <> b and p > 0")
    first = s.where(F.col("a") == word).select(F.col("b").alias("mid"), F.col("p").alias("p1"))
    second = s.where(F.col("b") != word).select(F.col("a").alias("mid"), F.col("b").alias("target"), F.col("p").alias("p2"))
    return first.join(second, "mid").select("mid", "target", F.round(F.col("p1") * F.col("p2"), 6).alias("score")).orderBy(F.desc("score"), "mid", "target").limit(n)


def group_inference(strength: DataFrame, words: list[str], n: int = 10, least: float = 0.01) -> DataFrame:
    """(target, confidence, whys): sum over words and mids of p1*p2, with the three best explanations.

    The best 2n targets are merged by ``merge_substrings`` into n.
    """
    s = strength.where((F.col("p") > least) & ~F.col("b").isin(words))
    first = s.where(F.col("a").isin(words)).select(F.col("a").alias("word"), F.col("b").alias("mid"), F.col("p").alias("p1"))
    second = s.where(~F.col("a").isin(words)).select(F.col("a").alias("mid"), F.col("b").alias("target"), F.col("p").alias("p2"))
    score = F.col("p1") * F.col("p2")
    best = F.sort_array(F.collect_list(F.struct((-F.round(score, 9)).alias("s"), "word", "mid")))
    grouped = first.join(second, "mid").groupBy("target").agg(F.round(F.sum(score), 6).alias("confidence"), F.slice(best, 1, 3).alias("w"))
    return _merged_group(grouped.orderBy(F.desc("confidence"), "target").limit(2 * n), n)


def _merged_group(best: DataFrame, n: int) -> DataFrame:
    merged = merge_substrings([(r.target, r.confidence, [tuple(x) for x in r.w]) for r in best.collect()], n, key=lambda x: x)
    rows = [(t, c, [f"{word} > {mid}" for _, word, mid in w]) for t, c, w in merged]
    return best.sparkSession.createDataFrame(rows, "target string, confidence double, whys array<string>")


def _words(spark, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted(set(words))], "w string")


def tiled_two_hop(t: Tiles, word: str, n: int = 5) -> DataFrame:
    """``two_hop`` without the strengths as a table: each tile gives its best paths."""
    own = _words(t.spark, [word])
    first = t.conditional_of(own).where(F.col("b") != word).select(F.col("b").alias("w"), "p")
    return t.top_products(first, own, n)


def tiled_group_inference(t: Tiles, words: list[str], n: int = 10, least: float = 0.01) -> DataFrame:
    """``group_inference`` without the strengths as a table: sums by tile, then the explanations of the best targets alone."""
    own = _words(t.spark, words)
    first = settle(t.conditional_of(own).where((F.col("p") > least) & ~F.col("b").isin(words)).select(F.col("a").alias("word"), F.col("b").alias("mid"), F.col("p").alias("p1")))
    weight = first.groupBy(F.col("mid").alias("w")).agg(F.sum("p1").alias("p"))
    scored = t.sums_over(weight, least, own).select("target", F.round("score", 6).alias("confidence"))
    top = settle(scored.orderBy(F.desc("confidence"), "target").limit(2 * n))
    second = t.towards(top.select(F.col("target").alias("w"))).where((F.col("p") > least) & ~F.col("a").isin(words)).select(F.col("a").alias("mid"), F.col("b").alias("target"), F.col("p").alias("p2"))
    best = F.sort_array(F.collect_list(F.struct((-F.round(F.col("p1") * F.col("p2"), 9)).alias("s"), "word", "mid")))
    whys = first.join(second, "mid").groupBy("target").agg(F.slice(best, 1, 3).alias("w"))
    return _merged_group(top.join(whys, "target"), n)


def merge_substrings(ranked: list[tuple[str, float, list]], n: int, key: Callable | None = None) -> list[tuple[str, float, list]]:
    """Fold shorter targets into the first kept longer one that contains them (at most 2n rows).

    Of the explanations, in the order of ``key`` if it is given, three are kept.
    """
    kept: list[list] = []
    for target, score, whys in sorted(ranked, key=lambda r: (-len(r[0]), -r[1], r[0])):
        host = next((k for k in kept if target in k[0]), None)
        if host is None:
            kept.append([target, score, list(whys)])
        else:
            host[1] += score
            host[2] = host[2] + list(whys)
            host[2] = (sorted(host[2], key=key) if key else host[2])[:3]
    return [(t, round(s, 6), w) for t, s, w in sorted(kept, key=lambda k: (-round(k[1], 6), k[0]))[:n]]


def degrees(strength: DataFrame, least: float = 0.0) -> DataFrame:
    return strength.where((F.col("p") > least) & (F.col("a") != F.col("b"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def hubs(strength: DataFrame, percentile: float = 0.95, least: float = 0.0) -> DataFrame:
    """(node, degree) of nodes whose degree exceeds that percentile of all degrees."""
    return above(degrees(strength, least), percentile)


def above(d: DataFrame, percentile: float) -> DataFrame:
    """(node, degree) whose degree exceeds that percentile of all."""
    return d.crossJoin(F.broadcast(d.agg(F.percentile("degree", F.lit(percentile)).alias("limit")))).where("degree > limit").select("node", "degree")


def beam_search(
    strength: DataFrame | Tiles, words: list[str], depth: int = 3, width: int = 20, least: float = 0.01, n: int = 10, hop_decay: float = 0.5, diversity: float = 0.6, hub_percentile: float = 0.95
) -> DataFrame:
    """(target, score, whys): what all the words lead to within exactly ``depth`` hops, with the three best paths.

    Each word has its own beam of the ``width`` best partial paths; hubs pass on only 0.3 of the
    strength, every further hop is damped by ``hop_decay``, and weak paths (under a tenth of
    ``least``) are dropped.  Targets are scored over all paths that reach the last hop before the
    beam is cut there.  With several words a target must be reached from each or be next to each;
    with one word it must be next to it.  The best 2n are merged by ``merge_substrings`` into n.
    Of tiles only the rows of words that a beam holds are counted.
    """
    tiled = isinstance(strength, Tiles)
    spark = strength.spark if tiled else strength.sparkSession
    edges = lambda s: s.where((F.col("p") > least) & (F.col("a") != F.col("b")) & ~F.col("b").isin(words)).select("a", F.col("b").alias("next"), "p")
    hub = (settle(above(strength.degrees(), hub_percentile)) if tiled else hubs(strength, hub_percentile)).select(F.col("node").alias("a"), F.lit(0.3).alias("damp"))
    beam = spark.createDataFrame([(w, w, 1.0, [w]) for w in sorted(set(words))], "word string, a string, cum double, path array<string>")
    reached = None
    for d in range(depth):
        if tiled:
            beam = settle(beam)
        e = edges(strength.conditional_of(beam.select(F.col("a").alias("w"))) if tiled else strength)
        step = beam.join(e, "a").join(hub, "a", "left").where(~F.array_contains("path", F.col("next")))
        cum = F.col("cum") * F.col("p") * (hop_decay**d) * F.coalesce("damp", F.lit(1.0))
        step = step.select("word", F.col("next").alias("a"), cum.alias("cum"), F.concat("path", F.array("next")).alias("path")).where(F.col("cum") >= 0.1 * least)
        if tiled:
            step = settle(step)
        if d == depth - 1:
            reached = step
        w = Window.partitionBy("word").orderBy(F.desc(F.round("cum", 12)), "path")
        beam = step.withColumn("r", F.row_number().over(w)).where(F.col("r") <= width).drop("r")
    scored = reached.groupBy(F.col("a").alias("target")).agg(
        F.sum("cum").alias("s"), F.countDistinct("word").alias("sources"), F.countDistinct(F.col("path")[1]).alias("bridges"),
        F.slice(F.sort_array(F.collect_list(F.struct((-F.round("cum", 9)).alias("s"), F.array_join("path", " > ").alias("path")))), 1, 3).alias("w"),
    )
    direct = (strength.conditional_of(_words(spark, words)) if tiled else strength).where(F.col("a").isin(words) & (F.col("p") > 0) & (F.col("a") != F.col("b"))).groupBy(F.col("b").alias("target")).agg(F.countDistinct("a").alias("near"))
    k = len(set(words))
    j = scored.join(direct, "target", "left").withColumn("coverage", F.coalesce("near", F.lit(0)) / k)
    j = j.where((F.col("sources") == k) | (F.col("coverage") == 1)) if k > 1 else j.where("coverage > 0")
    many = F.when((F.col("sources") == k) & F.lit(k > 1), 1.5).when(F.col("sources") > 1, 1 + 0.2 * (F.col("sources") - 1)).otherwise(1.0)
    few = F.when(F.col("bridges") <= 1, diversity).otherwise(1.0)
    score = F.round(F.col("s") * F.sqrt("coverage") * many * few, 6)
    top = j.select("target", score.alias("score"), "w").orderBy(F.desc("score"), "target").limit(2 * n).collect()
    merged = merge_substrings([(r.target, r.score, [tuple(x) for x in r.w]) for r in top], n, key=lambda x: x)
    return spark.createDataFrame([(t, c, [path for _, path in w]) for t, c, w in merged], "target string, score double, whys array<string>")
