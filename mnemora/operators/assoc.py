"""Association scores over co-occurrence cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.operators.cooc import mirror


def _with_df(cells: DataFrame) -> DataFrame:
    df = cells.where("a = b").select(F.col("a").alias("w"), F.col("n").alias("df"))
    both = cells.where("a <> b").join(df.select(F.col("w").alias("a"), F.col("df").alias("df_a")), "a")
    return both.join(df.select(F.col("w").alias("b"), F.col("df").alias("df_b")), "b").where("df_a > 0 and df_b > 0")


def ppmi(cells: DataFrame, docs: int) -> DataFrame:
    """(a, b, ppmi), a < b, positive ones; without documents the counts themselves, diagonal included."""
    if docs == 0:
        return cells.select("a", "b", F.col("n").alias("ppmi"))
    pmi = F.log2(F.col("n") * F.lit(float(docs)) / (F.col("df_a") * F.col("df_b")))
    return _with_df(cells).select("a", "b", pmi.alias("ppmi")).where("ppmi > 0")


def conditional(cells: DataFrame) -> DataFrame:
    """(a, b, p): P(b | a) = n(a, b) / n(a, a), both directions and the diagonal of 1."""
    every = mirror(cells)
    df = cells.where("a = b").select("a", F.col("n").alias("d"))
    return every.join(df, "a", "left").select("a", "b", (F.col("n") / F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)).alias("p"))


def top_associations(scores: DataFrame, low: float, high: float, n: int, value: str = "ppmi") -> DataFrame:
    """Strongest pairs with low <= score < high, in both directions."""
    every = mirror(scores, value).where("a <> b").where((F.col(value) >= low) & (F.col(value) < high))
    return every.orderBy(F.desc(F.round(value, 6)), "a", "b").limit(n)


def expand(queries: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, word, score, rank): the words most associated with each query's words, these excluded."""
    from pyspark.sql import Window

    q = queries.select("query_id", "word").distinct()
    near = mirror(scores, "ppmi").where("a <> b and ppmi > 0").join(q.withColumnRenamed("word", "a"), "a")
    total = near.groupBy("query_id", F.col("b").alias("word")).agg(F.round(F.sum("ppmi"), 6).alias("score")).join(q, ["query_id", "word"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "word")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
