"""Keyword extraction as column expressions and DataFrame operators.

Tokens are lower-cased runs of letters; Han runs, which have no blanks, are cut into their
bigrams besides.  What isn't a built-in expression runs on Arrow batches (``lexer``), never on rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.lexer import keyword_lists, learnable_lists, maximal_lists, word_counts
from mnemora.functions.stopwords import STOPWORDS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _arrow(kind: str, step, *columns: Column) -> Column:
    """An Arrow function of columns; called nondeterministic so that no plan evaluates it twice."""

    def run(x: pa.Array) -> pa.Array:
        return step(x)

    return F.arrow_udf(run, kind).asNondeterministic()(*columns)


def drop_contained(tokens: Column) -> Column:
    """Only words that aren't a strict substring of another word of the list, in its order; null gives an empty list."""
    return _arrow("array<string>", maximal_lists, tokens)


def keywords(text: Column | str, min_len: int = 2, stopwords: list[str] | None = None) -> Column:
    """Distinct usable words of a text that no other one contains, longest first, then alphabetical."""
    stop = frozenset(STOPWORDS if stopwords is None else stopwords)
    return _arrow("array<string>", lambda x: keyword_lists(x, min_len, stop), col(text))


def learnable_words(text: Column | str, min_len: int = 2) -> Column:
    """``keywords`` of a text, or if it has Han runs the pairs of their characters and its other words, in order."""
    stop = frozenset(STOPWORDS)
    return _arrow("array<string>", lambda x: learnable_lists(x, min_len, stop), col(text))


def counted_words(text: Column | str) -> Column:
    """All distinct words of a text, stop words too, with their numbers of occurrences: (word, n)."""
    return _arrow("array<struct<word:string,n:int>>", word_counts, col(text))


def document_frequency(docs: DataFrame, tokens: str = "words") -> DataFrame:
    """(word, df) over the distinct words of each row."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def weighted_keywords(docs: DataFrame, id_col: str, text_col: str, top_k: int = 25, long_threshold: int = 80, min_len: int = 2) -> DataFrame:
    """(id, word, weight, rank): the words that describe each text.

    Texts up to ``long_threshold`` characters keep all keywords at weight 1; longer ones the
    ``top_k`` of highest TF-IDF, tf*ln(N/df) rounded to 6 places, ties by word, from twice as many
    of which contained words are dropped first.  Frequencies are those of the whole table.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col) > long_threshold, F.lit(False)).alias("long"), F.col(text_col).alias("text"))
    n = docs.count()
    tokens = base.select("id", "long", F.explode(counted_words("text")).alias("t")).select("id", "long", "t.word", F.col("t.n").cast("long").alias("tf"))
    counted = tokens.where("long").drop("long").where((F.length("word") >= min_len) & ~F.col("word").isin(STOPWORDS))
    every = tokens.groupBy("word").agg(F.count("*").alias("df"))
    scored = counted.join(every, "word").withColumn("weight", F.round(F.col("tf") * F.log(F.lit(float(n)) / F.col("df")), 6))
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "word")
    top = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * top_k)
    lists = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("m"), "word"))).alias("x"))
    lists = lists.withColumn("kept", drop_contained(F.col("x.word")))
    lists = lists.withColumn("x", F.slice(F.filter("x", lambda s: F.array_contains("kept", s.word)), 1, top_k))
    longs = lists.select("id", F.posexplode("x").alias("p", "s")).select("id", F.col("s.word").alias("word"), (-F.col("s.m")).alias("weight"), (F.col("p") + 1).cast("int").alias("rank"))
    shorts = base.where("not long").select("id", F.posexplode(keywords("text", min_len)).alias("p", "word")).select("id", "word", F.lit(1.0).alias("weight"), (F.col("p") + 1).cast("int").alias("rank"))
    return longs.unionByName(shorts)


def tier_words(ranked: DataFrame, core_ratio: float = 0.2, important_ratio: float = 0.4) -> DataFrame:
    """Add ``tier`` (core, important, supplement) to ranked words by their place among the id's words."""
    n = F.count("*").over(Window.partitionBy("id"))
    core = F.greatest(F.lit(3), F.floor(n * core_ratio))
    important = core + F.greatest(F.lit(3), F.floor(n * important_ratio))
    tier = F.when(F.col("rank") <= core, "core").when(F.col("rank") <= important, "important").otherwise("supplement")
    return ranked.withColumn("tier", tier)
