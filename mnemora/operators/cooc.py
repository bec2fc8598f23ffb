"""Word co-occurrence: cells (a, b, n) with a <= b; the diagonal is the word's document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs(terms: DataFrame, *others: str) -> DataFrame:
    """All (a, b), a <= b, of each row's distinct words, without joining rows with each other.

    A row of n words is held n words at a time, never as its n*(n+1)/2 pairs.
    """
    s = terms.select(*others, F.array_sort(F.array_distinct("words")).alias("s"))
    each = s.select(*others, "s", F.posexplode("s").alias("i", "a"))
    return each.select(*others, "a", F.explode(F.slice("s", F.col("i") + 1, F.size("s"))).alias("b"))


def enough_words(terms: DataFrame) -> DataFrame:
    return terms.where(F.size(F.array_distinct("words")) >= 2)


def prefilter(terms: DataFrame, least: int) -> DataFrame:
    """Drop words in fewer than ``least`` rows: no cell of theirs can reach ``least``.

    Exact for pruned results, also with decay, which only lowers cells; not for vocabulary sizes.
    """
    frequent = terms.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("w")
    keyed = terms.withColumn("words", F.array_distinct("words"))
    others = [c for c in keyed.columns if c != "words"]
    kept = keyed.select(*others, F.explode("words").alias("w")).join(frequent, "w", "left_semi")
    return kept.groupBy(*others).agg(F.collect_list("w").alias("words"))


def build(terms: DataFrame) -> DataFrame:
    """Pairs are made within the row, so the only shuffle is that of the map-side combined counts."""
    return pairs(terms).groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))


def frequent_numbers(terms: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The rows with words of at least ``least`` rows as numbers in the words' order, and (w, number).

    Rows stay apart even if all their other columns are equal; those without such a word are left out.
    """
    from mnemora.session import settle

    counted = terms.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    number = settle(number_documents(counted.select("w"), "w").select("w", F.col("doc_seq").cast("int").alias("number")))
    others = [c for c in terms.columns if c != "words"]
    row = settle(terms.withColumn("row", F.monotonically_increasing_id()))
    kept = row.select("row", *others, F.explode(F.array_distinct("words")).alias("w")).join(number, "w")
    return settle(kept.groupBy("row", *others).agg(F.collect_list("number").alias("words")).drop("row")), number


def named(cells: DataFrame, number: DataFrame) -> DataFrame:
    """Cells of numbered words with the words again."""
    a, b = (number.select(F.col("number").alias(c), F.col("w").alias(f"{c}_w")) for c in "ab")
    return cells.join(a, "a").join(b, "b").select(F.col("a_w").alias("a"), F.col("b_w").alias("b"), "n")


def build_pruned(terms: DataFrame, least: int) -> DataFrame:
    """The cells of ``prune(build(terms), least)``; only numbers of words that can reach it are paired."""
    rows, number = frequent_numbers(terms, least)
    return named(prune(build(rows), least), number)


def prune(cells: DataFrame, least: float) -> DataFrame:
    return cells.where(F.col("n") >= least)


def mirror(cells: DataFrame, value: str = "n") -> DataFrame:
    """Both triangles, the diagonal once."""
    return cells.unionByName(cells.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), value))


def total_docs(terms: DataFrame) -> int:
    """Documents learnt from; keyword lists don't count."""
    return enough_words(terms).where("channel = 'doc'").count()


def stats(cells: DataFrame, docs: int) -> DataFrame:
    """One row: documents, vocabulary, cells of both triangles, density."""
    one = cells.agg(F.count_if(F.col("a") == F.col("b")).alias("vocab_size"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2)).alias("nnz"))
    return density(one, docs)


def density(one: DataFrame, docs: int) -> DataFrame:
    """One row (vocab_size, nnz) with documents and density."""
    return one.select(
        F.lit(docs).cast("long").alias("total_docs"), "vocab_size", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"),
        F.coalesce(F.try_divide(F.col("nnz").cast("double"), F.pow(F.col("vocab_size").cast("double"), F.lit(2.0))), F.lit(0.0)).alias("density"),
    )


def decayed(terms: DataFrame, rate: float, interval: int, docs: int) -> DataFrame:
    """Cells when every ``interval`` documents all are scaled by 1-rate and those under 0.5 dropped.

    ``doc_seq`` numbers documents from 1; a keyword list carries the number of documents before it.
    The counts of each cell and epoch are aggregated first, and an ordered fold over a cell's few
    epochs applies the decay; empty epochs between are skipped exactly, as values only fall there.
    """
    epoch = F.when(F.col("channel") == "doc", F.ceil(F.col("doc_seq") / interval)).otherwise(F.floor(F.col("doc_seq") / interval) + 1)
    from mnemora.operators.tiles import pairs_by_epoch

    each = pairs_by_epoch(terms.withColumn("e", epoch.cast("int"))).groupBy("a", "b", "e").agg(F.sum("c").cast("double").alias("c"))
    done = docs // interval  # completed epochs
    keep = lambda v: F.when(v < 0.5, 0.0).otherwise(v)
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("e"))

    def step(s, x):
        waited = F.when(s.e > 0, F.greatest(x.e - s.e - 1, F.lit(0))).otherwise(0)
        v = keep(s.v * F.pow(F.lit(1 - rate), waited)) + x.c
        v = F.when(x.e <= done, keep(v * (1 - rate))).otherwise(v)
        return F.struct(v.alias("v"), x.e.alias("e"))

    def finish(s):
        rest = F.greatest(F.lit(done) - s.e, F.lit(0))
        return keep(s.v * F.pow(F.lit(1 - rate), rest))

    folded = each.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("e", "c"))).alias("x"))
    return folded.select("a", "b", F.aggregate("x", start, step, finish).alias("n")).where("n > 0")


def word_frequency(cells: DataFrame) -> DataFrame:
    """(word, freq): twice the word's row sum, in which the diagonal counts once."""
    return mirror(cells).groupBy("a").agg((2 * F.sum("n")).alias("freq")).withColumnRenamed("a", "word")


def cleanup(cells: DataFrame, least: float, max_vocab: int | None = None) -> DataFrame:
    """The words to drop: those under ``least``, then the least frequent beyond ``max_vocab`` (ties: later words)."""
    return rare(word_frequency(cells), least, max_vocab)


def rare(frequency: DataFrame, least: float, max_vocab: int | None = None) -> DataFrame:
    """``cleanup`` from the frequencies (word, freq).

    The limit is a frequency, found from the numbers of words of each; only words of just that
    frequency are numbered in their order, and no task sorts the vocabulary.
    """
    from mnemora.session import settle

    freq = settle(frequency)
    low = freq.where(F.col("freq") < least).select("word")
    if max_vocab is None:
        return low
    kept = freq.where(F.col("freq") >= least)
    surplus = kept.count() - max_vocab
    if surplus <= 0:
        return low
    for r in kept.groupBy("freq").count().orderBy("freq").toLocalIterator():
        if r["count"] >= surplus:
            break
        surplus -= r["count"]
    ties = number_documents(kept.where(F.col("freq") == r.freq).select("word"), "word")
    last = ties.where(F.col("doc_seq") > r["count"] - surplus).select("word")
    return low.unionByName(kept.where(F.col("freq") < r.freq).select("word")).unionByName(last)


def remove_words(cells: DataFrame, words: DataFrame) -> DataFrame:
    w = words.select("word").distinct()
    return cells.join(w.withColumnRenamed("word", "a"), "a", "left_anti").join(w.withColumnRenamed("word", "b"), "b", "left_anti").select("a", "b", "n")


def consolidate(entries: DataFrame, since: float) -> DataFrame:
    """Cells learnt anew from recent entries' keyword lists alone."""
    recent = entries.where((F.col("timestamp") >= since) & (F.size(F.array_distinct("keywords")) >= 2))
    return build(recent.select(F.col("keywords").alias("words")))


def forget_words(terms: DataFrame, words: DataFrame) -> DataFrame:
    """The terms as if these words had never been learnt; rows without any other word are left out."""
    from mnemora.session import settle

    row = settle(terms.withColumn("row", F.monotonically_increasing_id()))
    others = [c for c in row.columns if c != "words"]
    each = row.select(*others, F.explode("words").alias("w"))
    kept = each.join(words.select(F.col("word").alias("w")).distinct(), "w", "left_anti")
    return kept.groupBy(*others).agg(F.collect_list("w").alias("words")).select(*terms.columns)


def number_documents(docs: DataFrame, order: str) -> DataFrame:
    """``doc_seq`` from 1 in the order of a unique column.

    Ranges of the order are numbered by themselves and shifted by the sizes of those before, so
    the rows are never gathered in one task.
    """
    part = docs.repartitionByRange(F.col(order)).withColumn("p", F.spark_partition_id())
    from mnemora.session import settle

    part = settle(part)
    sizes = part.groupBy("p").agg(F.count("*").alias("k"))
    before = sizes.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "before")
    w = Window.partitionBy("p").orderBy(order)
    return part.join(F.broadcast(before), "p").withColumn("doc_seq", F.row_number().over(w) + F.col("before")).drop("p", "before")
