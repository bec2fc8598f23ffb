"""Language identification: word first, backing off to shorter character n-grams.

A known word adds its log frequency in each language.  An unseen word backs off to its n-grams of
five characters (marked where they touch the word's ends); if none of them is known, to those of
four, and so on down to single characters; the mean log frequency of its known n-grams stands for
it, scaled to a word.  A word without any known character adds nothing.  The language with the
highest sum wins; of equals the first in alphabetical order.

The frequencies are counted on a bounded sample of documents with a known language (a parameter);
scoring covers every word of every text.

Defined cases: a null or empty text, or one without words, has no language (null) and confidence 0;
repeated rows are scored alike; a null ``doc_id`` is scored too; rows with a null ``lang`` aren't
learnt from; without any such row no document gets a language; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import bounded, explode_texts, map_texts, table
from mnemora.llm.textkit import Words, mix

#: Most documents that frequencies are counted on.
MOST_DOCUMENTS = 10_000
#: Code points counted at once; larger slices repeat fewer n-grams.
_COUNT_CHARS = 4_000_000
#: Words and n-grams must occur this often in the sample to be known.
LEAST = 3
LONGEST = 5
_WEIGHT = 0.5  # of an unseen word against a known one


def grams(w: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``which``, hash) of all n-grams of the words ``which``; ends are marked."""
    length = w.ends[which] - w.starts[which]
    many = np.maximum(length - n + 1, 0)
    owner = np.repeat(np.arange(len(which)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = w.starts[which][owner] + offset
    mark = (offset == 0).astype(np.uint64) * np.uint64(2) + (offset == many[owner] - 1).astype(np.uint64)
    return owner, mix(w.span_hash(start, start + n) + mark * np.uint64(8) + np.uint64(n))


class Model:
    """Known hashes by table (0 words, n the n-grams of n), sorted, with log frequencies by language."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.languages, self.tables = languages, tables

    def _known(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.tables[kind][0]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log frequencies by text and language, number of words that added to it)."""
        w, k = Words(texts), len(self.languages)
        total, used = np.zeros((w.n_docs, k)), np.zeros(w.n_docs)
        h = w.hashes()
        if not len(h) or not k:
            return total, used
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        value, worth = np.zeros((len(distinct), k)), np.zeros(len(distinct))
        known, at = self._known(0, distinct)
        value[known], worth[known] = self.tables[0][1][at[known]], 1.0
        left = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            owner, g = grams(w, first[left], n)
            ok, at = self._known(n, g)
            owner, at = owner[ok], at[ok]
            count = np.bincount(owner, minlength=len(left)).astype(float)
            got = count > 0
            if got.any():
                for j in range(k):
                    s = np.bincount(owner, weights=self.tables[n][1][at, j], minlength=len(left))
                    value[left[got], j] = _WEIGHT * s[got] / count[got]
                worth[left[got]] = _WEIGHT
                left = left[~got]
        for j in range(k):
            total[:, j] = np.bincount(w.doc, weights=value[back, j], minlength=w.n_docs)[: w.n_docs]
        used = np.bincount(w.doc, weights=(worth > 0)[back].astype(float), minlength=w.n_docs)[: w.n_docs]
        return total, used

    def classify(self, texts: list[str | None]) -> tuple[list, np.ndarray]:
        total, used = self.scores(texts)
        if not self.languages:
            return [None] * len(texts), np.zeros(len(texts))
        best = np.round(total, 9).argmax(1)
        mean = (total - total.max(1, keepdims=True)) / np.maximum(used, 1)[:, None]
        p = np.exp(mean * np.minimum(used, 10)[:, None])
        confidence = np.where(used > 0, p[np.arange(len(p)), best] / p.sum(1), 0.0)
        return [self.languages[b] if u else None for b, u in zip(best, used)], confidence


def count(texts: list[str | None], group: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(table, group, hash, occurrences) of the words and n-grams of texts, by the texts' group."""
    w = Words(texts)
    h, g = w.hashes(), group[w.doc]
    out = []

    def distinct(kind, g, h, n):
        _, at, back = np.unique(mix(h + g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        out.append((kind, g[at], h[at], np.bincount(back, weights=n, minlength=len(at)).astype(np.int64)))
        return at

    at = distinct(0, g, h, None)
    n = out[0][3]
    for k in range(1, LONGEST + 1):
        owner, code = grams(w, at, k)
        distinct(k, g[at][owner], code, n[owner])
    return out


def train(docs: DataFrame, most: int = MOST_DOCUMENTS, least: int = LEAST) -> Model:
    """Counts by language on the executors; only what occurs ``least`` times comes to the driver."""
    known = docs.select("text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sample = bounded(known.withColumn("h", F.xxhash64("text")), most, "h", "lang").select("text", "lang")
    schema = T.StructType.fromDDL("lang string, kind int, hash long, n long")

    def step(texts, langs):
        names, lang = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
        got = count(texts, lang)
        kinds = np.repeat([x[0] for x in got], [len(x[1]) for x in got])
        group, h, n = (np.concatenate([x[i] for x in got]) for i in (1, 2, 3))
        return [names[group] if len(group) else [], kinds, h.view(np.int64), n]

    # ``sample`` is sorted and bounded, so it is spread again before it is counted.
    counts = explode_texts(sample.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), schema, ["text", "lang"], lambda: step, _COUNT_CHARS)
    rows = counts.groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n"))
    total = rows.groupBy("kind", "hash").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("all") >= least)
    sizes = {(r.lang, r.kind): r.n for r in rows.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for lang, _ in sizes})
    columns = [F.coalesce(F.col("by")[lang], F.lit(0)).alias(f"c{i}") for i, lang in enumerate(languages)]
    data = total.select("kind", "hash", *columns).toPandas() if languages else None
    tables = {}
    for kind in range(LONGEST + 1):
        if data is None:
            tables[kind] = (np.zeros(0, np.uint64), np.zeros((0, 0)))
            continue
        part = data[data.kind == kind]
        keys = part["hash"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        n = part[[f"c{i}" for i in range(len(languages))]].to_numpy(np.float64)[order]
        size = np.array([sizes.get((lang, kind), 0) for lang in languages], np.float64)
        tables[kind] = (keys[order], np.log((n + 0.5) / (size + 0.5 * max(len(keys), 1))))
    return Model(languages, tables)


def identify(spark: SparkSession, docs: DataFrame, most: int = MOST_DOCUMENTS, least: int = LEAST) -> DataFrame:
    """(doc_id, language, confidence) of every document."""
    shared = spark.sparkContext.broadcast(train(docs, most, least))

    def step(texts):
        language, confidence = shared.value.classify(texts)
        return [pa.array(language, pa.string()), np.round(confidence, 6)]

    fields = T.StructType.fromDDL("language string, confidence double").fields
    return map_texts(docs.select("doc_id", "text"), "text", fields, lambda: step).drop("text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, table(spark, sf_dir, "documents"))
