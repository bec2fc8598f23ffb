"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by their number of distinct word shingles into classes of size at most u (a
power of two).  For each class a document is read as overlapping windows of two blocks of u
shingles, so that a passage of an item's length lies whole in one window however long the document
is; that keeps the Jaccard similarity of item and window within a small factor of the containment,
which a whole-document MinHash of a long text could not.  Signatures are one-permutation MinHashes:
the least shingle of each of BINS bins.  An item is a candidate for a document if any bin of its
signature equals that of a window.  The smallest class has as many bins as there are shingles, so
that its items, of which a single shingle may be shared, are always found; in the others a passage of
half an item shares more than u/4 shingles with it, and the chance that each of them is hidden by a
smaller one in its bin is below 1e-5 for u=16 and vanishes for greater u.  A bin can only match on a
value of an item's signature, so window minima are evaluated just where a document has such a value,
which gives the same candidates as complete signatures.

Only candidates are verified, by the exact containment of the item's shingles in the whole document.

The item index is broadcast in slices of bounded size; a benchmark beyond one slice takes one pass
over the documents for each slice.

Defined cases: null or empty documents match nothing; null or empty items (or those without a word)
are matched by nothing; an item of fewer words than a shingle is searched as one shingle of all its
words; repeated documents and items each give their own rows; a null ``doc_id`` or ``item_id`` is
reported as null; an empty table gives an empty result; other columns are carried along or ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import explode_texts, map_texts, pick, table
from mnemora.llm.textkit import Words

WIDTH = 5
CONTAINMENT = 0.5
#: Bins of a signature, of which the smallest class needs none.
BINS = 256
SMALLEST = 8
#: Characters of item texts in one broadcast slice of the index.
SLICE_CHARS = 8_000_000
_FILTER = 1 << 20


class Signatures:
    """Signature values of the items of one class, by value, with a filter of their bits."""

    def __init__(self, bound: int, shingle: np.ndarray, item: np.ndarray):
        self.bound = bound
        if bound > SMALLEST:  # the least shingle of each bin of each item
            order = np.lexsort((shingle, shingle % np.uint64(BINS), item))
            shingle, item = shingle[order], item[order]
            bin_ = shingle % np.uint64(BINS)
            least = np.concatenate(([True], (item[1:] != item[:-1]) | (bin_[1:] != bin_[:-1])))
            shingle, item = shingle[least], item[least]
        order = np.argsort(shingle, kind="stable")
        self.value, self.item = shingle[order], item[order]
        self.bits = np.zeros(_FILTER, bool)
        self.bits[self.value & np.uint64(_FILTER - 1)] = True

    def candidates(self, s: np.ndarray, d: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of the shared signature values; ``s`` and ``d`` are the texts' shingles, ``start`` where each begins."""
        place = np.flatnonzero(self.bits[s & np.uint64(_FILTER - 1)])
        at = np.searchsorted(self.value, s[place])
        known = self.value[np.minimum(at, len(self.value) - 1)] == s[place]
        place, low = place[known], at[known]
        if self.bound > SMALLEST and len(place):
            least = self._least(s, d, start, place)
            place, low = place[least], low[least]
        many = np.searchsorted(self.value, s[place], side="right") - low
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        return np.repeat(d[place], many), self.item[entry]

    def _least(self, s: np.ndarray, d: np.ndarray, start: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a shingle is the least of its bin in one of the two windows that it lies in."""
        bound, bins = self.bound, np.uint64(BINS)
        ok = np.zeros(len(place), bool)
        doc = d[place]
        block = (place - start[doc]) // bound
        step = 400_000 // bound + 1
        for back in (0, 1):
            first = np.maximum(start[doc] + (block - back) * bound, start[doc])
            for a in range(0, len(place), step):
                near = first[a : a + step, None] + np.arange(2 * bound)
                x = s[np.minimum(near, len(s) - 1)]
                own = s[place[a : a + step]][:, None]
                smaller = (near < start[doc[a : a + step] + 1][:, None]) & (x % bins == own % bins) & (x < own)
                ok[a : a + step] |= ~smaller.any(axis=1)
        return ok


class Index:
    """Signatures by class, and shingle sets, of the items of one slice."""

    def __init__(self, texts: list[str | None], width: int = WIDTH):
        self.sets: dict[int, tuple] = {}
        w = Words(texts)
        h, count = w.hashes(), np.diff(w.first)
        self.size = np.zeros(len(texts), np.int64)
        for k in range(1, width + 1):
            s, d = w.shingles(k, h)
            chosen = (np.minimum(count, width) == k)[d]
            if not chosen.any():
                continue
            # distinct (item, shingle) pairs in order
            order = np.lexsort((s[chosen], d[chosen]))
            shingle, item = s[chosen][order], d[chosen][order]
            new = np.concatenate(([True], (item[1:] != item[:-1]) | (shingle[1:] != shingle[:-1])))
            shingle, item = shingle[new], item[new]
            size = np.bincount(item, minlength=len(texts))
            self.size += size
            bound = np.maximum(SMALLEST, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))[item]
            classes = [Signatures(int(u), shingle[bound == u], item[bound == u]) for u in np.unique(bound)]
            self.sets[k] = classes, shingle, np.searchsorted(item, np.arange(len(texts) + 1))

    def search(self, texts: list[str | None], containment: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arrays (text, item, containment) of the verified pairs."""
        found: list[np.ndarray] = []
        w = Words(texts)
        h = w.hashes()
        for k, (classes, shingle, start_item) in self.sets.items():
            s, d = w.shingles(k, h)
            start = np.searchsorted(d, np.arange(w.n_docs + 1))
            pairs = [np.stack(c.candidates(s, d, start), 1) for c in classes]
            pairs = np.unique(np.concatenate(pairs), axis=0)
            at = 0
            for doc in np.unique(pairs[:, 0]):  # texts with candidates are few
                items = pairs[at : at + np.searchsorted(pairs[at:, 0], doc, side="right"), 1]
                at += len(items)
                own = np.unique(s[start[doc] : start[doc + 1]])
                many = start_item[items + 1] - start_item[items]
                wanted = shingle[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start_item[items], many)]
                shared = own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted
                n = np.add.reduceat(shared, np.cumsum(many) - many)
                found.append(np.stack([np.full(len(items), doc), items, n / self.size[items]], 1))
        got = np.concatenate(found) if found else np.zeros((0, 3))
        got = got[got[:, 2] >= containment]
        return got[:, 0].astype(np.int64), got[:, 1].astype(np.int64), got[:, 2]


def _indexes(spark: SparkSession, benchmark: DataFrame, width: int, slice_chars: int):
    """Broadcast (Index, item ids) of each slice of the items."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / slice_chars))
    for i in range(n):
        rows = items.where(F.pmod(pick("text"), F.lit(n)) == i).collect() if total else []
        if rows:
            yield spark.sparkContext.broadcast((Index([r.text for r in rows], width), [r.item_id for r in rows]))


def find_contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """(doc_id, item_id, containment) of each document that holds at least that share of an item."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType())])
    source = docs.selectExpr("text", "cast(doc_id as long) doc_id")
    parts = []
    for shared in _indexes(spark, benchmark, width, slice_chars):

        def make(shared=shared):
            index, ids = shared.value

            def step(texts, doc_ids):
                doc, item, share = index.search(texts, containment)
                return [doc_ids[x] for x in doc], [ids[x] for x in item], share

            return step

        parts.append(explode_texts(source, schema, ["text", "doc_id"], make))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """The documents that hold less than that share of every item, with all their columns."""
    for shared in _indexes(spark, benchmark, width, slice_chars):

        def make(shared=shared):
            index = shared.value[0]

            def step(texts):
                clean = np.ones(len(texts), bool)
                clean[index.search(texts, containment)[0]] = False
                return [clean]

            return step

        docs = map_texts(docs, "text", [], make, keep=True)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


#: Exact containment by brute force.
OP4_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
i_s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM iw)),
size AS (SELECT item_id, k, count(*) AS n FROM i_s GROUP BY ALL),
d_s AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
              FROM d, (SELECT DISTINCT k FROM iw) ks WHERE len(w) >= k)),
shared AS (SELECT doc_id, item_id, k, count(*) AS c FROM d_s JOIN i_s USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, round(c / n, 6) AS containment FROM shared JOIN size USING (item_id, k) WHERE c / n >= 0.5
"""
