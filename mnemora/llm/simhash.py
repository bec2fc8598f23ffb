"""SimHash near-duplicates: BK-trees over sharded fingerprints.

Each text with at least one word has two 64-bit SimHashes: one of its words (those of fewer than
five characters weigh a tenth), which is searched, and one of its word pairs, which confirms.  As
both are majority votes, they converge for long texts of one language, so a sketch that doesn't
(one bit of each of 256 MinHashes of the runs of three words) verifies.  Two texts are
near-duplicates if the first differ in at most ``radius`` bits, the second in at most ``confirm``
and the sketches in at most ``MOST_APART``.  Groups are the connected components of that relation; a group's representative is
its smallest ``doc_id``.

The search is exact.  The 64 bits are cut into radius+m blocks; two fingerprints within the radius
agree on at least m blocks, so every fingerprint joins one shard for each choice of m blocks, and
each shard is a BK-tree, searched by all its members, that follows only edges within the radius.
m grows with the number of fingerprints, so as to weigh what is sorted against what is compared.
All choices with the same first block travel together: a fingerprint is shuffled once for each of
the radius+1 blocks that can be first, whatever m is, and the task makes the choices.  Only where
too many fingerprints agree on that block are the first two (three, ...) told apart in the shuffle.

Defined cases: null and empty texts, and texts without a word, are never duplicates; repeated rows
are duplicates of each other, of which ``drop_duplicates`` keeps one; rows with a null ``doc_id``
are grouped like others, but represent a group only if all its ids are null; an empty table gives
an empty result; other columns, whatever their names, are carried along or ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.bktree import Forest
from mnemora.llm.common import OWN, map_texts, settle, table
from mnemora.llm.textkit import Words, mix

RADIUS = 8
CONFIRM = 22
#: MinHashes of a sketch, and the bits in which two may differ: those expected at a Jaccard similarity of 0.35.
SKETCH = 256
MOST_APART = 83
#: What it costs to put a fingerprint into one more shard, in comparisons with a tree's node.
ROUTE_COST = 30
#: Fingerprints that a shuffled shard may have before it is cut by one block more, which bounds a task's memory.
SHARD_ROWS = 400_000
#: Pairs found in a cell before they are replaced by spanning edges.
PAIRS = 1 << 20
#: 64-bit words of the filter of dropped documents, which is broadcast: at most one row for each, whatever the corpus.
FILTER_WORDS = 1 << 22
_LONG, _SHORT_WEIGHT = 5, 0.1
A, B, C = f"{OWN}a", f"{OWN}b", f"{OWN}c"
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _vote(hashes: np.ndarray, doc: np.ndarray, n: int, weight: np.ndarray | None) -> np.ndarray:
    """SimHash of each text: every bit is set if the features with it outweigh those without."""
    out = np.zeros((n, 8), np.uint8)
    if len(hashes):
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        total = np.bincount(doc, weights=weight, minlength=n).astype(np.float64)
        at = doc.astype(np.int64) * 256
        for k in range(8):
            counts = np.bincount(at + lanes[:, k], weights=weight, minlength=n * 256).reshape(n, 256)
            ones = counts @ _BYTE_BITS
            out[:, k] = np.packbits(2 * ones > total[:, None] + 1e-9, axis=1, bitorder="little")[:, 0]
    return out.view(np.uint64)[:, 0]


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both SimHashes of each text, and whether it has any word."""
    return _prints(Words(texts))


def _prints(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = w.hashes()
    weight = np.where(w.ends - w.starts >= _LONG, 1.0, _SHORT_WEIGHT)
    pairs, pair_doc = w.shingles(2, h)
    return _vote(h, w.doc, w.n_docs, weight), _vote(pairs, pair_doc, w.n_docs, None), np.diff(w.first) > 0


def sketches(w: Words) -> np.ndarray:
    """Sketch of each text: a row of SKETCH bits, packed in 64-bit numbers; they agree in (1 + J) / 2 of their bits."""
    out = np.zeros((w.n_docs, SKETCH), np.uint8)
    runs, doc = w.shingles(3)
    if len(runs):
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for k, factor in enumerate(mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)):
            out[doc[first], k] = mix(np.minimum.reduceat(runs * factor, first)) >> np.uint64(63)
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with both SimHashes and the sketch appended (null where a text has no word)."""

    def step(texts):
        w = Words(texts)
        a, b, some = _prints(w)
        c = [x.tobytes() if y else None for x, y in zip(sketches(w), some)]
        return [pa.array(a.view(np.int64), mask=~some), pa.array(b.view(np.int64), mask=~some), c]

    return map_texts(docs, text, [T.StructField(A, T.LongType()), T.StructField(B, T.LongType()), T.StructField(C, T.BinaryType())], lambda: step)


def cut_blocks(n: int, radius: int = RADIUS) -> tuple[int, list[int]]:
    """m, and the bit masks of radius+m blocks, with the m of least modelled cost for n fingerprints.

    A member of a shard is compared with at most half of it, as each pair is met once.
    """

    def cost(m: int) -> float:
        return math.comb(radius + m, m) * (ROUTE_COST + n / 2 ** (64 * m / (radius + m)) / 2)

    m = min(range(1, 7), key=cost)
    ends = [round(64 * i / (radius + m)) for i in range(radius + m + 1)]
    return m, [((1 << b) - (1 << a)) & (2**64 - 1) for a, b in zip(ends, ends[1:])]


def plan_blocks(n: int, radius: int = RADIUS) -> list[int]:
    """The bit masks of every choice of m of radius+m blocks."""
    m, blocks = cut_blocks(n, radius)
    return [sum(c) for c in combinations(blocks, m)]


class Choices:
    """The choices of 1 to m blocks that begin a choice of m, as a tree.

    Those of k blocks are all that lie within the first radius+k.  They are numbered by k, then in
    order, so that the next longer ones (``child``, ``children``) and those of m (``leaf``,
    ``leaves``) that begin with one are consecutive.
    """

    def __init__(self, n: int, radius: int):
        self.m, blocks = cut_blocks(n, radius)
        self.first = radius + 1  # choices of one block, numbered from 0
        each = [c for k in range(1, self.m + 1) for c in combinations(range(radius + k), k)]
        at = {c: i for i, c in enumerate(each)}
        self.masks = np.array([sum(blocks[b] for b in c) for c in each], np.uint64)
        self.child = np.array([at.get((*c, c[-1] + 1), 0) for c in each])
        self.children = np.array([radius + len(c) - c[-1] if len(c) < self.m else 0 for c in each])
        self.leaf = np.array([at[*c, *range(c[-1] + 1, c[-1] + 1 + self.m - len(c))] for c in each])
        self.leaves = np.array([math.comb(radius + self.m - 1 - c[-1], self.m - len(c)) for c in each])

    def shards(self, a: np.ndarray, cut: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, choice, key) of the shards of each fingerprint: of one block, but of one more for those in ``cut``.

        With ``level``, only the shards of so many blocks, whether in ``cut`` or not.
        """
        row, which = np.tile(np.arange(len(a)), self.first), np.repeat(np.arange(self.first), len(a))
        out = []
        for k in range(1, self.m + 1):
            key = _shard_key(a[row] & self.masks[which], which)
            if k == level:
                return row, which, key
            more = np.isin(key, cut) if k < self.m and len(cut) else np.zeros(len(key), bool)
            out.append((row[~more], which[~more], key[~more]))
            row, which = row[more], which[more]
            many = self.children[which]
            row, which = np.repeat(row, many), np.repeat(self.child[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return tuple(np.concatenate(x) for x in zip(*out))


def _to_cut(nodes: DataFrame, n: int, choices: Choices, most: int) -> tuple[np.ndarray, int]:
    """Keys of the shards of more than ``most`` members, and the copies of fingerprints if these are cut.

    Each has more than ``most`` of the copies, so there are few.
    """
    cut, copies = np.zeros(0, np.uint64), n * choices.first
    for level in range(1, choices.m if n > most else 1):

        def count(batches, level=level, cut=cut):
            for batch in batches:
                _, which, key = choices.shards(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), cut, level)
                key, at, k = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(which[at]), pa.array(k)], ["key", "which", "k"])

        large = nodes.select(A).mapInArrow(count, "key long, which long, k long").groupBy("key", "which").agg(F.sum("k").alias("k")).where(F.col("k") > most).collect()
        if not large:
            break
        cut = np.concatenate([cut, np.array([r.key for r in large], np.int64).view(np.uint64)])
        copies += sum(r.k * (int(choices.children[r.which]) - 1) for r in large)
    return cut, copies


def _routed(nodes: DataFrame, choices: Choices, cut: np.ndarray, cells: int) -> DataFrame:
    """(cell, blob): the fingerprints of each shard, packed in a blob for each batch and cell, to keep the shuffle and the JVM's work small."""
    step = max(1, 500_000 // choices.first)

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                a = batch.column(0)[at : at + step].to_numpy(zero_copy_only=False).view(np.uint64)
                b = batch.column(1)[at : at + step].to_numpy(zero_copy_only=False).view(np.uint64)
                c = np.frombuffer(b"".join(batch.column(2)[at : at + step].to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
                row, which, key = choices.shards(a, cut)
                cell = (key % np.uint64(cells)).astype(np.int64)
                order = np.argsort(cell, kind="stable")
                row, which, cell = row[order], which[order].astype(np.uint16), cell[order]
                ends = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
                blobs = [a[r].tobytes() + b[r].tobytes() + c[r].tobytes() + w.tobytes() for r, w in ((row[s:e], which[s:e]) for s, e in zip(ends, ends[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(cell[ends[:-1]]), pa.array(blobs, pa.binary())], ["cell", "blob"])

    return nodes.select(A, B, C).mapInArrow(route, "cell long, blob binary")


def _edges(nodes: DataFrame, n: int, radius: int, confirm: int, most: int = SHARD_ROWS) -> DataFrame:
    """Spanning edges, cell by cell, of the graph of near-duplicate fingerprint pairs."""
    choices = Choices(n, radius)
    cut, copies = _to_cut(nodes, n, choices, most)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, math.ceil(copies / 2_000_000))

    def search(batches):
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blobs.setdefault(c, []).append(x)
        while blobs:
            _, mine = blobs.popitem()
            count = [len(x) // (18 + SKETCH // 8) for x in mine]
            a = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(mine, count)])
            b = np.concatenate([np.frombuffer(x, np.uint64, k, 8 * k) for x, k in zip(mine, count)])
            c = np.concatenate([np.frombuffer(x, np.uint64, k * (SKETCH // 64), 16 * k) for x, k in zip(mine, count)]).reshape(-1, SKETCH // 64)
            which = np.concatenate([np.frombuffer(x, np.uint16, k, (16 + SKETCH // 8) * k) for x, k in zip(mine, count)])
            del mine
            left, right, found = [], [], 0
            # The choices of m blocks that a shard stands for are made here, one for each of its members at a time.
            for t in range(int(choices.leaves[which].max())):
                own = np.flatnonzero(choices.leaves[which] > t)
                leaf = choices.leaf[which[own]] + t
                key = _shard_key(a[own] & choices.masks[leaf], leaf)
                order = np.argsort(key)
                own, key = own[order], key[order]
                for i, j in Forest(key, a[own]).within(radius):
                    i, j = own[i], own[j]
                    near = np.bitwise_count(b[i] ^ b[j]) <= confirm
                    i, j = i[near], j[near]
                    near = np.bitwise_count(c[i] ^ c[j]).sum(1, dtype=np.int64) <= MOST_APART
                    left.append(i[near])
                    right.append(j[near])
                    found += len(left[-1])
                    if found > PAIRS:
                        i, j = _spanning(np.concatenate(left), np.concatenate(right), len(a))
                        left, right, found = [i], [j], 0
            if left and sum(map(len, left)):
                i, j = _spanning(np.concatenate(left), np.concatenate(right), len(a))
                columns = [pa.array(x[k].view(np.int64) if x is not c else [y.tobytes() for y in c[k]]) for k in (i, j) for x in (a, b, c)]
                yield pa.RecordBatch.from_arrays(columns, ["a1", "b1", "c1", "a2", "b2", "c2"])

    routed = _routed(nodes, choices, cut, parts * 4).repartition(parts, "cell")
    return routed.mapInArrow(search, "a1 long, b1 long, c1 binary, a2 long, b2 long, c2 binary").distinct()


def _shard_key(masked: np.ndarray, which: np.ndarray) -> np.ndarray:
    return mix(masked + mix(which.astype(np.uint64) + np.uint64(1)))


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) with the same connected components as the edges given."""
    used, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    u, v = flat[: len(i)], flat[len(i) :]
    low = np.arange(len(used))
    while True:
        before = low.copy()
        m = np.minimum(low[u], low[v])
        np.minimum.at(low, u, m)
        np.minimum.at(low, v, m)
        low = low[low]
        if (low == before).all():
            break
    rest = low != np.arange(len(used))
    return used[rest], used[low[rest]]


def components(edges: DataFrame) -> DataFrame:
    """(node, low): the smallest node of the component of each node of ``edges`` (u, v).

    Alternating large-star and small-star steps; every round is written to the shared folder, and
    the number of rounds grows with the logarithm of the component size.
    """
    e = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        to_low = large.join(small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = settle(to_low.where("u <> v").distinct())
        sign = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sign(new) == sign(e):
            return new.select(F.col("u").alias("node"), F.col("v").alias("low")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("low")).distinct())
        e = new


def near_duplicate_groups(prints: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """Rows (a, b, c, group) for each distinct pair of SimHashes with a sketch; only those with a neighbour."""
    nodes = settle(prints.where(F.col(A).isNotNull()).select(A, B, C).distinct())
    edges = _edges(nodes, nodes.count(), radius, confirm)
    pack = lambda *x: F.struct(*(F.col(c).alias(n) for c, n in zip(x, "abc")))
    found = components(edges.select(pack("a1", "b1", "c1").alias("u"), pack("a2", "b2", "c2").alias("v")))
    return found.select(F.col("node.a").alias(A), F.col("node.b").alias(B), F.col("node.c").alias(C), F.col("low").alias(f"{OWN}low"))


def group_rows(prints: DataFrame, *identity: str, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """Every row of ``prints`` that has a duplicate, with ``group_id`` and ``n`` rows in its group."""
    groups = near_duplicate_groups(prints, radius, confirm)
    own = F.struct(F.col(A).alias("a"), F.col(B).alias("b"), F.col(C).alias("c"))
    placed = prints.where(F.col(A).isNotNull()).join(groups, [A, B, C], "left").withColumn(f"{OWN}low", F.coalesce(f"{OWN}low", own))
    size = placed.groupBy(f"{OWN}low").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id")).where("n > 1")
    return placed.join(size, f"{OWN}low").select(*identity, f"{OWN}low", "group_id", "n")


def find_near_duplicates(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """(doc_id, group_id, keep) of each document that has a near-duplicate.

    ``keep`` marks the representative; where its id is repeated, all of its rows have the mark.
    """
    prints = settle(with_fingerprints(docs.select("doc_id", "text")).drop("text"))
    found = group_rows(prints, "doc_id", radius=radius, confirm=confirm)
    return found.select("doc_id", "group_id", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("keep"))


def drop_duplicates(docs: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM, filter_words: int = FILTER_WORDS) -> DataFrame:
    """One document of each group (its smallest id), and all documents without a duplicate.

    The identities (id and text hash) of rows that are dropped or repeated set bits of a filter of bounded
    size, which is broadcast.  Rows that miss it stay where they are; only those that hit it, the dropped
    ones and a few by chance, are shuffled to be decided exactly.  The plan is the same at every size: the more
    is dropped, the more rows hit by chance, at worst all of them.
    """
    text_id = f"{OWN}text"
    marked = docs.withColumn(text_id, F.xxhash64("text"))
    prints = settle(with_fingerprints(marked.select("doc_id", text_id, "text")).drop("text"))
    found = group_rows(prints, "doc_id", text_id, radius=radius, confirm=confirm)
    # Of the rows with the group's smallest id (more than one if ids repeat) that of the smallest text hash stays.
    low = f"{OWN}low"
    first = found.groupBy(low, "group_id", "doc_id", text_id).agg(F.count("*").alias("k"))
    chosen = first.where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy(low).agg(F.min(text_id).alias("chosen"))
    first = first.join(chosen, low).select(
        "doc_id", text_id, "k", (F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col(text_id) == F.col("chosen"))).alias("stays")
    )
    identity, word, bit, bits = (f"{OWN}{x}" for x in ("identity", "word", "bit", "bits"))
    key = F.xxhash64(F.lit(3), F.col("doc_id"), F.col(text_id))
    place = F.pmod(F.shiftrightunsigned(key, 6), F.lit(filter_words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    fate = first.groupBy("doc_id", text_id).agg(F.max("stays").alias("stays"), F.sum("k").alias("k"))
    leaves = settle(fate.where("not stays or k > 1").select(F.col("doc_id").alias(f"{OWN}i"), F.col(text_id).alias(f"{OWN}t"), "stays", place[0].alias(word), place[1].alias(bit)))
    sieve = settle(leaves.groupBy(word).agg(F.bit_or(bit).alias(bits)))
    tried = marked.withColumns({word: place[0], bit: place[1]}).join(F.broadcast(sieve), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(F.col(bit)), F.lit(0).cast("long")) != 0
    columns = [F.col(c) for c in marked.columns]
    away = tried.where(~hit).select(*columns)
    # The hint keeps the plan from changing with the number of rows.
    exact = leaves.select(f"{OWN}i", f"{OWN}t", F.col("stays").alias(bits)).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col(f"{OWN}i")) & (F.col(text_id) == F.col(f"{OWN}t"))
    near = tried.where(hit).select(*columns).join(exact, same, "left")
    kept = near.where(F.col(bits).isNull()).select(*columns)
    once = near.where(F.col(bits)).select(*columns).dropDuplicates(["doc_id", text_id])
    return away.unionByName(kept).unionByName(once).drop(text_id)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(table(spark, sf_dir, "documents"))
