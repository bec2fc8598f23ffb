"""Co-occurrence cells of numbered words, counted by numpy in tiles of the matrix.

Pairs of words grow with the square of a document's words, and cells are many times the input.  So
neither is shuffled: words are numbered in their order, documents are stored as numbers by block of
words, and a task counts the cells of two blocks over all documents and uses them on the spot.
The folder of intermediate tables holds what all tasks read, about two bytes for each word of a document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.lexer import distinct
from mnemora.functions.spans import Spans, code_points
from mnemora.operators.cooc import number_documents
from mnemora.session import settle, shared_dir

#: Words of a block at most, whose numbers within it take two bytes.
WIDTH = 1 << 16
#: Words of documents in a block, on average, at most.
OCCURRENCES = 1 << 25
#: Blocks at least for more words of documents than SMALL, so that there are enough tiles for all cores.
BLOCKS, SMALL = 12, 1 << 20
#: Pairs counted at once.
_PIECE = 1 << 19


def _read(path: str, columns: list[str]) -> pa.Table:
    """A table of the shared folder, or of one of its partitions; empty if there is none."""
    path = re.sub("^file:/+", "/", path)
    fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
    if fs.get_file_info(at).type == pa.fs.FileType.NotFound:
        return pa.table({c: [] for c in columns})
    return ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=columns)


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    ends = np.cumsum(np.array([len(w) + 1 for w in words], np.int64)) - 1
    lengths = np.array([len(w) for w in words], np.int64)
    return Spans(code_points("\n".join(words))).span_hash(ends - lengths, ends) if words else np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def _numbers(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, numbers) of the vocabulary."""
    t = _read(path, ["h", "number"])
    h, number = t["h"].to_numpy().view(np.uint64), t["number"].to_numpy()
    order = np.argsort(h)
    h, number = h[order], number[order]
    if len(h) > 1 and (h[1:] == h[:-1]).any():
        raise ValueError("two words have the same hash")
    return h, number


def _numbered(path: str, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the distinct words of each row that are in the vocabulary, in order."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    coded = lists.flatten().dictionary_encode()
    h, number = _numbers(path)
    own = hashes(coded.dictionary.to_pylist())
    at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
    found = np.where(h[at] == own, number[at], -1) if len(h) else np.full(len(own), -1)
    index = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    n = np.append(found, -1)[index].astype(np.int64)
    v = int(number.max()) + 1 if len(number) else 1
    codes = distinct((row * v + n)[n >= 0])
    return codes // v, codes % v


def _stored(chunk: int, counts: np.ndarray, words: np.ndarray, block: int) -> pa.RecordBatch:
    return pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary()), "block": pa.array([block], pa.int32())})


def _encoder(path: str, width: int):
    def encode(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            row, number = _numbered(f"{path}/words", batch.column(0))
            block = number // width
            order = np.argsort(block, kind="stable")
            row, number, block = row[order], number[order], block[order]
            which = distinct(block)
            edges = np.searchsorted(block, np.append(which, which[-1:] + 1))
            for b, s, e in zip(which.tolist(), edges, edges[1:]):
                counts = np.bincount(row[s:e], minlength=batch.num_rows).astype(np.int32)
                words = (number[s:e] - b * width).astype(np.uint16)
                yield _stored(chunk, counts, words, b)
            if batch.num_columns > 1:
                yield _stored(chunk, batch.column(1).to_numpy().astype(np.int32), np.zeros(0, np.uint16), -1)
            chunk += 1

    return encode


@dataclass(frozen=True)
class Part:
    """A block of words: their numbers begin at ``first``; ``rows`` has (counts, words) by chunk of documents."""

    first: int
    names: pa.Array
    df: np.ndarray
    rows: dict

    @classmethod
    def load(cls, path: str, block: int, width: int) -> Part:
        w = _read(f"{path}/words/block={block}", ["number", "w", "df"]).sort_by("number")
        t = _read(f"{path}/rows/block={block}", ["chunk", "counts", "words"])
        rows = {c: (np.frombuffer(n, np.int32), np.frombuffer(x, np.uint16)) for c, n, x in zip(*(t[c].to_pylist() for c in ("chunk", "counts", "words")))}
        return cls(block * width, w["w"].combine_chunks(), w["df"].to_numpy(), rows)


class Tile:
    """The cells of the words of x with those of y, or of x with itself (``upper``: a <= b only)."""

    def __init__(self, x: Part, y: Part, least: float, docs: int, upper: bool):
        self.x, self.y, self.least, self.docs, self.upper = x, y, least, docs, upper

    def named(self, numbers: np.ndarray) -> pa.Array:
        """The words of numbers of either part."""
        x, y = self.x, self.y
        inside = (numbers >= x.first) & (numbers < x.first + len(x.df))
        return pa.concat_arrays([x.names, y.names]).take(pa.array(np.where(inside, numbers - x.first, numbers - y.first + len(x.df))))

    def cells(self, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, n) in pieces: places in x and y, and counts of at least ``least``; of the ``wanted`` places of x only, if given."""
        p = self._postings(wanted)
        if p is not None:
            yield from self._counted(*p)

    def _chunks(self) -> list[int]:
        return sorted(self.x.rows.keys() & self.y.rows.keys())

    def _postings(self, wanted: np.ndarray | None = None):
        """(words of y by document, x's words in order, and of each its document and its range of y's words); none without common documents."""
        x, y = self.x, self.y
        chunks = self._chunks()
        if not chunks:
            return None
        (nx, wx), (ny, wy) = (tuple(np.concatenate([p.rows[c][k] for c in chunks]) for k in (0, 1)) for p in (x, y))
        small = np.int32 if len(wy) < 1 << 31 else np.int64
        end = np.cumsum(ny, dtype=np.int64)
        size = len(x.df)
        if wanted is None:
            order = np.argsort(wx, kind="stable")
        else:
            use = np.zeros(size, bool)
            use[wanted] = True
            order = np.flatnonzero(use[wx])
            order = order[np.argsort(wx[order], kind="stable")]
        word = wx[order]
        begin = np.searchsorted(word, np.arange(size + 1))
        doc = np.repeat(np.arange(len(nx), dtype=np.int32), nx)[order]
        start = order if self.upper else end[doc] - ny[doc]
        length = end[doc] - start
        return wy, word, begin, doc, start.astype(small), length

    def decayed(self, epochs: dict[int, np.ndarray], rate: float, done: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, n) as ``cooc.decayed`` has them, of cells with a count of at least ``least``; ``epochs`` of the documents by chunk."""
        p = self._postings()
        if p is None:
            return
        wy, word, begin, doc, start, length = p
        epoch = np.concatenate([epochs[c] for c in self._chunks()]).astype(np.int64)
        most = int(epoch.max()) + 1
        work = np.concatenate([[0], np.cumsum(length)])[begin]
        v, a, size = len(self.y.df), 0, len(self.x.df)
        while a < size:
            z = max(a + 1, min(int(np.searchsorted(work, work[a] + _PIECE, side="right")) - 1, size))
            at = slice(int(begin[a]), int(begin[z]))
            if work[z] > work[a]:
                ln = length[at]
                code = (np.repeat((word[at].astype(np.int64) - a) * v, ln) + wy[_ranges(start[at], ln)]) * most + np.repeat(epoch[doc[at]], ln)
                key, n = _folded(code, most, self.least, rate, done)
                yield key // v + a, key % v, n
            a = z

    def _counted(self, wy, word, begin, doc, start, length) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        work = np.concatenate([[0], np.cumsum(length)])[begin]
        v, size = len(self.y.df), len(self.x.df)
        a = 0
        while a < size:
            z = min(max(a + 1, int(np.searchsorted(work, work[a] + _PIECE, side="right")) - 1), a + (1 << 31) // (v + 1), size)
            z = max(z, a + 1)
            todo = int(work[z] - work[a])
            p, q = int(begin[a]), int(begin[z])
            if todo > 2 * _PIECE:  # of one word
                count, step = np.zeros(v, np.int64), max(1, int(_PIECE * (q - p) / todo))
                for k in range(p, q, step):
                    count += np.bincount(wy[_ranges(start[k : min(k + step, q)], length[k : min(k + step, q)])], minlength=v)
                key = np.flatnonzero(count >= max(self.least, 1))
                n = count[key]
            elif todo:
                ln = length[p:q]
                key = wy[_ranges(start[p:q], ln)].astype(np.int32)
                if z > a + 1:
                    key += np.repeat(((word[p:q].astype(np.int64) - a) * v).astype(np.int32), ln)
                if todo * 16 > (z - a) * v:
                    count = np.bincount(key, minlength=(z - a) * v)
                    key = np.flatnonzero(count >= max(self.least, 1))
                    n = count[key]
                else:
                    key.sort()
                    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
                    n = np.diff(last, prepend=-1)
                    many = n >= self.least
                    key, n = key[last[many]], n[many]
            if todo and len(key):
                yield key // v + a, key % v, n
            a = z


def _folded(code: np.ndarray, most: int, least: float, rate: float, done: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, value over 0) of the codes cell * most + epoch: the counts of a cell's epochs in order, all cells at once."""
    code.sort()
    last = np.flatnonzero(np.append(code[1:] != code[:-1], True))
    count = np.diff(last, prepend=-1)
    cell, epoch = code[last] // most, code[last] % most
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    runs = np.diff(np.append(first, len(cell)))
    enough = np.add.reduceat(count, first) >= least
    first, runs = first[enough], runs[enough]
    order = np.argsort(-runs, kind="stable")
    first, runs = first[order], runs[order]
    keep = lambda x: np.where(x < 0.5, 0.0, x)
    value, before = np.zeros(len(first)), np.zeros(len(first), np.int64)
    for k in range(int(runs[0]) if len(runs) else 0):
        m = int(np.searchsorted(-runs, -k, side="left"))  # cells of more than k epochs
        e = epoch[first[:m] + k]
        waited = np.where(before[:m] > 0, np.maximum(e - before[:m] - 1, 0), 0)
        x = keep(value[:m] * (1 - rate) ** waited) + count[first[:m] + k]
        value[:m], before[:m] = np.where(e <= done, keep(x * (1 - rate)), x), e
    value = keep(value * (1 - rate) ** np.maximum(done - before, 0))
    left = value > 0
    return cell[first[left]], value[left]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range."""
    done = np.cumsum(length)
    return np.arange(int(done[-1]), dtype=start.dtype) + np.repeat((start - (done - length)).astype(start.dtype), length)


@dataclass(frozen=True)
class Tiles:
    """Documents as numbers, from which any query counts the cells that it needs.

    ``vocabulary`` has (number, w, df); cells of less than ``least`` documents don't count.
    """

    spark: SparkSession
    path: str
    vocabulary: DataFrame
    words: int
    width: int
    least: float
    docs: int

    @property
    def blocks(self) -> int:
        return -(-self.words // self.width)

    def scan(self, schema: str, use: Callable[[Tile], Iterator[pa.RecordBatch]]) -> DataFrame:
        """What ``use`` makes of each tile; each cell a <= b is in one of them."""
        k, path, width, least, docs = self.blocks, self.path, self.width, self.least, self.docs
        pairs = [(i, j) for d in range(k) for i, j in zip(range(k), range(d, k))]

        def run(batches):
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    i, j = pairs[t]
                    x = Part.load(path, i, width)
                    yield from use(Tile(x, x if i == j else Part.load(path, j, width), least, docs, i == j))

        return self.spark.range(0, len(pairs), 1, max(1, len(pairs))).mapInArrow(run, schema)

    def rows(self, words: DataFrame, schema: str, use: Callable[[Tile, Iterator], Iterator[pa.RecordBatch]]) -> DataFrame:
        """What ``use`` makes of all cells (a, b, n), in both directions, of these words (w)."""
        wanted = store(self.vocabulary.join(words.select("w").distinct(), "w", "left_semi").select("number"))
        blocks = [r[0] for r in self.spark.read.schema("number int").parquet(wanted).select(F.floor(F.col("number") / self.width).cast("int").alias("b")).distinct().orderBy("b").collect()]
        pairs = [(i, j) for i in blocks for j in range(self.blocks)]
        path, width, least, docs = self.path, self.width, self.least, self.docs

        def run(batches):
            own = _read(wanted, ["number"])["number"].to_numpy()
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    i, j = pairs[t]
                    x = Part.load(path, i, width)
                    tile = Tile(x, x if i == j else Part.load(path, j, width), least, docs, False)
                    yield from use(tile, tile.cells(own[own // width == i] - i * width))

        return self.spark.range(0, len(pairs), 1, max(1, len(pairs))).mapInArrow(run, schema)

    # ---- cells and scores by name ---------------------------------------------------------------

    def cells(self) -> DataFrame:
        """(a, b, n), a <= b."""

        def use(t):
            for a, b, n in t.cells():
                yield batch(a=t.x.names.take(pa.array(a)), b=t.y.names.take(pa.array(b)), n=n.astype(np.float64))

        return self.scan("a string, b string, n double", use)

    def decayed(self, rate: float, done: int, least: float) -> DataFrame:
        """(a, b, n) of decayed cells of at least ``least``, where the rows had an ``epoch`` from 1."""
        path, width = self.path, self.width

        def use(t):
            epochs = {c: e for c, (e, _) in Part.load(path, -1, width).rows.items()}
            for a, b, n in t.decayed(epochs, rate, done):
                kept = n >= least
                yield batch(a=t.x.names.take(pa.array(a[kept])), b=t.y.names.take(pa.array(b[kept])), n=n[kept])

        return self.scan("a string, b string, n double", use)

    def ppmi(self) -> DataFrame:
        """(a, b, ppmi), a < b, positive ones."""

        def use(t):
            for a, b, _, s in positive(t, t.cells()):
                yield batch(a=t.x.names.take(pa.array(a)), b=t.y.names.take(pa.array(b)), ppmi=s)

        return self.scan("a string, b string, ppmi double", use)

    def ppmi_of(self, words: DataFrame) -> DataFrame:
        """The rows of ``ppmi`` that have one of these words (w), each pair once in either direction."""
        path = store(words.select("w").distinct())

        def use(t, cells):
            known = _read(path, ["w"])["w"].combine_chunks()
            twice = pa.compute.is_in(t.y.names, value_set=known).to_numpy(zero_copy_only=False)
            for a, b, _, s in positive(t, cells):
                keep = ~twice[b] | (a + t.x.first < b + t.y.first)
                yield batch(a=t.x.names.take(pa.array(a[keep])), b=t.y.names.take(pa.array(b[keep])), ppmi=s[keep])

        return self.rows(self.spark.read.schema("w string").parquet(path), "a string, b string, ppmi double", use)

    def conditional(self) -> DataFrame:
        """(a, b, p): P(b | a), both directions and the diagonal of 1."""

        def use(t):
            for a, b, n in t.cells():
                x, y = t.x.names.take(pa.array(a)), t.y.names.take(pa.array(b))
                yield batch(a=x, b=y, p=n / t.x.df[a])
                other = a + t.x.first != b + t.y.first
                yield batch(a=y.filter(pa.array(other)), b=x.filter(pa.array(other)), p=(n / t.y.df[b])[other])

        return self.scan("a string, b string, p double", use)

    def conditional_of(self, words: DataFrame) -> DataFrame:
        """The rows of ``conditional`` whose a is one of these words (w)."""

        def use(t, cells):
            for a, b, n in cells:
                yield batch(a=t.x.names.take(pa.array(a)), b=t.y.names.take(pa.array(b)), p=n / t.x.df[a])

        return self.rows(words, "a string, b string, p double", use)

    def towards(self, words: DataFrame) -> DataFrame:
        """The rows of ``conditional`` whose b is one of these words (w)."""

        def use(t, cells):
            for b, a, n in cells:
                yield batch(a=t.y.names.take(pa.array(a)), b=t.x.names.take(pa.array(b)), p=n / t.y.df[a])

        return self.rows(words, "a string, b string, p double", use)

    # ---- sums over cells ------------------------------------------------------------------------

    def sums(self) -> DataFrame:
        """(w, cells, total): of each word's cells in both triangles, the diagonal once; words without cells too."""

        def use(t):
            count, total = ([np.zeros(len(p.df), np.int64) for p in (t.x, t.y)] for _ in range(2))
            for a, b, n in t.cells():
                other = a + t.x.first != b + t.y.first
                for k, (c, o) in enumerate(((a, slice(None)), (b, other))):
                    count[k] += np.bincount(c[o], minlength=len(count[k]))
                    total[k] += np.bincount(c[o], n[o], minlength=len(count[k])).astype(np.int64)
            for k, p in enumerate((t.x, t.y)):
                yield batch(number=np.arange(len(p.df), dtype=np.int64) + p.first, cells=count[k], total=total[k])

        s = self.scan("number long, cells long, total long", use).groupBy("number").agg(F.sum("cells").alias("cells"), F.sum("total").alias("total"))
        return self.vocabulary.select("number", "w").join(s, "number").select("w", "cells", "total")

    def strangers(self, terms: DataFrame) -> DataFrame:
        """(w, strangers): words outside the vocabulary in all rows that have the word, as often as they are in one."""
        path = f"{self.path}/words"

        def run(batches):
            for rows in batches:
                lists = rows.column(0)
                row, number = _numbered(path, lists)
                rest = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) - np.bincount(row, minlength=len(lists))
                which = distinct(number)
                yield batch(number=which.astype(np.int64), strangers=np.bincount(np.searchsorted(which, number), rest[row], len(which)).astype(np.int64))

        s = terms.select(F.array_compact(F.array_distinct("words")).alias("words")).mapInArrow(run, "number long, strangers long").groupBy("number").agg(F.sum("strangers").alias("strangers"))
        return self.vocabulary.select("number", "w").join(s, "number").select("w", "strangers")

    def sums_over(self, weight: DataFrame, least: float, out: DataFrame) -> DataFrame:
        """(target, score): of weight (w, p) times P(target | w) where that is over ``least``; neither is one of the words ``out`` (w)."""
        own, gone = (store(self.vocabulary.select("number", "w").join(d, "w").drop("w")) for d in (weight, out.select("w").distinct()))

        def use(t):
            x, left = _dense(own, t), _dense(gone, t, None)
            score = [np.zeros(len(p.df)) for p in (t.x, t.y)]
            for a, b, n in t.cells():
                other = a + t.x.first != b + t.y.first
                for k, (mid, to, some) in enumerate(((a, b, slice(None)), (b, a, other))):
                    mid, to = mid[some], to[some]
                    p = n[some] / (t.x, t.y)[k].df[mid]
                    p[(p <= least) | left[k][mid] | left[1 - k][to]] = 0
                    score[1 - k] += np.bincount(to, p * x[k][mid], len(score[1 - k]))
            for k, part in enumerate((t.x, t.y)):
                at = np.flatnonzero(score[k])
                yield batch(number=at + part.first, score=score[k][at])

        s = self.scan("number long, score double", use).groupBy("number").agg(F.sum("score").alias("score"))
        return self.vocabulary.select("number", F.col("w").alias("target")).join(s, "number").select("target", "score")

    def top_products(self, weight: DataFrame, out: DataFrame, n: int) -> DataFrame:
        """(mid, target, score): the best of weight (w, p) of mid times P(target | mid), rounded to 6 places, ties by mid and target; mid and target differ and neither is one of ``out`` (w)."""
        own, gone = (store(self.vocabulary.select("number", "w").join(d, "w").drop("w")) for d in (weight, out.select("w").distinct()))

        def use(t):
            x, left = _dense(own, t), _dense(gone, t, None)
            best = _Best(n)
            best.add(np.zeros(0), *[np.zeros(0, np.int64)] * 2)
            for a, b, c in t.cells():
                for k, (mid, to) in enumerate(((a, b), (b, a))):
                    q, r = (t.x, t.y)[k], (t.x, t.y)[1 - k]
                    s = x[k][mid] * (c / q.df[mid])
                    keep = (s > 0) & ~left[k][mid] & ~left[1 - k][to] & (mid + q.first != to + r.first)
                    best.add(s[keep], mid[keep] + q.first, to[keep] + r.first)
            s, mid, to = best.rows()
            yield batch(mid=t.named(mid), target=t.named(to), score=s)

        every = self.scan("mid string, target string, score double", use)
        return every.select("mid", "target", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "mid", "target").limit(n)

    def degrees(self) -> DataFrame:
        """(node, degree): other words of each word's cells, of those that have any."""
        return self.sums().select(F.col("w").alias("node"), (F.col("cells") - 1).alias("degree")).where("degree > 0")

    def top_ppmi(self, low: float, high: float, n: int) -> DataFrame:
        """The strongest pairs with low <= ppmi < high in both directions, as ``assoc.top_associations`` has them."""

        def use(t):
            best = _Best(n)
            best.add(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for a, b, _, s in positive(t, t.cells()):
                keep = (s >= low) & (s < high)
                a, b, s = a[keep] + t.x.first, b[keep] + t.y.first, s[keep]
                best.add(s, a, b)
            s, a, b = best.rows()
            x, y = t.named(a), t.named(b)
            yield batch(a=x, b=y, ppmi=s)
            yield batch(a=y, b=x, ppmi=s)

        every = self.scan("a string, b string, ppmi double", use)
        return every.orderBy(F.desc(F.round("ppmi", 6)), "a", "b").limit(n)


class _Best:
    """The n rows of greatest score, rounded to 6 places, and of these the least a and b."""

    def __init__(self, n: int):
        self.n, self.kept = n, []

    def add(self, s: np.ndarray, *others: np.ndarray) -> None:
        self.kept.append(self._cut(s, *others))
        if len(self.kept) > 20:
            self.kept = [self.rows()]

    def _cut(self, s, *others):
        if len(s) > 4 * self.n:  # what may round to the n-th score is ordered, the rest left out
            near = s >= np.partition(s, len(s) - self.n)[len(s) - self.n] - 2e-6
            s, *others = (x[near] for x in (s, *others))
        order = np.lexsort((*others[::-1], -np.floor(s * 1e6 + 0.5)))[: self.n]
        return tuple(x[order] for x in (s, *others))

    def rows(self) -> tuple[np.ndarray, ...]:
        return self._cut(*map(np.concatenate, zip(*self.kept)))


@dataclass(frozen=True)
class Edges:
    """The positive PPMI of tiles as places of two blocks and counts, six bytes a cell before compression, for rounds over the graph.

    A vector has a number for each word; it is held whole, as one of each task's blocks is summed up.
    """

    tiles: Tiles
    path: str
    df: np.ndarray
    least: float

    @classmethod
    def of(cls, t: Tiles, least: float) -> Edges:
        """Edges between the words whose PPMI is ``least`` or more, and over 0."""

        def use(tile):
            for a, b, n, s in positive(tile, tile.cells()):
                keep = s >= least
                if keep.any():
                    parts = (a[keep].astype(np.uint16), b[keep].astype(np.uint16), n[keep].astype(np.uint32))
                    yield batch(x=pa.array([tile.x.first], pa.int64()), y=pa.array([tile.y.first], pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in zip("abn", parts)})

        path = f"{shared_dir(t.spark)}/mnemora/{uuid.uuid4().hex}"
        t.scan("x long, y long, a binary, b binary, n binary", use).write.option("compression", "zstd").parquet(path)
        df = t.vocabulary.select("number", "df").toArrow().sort_by("number")["df"].to_numpy()
        return cls(t, path, df, least)

    def _stored(self) -> DataFrame:
        return self.tiles.spark.read.schema("x long, y long, a binary, b binary, n binary").parquet(self.path)

    def spread(self, shared: dict[str, np.ndarray], step: Callable, start: float, combine: np.ufunc) -> np.ndarray:
        """The vector of ``combine``d values that ``step(shared, from, to, weight)`` gives ``to``, over all edges in both directions."""
        t = self.tiles
        width, words, docs, least = t.width, t.words, float(t.docs), self.least
        given = t.spark.sparkContext.broadcast(shared | {"df": self.df})

        def run(batches):
            v, out = given.value, {}

            def give(first, to, value):
                held = out.setdefault(first, np.full(min(width, words - first), start))
                if combine is np.add:
                    held += np.bincount(to - first, value, len(held))
                else:
                    order = np.argsort(to, kind="stable")
                    to, value = to[order], value[order]
                    at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                    held[to[at] - first] = combine(held[to[at] - first], combine.reduceat(value, at))

            for rows in batches:
                for x, y, a, b, n in zip(*(c.to_pylist() for c in rows.columns)):
                    a, b, n = np.frombuffer(a, np.uint16).astype(np.int64) + x, np.frombuffer(b, np.uint16).astype(np.int64) + y, np.frombuffer(n, np.uint32)
                    s = np.log2(n * docs / (v["df"][a].astype(np.float64) * v["df"][b]))
                    give(y, b, step(v, a, b, s))
                    give(x, a, step(v, b, a, s))
            for first, values in out.items():
                yield batch(first=pa.array([first], pa.int64()), v=pa.array([values.tobytes()], pa.binary()))

        def together(key, table):
            whole = combine.reduce([np.frombuffer(x, np.float64) for x in table["v"].to_pylist()])
            return pa.table({"first": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([whole.tobytes()], pa.binary())})

        parts = self._stored().mapInArrow(run, "first long, v binary").groupBy("first").applyInArrow(together, "first long, v binary").collect()
        out = np.full(words, start)
        for r in parts:
            out[r.first : r.first + width] = np.frombuffer(r.v, np.float64)
        given.unpersist()
        return out

    def into(self, numbers: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """The neighbours of these few words, with the weights."""
        df, docs = self.df, float(self.tiles.docs)
        given = self.tiles.spark.sparkContext.broadcast(df)

        def run(batches):
            for rows in batches:
                for x, y, a, b, n in zip(*(c.to_pylist() for c in rows.columns)):
                    a, b, n = np.frombuffer(a, np.uint16).astype(np.int64) + x, np.frombuffer(b, np.uint16).astype(np.int64) + y, np.frombuffer(n, np.uint32)
                    for p, q in ((a, b), (b, a)):
                        at = np.flatnonzero(np.isin(p, numbers))
                        d = given.value
                        yield batch(node=p[at], other=q[at], weight=np.log2(n[at] * docs / (d[a[at]].astype(np.float64) * d[b[at]])))

        found: dict[int, list] = {int(k): [] for k in numbers}
        for r in self._stored().mapInArrow(run, "node long, other long, weight double").collect():
            found[r.node].append((r.other, r.weight))
        return found

    def names(self, numbers) -> dict[int, str]:
        return {r.number: r.w for r in self.tiles.vocabulary.where(F.col("number").isin([int(x) for x in numbers])).select("number", "w").collect()}

    def numbers(self, words: list[str]) -> dict[str, int]:
        """The numbers of the words that are in the vocabulary."""
        return {r.w: r.number for r in self.tiles.vocabulary.where(F.col("w").isin(words)).select("number", "w").collect()}

    def vector(self, column: str, values: np.ndarray, where: np.ndarray) -> DataFrame:
        """(node, column) of the words in ``where``."""
        at = np.flatnonzero(where)
        given = self.tiles.spark.createDataFrame(pa.table({"number": pa.array(at, pa.int64()), column: pa.array(values[at], pa.float64())}))
        return self.tiles.vocabulary.select("number", F.col("w").alias("node")).join(given, "number").select("node", column)


def pairs_by_epoch(terms: DataFrame) -> DataFrame:
    """(a, b, e, c) of rows (e, words): how many rows of the epoch e have both words, summed up for each batch of rows first."""

    def run(batches):
        for rows in batches:
            lists = rows.column(1)
            coded = lists.flatten().dictionary_encode()
            words = sorted(w for w in coded.dictionary.to_pylist() if w is not None)
            rank = {w: i for i, w in enumerate(words)}
            place = np.array([rank.get(w, -1) for w in coded.dictionary.to_pylist()] + [-1], np.int64)
            n = place[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            v = max(len(words), 1)
            codes = distinct((row * v + n)[n >= 0])
            row, n = codes // v, codes % v
            end = np.searchsorted(row, np.arange(len(lists)), side="right")[row]
            e = rows.column(0).to_numpy().astype(np.int64)
            low = int(e.min()) if len(e) else 0
            total = np.concatenate([[0], np.cumsum(end - np.arange(len(n)))])
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(total, total[at] + 4 * _PIECE, side="right")) - 1)
                start = np.arange(at, to)
                ln = end[at:to] - start
                code = np.sort(np.repeat(((e[row[at:to]] - low) * v + n[at:to]) * v, ln) + n[_ranges(start, ln)])
                last = np.flatnonzero(np.append(code[1:] != code[:-1], True))
                code, c = code[last], np.diff(last, prepend=-1)
                named = pa.array(words, pa.string())
                yield batch(a=named.take(pa.array(code // v % v)), b=named.take(pa.array(code % v)), e=(code // (v * v) + low).astype(np.int32), c=c.astype(np.int64))
                at = to

    return terms.select("e", "words").mapInArrow(run, "a string, b string, e int, c long")


def _dense(path: str, t: Tile, value: str | None = "p") -> list[np.ndarray]:
    """A stored column by the places of x and of y, 0 for words that aren't there; without one, whether they are."""
    rows = _read(path, ["number", value] if value else ["number"])
    number, out = rows["number"].to_numpy(), []
    for p in (t.x, t.y):
        own = (number >= p.first) & (number < p.first + len(p.df))
        out.append(np.zeros(len(p.df), float if value else bool))
        out[-1][number[own] - p.first] = rows[value].to_numpy()[own] if value else True
    return out


def positive(t: Tile, cells) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n, ppmi) of the cells of two words with a positive one."""
    for a, b, n in cells:
        s = np.log2(n * float(t.docs) / (t.x.df[a].astype(np.float64) * t.y.df[b]))
        keep = (s > 0) & (a + t.x.first != b + t.y.first)
        yield a[keep], b[keep], n[keep], s[keep]


def batch(**columns) -> pa.RecordBatch:
    return pa.record_batch({k: c if isinstance(c, pa.Array) else pa.array(c) for k, c in columns.items()})


def store(df: DataFrame) -> str:
    """The folder that the rows were written to, for tasks that read them all."""
    path = f"{shared_dir(df.sparkSession)}/mnemora/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def tiles(terms: DataFrame, least: float, vocabulary: DataFrame | None = None, width: int | None = None, cells_least: float | None = None) -> Tiles:
    """The rows of distinct ``words`` by blocks; the vocabulary (w, df) is that of words in at least ``least`` rows unless given."""
    spark = terms.sparkSession
    if vocabulary is None:
        vocabulary = terms.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    h = F.arrow_udf(lambda w: pa.array(hashes(w.to_pylist()).view(np.int64)), "long")
    number = settle(number_documents(vocabulary.select("w", "df"), "w").select((F.col("doc_seq") - 1).cast("int").alias("number"), "w", F.col("df").cast("long").alias("df"), h("w").alias("h")))
    words, total = number.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    if width is None:
        blocks = max(BLOCKS if total > SMALL else 1, -(-total // OCCURRENCES), -(-words // WIDTH), 1)
        width = max(1, -(-words // blocks))
    path = f"{shared_dir(spark)}/mnemora/{uuid.uuid4().hex}"
    number.withColumn("block", F.floor(F.col("number") / width).cast("int")).write.partitionBy("block").parquet(f"{path}/words")
    terms.select("words", *(c for c in terms.columns if c == "epoch")).mapInArrow(_encoder(path, width), "chunk long, counts binary, words binary, block int").write.partitionBy("block").parquet(f"{path}/rows")
    return Tiles(spark, path, number, words, width, least if cells_least is None else cells_least, terms.count())
