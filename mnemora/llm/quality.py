"""Quality classifier: Bradley-Terry pairwise ranking, thresholded by a score quantile.

A document's score is linear in features of its whole text.  The weights maximise the
Bradley-Terry likelihood of preference pairs (a good labelled document over a bad one), i.e. they
minimise the logistic loss of feature differences.  Documents in the lowest ``level`` of all
scores are rejected; unless given, the level is the share of the labelled documents that lies below
the score that tells good from bad with the fewest mistakes.

Defined cases: a null or empty text has the features of a text without words and is scored like
any other; rows with equal scores share one fate; repeated rows count as often as they occur; a
null ``doc_id`` is scored too; with no usable labels (or only one kind) all weights are 0 and
nothing is rejected; an empty table gives an empty result.  Other columns, whatever their names,
are carried along by ``filter_quality`` and ignored by ``score_quality``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import OWN, explode_texts, labelled_sample, map_texts, settle, table
from mnemora.llm.textkit import Words, mix

#: Most labelled documents that the weights are fitted on.
MOST_LABELLED = 20_000
#: Good documents that each bad document is compared with.
PAIRS_EACH = 24
#: Scores are kept as multiples of this, which makes their quantiles exact.
GRID = 1e-4

FEATURES = (
    "log_words word_length long_words short_words punctuation_per_word bars hashes percents ampersands dollars stars "
    "bangs digits uppercase distinct_words repeated_lines words_per_line run_of_symbols words_with_case spaces"
).split()


def features(texts: list[str | None]) -> np.ndarray:
    """One row of bounded features per text, in the order of FEATURES."""
    w = Words(texts)
    n, chars = w.n_docs, np.maximum(np.diff(w.begin) - 1, 0).astype(float)
    words = np.diff(w.first).astype(float)
    some, length = np.maximum(words, 1), (w.ends - w.starts).astype(float)
    per_doc = lambda x: np.bincount(w.doc, weights=x, minlength=n)[:n] if len(x) else np.zeros(n)
    owner = np.repeat(np.arange(n), np.diff(w.begin))[: len(w.raw)]
    ascii_ = np.minimum(w.raw, 128)
    table_ = np.bincount(owner * 129 + ascii_, minlength=n * 129)[: n * 129].reshape(n, 129).astype(float)
    code = lambda s: table_[:, [ord(c) for c in s]].sum(1)
    symbols = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    is_symbol = np.zeros(129, bool)
    is_symbol[[ord(c) for c in symbols]] = True
    mark = is_symbol[ascii_]
    runs = np.zeros(n)
    if len(w.raw) > 1:
        same = mark[1:] & mark[:-1]
        runs = np.bincount(owner[1:][same], minlength=n)[:n].astype(float)
    upper = np.bincount(owner[w.raw != w.cps], minlength=n)[:n].astype(float)
    h = w.hashes()
    # distinct (text, word) and repeated (text, line) by sorting hashes
    distinct = np.zeros(n)
    if len(h):
        key = np.unique(mix(h + np.uint64(0x9E3779B9) * w.doc.astype(np.uint64)))
        order = np.argsort(h2 := mix(h + np.uint64(0x9E3779B9) * w.doc.astype(np.uint64)))
        firsts = order[np.concatenate(([True], h2[order][1:] != h2[order][:-1]))]
        distinct = np.bincount(w.doc[firsts], minlength=n)[:n].astype(float)
        del key
    breaks = np.flatnonzero(w.raw == 10)
    line_start = np.concatenate(([0], breaks + 1))
    line_end = np.concatenate((breaks, [len(w.raw)]))
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    lines, repeated = np.zeros(n), np.zeros(n)
    if len(line_start):
        line_doc = np.searchsorted(w.begin, line_start, "right") - 1
        lh = mix(w.span_hash(line_start, line_end) + np.uint64(0x9E3779B9) * line_doc.astype(np.uint64))
        order = np.argsort(lh, kind="stable")
        again = order[1:][lh[order][1:] == lh[order][:-1]]
        lines = np.bincount(line_doc, minlength=n)[:n].astype(float)
        repeated = np.bincount(line_doc[again], minlength=n)[:n].astype(float)
    letters = np.maximum(per_doc(length), 1)
    has_case = np.zeros(0)
    if len(h):
        changed = np.concatenate(([0], np.cumsum(w.raw != w.cps)))
        has_case = ((changed[w.ends] - changed[w.starts]) >= 2).astype(float)
    space = np.maximum(chars, 1)
    x = [
        np.log1p(words) / 10, per_doc(length) / some / 10, per_doc((length >= 6) * 1.0) / some, per_doc((length <= 3) * 1.0) / some,
        np.minimum(table_[:, [ord(c) for c in symbols]].sum(1) / some, 4), np.minimum(code("|") / some, 1), np.minimum(code("#") / some, 1),
        np.minimum(code("%") / some, 1), np.minimum(code("&") / some, 1), np.minimum(code("$") / some, 1), np.minimum(code("*") / some, 1),
        np.minimum(code("!?") / some, 1), code("0123456789") / letters, upper / letters, distinct / some,
        repeated / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)) / 5, runs / space, per_doc(has_case) / some if len(h) else np.zeros(n),
        code(" \t\n") / space,
    ]
    return np.stack(x, axis=1)


def fit_bradley_terry(x: np.ndarray, good: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights that minimise sum(log(1 + exp(-w.(x_good - x_bad)))) + ridge/2 |w|^2 by Newton steps."""
    top, low = np.flatnonzero(good), np.flatnonzero(~good)
    w = np.zeros(x.shape[1])
    if not len(top) or not len(low):
        return w
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(11)
    left = rng.choice(top, size=len(low) * pairs_each)
    d = (x[left] - x[np.repeat(low, pairs_each)]) / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        gradient = ridge * w - d.T @ p
        hessian = ridge * np.eye(len(w)) + (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, float]:
    """The weights, and the quantile level to reject below (0 if no weights can be fitted)."""
    sample = labelled_sample(spark, docs, labels, most, "quality")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = explode_texts(
        sample.selectExpr("text", "cast(doc_id as long) doc_id", "cast(quality as long) quality"),
        schema, ["text", "doc_id", "quality"], lambda: lambda t, i, q: (i, q, features(t).tolist()),
    ).toPandas()
    if not len(rows):
        return np.zeros(len(FEATURES)), 0.0
    x = np.array(rows.x.tolist())
    order = np.lexsort((*x.T, rows.doc_id.to_numpy()))
    x, good = x[order], rows.quality.to_numpy()[order] > 0
    w = fit_bradley_terry(x, good)
    return w, best_level(x @ w, good) if w.any() else 0.0


def best_level(scores: np.ndarray, good: np.ndarray) -> float:
    """Share of the scores below the cut with the fewest mistakes; of equals the lowest."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    mistakes = np.concatenate(([(~g).sum()], (~g).sum() - np.cumsum(~g) + np.cumsum(g)))
    mistakes[1:-1][s[1:] == s[:-1]] = len(s) + 1  # no cut between equal scores
    return float(np.argmin(mistakes)) / len(s)


def _scorer(w: np.ndarray):
    return lambda: lambda texts: [np.round(features(texts) @ w / GRID).astype(np.int64)]


def _cut(scores: DataFrame, level: float) -> int | None:
    """The largest grid score whose cumulative share is at most ``level``, over all rows."""
    counts = scores.groupBy(f"{OWN}score").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    if not total or level <= 0:
        return None
    # Counts by score are as many as distinct scores; only their running total is ordered.
    coarse = counts.groupBy(F.floor(F.col(f"{OWN}score") / 1000).alias("c")).agg(F.sum("count").alias("n")).orderBy("c").collect()
    below, at = 0, None
    for row in coarse:
        if below + row.n > level * total:
            at = row.c
            break
        below += row.n
    if at is None:
        return None
    best = None if not below else at * 1000 - 1
    for row in counts.where(F.floor(F.col(f"{OWN}score") / 1000) == at).orderBy(f"{OWN}score").collect():
        below += row["count"]
        if below > level * total:
            break
        best = row[f"{OWN}score"]
    return best


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, level: float | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, score, keep) of every document."""
    w, share = train(spark, docs, labels, most)
    scored = settle(map_texts(docs.select("doc_id", "text"), "text", [T.StructField(f"{OWN}score", T.LongType())], _scorer(w)).drop("text"))
    cut = _cut(scored, share if level is None else level)
    keep = F.lit(True) if cut is None else F.col(f"{OWN}score") > cut
    return scored.select("doc_id", (F.col(f"{OWN}score") * GRID).alias("score"), keep.alias("keep"))


def filter_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, level: float | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """The documents above the quantile, with all their columns.

    Scores are computed twice, for the quantile and for the filter, as that is cheaper than
    writing or shuffling the texts together with their scores.
    """
    w, share = train(spark, docs, labels, most)
    field = [T.StructField(f"{OWN}score", T.LongType())]
    cut = _cut(settle(map_texts(docs.select("text"), "text", field, _scorer(w)).drop("text")), share if level is None else level)
    if cut is None:
        return docs
    return map_texts(docs, "text", field, _scorer(w)).where(F.col(f"{OWN}score") > cut).drop(f"{OWN}score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
