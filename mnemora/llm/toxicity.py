"""Toxicity: cumulative-link (proportional odds) regression on sparse text features.

Features are the presence of markers: hashed words and word beginnings whose counts among toxic and
clean labelled documents differ beyond chance.  A word has one marker at most, itself or else its
longest beginning that is one, so inflected forms share evidence and no word counts twice.
P(grade <= k) = logistic(theta_k - w.x): the thresholds are ordered and share the weights.  The
result for each document is its expected severity, its likeliest grade and whether any toxicity is
likelier than none.

Chance is judged by the likelihood ratio of each feature's table of two by two counts, at a level
that limits the share of false markers among all features that are tested.  ``labels`` only tells toxic from clean, so the
grades above 0 are those of evidence: every toxic document is scored by a model of toxic against
clean that was fitted without it, and the terciles of these scores are mild, medium and severe.

Defined cases: null or empty texts have no features and get the severity of the intercepts alone;
repeated rows are scored alike; a null ``doc_id`` is scored too; with no usable labels (or only one
kind) every severity is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import explode_texts, labelled_sample, map_texts, settle, table
from mnemora.llm.textkit import Words, mix

#: Most labelled documents that the model is fitted on.
MOST_LABELLED = 12_000
GRADES = 4
#: Parts of the sample, each scored by a model of the others, from which grades are taken.
FOLDS = 4
_BITS = 26
#: Word beginnings that are features besides the whole words, which come first; the longest is preferred.
_BEGINNINGS = (7, 6, 5, 4)
_KINDS = 1 + len(_BEGINNINGS)
#: Sampled documents that a marker must occur in, share of markers by accident, and signals that can't be markers.
_LEAST, _FALSE, _WEAK = 4, 0.05, 2.5
_RIDGE = 0.1


def sparse_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text of each distinct word, its features: one row of the word and its beginnings, -1 where too short)."""
    w = Words(texts)
    h = w.hashes()
    # each distinct word of a text once; equal words have equal beginnings
    _, at = np.unique(mix(h + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    at.sort()
    starts, length = w.starts[at], (w.ends - w.starts)[at]
    short = lambda x: (x >> np.uint64(64 - _BITS)).astype(np.int64)
    out = np.full((len(at), _KINDS), -1, np.int64)
    out[:, 0] = short(h[at])
    for i, n in enumerate(_BEGINNINGS, 1):
        m = length > n
        out[m, i] = short(mix(w.span_hash(starts[m], starts[m] + n) + np.uint64(n)))
    return w.doc[at], out


def likelihood_ratio(bad: Column, n: Column, n_bad: int, n_all: int) -> Column:
    """Signed root of the G statistic of a feature in ``n`` documents, ``bad`` of them toxic."""
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = n_bad / n_all
    cells = ((bad, n * share), (n - bad, n * (1 - share)), (n_bad - bad, (n_all - n) * share), (n_all - n_bad - n + bad, (n_all - n) * (1 - share)))
    g = F.greatest(2 * sum((part(a, b) for a, b in cells[1:]), part(*cells[0])), F.lit(0.0))
    return F.when(bad > n * share, F.sqrt(g)).otherwise(-F.sqrt(g))


def discoveries(signal: np.ndarray, tested: int) -> np.ndarray:
    """Which of the greatest signals to believe, so that a share of _FALSE of them is expected to be chance.

    Benjamini-Hochberg over all ``tested`` features; ``signal`` has all those beyond _WEAK.
    """
    order = np.argsort(-np.abs(signal), kind="stable")
    p = np.array([2 * (1 - NormalDist().cdf(z)) for z in np.abs(signal[order])])
    below = np.flatnonzero(p <= np.arange(1, len(p) + 1) * _FALSE / max(tested, 1))
    keep = np.zeros(len(signal), bool)
    keep[order[: below[-1] + 1 if len(below) else 0]] = True
    return keep


def place_markers(doc: np.ndarray, features: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, index in ``names``) of the marker of each word, if it has one."""
    if not len(names) or not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(names, features), len(names) - 1)
    hit = names[at] == features
    some = hit.any(1)
    first = hit[some].argmax(1)
    code = np.unique(doc[some] * len(names) + at[some][np.arange(len(first)), first])
    return code // len(names), code % len(names)


def fit_cumulative(doc: np.ndarray, column: np.ndarray, grade: np.ndarray, width: int, ridge: float = 0.02, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) minimising the negative log likelihood plus ridge/2 |w|^2 (Adam)."""
    n, k = len(grade), int(grade.max()) + 1
    above = np.array([(grade > j).mean() for j in range(k - 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - above) / above)
    # thresholds as a first one and the logarithms of gaps, which keeps them ordered
    raw = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))))
    w = np.zeros(width)
    p = np.concatenate((w, raw))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w, raw = p[:width], p[width:]
        theta = np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))
        s = np.bincount(doc, weights=w[column], minlength=n)[:n]
        high = np.where(grade < k - 1, sig(theta[np.minimum(grade, k - 2)] - s), 1.0)
        low = np.where(grade > 0, sig(theta[np.maximum(grade - 1, 0)] - s), 0.0)
        like = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / like, low * (1 - low) / like
        g_s = (dh - dl) / n
        g_theta = np.zeros(k - 1)
        np.add.at(g_theta, np.minimum(grade, k - 2), np.where(grade < k - 1, -dh / n, 0))
        np.add.at(g_theta, np.maximum(grade - 1, 0), np.where(grade > 0, dl / n, 0))
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate((np.bincount(column, weights=g_s[doc], minlength=width)[:width] + ridge / n * w, tail[:1], tail[1:] * np.exp(raw[1:])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w, raw = p[:width], p[width:]
    return w, np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))


class Model:
    """Chosen features (sorted), their weights and the thresholds."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.names, self.weights, self.thresholds = names, weights, thresholds

    def severity(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(expected severity, likeliest grade, any toxicity likelier than none) of each text."""
        n = len(texts)
        if not len(self.thresholds):
            return np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
        score = np.zeros(n)
        if len(self.names):
            doc, at = place_markers(*sparse_features(texts), self.names)
            score = np.bincount(doc, weights=self.weights[at], minlength=n)[:n]
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        grades = np.diff(np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1), axis=1)
        return (1 - below).sum(1), grades.argmax(1), below[:, 0] < 0.5


NOTHING = Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def evidence_grades(doc: np.ndarray, column: np.ndarray, toxic: np.ndarray, width: int, folds: int = FOLDS) -> np.ndarray:
    """0 for clean texts, else 1 and up by terciles of the score from a model of the other folds."""
    score, fold = np.zeros(len(toxic)), np.arange(len(toxic)) % folds
    for k in range(folds):
        other = fold != k
        if len(set(toxic[other])) < 2:
            continue
        number = np.cumsum(other) - 1
        use = other[doc]
        w, _ = fit_cumulative(number[doc[use]], column[use], toxic[other].astype(np.int64), width, _RIDGE)
        held = ~use
        score += np.bincount(doc[held], weights=w[column[held]], minlength=len(toxic))[: len(toxic)]
    cuts = np.quantile(score[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic, 1 + np.searchsorted(cuts, score, side="left"), 0)
    return np.unique(grade, return_inverse=True)[1]  # without empty grades


def fit(doc: np.ndarray, column: np.ndarray, toxic: np.ndarray, names: np.ndarray) -> Model:
    """The model for labelled texts given as (text, index of a marker) pairs."""
    grade = evidence_grades(doc, column, toxic, len(names))
    w, theta = fit_cumulative(doc, column, grade, len(names), _RIDGE)
    return Model(names, w, theta)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Markers are chosen by counts made on the executors; the driver only gets those and their places."""
    sample = labelled_sample(spark, docs, labels, most, "toxic")

    def step(texts, ids, toxic):
        doc, features = sparse_features(texts)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [ids, toxic, [features[a:b].ravel().astype(np.int32) for a, b in zip(cut, cut[1:])]]

    schema = T.StructType.fromDDL("doc_id long, toxic long, features array<int>")
    source = sample.selectExpr("text", "cast(doc_id as long) doc_id", "cast(toxic > 0 as long) toxic")
    rows = settle(explode_texts(source, schema, ["text", "doc_id", "toxic"], lambda: step))
    size = rows.groupBy("toxic").count().toPandas().set_index("toxic")["count"].to_dict()
    if len(size) < 2:
        return NOTHING
    each = rows.select(F.explode(F.array_distinct("features")).alias("feature"), "toxic").where("feature >= 0")
    counts = each.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(F.col("n") >= _LEAST)
    signal = F.abs(likelihood_ratio(F.col("bad").cast("double"), F.col("n").cast("double"), size[1], sum(size.values())))
    counts = settle(counts.select("feature", signal.alias("signal")))
    strong = counts.where(F.col("signal") >= _WEAK).orderBy(F.desc("signal"), "feature").toPandas()
    names = np.sort(strong.feature.to_numpy(np.int64)[discoveries(strong.signal.to_numpy(np.float64), counts.count())])

    def places(batches):
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy().astype(np.int64).reshape(-1, _KINDS)
            words = np.diff(batch.column("features").offsets.to_numpy()) // _KINDS
            owner, at = place_markers(np.repeat(np.arange(batch.num_rows), words), flat, names)
            found = np.split(at.astype(np.int32), np.searchsorted(owner, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "features"])

    got = rows.mapInArrow(places, schema).toPandas()
    got = got.iloc[np.lexsort((got.features.map(lambda f: tuple(f)).to_numpy(), got.doc_id.to_numpy()))]
    length = got.features.map(len).to_numpy()
    column = np.concatenate(got.features.tolist()).astype(np.int64)
    return fit(np.repeat(np.arange(len(got)), length), column, got.toxic.to_numpy() > 0, names)


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) of every document."""
    shared = spark.sparkContext.broadcast(train(spark, docs, labels, most))

    def step(texts):
        severity, grade, toxic = shared.value.severity(texts)
        return [np.round(severity, 6), grade, toxic]

    fields = T.StructType.fromDDL("expected_severity double, grade long, toxic boolean").fields
    return map_texts(docs.select("doc_id", "text"), "text", fields, lambda: step).drop("text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
