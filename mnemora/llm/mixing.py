"""Mixing sources to target weights by entropy balancing.

Documents get rates w_i that are as close as possible (in relative entropy) to equal rates while
each source's tokens, sum of w_i * t_i over its documents, meet a target and the rates sum to the
number of documents.  The solution is exponentially tilted, w_i = N exp(a_s t_i) / Z; Newton
iterations find the convex dual's minimum.  A document enters the dual only through its source and
token count, so the table is reduced once to counts of (source, tokens), written to the shared
folder, and every iteration is one distributed aggregation of that reduction (value, gradient and
curvature for each source); only sums per source come to the driver.

Rates are rounded into copies without bias, floor(w_i + u_i), where u_i is a fixed pseudo-random
number of the document's id and text length, so no document depends on another one.

Unless targets are given, a source's share of the tokens is its present share to the power
``smoothing``, normalised, and limited to what rates can reach: where it can't, all shares stay
nearer to the present ones.  Given targets out of reach are an error, as is a dual that isn't solved.

Defined cases: a null source is a source of its own; null or empty texts have no tokens and a rate
that only the normalisation sets; sources without tokens take no part in targets; repeated rows have
equal rates and copies; a null ``doc_id`` is rounded by its text length; an empty table gives an
empty result; other columns, whatever their names, are carried along or ignored.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import OWN, settle, table

#: Exponent of the present shares that gives the default targets; 1 changes nothing, 0 makes all equal.
SMOOTHING = 0.7
_S, _T, _RATE = f"{OWN}source", f"{OWN}tokens", f"{OWN}rate"


def tokens(text: str = "text") -> Column:
    """Number of blank-separated tokens of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def default_targets(share: dict, smoothing: float = SMOOTHING) -> dict:
    raised = {s: v**smoothing for s, v in share.items() if v > 0}
    total = sum(raised.values())
    return {s: v / total for s, v in raised.items()}


def reach(goal: np.ndarray, share: np.ndarray, top: np.ndarray, low: np.ndarray) -> float:
    """How far from the present shares (0) towards the goal (1, or more) there are rates, by sources' tokens of a document.

    The shares that rates can give are a polytope, spanned by the longest and the shortest documents of each source.
    """
    far = np.inf
    for size, sign in ((top, 1.0), (low, -1.0)):
        if size.min() > 0:
            now, then = sign * (share / size).sum(), sign * (goal / size).sum()
            if then > now + 1e-12:
                far = min(far, max(sign - now, 0.0) / (then - now))
    return far


def solve(counts: DataFrame, targets: dict | None = None, smoothing: float = SMOOTHING, rounds: int = 500, tolerance: float = 1e-9) -> tuple[dict, float, float]:
    """(tilt of each source, log normaliser, scale of tokens) for rows (source, tokens, n).

    ``counts`` must be written already, as every iteration reads it.  Tokens are divided by their
    mean, which keeps the dual well scaled.
    """
    sums = counts.groupBy(_S).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col(_T)).alias("t"), F.max(_T).alias("top"), F.min(_T).alias("low")).collect()
    n_all, t_all = sum(r.n for r in sums), float(sum(r.t for r in sums))
    if not t_all:
        return {}, 0.0, 1.0
    scale = t_all / n_all
    live = sorted((r for r in sums if r.t), key=lambda r: (r[_S] is not None, r[_S] or ""))
    names = [r[_S] for r in live]
    share = {r[_S]: r.t / t_all for r in live}
    want = dict(targets) if targets else default_targets(share, smoothing)
    goal = np.array([max(want.get(s, 0.0), 1e-9) for s in names])
    goal = goal / goal.sum()  # mean scaled tokens per document, by source; they sum to 1
    present = np.array([share[s] for s in names])
    empty = any(not r.low for r in sums)  # documents without tokens stand for shorter ones of any source
    far = reach(goal, present, *(np.array([float(x) for x in c]) / scale for c in ([r.top for r in live], [0 if empty else r.low for r in live])))
    if far < 1 and targets:
        raise ValueError(f"no rates reach these targets; from the present shares they reach {far:.3g} of the way")
    if 0.99 * far < 1 and not targets:  # on the very edge all rates but some would be 0
        warnings.warn(f"targets are limited to {0.99 * far:.3g} of the way from the present shares", stacklevel=2)
        goal = present + 0.99 * far * (goal - present)
    tilt = np.zeros(len(names))
    place = {s: i for i, s in enumerate(names)}

    def moments(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """log of the mean of exp(a_s t), and the tilted mean and second moment of t, by source."""
        spark = counts.sparkSession
        rows = spark.createDataFrame([(s, float(at[i])) for s, i in place.items()], f"{OWN}s string, a double")
        on = F.col(_S).cast("string").eqNullSafe(F.col(f"{OWN}s"))
        x = F.col(_T) / F.lit(scale)
        # One row per source: its size is that of the driver's own list of sources.
        e = counts.join(F.broadcast(rows), on, "left").withColumn("z", F.coalesce("a", F.lit(0.0)) * x)
        peak = float(e.agg(F.max("z")).first()[0]) if (at > 0).any() else 0.0
        g = e.withColumn("w", F.col("n") * F.exp(F.col("z") - F.lit(peak)))
        got = g.groupBy(_S).agg(F.sum("w").alias("w"), F.sum(F.col("w") * x).alias("m"), F.sum(F.col("w") * x * x).alias("q")).collect()
        total = sum(r.w for r in got)
        m, q = np.zeros(len(names)), np.zeros(len(names))
        for r in got:
            if r[_S] in place:
                m[place[r[_S]]], q[place[r[_S]]] = r.m / total, r.q / total
        return float(np.log(total / n_all) + peak), m, q

    value, m, q = moments(tilt)
    dual = value - tilt @ goal
    solved = lambda g, most: (np.abs(g) < np.minimum(most, 1e3 * most * (goal + 1e-6))).all()
    for _ in range(rounds):
        gradient = m - goal
        if solved(gradient, tolerance):
            break
        hessian = np.diag(q) - np.outer(m, m)
        unit = 1 / np.sqrt(np.maximum(np.diag(hessian), 1e-300))  # rare sources have small curvature
        step = unit * np.linalg.solve(hessian * np.outer(unit, unit) + 1e-12 * np.eye(len(m)), unit * gradient)
        size = 1.0
        while size > 1e-9:
            new = tilt - size * step
            value, m2, q2 = moments(new)
            if value - new @ goal <= dual - 1e-4 * size * float(gradient @ step) + 1e-14 * max(1.0, abs(dual)):
                break
            size /= 2
        else:
            value = dual + tilt @ goal
            break
        tilt, m, q, dual = new, m2, q2, value - new @ goal
    if not solved(m - goal, 1e3 * tolerance):
        raise ArithmeticError(f"shares are still {np.abs(m - goal).max():.3g} off their targets")
    return {s: float(tilt[i]) for s, i in place.items()}, value, scale


def with_rates(spark: SparkSession, docs: DataFrame, targets: dict | None = None, smoothing: float = SMOOTHING, source: str = "source", text: str = "text") -> DataFrame:
    """The table with the source, tokens and rate of each document appended under own names."""
    marked = docs.withColumn(_S, F.col(source).cast("string")).withColumn(_T, tokens(text))
    counts = settle(marked.groupBy(_S, _T).agg(F.count("*").alias("n")))
    tilt, log_z, scale = solve(counts, targets, smoothing)
    if not tilt:
        return marked.withColumn(_RATE, F.lit(1.0))
    rows = spark.createDataFrame(list(tilt.items()), f"{OWN}s string, {OWN}a double")
    z = F.coalesce(f"{OWN}a", F.lit(0.0)) * F.col(_T) / F.lit(scale) - F.lit(log_z)
    # One row per source, which are few enough for the dual's Newton system on the driver.
    joined = marked.join(F.broadcast(rows), F.col(_S).eqNullSafe(F.col(f"{OWN}s")), "left")
    return joined.withColumn(_RATE, F.exp(z)).drop(f"{OWN}s", f"{OWN}a")


def copies(rate: Column, doc_id: Column, length: Column) -> Column:
    """Unbiased rounding of a rate by a fixed pseudo-random number of the document."""
    u = F.pmod(F.xxhash64(F.lit(23), doc_id, length), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("long")


def mix_rates(spark: SparkSession, docs: DataFrame, targets: dict | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of every document."""
    rated = with_rates(spark, docs.select("doc_id", "source", "text"), targets, smoothing)
    n = copies(F.col(_RATE), F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0)))
    return rated.select("doc_id", F.col(_S).alias("source"), F.col(_T).alias("tokens"), F.col(_RATE).alias("rate"), n.alias("copies"))


def mix_documents(spark: SparkSession, docs: DataFrame, targets: dict | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """Each document as often as its copies say, numbered from 0 in ``copy`` (after its own columns).

    Where the documents have a column of that name already, in any case, theirs stays and the number
    is in ``copy_1``, or the first such name that is free.
    """
    rated = with_rates(spark, docs, targets, smoothing)
    n = copies(F.col(_RATE), F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0)))
    numbered = rated.withColumn(f"{OWN}n", n).where(F.col(f"{OWN}n") > 0)
    numbered = numbered.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{OWN}n") - 1)))
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("copy", *(f"copy_{i}" for i in range(1, len(taken) + 2))) if n not in taken)
    return numbered.select(*docs.columns, F.col(f"{OWN}copy").alias(name))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(spark, table(spark, sf_dir, "documents"))
