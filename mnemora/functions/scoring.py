"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT, FUZZY, ASSOC = 1.0, 0.6, 0.4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def time_weight(timestamp, importance, now: float, decay: float = 0.1) -> Column:
    """Hyperbolic decay in days; an entry of importance 3 halves after 1/decay days, others in proportion."""
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - _c(timestamp)) / 86400.0)
    return 1.0 / (1.0 + F.lit(decay) * 3.0 / F.greatest(F.lit(1), _c(importance)) * age)


def importance_factor(importance) -> Column:
    return _c(importance) / 3.0


def relevance(exact, fuzzy, assoc) -> Column:
    return EXACT * _c(exact) + FUZZY * _c(fuzzy) + ASSOC * _c(assoc)


def merge_association(exact, fuzzy, chain_exact=0.0, chain_fuzzy=0.0) -> Column:
    """Hits on expanded words, then on chain words; sums and maxima in this order."""
    first = F.greatest(0.5 * _c(exact), 0.3 * _c(fuzzy))
    return F.greatest(first + 0.4 * _c(chain_exact), 0.2 * _c(chain_fuzzy))


def supplement_bonus(supplement, keywords, summary, body) -> Column:
    """1 + half the share of supplement words among the keywords or within summary or body."""
    text = F.concat(F.coalesce(_c(summary), F.lit("")), F.coalesce(_c(body), F.lit("")))
    own = F.coalesce(_c(keywords), F.array().cast("array<string>"))
    matched = F.size(F.filter(_c(supplement), lambda w: F.array_contains(own, w) | F.contains(text, w)))
    return F.when(F.size(_c(supplement)) > 0, 1.0 + 0.5 * matched / F.size(_c(supplement))).otherwise(F.lit(1.0))


def final_score(rel, bonus, weight, importance) -> Column:
    return F.round(_c(rel) * _c(bonus) * _c(weight) * importance_factor(importance), 4)


def clamp_importance(level) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), _c(level))).cast("int")


def retention(rate: float, steps) -> Column:
    return F.pow(F.lit(1.0 - rate), _c(steps))


def date_of(timestamp) -> Column:
    return F.date_format(F.timestamp_seconds(_c(timestamp)), "yyyy-MM-dd")
