"""Recall and summaries of the episodic log (entries with a date)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS = {"day": 1, "week": 7, "month": 30}


def recall(entries: DataFrame, start: str, end: str | None = None, category: str | None = None, source: str | None = None, keyword: str | None = None) -> DataFrame:
    """Logs of inclusive dates, oldest first; a keyword may be in summary, body or (either way round) a tag."""
    e = entries.where(F.col("is_episodic") & F.col("date_str").between(start, end or start))
    if category is not None:
        e = e.where(F.col("topic") == category)
    if source is not None:
        e = e.where(F.col("source") == source)
    if keyword is not None:
        k = F.lit(keyword)
        tags = F.coalesce("keywords", F.array().cast("array<string>"))
        e = e.where(F.coalesce(F.contains("summary", k), F.lit(False)) | F.coalesce(F.contains("body", k), F.lit(False)) | F.exists(tags, lambda t: F.contains(t, k) | F.contains(k, t)))
    return e.orderBy("timestamp", "id")


def category_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.col("topic").alias("category")).agg(F.count("*").alias("n"))


def period_bounds(period: str, end: str) -> tuple[str, str]:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}")
    return (date.fromisoformat(end) - timedelta(days=PERIODS[period] - 1)).isoformat(), end


def summarize(entries: DataFrame, period: str, end: str) -> DataFrame:
    """(date_str, category, n): counts by day and category, by day, by category and in total.

    One pass: the total has neither date nor category, the others have a null where they sum.
    """
    logs = recall(entries, *period_bounds(period, end))
    cube = logs.select("date_str", F.col("topic").alias("category")).cube("date_str", "category")
    return cube.agg(F.count("*").alias("n"))
