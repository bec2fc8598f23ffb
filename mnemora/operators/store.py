"""Entries as a fold over an append-only operation log, their keyword index, and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.scoring import clamp_importance


def current_entries(ops: DataFrame) -> DataFrame:
    """The present state of all entries that weren't removed, in one shuffle by entry.

    ``set_imp`` sets the clamped importance and ``demote`` lowers it by one, not below 1, in the
    order of ``seq``; ``access`` counts (as often as ``level`` says, once if it is null) and keeps the latest time.
    """
    step = F.struct("seq", "op", "level")
    folded = ops.groupBy("entry_id").agg(
        F.min_by("payload", F.when(F.col("op") == "add", F.col("seq"))).alias("p"),
        F.bool_or(F.col("op") == "remove").alias("gone"),
        F.bool_or(F.col("op") == "add").alias("known"),
        F.sort_array(F.collect_list(F.when(F.col("op").isin("set_imp", "demote"), step))).alias("steps"),
        F.coalesce(F.sum(F.when(F.col("op") == "access", F.coalesce(F.col("level"), F.lit(1)))), F.lit(0)).alias("access_count"),
        F.max(F.when(F.col("op") == "access", F.col("ts"))).alias("last_accessed"),
    )
    live = folded.where("known and not gone")
    return live.select(F.col("entry_id").alias("id"), "p.*", "steps", "access_count", "last_accessed").withColumn("importance", importance_fold(clamp_importance("importance"), F.col("steps"))).drop("steps")


def importance_fold(start: Column, steps: Column) -> Column:
    """Apply ordered set_imp and demote steps to a starting importance."""
    return F.aggregate(
        steps, start,
        lambda v, s: F.when(s.op == "set_imp", clamp_importance(s.level)).otherwise(F.greatest(F.lit(1), v - 1)).cast("int"),
    )


def keyword_index(entries: DataFrame) -> DataFrame:
    """Distinct (keyword, entry_id); the topic counts as a keyword."""
    topic = F.when(F.col("topic").isNotNull() & (F.col("topic") != ""), F.array("topic")).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), topic))
    return entries.select(F.explode(every).alias("keyword"), F.col("id").alias("entry_id"))


def list_entries(entries: DataFrame, source: str | None = None, entry_type: str | None = None) -> DataFrame:
    if source is not None:
        entries = entries.where(F.col("source") == source)
    if entry_type is not None:
        entries = entries.where(F.col("entry_type") == entry_type)
    return entries.orderBy(F.desc("timestamp"), "id")


def entries_since(entries: DataFrame, since: float) -> DataFrame:
    return entries.where(F.col("timestamp") >= since).orderBy("timestamp", "id")


def by_source(entries: DataFrame, source: str) -> DataFrame:
    return entries.where(F.col("source") == source).select("id")


def time_filter(entries: DataFrame, now: float, hours: float | None = None, between: tuple[float, float] | None = None) -> DataFrame:
    """Inclusive at both ends; a range wins over recent hours, and 0 hours filter nothing."""
    if between:
        return entries.where(F.col("timestamp").between(*map(float, between)))
    if hours:
        return entries.where(F.col("timestamp").between(float(now) - hours * 3600, float(now)))
    return entries


def inverted_index(index: DataFrame) -> DataFrame:
    return index.groupBy("keyword").agg(F.sort_array(F.collect_set("entry_id")).alias("entry_ids"))


def all_keywords(index: DataFrame) -> DataFrame:
    return index.select("keyword").distinct()


def store_stats(entries: DataFrame, index: DataFrame) -> DataFrame:
    """One row: entries, distinct keywords, sorted distinct sources."""
    a = entries.agg(F.count("*").alias("total_entries"), F.sort_array(F.collect_set("source")).alias("sources"))
    return a.crossJoin(index.agg(F.countDistinct("keyword").alias("total_keywords"))).select("total_entries", "total_keywords", "sources")


def access_counts(accesses: DataFrame) -> DataFrame:
    """(id, access_count, last_accessed) from rows (id, ts)."""
    return accesses.groupBy("id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))
