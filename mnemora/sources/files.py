"""Reading documents from CSV, and saving and restoring snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, content_column: str = "content", multi_line: bool = True) -> DataFrame:
    """Texts of one column of a CSV file with a header; quoted fields may span lines.

    Files without such fields are split among tasks if ``multi_line`` is off; else a file is one task.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    if content_column not in df.columns:
        raise ValueError(f"no column {content_column!r} among {df.columns}")
    return df.withColumnRenamed(content_column, "text")


def long_enough(texts: DataFrame, least: int = 10) -> DataFrame:
    """Rows whose text has at least ``least`` characters without white space at its ends."""
    stripped = F.regexp_replace("text", r"^[\s 　]+|[\s 　]+$", "")
    return texts.where(F.coalesce(F.length(stripped) >= least, F.lit(False)))


def csv_counts(texts: DataFrame, least: int = 10) -> DataFrame:
    """One row: texts processed and skipped."""
    kept = long_enough(texts, least).count()
    return texts.agg(F.count("*").alias("n")).select(F.lit(kept).cast("long").alias("docs_processed"), (F.col("n") - kept).alias("docs_skipped"))


def save_snapshot(path: str, tables: dict[str, DataFrame], config: dict) -> None:
    """Each table as Parquet, and the configuration last, so that a partial snapshot isn't one."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict] | None:
    """The tables and configuration of a snapshot; None if there is none."""
    try:
        config = json.loads(spark.read.text(f"{path}/config").first()[0])
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, config


def export_entries(entries: DataFrame, path: str, next_id: int) -> None:
    """Entries as JSON lines, and the number of the next one."""
    entries.write.mode("overwrite").json(f"{path}/entries")
    entries.sparkSession.createDataFrame([(json.dumps({"next_id": next_id}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def import_entries(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """What ``export_entries`` wrote; None if there is nothing."""
    from mnemora.schema import ENTRIES

    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return spark.read.schema(ENTRIES).json(f"{path}/entries"), int(meta["next_id"])
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
