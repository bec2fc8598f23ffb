"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.textkit import slices

#: Prefix of columns that operators add for themselves, so that callers' columns can't clash.
OWN = "__mn_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests) it is a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "mnemora-checkpoints")
    return root.rstrip("/")


_written: list[list[str]] = []


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``settle`` writes within, at the end; what is computed from them must be written by then."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again.

    Unlike a local checkpoint this survives the loss of any executor, and unlike ``cache`` it is
    never computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemora/{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list]],
    keep: bool = False,
) -> DataFrame:
    """Append columns computed from slices of whole texts.

    ``make()`` runs once per task and gives a function from a list of texts (None for null) to one
    list or array per field; with ``keep`` its last result is a boolean array, and only rows that
    it marks stay.  ``text`` may also name an array column, whose elements are lists then.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    arrow = _arrow_schema(schema)
    n_in = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in slices(texts):
                got = list(step(texts[a:b]))
                rows = pa.array(got.pop()) if keep else None
                part = batch.slice(a, b - a)
                columns = [*part.columns, *(pa.array(x, type=arrow.field(n_in + i).type) for i, x in enumerate(got))]
                out = pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)
                yield out.filter(rows) if keep else out

    return df.mapInArrow(run, schema)


def explode_texts(
    df: DataFrame, schema: T.StructType, inputs: list[str], make: Callable[[], Callable[..., list]], chars: int | None = None
) -> DataFrame:
    """Turn slices of whole texts (the first of ``inputs``) into any number of rows of ``schema``.

    ``make()`` runs once per task and gives a function from one list per input column to one list
    or array per field of ``schema``.
    """
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in inputs]
            for a, b in slices(columns[0]) if chars is None else slices(columns[0], chars):
                got = step(*(c[a:b] for c in columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(got, arrow)], schema=arrow)

    return df.select(*inputs).mapInArrow(run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pick(key: Column | str, seed: int = 7) -> Column:
    """A fixed pseudo-random number of a key, for samples that don't change between runs."""
    return F.xxhash64(F.lit(seed), key)


def bounded(df: DataFrame, most: int, *key: Column | str) -> DataFrame:
    """At most ``most`` rows of a table, the first by a hash of ``key``, without sorting all of it.

    Beyond the bound a hash threshold leaves little more than ``most`` rows to be sorted.
    """
    n = df.count()
    rank = pick(F.concat_ws(",", *(F.col(k).cast("string") if isinstance(k, str) else k for k in key)))
    if n > most:
        df = df.where(F.pmod(rank, F.lit(1 << 20)) < int((1.2 * most + 1000) / n * (1 << 20)) + 1)
    return df.orderBy(rank, *key).limit(most)


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most ``most`` labelled documents with their labels, chosen by a hash of ``doc_id``.

    Where labels repeat a ``doc_id`` the highest values count; rows with a null ``doc_id`` or a
    null label are left out.  The bounded side is small by construction, so it is broadcast and
    the texts aren't shuffled.  Repeated documents give repeated rows.
    """
    known = labels.where(" and ".join(f"{c} is not null" for c in ("doc_id", *columns)))
    known = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    chosen = bounded(settle(known), most, "doc_id")
    return docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(chosen), "doc_id")
