"""Schemas of the engine's tables."""

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
_WORDS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


ENTRY = _struct(
    entry_type=_S, topic=_S, summary=_S, body=_S, source=_S, category=_S, keywords=_WORDS, timestamp=_D, date_str=_S, importance=_I, supersedes=_S,
    is_episodic=T.BooleanType(),
)
#: Append-only operations; entries are a fold over them.
OPS = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),  # add, remove, set_imp, demote, access
        T.StructField("entry_id", T.StringType(), False),
        T.StructField("ts", T.DoubleType()),
        T.StructField("level", T.IntegerType()),  # of set_imp; of access: how many at once, if not one
        T.StructField("payload", ENTRY),
    ]
)
#: Word lists to learn from: documents (channel "doc") count towards the corpus, keyword lists ("kw") don't.
TERMS = _struct(doc_seq=_L, channel=_S, words=_WORDS)
ENTRIES = T.StructType([T.StructField("id", T.StringType()), *ENTRY.fields, T.StructField("access_count", T.LongType()), T.StructField("last_accessed", T.DoubleType())])
