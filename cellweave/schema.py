"""The cell model: one DataFrame row for each versioned cell, ordered by (row, cf, cq, cv, newest first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of stored cell files.
CELL = T.StructType([
    T.StructField("row", T.BinaryType()), T.StructField("cf", T.BinaryType()), T.StructField("cq", T.BinaryType()), T.StructField("cv", T.BinaryType()),
    T.StructField("timestamp", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("value", T.BinaryType()),
])
COORD = ["row", "cf", "cq", "cv"]

#: Row prefixes and column families of the graph layout.
EVENT, ENTITY, TERM, CHECKPOINT, REPLAY = "evt:", "ent:", "idx:", "ckpt:", "replay:"
CONTENT, VECTOR, ATTRIBUTE, POSTING, PROVENANCE = "content:", "vec:", "attr:", "post:", "prov:"
EDGES = {"temporal": "edge.temp:", "causal": "edge.causal:", "semantic": "edge.sem:", "entity": "edge.ent:"}


def b(text: str | bytes) -> Column:
    """A binary literal, so that comparisons with key columns reach the Parquet scan."""
    return F.lit(bytearray(text.encode() if isinstance(text, str) else text))


def successor(prefix: str | bytes) -> bytes | None:
    """The smallest key after all keys with the prefix; None if there is none."""
    raw = (prefix.encode() if isinstance(prefix, str) else bytes(prefix)).rstrip(b"\xff")
    return raw[:-1] + bytes([raw[-1] + 1]) if raw else None


def row_key(prefix: str, name: Column) -> Column:
    """The row key of an event (EVENT), entity (ENTITY) or term (TERM)."""
    return F.concat(b(prefix), name.cast("binary"))


def row_name(row: Column, prefix: str) -> Column:
    """What stands behind the prefix of a row key; null if it has another one."""
    n = len(prefix.encode())
    return F.when(F.substring(row, 1, n) == b(prefix), F.substring(row, n + 1, 1 << 30).cast("string"))


def cells(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small cell DataFrame of (row, cf, cq, cv, timestamp, deleted, value) with texts or bytes."""
    raw = lambda x: bytearray(x.encode()) if isinstance(x, str) else x
    return spark.createDataFrame([tuple(raw(x) for x in r) for r in rows], CELL)


def key_order() -> list[Column]:
    return [F.col(c) for c in COORD] + [F.col("timestamp").desc(), F.col("deleted").desc()]


def shown(df: DataFrame) -> DataFrame:
    """Binary columns as text."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in df.schema.fields])
