"""Checkpoints (named times to read a table at) and provenance stamps, both kept as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.cells import as_of, deleting, scan_prefix, versioning
from cellweave.schema import CHECKPOINT, PROVENANCE, b

META = "meta:"


def _cells(rows: DataFrame, parts: list[tuple], cf: str) -> DataFrame:
    """Cells of a family from rows (row, cv, timestamp, deleted); parts are (qualifier, value column), a null value gives none."""
    cell = F.explode(F.array(*[F.struct(F.lit(q).alias("cq"), v.cast("string").alias("value")) for q, v in parts]))
    out = rows.select("row", "cv", "timestamp", "deleted", cell.alias("c")).filter("c.value is not null")
    raw = lambda c: c.cast("binary")
    return out.select(raw(F.col("row")).alias("row"), raw(F.lit(cf)).alias("cf"), raw(F.col("c.cq")).alias("cq"), raw(F.col("cv")).alias("cv"), "timestamp", "deleted", raw(F.col("c.value")).alias("value"))


def checkpoint_cells(named: DataFrame, written: int, delete: bool = False) -> DataFrame:
    """Cells of checkpoints (label, ts, created_at), written at a time; or the tombstones that delete them. A label without a name or with a time of 0 or less is an error."""
    good = F.when((F.col("label") == "") | F.col("label").isNull() | (F.col("ts") <= 0), F.raise_error(F.lit("a checkpoint needs a label and a time above 0"))).otherwise(F.lit(True))
    rows = named.filter(good.cast("boolean")).withColumns({"row": F.concat(F.lit(CHECKPOINT), "label"), "cv": F.lit(""), "timestamp": F.lit(written).cast("long"), "deleted": F.lit(delete)})
    return _cells(rows, [("ts", F.col("ts")), ("created_at", F.col("created_at"))], META)


def checkpoints(cells: DataFrame) -> DataFrame:
    """(label, ts, created_at) of all checkpoints that hold now."""
    live = versioning(deleting(scan_prefix(cells, CHECKPOINT).filter(F.col("cf") == b(META))))
    value = lambda q: F.max(F.when(F.col("cq") == b(q), F.col("value").cast("string").cast("long")))
    label = F.substring(F.col("row").cast("string"), len(CHECKPOINT) + 1, 1 << 30)
    return live.groupBy(label.alias("label")).agg(value("ts").alias("ts"), value("created_at").alias("created_at")).filter("label <> ''")


def at_checkpoint(cells: DataFrame, marks: DataFrame, label: str) -> DataFrame:
    """``cells`` as of the time that a label of ``marks`` names; an unknown label is an error."""
    found = checkpoints(marks).filter(F.col("label") == label).select("ts").first()  # one row
    if found is None:
        raise ValueError(f"unknown checkpoint: {label!r}")
    return as_of(cells, found["ts"])


def provenance_cells(stamps: DataFrame) -> DataFrame:
    """Cells of stamps (row, cv, timestamp, actor, sources, rationale, hop, ops, created_at); what is empty gives no cell, an empty stamp none at all.

    Sources keep their order, operations are sorted; without ``created_at`` the cell's time counts, in milliseconds.
    """
    some = lambda c: F.when(c != "", c)
    sources, ops = F.when(F.size("sources") > 0, F.array_join("sources", "\n")), F.when(F.size("ops") > 0, F.array_join(F.array_sort("ops"), ","))
    hop = F.when(F.col("hop") != 0, F.col("hop"))
    stamped = F.coalesce(F.col("created_at"), F.timestamp_millis("timestamp"))
    empty = F.coalesce(some(F.col("actor")), sources, some(F.col("rationale")), hop.cast("string"), ops, F.col("created_at").cast("string")).isNull()
    parts = [("actor", some(F.col("actor"))), ("sources", sources), ("rationale", some(F.col("rationale"))), ("pca_hop", hop), ("pca_ops", ops), ("created_at", F.date_format(F.to_utc_timestamp(stamped, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))]
    return _cells(stamps.filter(~empty).withColumn("deleted", F.lit(False)), parts, PROVENANCE)


def provenance(cells: DataFrame) -> DataFrame:
    """(row, actor, sources, rationale, hop, ops, created_at) of provenance cells, the inverse of provenance_cells()."""
    live = versioning(deleting(cells.filter(F.col("cf") == b(PROVENANCE))))
    value = lambda q: F.max(F.when(F.col("cq") == b(q), F.col("value").cast("string")))
    many = lambda q, sep: F.coalesce(F.split(value(q), sep), F.array().cast("array<string>"))
    return live.groupBy(F.col("row").cast("string").alias("row")).agg(
        value("actor").alias("actor"), many("sources", "\n").alias("sources"), value("rationale").alias("rationale"), F.coalesce(value("pca_hop").cast("int"), F.lit(0)).alias("hop"), many("pca_ops", ",").alias("ops"),
        value("created_at").alias("created_at"))
