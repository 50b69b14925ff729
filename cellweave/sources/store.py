"""Tables of cells as batches of Parquet: a folder ``batch=N`` for each append.

Spark's own writers and readers do the work; of equal keys the one of the later batch wins (``_seq``). Files are
sorted by key, so a range of rows reads few row groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.cells import deleting, resolve, versioning
from cellweave.operators.graph import cut
from cellweave.operators.visibility import stamp
from cellweave.schema import CELL, COORD, key_order

_STORED = T.StructType([*CELL.fields, T.StructField("batch", T.LongType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All cells with ``_seq``; none where nothing was written."""
    try:
        return spark.read.schema(_STORED).parquet(path).withColumnRenamed("batch", "_seq")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _STORED).withColumnRenamed("batch", "_seq")


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """What a reader sees; options of resolve()."""
    return resolve(read(spark, path), **options).drop("_seq")


def sorted_by_key(cells: DataFrame) -> DataFrame:
    return cells.repartitionByRange("row").sortWithinPartitions(*key_order())


def append(cells: DataFrame, path: str, now_us: int | None = None, constraints: dict[str, Column] | None = None) -> int:
    """Write a batch and return its number. Cells without a time (0) get ``now_us`` and later ones, in no order of their own.

    An empty row key is an error, and so is a cell that a constraint does not hold for; nothing is written then.
    Another writer's batch of the same number is an error too: read again and retry.
    """
    rules = {"row key": F.octet_length("row") > 0} | (constraints or {})
    for name, holds in rules.items():
        cells = cells.filter(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"a cell fails its constraint: {name}")).cast("boolean")))
    if now_us is not None:
        cells = cells.withColumn("timestamp", F.when(F.col("timestamp") == 0, F.lit(now_us) + F.monotonically_increasing_id()).otherwise(F.col("timestamp")))
    number = (read(cells.sparkSession, path).agg(F.max("_seq")).first()[0] or 0) + 1
    writer = sorted_by_key(cells.select(*CELL.fieldNames())).write.option("parquet.bloom.filter.enabled#row", "true")
    writer.mode("errorifexists").parquet(f"{path}/batch={number}")
    return number


MUTATION = (
    "id long, row binary, conditions array<struct<cf:binary,cq:binary,cv:binary,timestamp:long,absent:boolean,equals:binary>>, "
    "entries array<struct<cf:binary,cq:binary,cv:binary,timestamp:long,deleted:boolean,value:binary>>"
)


def append_if(mutations: DataFrame, path: str) -> DataFrame:
    """Write those mutations of which all conditions hold, each as a whole or not at all; (id, accepted).

    A condition asks for a coordinate without a live cell (``absent``) or for its value, of its newest cell or of the
    one at ``timestamp``. A row's mutations are judged in the order of their id, each seeing those accepted
    before; the rows are independent of each other, so each is one task's work.
    """
    spark = mutations.sparkSession
    asked = mutations.select("row", F.explode("conditions").alias("c")).select("row", "c.cf", "c.cq", "c.cv").distinct()
    current = read(spark, path).join(asked, COORD, "left_semi")

    def judged(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple, list[tuple]] = {}
        for c in held.itertuples():
            cells.setdefault((c.cf, c.cq, c.cv), []).append((c.timestamp, c.deleted, c._8, c.value))
        out = []
        for m in rows.sort_values("id").itertuples():
            holds = True
            for c in m.conditions:
                versions = [v for v in cells.get((c["cf"], c["cq"], c["cv"]), []) if c["timestamp"] is None or v[0] == c["timestamp"]]
                newest = max(versions, key=lambda v: v[:3], default=None)
                live = newest is not None and not newest[1]
                holds &= not live if c["absent"] else live and newest[3] == c["equals"]
            for e in m.entries if holds else ():
                cells.setdefault((e["cf"], e["cq"], e["cv"]), []).append((e["timestamp"], e["deleted"], 1 << 62, e["value"]))
            out.append((m.id, holds))
        return pd.DataFrame(out, columns=["id", "accepted"])

    names = [*CELL.fieldNames(), "_seq"]
    verdict = cut(mutations.groupBy("row").cogroup(current.select(*names).groupBy("row")).applyInPandas(judged, "id long, accepted boolean"))
    entries = mutations.join(verdict.filter("accepted").select("id"), "id").select("row", F.explode("entries").alias("e")).select("row", "e.*")
    append(entries.select(*CELL.fieldNames()), path)
    return verdict


def compact(spark: SparkSession, path: str, target: str, keep_history: bool = True, max_versions: int | None = None, most_bytes: int | None = None) -> int:
    """Everything as one batch of a new table; without history tombstones and what they swallowed go.

    The old table stays as it is until readers have moved. More than ``most_bytes`` of keys and values is an error.
    """
    cells = read(spark, path)
    if not keep_history:
        cells = deleting(cells)
    if max_versions is not None:
        cells = versioning(cells, max_versions)
    latest = F.row_number().over(Window.partitionBy(*COORD, "timestamp", "deleted").orderBy(F.col("_seq").desc()))
    cells = cells.withColumn("__n", latest).filter("__n = 1")
    if most_bytes is not None:
        size = cells.agg(F.sum(sum((F.octet_length(c) for c in (*COORD, "value")), F.lit(0)))).first()[0] or 0
        if size > most_bytes:
            raise ValueError(f"the output would hold {size} bytes")
    return append(cells, target)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, cells, digest) of a table's files, named from the batch on."""
    cells = spark.read.schema(_STORED).parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(batch=[0-9]+/[^/]+)$", 1)
    hashed = F.xxhash64(*CELL.fieldNames())
    return cells.select("*", name.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("cells"), F.concat_ws(":", F.hex(F.bit_xor(hashed)), F.sum(hashed.cast("decimal(20,0)")).cast("string")).alias("digest"))


def export(spark: SparkSession, path: str, target: str, shipped: DataFrame | None = None, producer: str = "") -> DataFrame:
    """Copy the files that were not shipped before; (file, cells, digest, status): uploaded, skipped or retired.

    The result, kept by the caller, is ``shipped`` of the next export. A batch keeps its number; a producer's name in
    front of the folder keeps several apart.
    """
    now = files(spark, path)
    if shipped is None:
        shipped = spark.createDataFrame([], "file string, cells long, digest string, status string")
    before = shipped.filter("status <> 'retired'").select("file", F.col("cells").alias("__c"), F.col("digest").alias("__d"))
    told = now.join(before, "file", "full").select(
        "file", F.coalesce("cells", "__c").alias("cells"), F.coalesce("digest", "__d").alias("digest"),
        F.when(F.col("digest").isNull(), "retired").when(F.col("digest") == F.col("__d"), "skipped").otherwise("uploaded").alias("status"))
    told = cut(told)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(batch=[0-9]+/[^/]+)$", 1)
    fresh = spark.read.schema(_STORED).parquet(path).select("*", name.alias("file")).join(told.filter("status = 'uploaded'").select("file"), "file", "left_semi").drop("file")
    fresh.write.mode("append").partitionBy("batch").parquet(f"{target}/{producer}" if producer else target)
    return told


def take_in(spark: SparkSession, source: str, path: str, label: str | None = None) -> int:
    """An exported or otherwise prepared folder of cells as a new batch; ``label`` is stamped on all of them. Older batches of the folder stay older by time only."""
    cells = spark.read.schema(CELL).parquet(source)
    return append(stamp(cells, label) if label else cells, path)
