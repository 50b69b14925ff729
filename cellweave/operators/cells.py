"""Cell semantics: ranges, time, deletes, versions, row filters. Each is a DataFrame to DataFrame function."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.visibility import visible
from cellweave.schema import COORD, b, key_order, successor


def scan_range(cells: DataFrame, start=None, end=None, start_inclusive: bool = True, end_inclusive: bool = True) -> DataFrame:
    """Rows between two keys; plain comparisons of ``row``, so they reach the scan."""
    if start is not None:
        cells = cells.filter(F.col("row") >= b(start) if start_inclusive else F.col("row") > b(start))
    if end is not None:
        cells = cells.filter(F.col("row") <= b(end) if end_inclusive else F.col("row") < b(end))
    return cells


def scan_prefix(cells: DataFrame, prefix) -> DataFrame:
    return scan_range(cells, prefix, successor(prefix), True, False)


def scan_ranges(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells of each range (range_idx, lo, hi), both inclusive; a cell in two ranges comes twice.

    Keys and ranges meet by the ``n`` bytes behind what all ranges have in common, with n the longest for which no range
    spans more than a few thousand of these; so it is an equality, however many ranges there are.
    """
    low, high = ranges.agg(F.min("lo"), F.max("hi")).first()
    if low is None:
        return cells.join(ranges.drop("lo", "hi"), F.lit(False))
    skip = len(os.path.commonprefix([bytes(low), bytes(high)]))
    head = lambda c, n: F.conv(F.rpad(F.hex(F.substring(c, skip + 1, n)), 2 * n, "0"), 16, 10).cast("long")
    spans = ranges.select(*[F.max(head(F.col("hi"), n) - head(F.col("lo"), n)).alias(str(n)) for n in range(1, 8)]).first()
    n = max((i for i in range(1, 8) if spans[str(i)] <= 4096), default=1)
    dealt = ranges.withColumn("__head", F.explode(F.sequence(head(F.col("lo"), n), F.greatest(head(F.col("lo"), n), head(F.col("hi"), n)))))
    cells = scan_range(cells, bytes(low), bytes(high)).withColumn("__head", head(F.col("row"), n))
    return cells.join(dealt, "__head").filter((F.col("row") >= F.col("lo")) & (F.col("row") <= F.col("hi"))).drop("lo", "hi", "__head")


def lookup_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of the rows named in ``rows`` (row, idx)."""
    return cells.join(rows, "row")


def columns(cells: DataFrame, families: list[str] | None = None, inclusive: bool = True, exact: list[tuple] | None = None) -> DataFrame:
    """Families in or out; or exact columns (cf[, cq[, cv]]). An empty inclusive list selects nothing."""
    if families is not None:
        inside = F.lit(False)
        for f in families:
            inside = inside | (F.col("cf") == b(f))
        cells = cells.filter(inside if inclusive else ~inside)
    if exact is not None:
        hit = F.lit(False)
        for c in exact:
            one = F.lit(True)
            for name, part in zip(("cf", "cq", "cv"), c, strict=False):
                one = one & (F.col(name) == b(part))
            hit = hit | one
        cells = cells.filter(hit)
    return cells


def as_of(cells: DataFrame, ceiling: int | None) -> DataFrame:
    return cells if ceiling is None or ceiling <= 0 else cells.filter(F.col("timestamp") <= int(ceiling))


def deleting(cells: DataFrame, propagate: bool = False, behavior: str = "process") -> DataFrame:
    """The newest tombstone of a coordinate swallows everything not newer than it."""
    if behavior == "fail":
        return cells.filter(F.when(F.col("deleted"), F.raise_error(F.lit("tombstone found"))).otherwise(F.lit(True)).cast("boolean"))
    if behavior != "process":
        raise ValueError(f"unknown behavior: {behavior!r}")
    # Tombstones are few: aggregated first, then joined, so live coordinates need no sort.
    buried = cells.filter("deleted").groupBy(*COORD).agg(F.max("timestamp").alias("__buried"))
    joined = cells.join(buried, COORD, "left")
    kept = ~F.col("deleted") & (F.col("__buried").isNull() | (F.col("timestamp") > F.col("__buried")))
    if propagate:
        kept = kept | (F.col("deleted") & (F.col("timestamp") == F.col("__buried")))
    out = joined.filter(kept).select(*cells.columns)
    return out


def versioning(cells: DataFrame, n: int = 1) -> DataFrame:
    """The newest ``n`` cells of each coordinate; tombstones count."""
    if n < 1:
        raise ValueError("at least one version")
    seq = [F.col("_seq")] if "_seq" in cells.columns else []
    if n == 1:
        rest = [c for c in cells.columns if c not in COORD]
        newest = F.max_by(F.struct(*rest), F.struct("timestamp", "deleted", *seq, "value"))
        return cells.groupBy(*COORD).agg(newest.alias("__x")).select(*[F.col(c) if c in COORD else F.col(f"__x.{c}").alias(c) for c in cells.columns])
    order = [F.col("timestamp").desc(), F.col("deleted").desc(), *[s.desc() for s in seq], F.col("value").desc()]
    return cells.withColumn("__rn", F.row_number().over(Window.partitionBy(*COORD).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def resolve(cells: DataFrame, ceiling: int | None = None, auths: list[str] | None = None, versions: int = 1) -> DataFrame:
    """What a reader sees: time ceiling, deletes, visibility, versions, in this order."""
    return versioning(visible(deleting(as_of(cells, ceiling)), auths), versions)


def in_key_order(cells: DataFrame, limit: int | None = None) -> DataFrame:
    cells = cells.orderBy(*key_order())
    return cells if limit is None else cells.limit(limit)


def neighbors(cells: DataFrame, rows: DataFrame, family: str) -> DataFrame:
    """(src, dst): live out-edges of a family for rows (row)."""
    live = resolve(columns(cells, [family]).join(rows, "row", "left_semi"))
    return live.select(F.col("row").alias("src"), F.col("cq").alias("dst")).distinct()


def grep(cells: DataFrame, term: str, row: bool = True, cf: bool = True, cq: bool = True, value: bool = True, cv: bool = False) -> DataFrame:
    """Cells any chosen part of which contains the term's bytes."""
    hit = F.lit(False)
    for name, use in (("row", row), ("cf", cf), ("cq", cq), ("value", value), ("cv", cv)):
        hit = hit | F.contains(F.col(name), b(term)) if use else hit
    return cells.filter(hit)


def whole_row(cells: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row for each row key, its cells in key order; an error if a row is larger than ``max_bytes``."""
    cell = F.struct("cf", "cq", "cv", (-F.col("timestamp")).alias("age"), "timestamp", "deleted", "value")
    size = F.sum(F.octet_length("cf") + F.octet_length("cq") + F.octet_length("cv") + F.octet_length("value"))
    out = cells.groupBy("row").agg(F.array_sort(F.collect_list(cell)).alias("cells"), size.alias("bytes"))
    if max_bytes is not None:
        out = out.filter(F.when(F.col("bytes") > max_bytes, F.raise_error(F.lit("row larger than the buffer"))).otherwise(F.lit(True)).cast("boolean"))
    return out


def of_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of the rows (row). A task hashes its share of the row keys; the cells, which are far more, are not sorted."""
    return cells.join(rows.hint("shuffle_hash"), "row", "left_semi")


def rows_with(cells: DataFrame, condition) -> DataFrame:
    """Whole rows of which a cell meets the condition."""
    return of_rows(cells, cells.filter(condition).select("row").distinct())


def rows_having(cells: DataFrame, cf: str, cq: str | None = None, values: list[str] | None = None) -> DataFrame:
    """Whole rows with a cell in a column, and with one of the values if given."""
    condition = F.col("cf") == b(cf)
    if cq is not None:
        condition = condition & (F.col("cq") == b(cq))
    if values is not None:
        condition = condition & F.col("value").cast("string").isin(values)
    return rows_with(cells, condition)
