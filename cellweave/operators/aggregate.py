"""Aggregation of cells by key parts, and the band filter on a metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.cells import rows_with
from cellweave.schema import b

OPS = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
_DECIMAL = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def number(value: Column) -> Column:
    """A value read as a decimal text, else as a big-endian float of four or eight bytes; null if neither."""
    bits = F.conv(F.hex(value), 16, 10).try_cast("decimal(20,0)")

    def ieee(exponent_bits: int, fraction_bits: int) -> Column:
        whole = F.when(bits >= F.lit(str(2**63)).cast("decimal(20,0)"), bits - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(bits).cast("long")
        top = exponent_bits + fraction_bits
        sign = F.when(F.shiftrightunsigned(whole, top).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
        exponent = F.shiftrightunsigned(whole, fraction_bits).bitwiseAND((1 << exponent_bits) - 1)
        fraction = whole.bitwiseAND((1 << fraction_bits) - 1)
        bias = (1 << (exponent_bits - 1)) - 1
        small = fraction / float(1 << fraction_bits) * F.pow(F.lit(2.0), F.lit(1 - bias))
        normal = (1 + fraction / float(1 << fraction_bits)) * F.pow(F.lit(2.0), exponent - bias)
        return F.when(exponent == (1 << exponent_bits) - 1, None).when(exponent == 0, sign * small).otherwise(sign * normal)

    size, text = F.octet_length(value), F.trim(value.cast("string"))
    return F.coalesce(F.when((size > 0) & text.rlike(_DECIMAL), text.try_cast("double")), F.when(size == 4, ieee(8, 23)), F.when(size == 8, ieee(11, 52)))


def row_prefix(separator: str = ":") -> Column:
    return F.substring_index(F.col("row").cast("string"), separator, 1)


def aggregate(cells: DataFrame, op: str = "count", by: str = "row", cf: str | None = None, cq: str | None = None, separator: str = ":") -> DataFrame:
    """(group, result): cells counted, or their numeric values aggregated; values that are no numbers are left out, and groups without any."""
    if op not in OPS:
        raise ValueError(f"unknown aggregation: {op!r}")
    if cf is not None:
        cells = cells.filter(F.col("cf") == b(cf))
    if cq is not None:
        cells = cells.filter(F.col("cq") == b(cq))
    group = row_prefix(separator) if by == "rowPrefix" else F.col(by).cast("string")
    if op == "count":
        return cells.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("result"))
    numbers = cells.select(group.alias("group"), number(F.col("value")).alias("v")).filter("v is not null")
    return numbers.groupBy("group").agg(OPS[op]("v").alias("result"))


def written(value: Column) -> Column:
    """A number as text: whole ones without a point, others without an exponent."""
    plain = F.regexp_replace(value.cast("decimal(38,15)").cast("string"), r"0+$", "")
    text = value.cast("string")
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e18), value.cast("long").cast("string")).when(text.contains("E"), plain).otherwise(text)


def result_cells(cells: DataFrame, op: str = "count", by: str = "row", cf: str | None = None, cq: str | None = None, separator: str = ":", row: str = "_agg", family: str = "result") -> DataFrame:
    """aggregate() as cells: one row, a qualifier for each group, the result written as a number."""
    found = aggregate(cells, op, by, cf, cq, separator)
    raw = lambda c: c.cast("binary")
    return found.select(
        raw(F.lit(row)).alias("row"), raw(F.lit(family)).alias("cf"), raw(F.col("group")).alias("cq"), raw(F.lit("")).alias("cv"), F.lit(0).cast("long").alias("timestamp"), F.lit(False).alias("deleted"),
        raw(written(F.col("result").cast("double"))).alias("value"))


def count_cells(cells: DataFrame, by: str) -> DataFrame:
    """Cells (not logical rows) for each key part: row, cf, cq, cv or rowPrefix."""
    group = row_prefix() if by == "rowPrefix" else F.col(by).cast("string")
    return cells.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("count"))


def outside_band(cells: DataFrame, cf: str, cq: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Whole rows with a metric cell outside [low, high]."""
    if low is None and high is None:
        raise ValueError("a bound is needed")
    v = number(F.col("value"))
    out = F.lit(False)
    if low is not None:
        out = out | (v < low)
    if high is not None:
        out = out | (v > high)
    return rows_with(cells, (F.col("cf") == b(cf)) & (F.col("cq") == b(cq)) & F.coalesce(out, F.lit(False)))


def digest(cells: DataFrame) -> DataFrame:
    """Number of cells and a digest that does not depend on their order: exclusive or and sum of 64-bit hashes, so equal pairs don't cancel out."""
    hashed = F.xxhash64(*cells.columns)
    total = F.sum(hashed.cast("decimal(20,0)")).cast("string")
    return cells.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor(hashed).cast("string"), total), 256).alias("digest"))
