"""Logical rows of cells: columns as the first cell in key order, and predicates on these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.text import matches
from cellweave.operators.cells import of_rows
from cellweave.schema import b


def _is(cf: str, cq: str | None) -> Column:
    return (F.col("cf") == b(cf)) & (F.col("cq") == b(cq)) if cq else F.col("cf") == b(cf)


def project(cells: DataFrame, columns: dict[str, tuple[str, str | None]], prefix: str = "", where: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(id, *columns): one row for each row key, with the value of the first cell of each (cf[, cq]) in key order, null if there is none.

    ``where`` holds (column, operator, text): = > >= < <= compare texts by their bytes, ``like`` takes a prefix with
    an optional % at its end, ``match`` asks for every word as a part. A row without the cell fails. Only cells of
    the columns named are read; rows without any of them are no rows.
    """
    hit = F.lit(False)
    for part in columns.values():
        hit = hit | _is(*part)
    place = F.struct("cf", "cq", "cv", (-F.col("timestamp")).alias("age"), (~F.col("deleted")).alias("live"))
    first = [F.min_by(F.when(_is(*part), F.col("value")), F.when(_is(*part), place)).cast("string").alias(name) for name, part in columns.items()]
    out = cells.filter(hit).groupBy("row").agg(*first)
    for name, op, text in where or ():
        out = out.filter(compared(F.col(name), op, text))
    key = F.col("row").cast("string")
    return out.select(F.when(key.startswith(prefix), F.substring(key, len(prefix) + 1, 1 << 30)).otherwise(key).alias("id"), *columns)


def compared(value: Column, op: str, text: str) -> Column:
    if op == "match":
        return matches(value, text)
    if op == "like":
        return F.startswith(value, F.lit(text.removesuffix("%")))
    raw, other = value.cast("binary"), b(text)
    found = {"=": raw == other, ">": raw > other, ">=": raw >= other, "<": raw < other, "<=": raw <= other}
    if op not in found:
        raise ValueError(f"unknown operator: {op!r}")
    return found[op]


def with_references(cells: DataFrame, log: str, locations: list[str], live: list[str]) -> DataFrame:
    """Whole rows with a cell of family ``log``, or whose location, ``value[cq]`` of the last such cell, is not among ``live``."""
    is_location = F.col("cf").isin([bytearray(c.encode()) for c in locations])
    place = F.concat(F.col("value").cast("string"), F.lit("["), F.col("cq").cast("string"), F.lit("]"))
    last = F.max_by(F.when(is_location, place), F.when(is_location, F.struct("cf", "cq", "cv", (-F.col("timestamp")).alias("age"))))
    rows = cells.groupBy("row").agg(F.bool_or(F.col("cf") == b(log)).alias("logged"), last.alias("place"))
    rows = rows.filter(F.col("logged") | (F.col("place").isNotNull() & ~F.col("place").isin(live))).select("row")
    return of_rows(cells, rows)
