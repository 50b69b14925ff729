"""Index joins over cells: terms, edges and document fields lead to the cells of other rows of the same table.

Each is a filter on the index cells, a distinct list of row keys, and a semi join with the table; nothing is
looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.cells import of_rows
from cellweave.operators.graph import cut
from cellweave.schema import b


def _part(source: str) -> Column:
    if source not in ("qualifier", "value"):
        raise ValueError(f"neither qualifier nor value: {source!r}")
    return F.col("cq" if source == "qualifier" else "value").cast("string")


def _rows(cells: DataFrame, ids: DataFrame, prefix: str) -> DataFrame:
    """Cells of the rows that the ids name."""
    return of_rows(cells, ids.select(F.concat(F.lit(prefix), "id").cast("binary").alias("row")).distinct())


def term_index(
    cells: DataFrame, terms: list[str], prefix: str = "", source: str = "qualifier", family: str | None = None, phrase: bool = False,
    low: float | None = None, high: float | None = None, low_inclusive: bool = False, high_inclusive: bool = False,
) -> DataFrame:
    """Cells of the primary rows that the posting rows ``terms`` name, any of them or all (``phrase``).

    A posting's id is its qualifier or its value; empty ids do not count. Bounds hold for ids read as numbers,
    ids that are none are left out then.
    """
    postings = cells.filter(F.col("row").isin([bytearray(t.encode()) for t in terms]) if terms else F.lit(False))
    if family:
        postings = postings.filter(F.col("cf") == b(family))
    hits = postings.select("row", _part(source).alias("id")).filter(F.col("id") != "")
    if low is not None or high is not None:
        n = F.col("id").try_cast("double")
        hits = hits.filter(n.isNotNull())
        if low is not None:
            hits = hits.filter(n >= low if low_inclusive else n > low)
        if high is not None:
            hits = hits.filter(n <= high if high_inclusive else n < high)
    if phrase:
        hits = hits.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(terms)))
    return _rows(cells, hits, prefix)


def tokens(cells: DataFrame, family: str | None, source: str, separator: str | None, id_index: int, rel_index: int) -> DataFrame:
    """(row, rel, id) of edge cells: the id is the whole token, or a part of it; tokens without the part are left out."""
    edges = cells.filter(F.col("cf") == b(family)) if family else cells
    token = _part(source)
    if not separator:
        return edges.select("row", F.lit("").alias("rel"), token.alias("id")).filter(F.col("id") != "")
    parts = F.split(token, F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))
    found = F.element_at(parts, -1) if id_index < 0 else F.get(parts, F.lit(id_index))
    return edges.select("row", F.get(parts, F.lit(rel_index)).alias("rel"), found.alias("id")).filter(F.col("id") != "")


def edge_expand(
    cells: DataFrame, anchors: DataFrame, family: str | None = None, source: str = "qualifier", separator: str | None = None, id_index: int = -1, rel_index: int = 0,
    relations: list[str] | None = None, weights: dict[str, float] | None = None, prefix: str = "", hops: int = 1, include_anchors: bool = False,
) -> DataFrame:
    """Cells of the rows within ``hops`` of the anchor rows (row), over edge cells.

    Relations and weights ask for a separator; a relation without a weight above 0 is not followed. With one hop an
    anchor that is another's neighbour counts; with more, anchors are visited from the start.
    """
    if (relations or weights) and not separator:
        raise ValueError("relations and weights are parts of a token: name its separator")
    edges = tokens(cells, family, source, separator, id_index, rel_index)
    if relations:
        edges = edges.filter(F.col("rel").isin(relations))
    if weights:
        edges = edges.filter(F.col("rel").isin([r for r, w in weights.items() if w > 0]))
    edges = edges.select("row", F.concat(F.lit(prefix), "id").cast("binary").alias("to"))
    start = anchors.select("row").distinct()
    step = lambda frontier: of_rows(edges, frontier).select(F.col("to").alias("row")).distinct()
    if hops <= 1:
        rows = step(start)
    else:
        frontier, seen, rows = start, start, start.limit(0)
        for _ in range(hops):
            # Written, so that plans stay short and a lost executor does not restart the walk.
            frontier = cut(step(frontier).join(seen.hint("shuffle_hash"), "row", "left_anti"))
            seen, rows = seen.union(frontier), rows.union(frontier)
    if include_anchors:
        rows = rows.union(start).distinct()
    return of_rows(cells, rows)


# -- documents: field cells under cf "datatype\0uid", cq "FIELD\0value"; index cells under cf "fi\0FIELD", cq "value\0datatype\0uid" ----


def document_cells(fields: DataFrame) -> DataFrame:
    """Field and index cells of rows (shard, datatype, uid, field, value, cv, timestamp)."""
    zero, raw = F.lit("\0"), lambda c: c.cast("binary")
    made = lambda cf, cq: fields.select(raw(F.col("shard")).alias("row"), raw(cf).alias("cf"), raw(cq).alias("cq"), raw(F.col("cv")).alias("cv"), "timestamp", F.lit(False).alias("deleted"), raw(F.lit("")).alias("value"))
    events = made(F.concat("datatype", zero, "uid"), F.concat("field", zero, "value"))
    return events.union(made(F.concat(F.lit("fi\0"), "field"), F.concat("value", zero, "datatype", zero, "uid")))


def field_index(cells: DataFrame) -> DataFrame:
    """(shard, field, value, datatype, uid) of index cells; a value may hold zero bytes, so the last two count."""
    cq = F.col("cq").cast("string")
    parts = F.split(cq, "\0")
    value = F.array_join(F.slice(parts, 1, F.size(parts) - 2), "\0")
    index = cells.filter((F.col("cf") >= b("fi\0")) & (F.col("cf") < b("fi\1")))
    index = index.filter(F.size(parts) >= 3)
    return index.select(F.col("row").cast("string").alias("shard"), F.substring(F.col("cf").cast("string"), 4, 1 << 30).alias("field"), value.alias("value"), F.element_at(parts, -2).alias("datatype"), F.element_at(parts, -1).alias("uid"))


def document_index(cells: DataFrame, terms: list[tuple[str, str]], op: str = "and", shards: list[str] | None = None, uid: str | None = None, datatype: str | None = None) -> DataFrame:
    """Field cells of the documents whose fields have the values, all or any; none for no terms. ``uid`` and ``datatype`` are held against what was found."""
    from cellweave.operators.documents import by_fields

    found = by_fields(field_index(cells), terms, op, shards)
    if uid is not None:
        found = found.filter(F.col("uid") == uid)
    if datatype is not None:
        found = found.filter(F.col("datatype") == datatype)
    keys = found.select(F.col("shard").cast("binary").alias("row"), F.concat("datatype", F.lit("\0"), "uid").cast("binary").alias("cf"))
    return cells.join(keys, ["row", "cf"], "left_semi")


def document_fields(cells: DataFrame) -> DataFrame:
    """(shard, datatype, uid, field, value) of field cells."""
    cf, cq = F.col("cf").cast("string"), F.col("cq").cast("string")
    rows = cells.filter((F.locate("\0", cf) > 0) & ~((F.col("cf") >= b("fi\0")) & (F.col("cf") < b("fi\1"))))
    return rows.select(F.col("row").cast("string").alias("shard"), F.substring_index(cf, "\0", 1).alias("datatype"), F.substring(cf, F.locate("\0", cf) + 1, F.lit(1 << 30)).alias("uid"), F.substring_index(cq, "\0", 1).alias("field"), F.substring(cq, F.locate("\0", cq) + 1, F.lit(1 << 30)).alias("value"))
