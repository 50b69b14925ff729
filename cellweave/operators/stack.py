"""Cell operators by name: a list of (name, options), checked as a whole and then folded over the table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from cellweave.operators import aggregate, cells, graph, index, rows, visibility

#: What an operator may be told, and how it is applied.
REGISTRY: dict[str, tuple[frozenset[str], Callable[..., DataFrame]]] = {}


def register(name: str, options: list[str], apply: Callable[..., DataFrame]) -> None:
    """Add an operator ``apply(cells, **options)``, of this library or of a user's own."""
    REGISTRY[name] = (frozenset(options), apply)


register("scanRange", ["start", "end", "start_inclusive", "end_inclusive"], cells.scan_range)
register("scanPrefix", ["prefix"], cells.scan_prefix)
register("asOf", ["ceiling"], cells.as_of)
register("deleting", ["propagate", "behavior"], cells.deleting)
register("versioning", ["n"], cells.versioning)
register("visibility", ["auths"], visibility.visible)
register("visibilityStamp", ["label", "mode"], visibility.stamp)
register("columns", ["families", "inclusive", "exact"], cells.columns)
register("grep", ["term", "row", "cf", "cq", "value", "cv"], cells.grep)
register("rowsHaving", ["cf", "cq", "values"], cells.rows_having)
register("wholeRow", ["max_bytes"], cells.whole_row)
register("withReferences", ["log", "locations", "live"], rows.with_references)
register("outsideBand", ["cf", "cq", "low", "high"], aggregate.outside_band)
register("graphAggregation", ["op", "by", "cf", "cq", "separator", "row", "family"], aggregate.result_cells)
register("termIndex", ["terms", "prefix", "source", "family", "phrase", "low", "high", "low_inclusive", "high_inclusive"], index.term_index)
register("edgeExpand", ["anchors", "family", "source", "separator", "id_index", "rel_index", "relations", "weights", "prefix", "hops", "include_anchors"], index.edge_expand)
register("documentIndex", ["terms", "op", "shards", "uid", "datatype"], index.document_index)
register("latentEdges", ["threshold", "per_cell", "buffer", "edge_cf", "family", "qualifier"], graph.latent_cells)
register("semanticEdges", ["threshold", "per_vertex", "most", "both_ways", "edge_cf", "inverse_cf", "family", "qualifier"], graph.semantic_cells)


def validate(stack: list[tuple[str, dict]]) -> None:
    """An unknown name or option is an error before anything is read."""
    for name, options in stack:
        if name not in REGISTRY:
            raise ValueError(f"unknown operator: {name!r}")
        if unknown := set(options) - REGISTRY[name][0]:
            raise ValueError(f"unknown options of {name}: {sorted(unknown)}")


def apply(table: DataFrame, stack: list[tuple[str, dict]]) -> DataFrame:
    """The operators one after the other, the first one next to the table; an empty list changes nothing.

    A time ceiling goes before versions are counted, wherever it stands.
    """
    validate(stack)
    names = [n for n, _ in stack]
    if "asOf" in names and "versioning" in names and names.index("asOf") > names.index("versioning"):
        stack = [s for s in stack if s[0] == "asOf"] + [s for s in stack if s[0] != "asOf"]
    return reduce(lambda df, step: df.transform(REGISTRY[step[0]][1], **step[1]), stack, table)
