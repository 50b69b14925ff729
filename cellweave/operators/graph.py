"""Edges: expansion over one or more hops, and edges derived from alike vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.text import unpack_vector
from cellweave.operators.rank import similarity
from cellweave.operators.visibility import compound
from cellweave.schema import b
from cellweave.sources.scratch import shared_folder


def expand(edges: DataFrame, anchors: DataFrame, relations: list[str] | None = None, weights: dict[str, float] | None = None, include_anchors: bool = False) -> DataFrame:
    """Ids one hop from the anchors (id) over edges (src, rel, dst); an anchor that is another's neighbour counts."""
    if relations is not None:
        edges = edges.filter(F.col("rel").isin(relations))
    if weights is not None:
        edges = edges.filter(F.col("rel").isin([r for r, w in weights.items() if w > 0]))
    out = edges.join(anchors.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return out.union(anchors.select("id")).distinct() if include_anchors else out


def expand_hops(edges: DataFrame, anchors: DataFrame, hops: int, **options) -> DataFrame:
    """(id, hop) within ``hops``, each id at its first hop; anchors are visited from the start.

    Every hop is written as a checkpoint, so plans stay short and no lost executor restarts the walk.
    """
    visited = anchors.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = visited
    for hop in range(1, hops + 1):
        found = expand(edges, frontier, **options).join(visited.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = cut(found)
        visited = visited.union(frontier)
    return visited.filter("hop > 0")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster names; where none is named (tests), in one of our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def neighbour_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``neighbours``, the sorted ids that a node points to; an empty list if none."""
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return nodes.join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<string>")))


def _alike(rows: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (cell, a, b, la, lb, similarity), a < b, of a cell's rows (cell, id, vector, label) that reach the threshold; sizes (cell, of) are the cells' numbers of blocks.

    Rows are dealt by a hash of their id into blocks of their cell, and each two blocks meet once, under a key of
    their own, so a large cell is many keys of bounded size. A product of matrices finds the pairs that may reach
    the threshold; these are scored by the sums of similarity(), in its order.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # similarity() to a vector that holds a null is 0.
    void = F.exists("vector", lambda x: x.isNull())
    dealt = rows.filter("id is not null and vector is not null").withColumn("void", void)
    dealt = dealt.join(sizes, "cell").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("cell", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "id", "vector", "void", "label")
    kinds = dict(dealt.dtypes)

    def meet(block: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(invalid="ignore"):
            p, q, score = _reaching(block["vector"].to_numpy(), block["void"].to_numpy(), block["blk"].to_numpy() == block["i"].iloc[0], bool(block["i"].iloc[0] == block["j"].iloc[0]), threshold)
        ids, labels = block["id"].to_numpy(), block["label"].to_numpy()
        turned = ids[p] > ids[q]
        p, q = np.where(turned, q, p), np.where(turned, p, q)
        return pd.DataFrame({"cell": block["cell"].iloc[0], "a": ids[p], "b": ids[q], "la": labels[p], "lb": labels[q], "similarity": score})[ids[p] != ids[q]]

    # An explicit number of partitions: two blocks are few bytes but much arithmetic, so tasks must not be coalesced by bytes.
    keys = ["cell", "i", "j"]
    pairs = dealt.repartition(parts, *keys).groupBy(*keys).applyInPandas(meet, f"cell {kinds['cell']}, a {kinds['id']}, b {kinds['id']}, la {kinds['label']}, lb {kinds['label']}, similarity double")
    return pairs.withColumn("similarity", F.coalesce("similarity", F.lit(float("nan"))))  # pandas gives NaN back as null


def _reaching(vectors: np.ndarray, void: np.ndarray, first: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places p, q and cosines of the pairs that reach the threshold, p of the ``first`` and q of the others (``same``: all pairs, once each)."""
    out = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    lengths = np.array([len(v) for v in vectors])

    def sides(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = np.stack(vectors[places]).astype(np.float64).T.copy()
        norm = np.zeros(len(places))
        for c in columns:
            norm += c * c
        norm = np.sqrt(norm)
        unit = np.where(np.isfinite(norm), columns / np.where(norm > 0, norm, 1.0), np.nan)
        return columns, norm, unit.T.astype(np.float32)

    for dim in np.unique(lengths):
        left = np.flatnonzero((lengths == dim) & first)
        right = left if same else np.flatnonzero((lengths == dim) & ~first)
        if not left.size or not right.size:
            continue
        x, y = sides(left), sides(right)
        # More than what single precision can be off, for unit vectors.
        least, step = threshold - (dim + 8) * 2.4e-7, max(1, (1 << 22) // right.size)
        for at in range(0, left.size, step):
            p, q = np.nonzero(~(x[2][at : at + step] @ y[2].T < least))
            p += at
            if same:
                p, q = p[p < q], q[p < q]
            score = np.zeros(p.size)
            for c, d in zip(x[0], y[0], strict=True):
                score += c[p] * d[q]
            norms = x[1][p] * y[1][q]
            score = np.where((norms <= 0) | void[left[p]] | void[right[q]], 0.0, score / np.where(norms == 0, 1.0, norms))
            hit = ~(score < threshold)  # as in Spark, NaN is above all numbers
            out[0].append(left[p[hit]])
            out[1].append(right[q[hit]])
            out[2].append(score[hit])
    return tuple(np.concatenate(x) for x in out)


#: Numbers in a block of vectors: 8,192 vectors of 64 dimensions.
BLOCK = 1 << 19


def _blocks(block: int) -> Column:
    """A cell's number of blocks, of ``block`` rows, or of BLOCK numbers for 0."""
    numbers = F.lit(block) if block > 0 else F.greatest(F.lit(64), F.lit(BLOCK) / F.greatest(F.lit(1), F.max(F.size("vector"))))
    return F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / numbers)).cast("int")


def latent_edges(vectors: DataFrame, threshold: float = 0.85, per_cell: int = 0, buffer: int = 0, block: int = 0) -> DataFrame:
    """Alike pairs (a < b) within a cell of rows (cell, id, vector, timestamp): similarity and a timestamp after all of the cell.

    All pairs of a cell are compared. Above 0, ``buffer`` leaves a cell its first vertices by id only, and
    ``per_cell`` its first pairs (i, j) in their order: these are compared, whatever comes of it, and no others.
    """
    newest = vectors.groupBy("cell").agg((F.max("timestamp") + 1).alias("timestamp"))
    return _latent(vectors, threshold, per_cell, buffer, block).join(newest, "cell").select("cell", "a", "b", "similarity", "timestamp")


def _latent(vectors: DataFrame, threshold: float, per_cell: int, buffer: int, block: int = 0) -> DataFrame:
    first = vectors.select("cell", "id", "vector", F.lit("").alias("label"))
    sizes = first.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    if buffer > 0:
        sizes = sizes.withColumn("n", F.least("n", F.lit(buffer)))
    # The pairs below ``per_cell`` reach no further than this; a row number below a bound is cut in each partition first.
    reach = min([x for x in (buffer, 2 * per_cell + 2 if per_cell > 0 else 0) if x > 0], default=0)
    if reach > 0:
        first = first.withColumn("__i", F.row_number().over(Window.partitionBy("cell").orderBy("id"))).filter(F.col("__i") <= reach).withColumn("__i", F.col("__i") - 1)
    if per_cell > 0:
        ahead = F.col("i") * (F.col("n") * 2 - F.col("i") - 1) / 2
        a = first.join(sizes, "cell").select("cell", "n", F.col("__i").alias("i"), F.col("id").alias("a"), F.col("vector").alias("va")).filter(ahead < per_cell)
        c = first.select("cell", F.col("__i").alias("j"), F.col("id").alias("b"), F.col("vector").alias("vb"))
        pairs = a.join(c, "cell").filter((F.col("i") < F.col("j")) & (ahead + F.col("j") - F.col("i") - 1 < per_cell) & (F.size("va") == F.size("vb")))
        pairs = pairs.withColumn("similarity", similarity(F.col("va"), F.col("vb"))).filter(F.col("similarity") >= threshold)
    else:
        first = first.drop("__i")
        pairs = _alike(first, first.groupBy("cell").agg(_blocks(block).alias("of")), threshold)
    return pairs.select("cell", "a", "b", "similarity")


def _edge(row: Column, cf: str, cq: Column, cv: Column) -> list[Column]:
    raw = lambda c: c.cast("binary")
    return [raw(row).alias("row"), raw(F.lit(cf)).alias("cf"), raw(cq).alias("cq"), raw(cv).alias("cv"), F.col("timestamp"), F.lit(False).alias("deleted"), raw(F.format_string("%.4f", F.col("similarity"))).alias("value")]


def latent_cells(cells: DataFrame, threshold: float = 0.85, per_cell: int = 0, buffer: int = 0, edge_cf: str = "link", family: str = "V", qualifier: str = "_embedding") -> DataFrame:
    """The cells, and unlabelled edges both ways between alike vertices of a cell, for rows ``cell:id``; rows without a colon only pass through."""
    row = F.col("row").cast("string")
    named = cells.filter(row.contains(":")).select(F.substring_index(row, ":", 1).alias("cell"), F.substring(row, F.locate(":", row) + 1, F.lit(1 << 30)).alias("id"), "cf", "cq", "cv", "timestamp", "deleted", "value")
    newest = named.groupBy("cell").agg((F.max("timestamp") + 1).alias("timestamp"))
    held = named.filter((F.col("cf") == b(family)) & (F.col("cq") == b(qualifier)) & ~F.col("deleted")).groupBy("cell", "id").agg(F.max_by("value", "timestamp").alias("value"))
    held = held.select("cell", "id", unpack_vector("value").alias("vector")).filter("vector is not null")
    pairs = _both(_latent(held, threshold, per_cell, buffer).join(newest, "cell"), "a", "b")
    return cells.unionByName(pairs.select(*_edge(F.concat("cell", F.lit(":"), "a"), edge_cf, F.col("b"), F.lit(""))))


def _both(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair both ways, from one pass over the pairs."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    turned = F.explode(F.array(F.struct(F.col(a), F.col(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b))))
    return pairs.select(turned.alias("__e"), *rest).select(*[F.col(f"__e.{c}") if c in (a, b) else F.col(c) for c in pairs.columns])


def semantic_cells(cells: DataFrame, threshold: float = 0.85, per_vertex: int = 10, most: int = 0, both_ways: bool = True, edge_cf: str = "link", inverse_cf: str | None = None, family: str = "V", qualifier: str = "_embedding") -> DataFrame:
    """The cells, and edges from each vertex to its nearest ones, with both labels and a time after all cells; with ``inverse_cf`` also back."""
    held = cells.filter((F.col("cf") == b(family)) & (F.col("cq") == b(qualifier)) & ~F.col("deleted")).groupBy("row").agg(F.max_by(F.struct("value", "cv"), "timestamp").alias("x"))
    held = held.select(F.col("row").cast("string").alias("id"), unpack_vector("x.value").alias("vector"), F.col("x.cv").cast("string").alias("label")).filter("vector is not null")
    edges = semantic_edges(held, threshold, per_vertex, most, both_ways).crossJoin(F.broadcast(cells.agg((F.max("timestamp") + 1).alias("timestamp"))))  # one row
    out = cells.unionByName(edges.select(*_edge(F.col("src"), edge_cf, F.col("dst"), F.col("label"))))
    return out if inverse_cf is None else out.unionByName(edges.select(*_edge(F.col("dst"), inverse_cf, F.col("src"), F.col("label"))))


def semantic_edges(vectors: DataFrame, threshold: float = 0.85, per_vertex: int = 10, most: int = 0, both_ways: bool = True, block: int = 0) -> DataFrame:
    """(src, dst, similarity, label) over all rows (id, vector, label): each vertex's nearest. If ``most`` is above 0, nothing is derived above so many vectors."""
    if most > 0 and vectors.limit(most + 1).count() > most:
        return vectors.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("similarity"), "label").limit(0)
    rows = vectors.select(F.lit(0).alias("cell"), "id", "vector", "label")
    pairs = _alike(rows, F.broadcast(rows.groupBy("cell").agg(_blocks(block).alias("of"))), threshold)
    pairs = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity", compound(F.col("la"), F.col("lb")).alias("label"))
    if both_ways:
        pairs = _both(pairs, "src", "dst")
    if per_vertex > 0:
        order = Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst")
        pairs = pairs.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= per_vertex).drop("__n")
    return pairs
