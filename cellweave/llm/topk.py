"""Operator 3: exact top-k by inner product, columnar branch-and-bound over blocks.

Candidates and queries are dealt by a hash of their id into groups of at most about ``room`` bytes, the sides of a
grid; each cell of the grid is one task's work. A query is shipped once for each group of candidates
and a candidate once for each group of queries, so what is shipped grows with rows times groups, not with
pairs. In a task both groups lie dimension by dimension. Scores are accumulated one block of dimensions
at a time; after each, a candidate's score plus the largest that its remaining mass allows
(Cauchy-Schwarz on the remaining dimensions) must reach the k-th best certain score so far, or it leaves
the compacted survivor list. Ties with the k-th best stay until the end, when equal scores are ordered
by id. A cell gives k rows for each query at most; the best k of all cells are kept.

Only id and v are read, so further columns of any name do no harm. A vector of any length works: groups
then hold fewer rows, one at least.
Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a
null id. A query only meets vectors of its own dimension. Of rows with an equal id the smallest vector
counts. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import table

#: Squares of integers summed over the dimensions stay exact in double precision below this.
_EXACT = float(1 << 53)


def _best(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``queries`` the positions and scores of its k best columns of ``points`` (dimension x candidate)."""
    dims = points.shape[0]
    cuts = list(range(0, dims, step)) + [dims]
    mass_q = [np.sqrt((queries[:, c:] ** 2).sum(1)) for c in cuts]
    mass_p = [np.sqrt((points[c:] ** 2).sum(0)) for c in cuts]
    at_once = max(1, (1 << 22) // max(ids.size, 1))
    for i, q in enumerate(queries):
        if i % at_once == 0:  # first sums of a few queries, 32 MB
            first = queries[i : i + at_once, : cuts[1]] @ points[: cuts[1]]
        alive = np.flatnonzero(ids != own[i])
        score = first[i % at_once, alive]
        for j in range(1, len(cuts)):
            if j > 1:
                score = score + q[cuts[j - 1] : cuts[j]] @ points[cuts[j - 1] : cuts[j]][:, alive]
            if j < len(cuts) - 1 and alive.size > k:
                slack = mass_q[j][i] * mass_p[j][alive] * (1 + 1e-9) + 1e-6
                floor = np.partition(score - slack, alive.size - k)[alive.size - k]
                keep = score + slack >= floor
                alive, score = alive[keep], score[keep]
        if alive.size > k:
            last = np.partition(score, alive.size - k)[alive.size - k]
            keep = score >= last
            alive, score = alive[keep], score[keep]
        order = np.lexsort((ids[alive], -score))[:k]
        yield alive[order], score[order]


def _exact(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same beyond double precision: whole Python integers, no pruning."""
    whole = np.vectorize(int, otypes=[object])
    points = whole(points)
    for q, mine in zip(queries, own, strict=True):
        score = whole(q) @ points
        alive = sorted((j for j in range(ids.size) if ids[j] != mine), key=lambda j: (-score[j], ids[j]))[:k]
        yield np.array(alive, dtype=int), score[alive]


def _columns(side) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix (row by row) of an Arrow table (id, v)."""
    ids = side["id"].to_numpy()
    return ids, side["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(ids.size, -1)


def _meet(k: int, step: int):
    def run(candidates, asked):
        import pyarrow as pa

        found: list[list] = [[], [], []]
        if candidates.num_rows and asked.num_rows:
            ids, rows = _columns(candidates)
            own, queries = _columns(asked)
            points = np.ascontiguousarray(rows.T)
            size = max(np.abs(points).max(initial=0), np.abs(queries).max(initial=0))
            best = _best(queries, points, ids, own, k, step) if size * size * points.shape[0] < _EXACT else _exact(queries, points, ids, own, k)
            for mine, (at, score) in zip(own, best, strict=True):
                found[0].append(np.full(len(at), mine))
                found[1].append(ids[at])
                found[2].append(np.array([int(x) for x in score], dtype=np.int64))
        empty = np.zeros(0, dtype=np.int64)
        return pa.table({name: pa.array(np.concatenate(f) if f else empty, pa.int64()) for name, f in zip(("query_id", "vec_id", "score"), found, strict=True)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, room: int = 1 << 25, step: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score of rows (id, v array<double> of whole numbers)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    good = good.select("id", "v").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    counts = good.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max("dim").alias("d")).first()
    fit = max(1, room // (8 * max(counts["d"] or 1, 1)))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    groups = max(1, math.ceil(counts["n"] / fit))
    # More groups of queries than memory asks for, as long as there are fewer cells than partitions.
    asked_groups = max(1, math.ceil(counts["q"] / fit), min(math.ceil(parts / groups), math.ceil(counts["q"] / 64)))

    def cells(df: DataFrame, name: str, n: int, other: str, others: int) -> DataFrame:
        df = df.withColumn(name, F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(n)).cast("int"))
        # An explicit number of partitions: a cell is few bytes but much arithmetic, so tasks must not be coalesced by bytes.
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(parts, "dim", "c", "a").groupBy("dim", "c", "a")

    candidates, asked = cells(good, "c", groups, "a", asked_groups), cells(good.filter(is_query), "a", asked_groups, "c", groups)
    found = candidates.cogroup(asked).applyInArrow(_meet(k, step), "query_id long, vec_id long, score long")
    # The rank limit is also applied before the shuffle, so each task sends k rows for a query at most.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for each vec_id divisible by 20."""
    usable = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.transform("embedding", lambda x: F.when(usable(x), F.floor(x.cast("double") * 64).cast("double")))
    return top_k(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v")), F.col("id") % 20 == 0, 20)
