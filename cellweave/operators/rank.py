"""Nearest vectors, score filters and rank fusion. Distances are computed in double precision by built-in functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.text import unpack_vector

METRICS = ("cosine", "dot", "l2")


def similarity(a: Column, c: Column, metric: str = "cosine") -> Column:
    """Cosine, dot product, or minus the squared distance; a zero vector has cosine 0."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    product = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    if metric == "dot":
        return total(product(a, c))
    if metric == "l2":
        return -total(F.zip_with(a, c, lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)))
    if metric != "cosine":
        raise ValueError(f"unknown metric: {metric!r}")
    norms = F.sqrt(total(product(a, a))) * F.sqrt(total(product(c, c)))
    return F.when(norms > 0, total(product(a, c)) / norms).otherwise(0.0)


def knn(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", least: float | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest rows: score descending, then key; vectors of another dimension are left out."""
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.filter(F.size(vector) == len(query)).withColumn("score", similarity(F.col(vector), target, metric))
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored.orderBy(F.col("score").desc(), F.col(key)).limit(k)


def grid(left: DataFrame, right: DataFrame, sizes: tuple[int, int], fit: int, parts: int, keys: tuple[str, str] = ("id", "query_id")):
    """Rows of both sides grouped into the cells of a grid, each side in groups of about ``fit`` rows; a row is shipped once for each group of the other side."""
    groups = max(1, math.ceil(sizes[0] / fit))
    others = max(1, math.ceil(sizes[1] / fit), min(math.ceil(parts / groups), math.ceil(sizes[1] / 64)))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int):
        df = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(parts, "__x", "__y").groupBy("__x", "__y")

    return dealt(left, keys[0], "__x", groups, "__y", others), dealt(right, keys[1], "__y", others, "__x", groups)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", room: int = 1 << 24) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest rows (id, vector) of each query (query_id, vector), all rows compared.

    Blocks of queries meet blocks of rows in Arrow tasks; what comes within rounding of a block's k best is
    scored again by similarity(). Scores are rounded to nine places, equal ones ordered by id. Rows and queries of
    different dimensions don't meet.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric!r}")
    vectors, queries = (df.filter("vector is not null and size(vector) > 0").withColumn("vector", F.col("vector").cast("array<double>")) for df in (vectors.select("id", "vector"), queries.select("query_id", "vector")))
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    sizes = (counts["n"], queries.count())
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], []]
        for dim in sorted(set(map(len, asked["vector"])) & set(map(len, rows["vector"]))):
            mine, theirs = rows[rows["vector"].map(len) == dim], asked[asked["vector"].map(len) == dim]
            x, q = np.stack(mine["vector"].to_numpy()), np.stack(theirs["vector"].to_numpy())
            unit = lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
            if metric == "cosine":
                x, q = unit(x), unit(q)
            ids, step = mine["id"].to_numpy(), max(1, (1 << 21) // len(x))
            for i in range(0, len(q), step):
                score = q[i : i + step] @ x.T
                if metric == "l2":
                    score = 2 * score - (x**2).sum(1)[None] - (q[i : i + step] ** 2).sum(1)[:, None]
                for s, name in zip(score, theirs["query_id"].to_numpy()[i : i + step], strict=True):
                    least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                    hit = np.flatnonzero(s >= least - 1e-9 * max(1.0, abs(least))) if np.isfinite(least) else np.arange(len(s))
                    out[0].append(np.full(len(hit), name))
                    out[1].append(ids[hit])
                    out[2].append(s[hit])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in zip(("query_id", "id", "score"), out, strict=True)})

    left, right = grid(vectors, queries, sizes, max(1, room // (8 * (counts["d"] or 1))), parts)
    id_kind, query_kind = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]
    found = left.cogroup(right).applyInPandas(meet, f"query_id {query_kind}, id {id_kind}, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    found = found.withColumn("__n", F.row_number().over(by_score))
    least = F.max(F.when(F.col("__n") == k, F.col("score"))).over(Window.partitionBy("query_id"))
    found = found.withColumn("__least", least).filter(F.col("__least").isNull() | (F.col("score") >= F.col("__least") - 1e-9 * F.greatest(F.lit(1.0), F.abs("__least"))))
    found = found.select("query_id", "id").join(vectors, "id").join(queries.withColumnRenamed("vector", "__q"), "query_id")
    found = found.select("query_id", "id", F.round(similarity(F.col("vector"), F.col("__q"), metric), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def hydrate(hits: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Hits (at most k) with the other columns of their rows."""
    return rows.join(F.broadcast(hits), key)


def time_decay(df: DataFrame, anchor_ms: int, half_life_ms: int, k: int = 10, ts: str = "timestamp", key: str = "id") -> DataFrame:
    """Top k by exp(-ln 2 * age / half life); the future scores 1."""
    age = F.greatest(F.lit(int(anchor_ms)) - F.col(ts), F.lit(0))
    return df.withColumn("score", F.exp(-math.log(2) * age / F.lit(float(half_life_ms)))).orderBy(F.col("score").desc(), key).limit(k)


def linear(df: DataFrame, factor: float = 1.0, k: int = 10, value: str = "value", key: str = "id") -> DataFrame:
    """Top k by a multiple of a number, or of the big-endian float that a binary value starts with; shorter values are left out."""
    if dict(df.dtypes)[value] == "binary":
        df = df.filter(F.octet_length(value) >= 4).withColumn(value, F.get(unpack_vector(F.substring(value, 1, 4)), F.lit(0)))
    return df.withColumn("score", F.lit(float(factor)) * F.col(value)).orderBy(F.col("score").desc(), key).limit(k)


def fuse(ranked: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal ranks of lists (id, rank) summed; a repeated id counts once, at its best rank."""
    every = None
    for one in ranked:
        one = one.groupBy("id").agg(F.min("rank").alias("rank"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def ranks(df: DataFrame, *order: Column, limit: int) -> DataFrame:
    """(id, rank) of the first ``limit`` rows; the window sees these rows only."""
    first = df.orderBy(*order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order))).select("id", "rank")
