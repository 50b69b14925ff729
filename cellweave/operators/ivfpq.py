"""Approximate nearest vectors: inverted lists of product codes, kept as Parquet.

Centroids and codebooks are fitted on a bounded sample (``sample`` vectors by a seeded hash of their id), so
their size does not depend on the data; every vector is assigned and encoded in Arrow tasks. An index is a
folder: ``model`` (one row), ``postings`` partitioned by generation and cluster, and ``manifest`` by generation.
A generation counts once its manifest is there, which is written last and never over another one.

Rows are (id, vector) and may have label, timestamp and tombstone. A search sees the newest posting of each
id among those that its time and authorizations allow; a tombstone hides the id and wins ties.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators.rank import similarity
from cellweave.operators.visibility import visible

POSTING = "id, cluster, code, label, timestamp, tombstone"


class Stale(ValueError):
    """The index is older than a search asks for."""


# -- the model ------------------------------------------------------------------------------------


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the rows' own squares, which don't change the nearest."""
    return (centres**2).sum(1)[None] - 2 * (x @ centres.T)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    """Lloyd's rounds from seeds drawn far from each other; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        total = gap.sum()
        chosen.append(int(rng.choice(len(x), p=gap / total)) if total > 0 else len(chosen))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    centres = x[chosen].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1) if spherical else _distances(x, centres).argmin(1)
        for c in range(len(centres)):
            mine = x[near == c]
            if len(mine):
                m = mine.mean(0)
                centres[c] = m / (np.linalg.norm(m) or 1) if spherical else m
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with all columns; without null, empty or non-finite vectors."""
    kinds = {"label": ("string", ""), "timestamp": ("long", 0), "tombstone": ("boolean", False)}
    out = vectors
    for name, (kind, value) in kinds.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value).cast(kind))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.filter(F.col("tombstone") | (F.col("vector").isNotNull() & (F.size("vector") > 0) & whole))


def train(vectors: DataFrame, lists: int | None = None, subspaces: int = 1, codes: int | None = None, rounds: int = 25, sample: int = 4096, seed: int = 1) -> dict:
    """Centroids and codebooks from a sample of rows (id, vector): min(64, n) lists and min(256, n) codes unless told."""
    drawn = vectors.orderBy(F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), F.col("id").cast("string")), 256)).limit(sample)
    rows = sorted((str(r["id"]), r["vector"]) for r in drawn.select("id", "vector").collect())  # ``sample`` rows at most
    if not rows:
        raise ValueError("no vectors to fit an index on")
    x = _unit(np.array([v for _, v in rows], dtype=np.float64))
    lists, codes = lists or min(64, len(x)), codes or min(256, len(x))
    parts = np.array_split(np.arange(x.shape[1]), subspaces)
    told = json.dumps([lists, subspaces, codes, rounds, seed, [i for i, _ in rows]]).encode() + x.tobytes()
    return {
        "dims": x.shape[1], "version": hashlib.sha256(told).hexdigest()[:16], "centroids": _kmeans(x, lists, rounds, seed, True), "parts": parts,
        "books": [_kmeans(x[:, p], codes, rounds, seed + i, False) for i, p in enumerate(parts)],
    }


def encode(vectors: DataFrame, model: dict) -> DataFrame:
    """Postings (id, cluster, code, label, timestamp, tombstone) of all rows; a tombstone has no code and cluster 0."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = held.value
        for f in frames:
            for i in range(0, len(f), 1024):
                part = f.iloc[i : i + 1024]
                live = (~part["tombstone"].astype(bool)).to_numpy()
                if any(len(v) != m["dims"] for v in part["vector"][live]):
                    raise ValueError(f"vectors of another dimension than {m['dims']}")
                cluster, code = np.zeros(len(part), dtype="int32"), np.full(len(part), None, dtype=object)
                if live.any():
                    x = _unit(np.stack(part["vector"][live].to_numpy()).astype(np.float64))
                    near = np.stack([_distances(x[:, p], b).argmin(1) for p, b in zip(m["parts"], m["books"], strict=True)], 1).astype("uint8")
                    cluster[live], code[live] = (x @ m["centroids"].T).argmax(1), [bytes(c) for c in near]
                yield pd.DataFrame({"id": part["id"], "cluster": cluster, "code": code, "label": part["label"], "timestamp": part["timestamp"], "tombstone": part["tombstone"]})

    rows = _usable(vectors).select("id", "vector", "label", F.col("timestamp").cast("long"), "tombstone")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, cluster int, code binary, label string, timestamp long, tombstone boolean")


# -- the folder -----------------------------------------------------------------------------------


def _publish(spark: SparkSession, path: str, manifest: dict) -> dict:
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest/generation={manifest['generation']}")
    return manifest


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """All generations' manifests in order; one short text each."""
    return sorted((json.loads(r["value"]) for r in spark.read.text(f"{path}/manifest").select("value").collect()), key=lambda m: m["generation"])


def active(spark: SparkSession, path: str) -> dict:
    return manifests(spark, path)[-1]


def _model(spark: SparkSession, path: str, manifest: dict) -> dict:
    row = spark.read.parquet(f"{path}/model").filter(F.col("version") == manifest["version"]).first()
    plain = json.loads(row["model"])
    return plain | {"centroids": np.array(plain["centroids"]), "parts": [np.array(p) for p in plain["parts"]], "books": [np.array(b) for b in plain["books"]]}


def _write(postings: DataFrame, path: str, generation: int) -> None:
    postings.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/postings/generation={generation}")


def _counted(spark: SparkSession, path: str, generations: list[int]) -> dict:
    """Postings by cluster, and how many are tombstones; one row for each list."""
    rows = _postings(spark, path, generations).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("tombstone").alias("dead")).collect()
    return {"records": sum(r["n"] for r in rows), "tombstones": sum(r["dead"] for r in rows), "clusters": {str(r["cluster"]): r["n"] for r in rows}}


def _postings(spark: SparkSession, path: str, generations: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/postings").filter(F.col("generation").isin(generations))


def build(vectors: DataFrame, path: str, watermark: int = 0, created: int = 0, **options) -> dict:
    """A new base generation, fitted and encoded; over an index that is there already, with its lineage."""
    spark = vectors.sparkSession
    try:
        before = active(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        before = None
    live = _usable(vectors).filter("not tombstone")
    model = train(live, **options)
    number = before["generation"] + 1 if before else 1
    plain = model | {"centroids": model["centroids"].tolist(), "parts": [p.tolist() for p in model["parts"]], "books": [b.tolist() for b in model["books"]]}
    spark.createDataFrame([(model["version"], json.dumps(plain))], "version string, model string").write.mode("append").parquet(f"{path}/model")
    _write(encode(live, model), path, number)
    counted = _counted(spark, path, [number])
    alone = live.select("id").distinct().count() == counted["records"]
    return _publish(spark, path, {
        "generation": number, "lineage": [*before["lineage"], before["generation"]] if before else [], "generations": [number], "version": model["version"], "dims": model["dims"], "lists": len(model["centroids"]),
        "indexed": watermark, "source": watermark, "created": created, "newest_only": alone, "recall": None, **counted,
    })


def update(changes: DataFrame, path: str, watermark: int, created: int = 0) -> dict:
    """A generation of changed rows and tombstones, encoded by the model in use."""
    spark = changes.sparkSession
    before = active(spark, path)
    number = before["generation"] + 1
    _write(encode(changes, _model(spark, path, before)), path, number)
    generations = [*before["generations"], number]
    return _publish(spark, path, before | {"generation": number, "lineage": [*before["lineage"], before["generation"]], "generations": generations, "indexed": watermark, "source": watermark, "created": created, "newest_only": False, **_counted(spark, path, generations)})


def compact(spark: SparkSession, path: str, before_ts: int, created: int = 0) -> dict:
    """One generation of everything from ``before_ts`` on, and of what is older the newest of each id and label, without tombstones."""
    before = active(spark, path)
    every = _postings(spark, path, before["generations"]).selectExpr(*POSTING.split(", "))
    newest = Window.partitionBy("id", "label", F.col("timestamp") >= before_ts).orderBy(F.col("timestamp").desc(), F.col("tombstone").desc(), "cluster", "code")
    kept = every.withColumn("__n", F.row_number().over(newest)).filter((F.col("timestamp") >= before_ts) | ((F.col("__n") == 1) & ~F.col("tombstone"))).drop("__n")
    number = before["generation"] + 1
    _write(kept, path, number)
    alone = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty() and kept.filter("tombstone").isEmpty()
    return _publish(spark, path, before | {"generation": number, "lineage": [*before["lineage"], before["generation"]], "generations": [number], "created": created, "newest_only": alone, **_counted(spark, path, [number])})


def with_recall(spark: SparkSession, path: str, k: int, measured: float, least: float, corpus: str) -> dict:
    """A generation that claims a recall, which has to be measured and to reach what it promises."""
    if not corpus or not 0 < least <= measured <= 1:
        raise ValueError("a recall is claimed with the corpus it was measured on, and not below its minimum")
    before = active(spark, path)
    return _publish(spark, path, before | {"generation": before["generation"] + 1, "lineage": [*before["lineage"], before["generation"]], "recall": {"k": k, "measured": measured, "least": least, "corpus": corpus}})


# -- search ---------------------------------------------------------------------------------------


def stale(manifest: dict, generation: int = 0, indexed: int = 0, source: int = 0, lag: int = -1) -> str:
    """Why an index is too old for what is asked, or nothing."""
    if generation > 0 and manifest["generation"] < generation:
        return f"generation {manifest['generation']} is older than {generation}"
    if indexed > 0 and manifest["indexed"] < indexed:
        return f"indexed up to {manifest['indexed']}, not {indexed}"
    if source > 0 and lag >= 0 and source - manifest["indexed"] > lag:
        return f"{source - manifest['indexed']} behind the source, more than {lag}"
    return ""


def newest(postings: DataFrame) -> DataFrame:
    """The posting of each id that a search sees; a tombstone hides the id."""
    latest = postings.groupBy("id").agg(F.max_by(F.struct("cluster", "code", "tombstone"), F.struct("timestamp", "tombstone", "generation", "code")).alias("p"))
    return latest.select("id", "p.*").filter("not tombstone")


def search(
    queries: DataFrame, path: str, k: int = 10, probes: int = 8, auths: list[str] | None = None, as_of: int | None = None, allowed: DataFrame | None = None,
    vectors: DataFrame | None = None, more: int = 20, freshness: dict | None = None, exact: bool = False, fit: int = 1 << 16,
) -> DataFrame:
    """(query_id, rank, id, score) for queries (query_id, vector): approximate cosine, best first, ties by id.

    With ``vectors`` (id, vector) the best ``k * more`` of a query are scored again on whole vectors. ``allowed`` (id)
    restricts what is scored. An index too old for ``freshness`` is an error, or with ``exact`` and ``vectors`` all
    of these are compared instead. Lists are split by a hash of the id and met by blocks of queries.
    """
    spark = queries.sparkSession
    manifest = active(spark, path)
    if reason := stale(manifest, **(freshness or {})):
        if not (exact and vectors is not None):
            raise Stale(reason)
        from cellweave.operators.rank import nearest

        return nearest(vectors, queries, k)
    model = _model(spark, path, manifest)
    held = spark.sparkContext.broadcast(model)
    every = _postings(spark, path, manifest["generations"])
    if as_of is not None:
        every = every.filter(F.col("timestamp") <= as_of)
    if auths is not None:
        every = visible(every.withColumn("cv", F.col("label").cast("binary")), auths).drop("cv")
    seen = every.filter("not tombstone").select("id", "cluster", "code") if manifest["newest_only"] else newest(every).select("id", "cluster", "code")
    if allowed is not None:
        seen = seen.join(allowed.select("id").distinct(), "id", "left_semi")
    probes = min(probes or 8, manifest["lists"])

    @F.pandas_udf("array<int>")
    def probed(v: pd.Series) -> pd.Series:
        score = _unit(np.stack(v.to_numpy()).astype(np.float64)) @ held.value["centroids"].T
        return pd.Series(np.argsort(-score, axis=1, kind="stable")[:, :probes].tolist())

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    asked = queries.filter(F.size("vector") == manifest["dims"]).select("query_id", "vector")
    # Lists and the queries of a list in groups of bounded size: counts by list are in the manifest.
    pieces = F.create_map(*[F.lit(x) for c, n in manifest["clusters"].items() for x in (int(c), math.ceil(n / fit))])
    blocks = max(1, math.ceil(asked.count() * probes / manifest["lists"] / 4096))
    asked = asked.withColumn("cluster", F.explode(probed("vector"))).withColumn("__q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("__p", F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(pieces, F.col("cluster")), F.lit(1)) - 1)))
    seen = seen.withColumn("__p", F.pmod(F.xxhash64("id"), F.coalesce(F.element_at(pieces, F.col("cluster")), F.lit(1))).cast("int")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys, wanted = ["cluster", "__p", "__q"], k * more if vectors is not None else k

    def meet(some: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], []]
        if len(some) and len(mine):
            m, ids = held.value, some["id"].to_numpy()
            code = np.frombuffer(b"".join(some["code"]), dtype=np.uint8).reshape(len(some), -1)
            for name, q in zip(mine["query_id"], _unit(np.stack(mine["vector"].to_numpy()).astype(np.float64)), strict=True):
                score = sum((b @ q[p])[code[:, i]] for i, (p, b) in enumerate(zip(m["parts"], m["books"], strict=True)))
                best = np.lexsort((ids, -score))[:wanted]
                out[0].append(np.full(len(best), name))
                out[1].append(ids[best])
                out[2].append(score[best])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in zip(("query_id", "id", "score"), out, strict=True)})

    kinds = f"query_id {dict(asked.dtypes)['query_id']}, id {dict(seen.dtypes)['id']}, score double"
    hits = seen.repartition(parts, *keys).groupBy(*keys).cogroup(asked.repartition(parts, *keys).groupBy(*keys)).applyInPandas(meet, kinds)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    hits = hits.withColumn("rank", place).filter(F.col("rank") <= wanted)
    if vectors is not None:
        again = hits.select("query_id", "id").join(vectors.select("id", F.col("vector").alias("__v")), "id").join(queries.select("query_id", "vector"), "query_id")
        again = again.select("query_id", "id", similarity(F.col("__v"), F.col("vector")).alias("score"))
        hits = again.withColumn("rank", place).filter(F.col("rank") <= k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def evidence(manifest: dict, probes: int, freshness: dict | None = None) -> str:
    """What a search rests on, in a line; a recall only if one was measured."""
    claim = manifest["recall"]
    told = f"recall@{claim['k']}={claim['measured']:.4f} measured on {claim['corpus']}" if claim else "no recall claimed"
    return f"generation {manifest['generation']}, model {manifest['version']}, indexed to {manifest['indexed']} of {manifest['source']}, {min(probes, manifest['lists'])} of {manifest['lists']} lists, {manifest['records']} postings, {told}, {stale(manifest, **(freshness or {})) or 'fresh'}"


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact hits (query_id, id) that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def previous(df: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """Adds the column's value in the row before, for chains of events."""
    return df.withColumn("previous", F.lag(column).over(Window.partitionBy(by).orderBy(*order)))
