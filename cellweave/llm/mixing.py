"""Operator 7: mix sources to target weights by capped water-filling.

Each source's target is its weighted share of the total; a source is clamped at ``epochs`` times its
own size and the excess goes to the others by weight, until none is above. With sources ordered by
cap per weight the clamped ones are a prefix, so the fixed point of those rounds is one pass of prefix
sums over the source table (one row for each source; documents are never gathered).

A document is taken floor(e) times, e being target over source size; the fractional repetition goes to
documents in the order of a seeded hash until the source's target is met, counted in ``bins`` hash
ranges so that a hot source is spread over tasks. Further passes fill what the document at the
boundary was too long for. What is still missing is exchanged at last: a few documents of each source,
half of them its longest, half the first ones by hash, get the repetitions, 0 to ``epochs`` each,
that bring the source within ``near`` of its target with the fewest changes, or as close as they can.
All sums of one half of these documents meet all sums of the other half, so the work for a source is
bounded. Only narrow rows (no texts) are shuffled, dealt by source and bin.

Null sources form one source, ordered last; null and empty texts have size 0 and are taken floor(e)
times; equal documents tie and are interchangeable; an empty table gives an empty result. Text lengths
do not matter here; columns ``source_size``, ``target`` and ``times`` of the input are replaced. The source
table (one row for each source) is ordered in one task, as weights go by a source's place among all.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import n_words, saved, table


def water_fill(sources: DataFrame, epochs: float = 3.0, total: Column | None = None) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight)."""
    everything = Window.partitionBy()
    by_cap = Window.partitionBy().orderBy(F.col("__cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("__cap", F.col("source_size") * F.lit(float(epochs)))
    df = df.withColumns({"__total": (total if total is not None else F.sum("source_size").over(everything)).cast("double"), "__weights": F.sum("weight").over(everything)})
    df = df.withColumns({"__full": F.coalesce(F.sum("__cap").over(by_cap), F.lit(0.0)), "__used": F.coalesce(F.sum("weight").over(by_cap), F.lit(0))})
    # The level is what one unit of weight gets once all sources with a lower cap per weight are clamped.
    level = (F.col("__total") - F.col("__full")) / (F.col("__weights") - F.col("__used"))
    # It rises up to the first source that need not be clamped, and falls behind it.
    df = df.withColumn("__level", F.max(F.when(level * F.col("weight") <= F.col("__cap"), level)).over(everything))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("weight"), F.col("__cap")))
    return df.withColumn("target", target).select(*sources.columns, "target")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: float = 3.0) -> DataFrame:
    """One row for each source of (source, size) rows: source_size, weight (repeating by code point, null last) and target."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return water_fill(sources.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int"))), epochs)


def settled(sizes: np.ndarray, times: np.ndarray, left: float, most: int, tolerance: float) -> np.ndarray:
    """Repetitions, 0 to ``most``, of a few documents that change their words by ``left``: within the tolerance with the fewest changes, else as near as can be."""

    def combined(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, changes = np.zeros(1), np.zeros(1, dtype=np.int64)
        for i in at:
            n = np.arange(most + 1)
            total = (total[:, None] + sizes[i] * n).ravel()
            changes = (changes[:, None] + np.abs(n - times[i])).ravel()
        return total, changes

    halves = [np.arange(j, sizes.size, 2) for j in range(2)]
    (first, moved), (second, moved_too) = (combined(h) for h in halves)
    rest = left + float((sizes * times).sum()) - first
    best = None
    for level in np.unique(moved_too):
        group = np.flatnonzero(moved_too == level)
        group = group[np.argsort(second[group], kind="stable")]
        sums = second[group]
        at = np.searchsorted(sums, rest)
        for near in (np.clip(at, 0, sums.size - 1), np.clip(at - 1, 0, sums.size - 1)):
            gap = np.abs(rest - sums[near])
            cost = np.where(gap <= tolerance, moved + level, np.iinfo(np.int64).max)
            i = np.lexsort((gap, cost))[0]
            if best is None or (cost[i], gap[i]) < best[0]:
                best = (cost[i], gap[i]), i, group[near[i]]
    out = np.zeros(sizes.size, dtype=np.int64)
    for half, code in zip(halves, best[1:], strict=True):
        for i in half[::-1]:
            code, out[i] = divmod(code, most + 1)
    return out


def repetitions(sized: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), epochs: float = 3.0, seed: int = 42, bins: int = 1024, passes: int = 2, near: float = 5e-4) -> DataFrame:
    """Adds source_size, target and ``times`` to rows (key, source, size, ...), which should be a written table."""
    sized = sized.drop("source_size", "target", "times")
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    targets = source_targets(sized, weights, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("long")
    targets = saved(targets.select(name.alias("__source"), "source_size", "target", whole.alias("__whole"), (F.col("target") - whole * F.col("source_size")).alias("__need")), "targets")
    drawn = F.xxhash64(F.lit(seed), F.col(key), F.col("size"))
    df = sized.withColumns({"__source": name, "__draw": drawn, "__bin": F.pmod(F.shiftright(drawn, 20), F.lit(bins)).cast("int"), "__extra": F.lit(False), "__no": F.monotonically_increasing_id()})
    cell = ["__source", "__bin"]

    def told(df: DataFrame, rows: DataFrame) -> DataFrame:
        """Rows with the columns of their source: a source meets them once a bin, so no task holds a hot source."""
        return df.join(df.select(*cell).distinct().join(rows, "__source"), cell)

    need = targets.select("__source", "__need")
    bins_ahead = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*cell).orderBy("__draw", "__no").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(passes):
        # Documents in the order of their draw, as long as they end within the need. The next pass fills
        # what the first one too long has left, with documents that are no longer than that.
        fits = ~F.col("__extra") & (F.col("size") > 0) & (F.col("size") <= F.col("__need"))
        now = told(df, need).withColumn("__mine", F.when(fits, F.col("size")).otherwise(F.lit(0)))
        parts = now.groupBy(*cell).agg(F.sum("__mine").alias("__sum"))
        parts = parts.select(*cell, F.coalesce(F.sum("__sum").over(bins_ahead), F.lit(0)).alias("__ahead"))
        now = now.withColumn("__before", F.coalesce(F.sum("__mine").over(ahead), F.lit(0))).join(parts, cell)
        new = fits & (F.col("__ahead") + F.col("__before") + F.col("size") <= F.col("__need"))
        now = now.withColumn("__new", F.when(new, F.col("size")).otherwise(F.lit(0))).withColumn("__extra", F.col("__extra") | new)
        now = saved(now.drop("__need", "__mine", "__before", "__ahead"), "mixed")
        got = now.groupBy("__source").agg(F.sum("__new").alias("__got"))
        need = need.join(got, "__source").select("__source", (F.col("__need") - F.col("__got")).alias("__need"))
        df = now.drop("__new")
    # The exchange: a half's sums are 2^16 at most, whatever the number of documents.
    most = int(epochs)
    half = max(1, int(16 / math.log2(most + 1)))
    some = df.filter("size > 0").select("__source", "__no", "__draw", "size", "__extra")
    chosen = [some.withColumn("__i", F.row_number().over(Window.partitionBy("__source").orderBy(*order))).filter(F.col("__i") <= half) for order in ([F.col("size").desc(), "__draw", "__no"], ["__draw", "__no"])]
    chosen = chosen[0].union(chosen[1]).drop("__i").distinct().join(need, "__source").join(targets.drop("__need"), "__source")

    def exchanged(rows):
        import pyarrow as pa

        rows = rows.sort_by([("__draw", "ascending"), ("__no", "ascending")])
        column = lambda name: rows[name].to_numpy()
        old = column("__whole") + column("__extra").astype(np.int64)
        new = settled(column("size").astype(np.float64), old, float(column("__need")[0]), most, max(0.5, near * float(column("target")[0])))
        return pa.table({"__no": rows["__no"], "__times": new})

    changed = chosen.groupBy("__source").applyInArrow(exchanged, "__no long, __times long")
    df = told(df, targets.drop("__need")).join(changed, "__no", "left")
    times = F.coalesce("__times", F.col("__whole") + F.col("__extra").cast("long"))
    return df.withColumn("times", times).drop(*cell, "__draw", "__extra", "__no", "__whole", "__times")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 by source, 100 % of all words, three epochs at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return repetitions(saved(docs, "sized")).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("times") * F.col("size")).cast("long").alias("taken"))
