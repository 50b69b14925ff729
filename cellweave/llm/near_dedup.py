"""Operator 1: near-duplicate documents by b-bit MinHash, links confirmed on full shingle sets.

1. Texts with an equal shingle set form one class; only classes are compared.
2. Each class has 512 minima. Bands of consecutive minima give bucket keys; of each minimum one bit is
   kept, 512 bits packed in eight longs. Two sets agree in a bit with probability (1 + s) / 2, so the
   likeness is estimated as 2 * matches / 512 - 1, corrected for the chance collisions. The
   number of rows in a band is the largest with which a pair at the threshold is missed by all bands
   with a probability below ``miss``.
3. A bucket gives a star: every member paired with the member that has the fewest shingles of its own.
   Pairs far below the threshold by their bits go; the rest is confirmed on full sets, the best pair
   of a class first, and the other ones only where they still join two components.
4. Members of a bucket that are still in different components are compared by size and bits. Of classes in
   large buckets the rare shingles are counted, and all pairs of such classes that share one are listed.
   Two such classes that share none share at most what is left of each; so one whose other shingles are
   too few for a link leaves its large buckets before these are paired, and the rest is held to that
   bound. A class in no large bucket has no such bound. What remains is confirmed like the others. So each pair
   that shares a bucket is confirmed, ruled out or already joined; none is capped.

Buckets are found in a sorted stream, which holds one entry, whatever a bucket's size. Only classes
that share a bucket have their sets written. Component labels are contracted on written tables.

Only ``text`` and ``doc_id`` of the input are read, so further columns of any name do no harm. Texts may be of
any length: hashing goes in slices of 2 MB, and a batch is given out whenever its sets pass 32 MB.
Null and word-less texts have an empty set and are linked with nothing. Rows with a null doc_id have
a null component and are kept, as no one can name them. Repeated rows are in one class; a doc_id with
several texts gets a row for each. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import grams, lowered, mix, saved, shared_keys, slices, small_batches, span_hashes, table, utf8, words
from cellweave.llm.components import connected, merged, rooted

MINIMA = 512
#: A bucket of so many classes is large; a shingle of so few classes of large buckets is rare.
LARGE, RARE = 24, 8
LONGS = MINIMA // 64
_MULTIPLIERS = (mix(np.arange(1001, 1001 + MINIMA, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MIX = mix(np.arange(5001, 5001 + MINIMA, dtype=np.uint64)) | np.uint64(1)


def band_rows(threshold: float, miss: float = 1e-7) -> int:
    """The largest number of minima in a band with which a pair at ``threshold`` is missed less often than ``miss``."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (MINIMA // r) < miss)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for first, last in slices(offsets):
        base = offsets[first]
        part = lowered(data[base : offsets[last]])
        start, end, index = words(part, offsets[first : last + 1] - base)
        hashes = span_hashes(part, start, end)
        runs = grams(hashes, k)
        for i in range(last - first):
            a, b = index[i], index[i + 1]
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield grams(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)


def _class(hashes: np.ndarray) -> int:
    """A 64-bit id of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _minima(hashes: np.ndarray) -> np.ndarray:
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, values.size, 512):
        np.minimum(out, (_MULTIPLIERS[:, None] * values[None, i : i + 512]).min(1), out=out)
    return out


def _signed(k: int, rows: int):
    bands = MINIMA // rows
    salts = mix(np.arange(9001, 9001 + bands, dtype=np.uint64))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n, ids, minima = [], [], []
            for s in _sets(data, offsets, k):
                n.append(s.size)
                ids.append(_class(s) if s.size else 0)
                minima.append(_minima(s))
            m = np.array(minima, dtype=np.uint32).reshape(len(n), MINIMA)
            bits = ((m * np.uint32(0x9E3779B1)) ^ (m >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(31)
            packed = np.packbits(bits.astype(np.uint8), axis=1).view("<i8")
            weighed = m[:, : bands * rows].astype(np.uint64).reshape(len(n), bands, rows) * _MIX[None, None, :rows]
            keys = mix(weighed.sum(2, dtype=np.uint64) ^ salts[None, :]).view(np.int64)
            full = np.array(n) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(ids, dtype=np.int64), mask=~full), lists, *[pa.array(np.ascontiguousarray(packed[:, j])) for j in range(LONGS)]],
                names=["doc_id", "n_shingles", "class", "bands", *[f"s{j}" for j in range(LONGS)]],
            )

    return run


def _shingles(k: int, most: int = 1 << 22):
    """(doc_id, class, set) rows, to write the sets of the classes that need them; batches of about ``most`` hashes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            first, held, size = 0, [], 0
            for i, one in enumerate(_sets(data, offsets, k)):
                held.append(one)
                size += one.size
                if size > most or i == batch.num_rows - 1:
                    ids = [_class(x) if x.size else None for x in held]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), pa.array(ids, pa.int64()), lists], names=["doc_id", "class", "shingles"])
                    first, held, size = i + 1, [], 0

    return run


def _matches(a: str, b: str) -> Column:
    """Agreeing bits of two packed signatures."""
    return sum((F.bit_count(F.col(f"{a}{j}").bitwiseXOR(F.col(f"{b}{j}"))) for j in range(LONGS)), F.lit(0)) * F.lit(-1) + F.lit(MINIMA)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, margin: float = 0.14, few: int = 500_000, column: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for rows of (key, column): links where den * shared >= num * union of k-word shingles."""
    small_batches(docs.sparkSession)
    threshold = num / den
    need = math.floor(MINIMA * (1 + threshold - margin) / 2)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text"))
    sig = [f"s{j}" for j in range(LONGS)]
    kinds = "doc_id long, n_shingles long, class long, bands array<long>, " + ", ".join(f"{s} long" for s in sig)
    signed = saved(texts.mapInArrow(_signed(k, band_rows(threshold)), kinds), "signed")
    named = signed.filter("class is not null and doc_id is not null")
    # The smallest doc_id of a class stands for it; of equal rows any, as all hold the same.
    heads = named.groupBy("class").agg(F.min("doc_id").alias("head"), F.min("n_shingles").alias("n"))
    classes = named.join(heads.select("class", F.col("head").alias("doc_id"), "n"), ["class", "doc_id"]).select("class", F.col("doc_id").alias("head"), "n", "bands", *sig)

    rows = classes.select(F.explode("bands").alias("key"), "class")
    rows = rows.repartition("key").sortWithinPartitions("key", "class").mapInArrow(shared_keys, "key long, class long")
    members = saved(rows, "members")
    candidates = members.select("class").distinct()
    found = classes.drop("bands").join(candidates, "class", "left_semi").dropDuplicates(["class"])
    traits = saved(found, "traits")
    # The candidates' ids go to all tasks while they are few, so that no texts are shuffled; else both sides are.
    wanted = traits.select(F.col("head").alias("doc_id")).distinct()
    if traits.count() <= few:
        wanted = F.broadcast(wanted)
    picked = texts.join(wanted, "doc_id", "left_semi")
    sets = picked.select("doc_id", "text").mapInArrow(_shingles(k), "doc_id long, class long, shingles array<long>")
    sets = sets.join(traits.select("class"), "class", "left_semi").dropDuplicates(["class"]).select("class", "shingles")
    sets = saved(sets, "sets")

    # Large buckets: shingles that at most RARE of their classes have. Two classes which share none of them
    # share no more than their other shingles; the pairs which do share one are few and listed.
    large = saved(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LARGE).select("key"), "large")
    within = saved(members.join(large, "key", "left_semi").select("class").distinct(), "within")
    exploded = sets.join(within, "class", "left_semi").select("class", F.explode("shingles").alias("h"))
    counts = exploded.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= RARE)
    rare = saved(exploded.join(counts, "h"), "rare")
    both_rare = rare.filter("c > 1").select("h", F.col("class").alias("a")).join(rare.filter("c > 1").select("h", F.col("class").alias("b")), "h").filter("a < b")
    both_rare = saved(both_rare.select("a", "b").distinct(), "both-rare")
    own = rare.groupBy("class").agg(F.count(F.lit(1)).alias("own"))
    # ``own`` is null for a class in no large bucket: of its shingles nothing is known to be rare.
    counted = within.withColumn("within", F.lit(True)).join(own, "class", "left").select("class", F.coalesce("own", F.lit(0)).alias("own"))
    traits = saved(traits.join(counted, "class", "left"), "traits")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose full sets are as alike as asked."""
        both = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.withColumn("i", shared).filter(F.col("i") * den >= (F.size("x") + F.size("y") - F.col("i")) * num).select("a", "b")

    def sided(side: str) -> DataFrame:
        return traits.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("own").alias(f"own_{side}"), *[F.col(s).alias(f"{side}{j}") for j, s in enumerate(sig)])

    def alike(most: Column) -> Column:
        """Whether sets that share ``most`` shingles at most can be as alike as asked, by sizes and bits."""
        return (most * den >= (F.col("n_a") + F.col("n_b") - most) * num) & (_matches("a", "b") >= need)

    sized = alike(F.least("n_a", "n_b"))

    centres = members.join(traits.select("class", "own"), "class").groupBy("key").agg(F.min(F.struct(F.coalesce("own", F.lit(0)), "class")).alias("c"))
    stars = members.join(centres, "key").filter(F.col("class") != F.col("c.class")).select(F.col("class").alias("a"), F.col("c.class").alias("b")).distinct()
    stars = stars.join(sided("a"), "a").join(sided("b"), "b").filter(sized).select("a", "b", _matches("a", "b").alias("m"))
    stars = saved(stars, "stars")
    best = saved(stars.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x")).select("a", "x.b"), "best")
    links = saved(confirmed(best), "links")

    every = traits.select(F.col("class").alias("node"))
    roots = saved(rooted(every, "node", connected(links), "root"), "roots")
    rest = rooted(rooted(stars.select("a", "b"), "a", roots, "ra"), "b", roots, "rb").filter("ra <> rb").join(best, ["a", "b"], "left_anti").select("a", "b")
    roots = merged(roots, saved(confirmed(saved(rest, "rest")), "links"))

    # What is left: pairs in a bucket whose components still differ, other than the stars, which are decided.
    # Every step is written: a single plan of them all has dozens of exchanges, which the driver would run and keep account of at once.
    placed = rooted(members, "class", roots, "root")
    differ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    split = saved(placed.join(differ, "key", "left_semi"), "split")
    # A pair is compared in the first bucket that it shares, whatever the number of these.
    buckets = split.groupBy("class").agg(F.collect_list("key").alias("keys"))
    buckets = saved(traits.join(buckets, "class"), "buckets")
    split = split.join(buckets, "class").join(large.withColumn("large", F.lit(True)), "key", "left")
    # In a large bucket all classes have their rare shingles counted: one that no link can do without these is decided by the list.
    decided = F.col("large").isNotNull() & F.col("own").isNotNull() & ((F.col("n") - F.col("own")) * den < F.col("n") * num)
    split = split.filter(~decided)
    left = split.select("key", F.col("keys").alias("keys_a"), F.col("root").alias("ra"), F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("own_a"), *[F.col(s).alias(f"a{j}") for j, s in enumerate(sig)])
    right = split.select("key", F.col("keys").alias("keys_b"), F.col("root").alias("rb"), F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("own").alias("own_b"), *[F.col(s).alias(f"b{j}") for j, s in enumerate(sig)])
    # A null in either ``own`` makes the bound null, and least() passes it over.
    unshared = alike(F.least("n_a", "n_b", F.least(F.col("n_a") - F.col("own_a") + F.col("own_b") * 0, F.col("n_b") - F.col("own_b") + F.col("own_a") * 0)))
    last = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & unshared & (F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key"))).select("a", "b")
    last = saved(last, "pairs")
    named_rare = rooted(rooted(both_rare, "a", roots, "ra"), "b", roots, "rb").filter("ra <> rb").join(sided("a"), "a").join(sided("b"), "b").filter(sized)
    named_rare = saved(named_rare.select("a", "b"), "pairs")
    last = last.union(named_rare).distinct().join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    roots = merged(roots, saved(confirmed(last), "links"))

    # Components are named after the smallest doc_id in them.
    groups = rooted(heads.select("class", "head"), "class", roots, "root")
    names = groups.groupBy("root").agg(F.min("head").alias("component_id"))
    named_classes = groups.join(names, "root").select("class", "component_id")
    out = signed.select("doc_id", "n_shingles", "class").join(named_classes, "class", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, three-word shingles, likeness of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
