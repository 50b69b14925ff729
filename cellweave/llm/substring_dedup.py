"""Operator 9: passages repeated from earlier documents, by relative Lempel-Ziv parsing against an index of all documents.

Every document is a reference block for those with a larger id. The index samples each block's runs of
``GRAM`` words: of the runs in a window of ``window`` words the one with the smallest hash is an
anchor, so two equal windows always have the same anchor at the same place. Windows whose anchor no
other text has can be no repetition and are never looked up; the others are looked up whole. A hit names
its reference block, the one with the smallest doc_id, and the place there. A factor starts at the first
hit and is extended greedily while the next window is found at the next place of the same block; at its
boundary the next hit begins a factor of its own, in whatever block that is. Windows are equal if two
independent hashes of their words are (64 and 32 bits); this is checked for every window of a factor, so for
those at its boundaries too, instead of shipping each reference text to each document. Factors
are ``window`` words long at least and become the spans to remove.

Texts of equal words are one class, indexed once; its later documents are repetitions as a whole.
Lookups are sorted streams that hold one row, so a passage in very many documents needs no group in
memory. Anchors that a sample of the documents shows to be in very many texts are spread: they count as
shared without a lookup, and their windows are looked up in parts by doc_id. All but the first document of a
part have found a smaller one there; the first documents of a window's parts, PARTS at most, are then
held against their minimum. This changes where rows go, never which windows are found.

Of the input only doc_id and text are read, so further columns of any name do no harm. Texts may be of any length:
hashing goes in slices of 2 MB. Null texts have no words. Documents with a null doc_id are kept whole and are
no reference. Documents with an equal doc_id are no reference for each other. Texts shorter than a window are kept
whole. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import grams, mix, saved, shared_keys, slices, small_batches, span_hashes, table, utf8, words

WINDOW, GRAM, SEED = 13, 6, 9
#: Hot anchors at most, and the parts in which their windows are looked up.
MOST, PARTS = 5000, 64
_OTHER = np.uint64(0x9E3779B97F4A7C15)
#: Copies of a text met again in a task are not indexed again; so many classes are remembered.
REMEMBERED = 200_000
_ROW = 40  # bits of a position; above it, which of several texts with the same doc_id


def _hashed(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of each row."""
    for first, last in slices(offsets):
        base = offsets[first]
        part = data[base : offsets[last]]
        start, end, index = words(part, offsets[first : last + 1] - base)
        hashes = span_hashes(part, start, end)
        for i in range(last - first):
            yield hashes[index[i] : index[i + 1]]


def _class(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of GRAM words, and for each window the position of its anchor."""
    runs = grams(hashes, GRAM)
    width = window - GRAM + 1
    return runs, np.lib.stride_tricks.sliding_window_view(runs, width).argmin(1) + np.arange(runs.size - width + 1)


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        n, ids = [], []
        for h in _hashed(*utf8(batch.column(1))):
            n.append(h.size)
            ids.append(_class(h))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "n_words", "class"])


def _indexed(window: int, hot):
    """Anchors (key, part, class) of texts; ``part`` is 0, or for one of ``hot`` one of PARTS by the class."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(keys, ids):
            keys, ids = np.concatenate(keys), np.concatenate(ids)
            part = np.where(np.isin(keys, hot.value), 1 + ids % PARTS, 0).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part), pa.array(ids)], names=["key", "part", "class"])

        seen: set[int] = set()
        for batch in batches:
            keys, ids, size = [], [], 0
            for h in _hashed(*utf8(batch.column(0))):
                if h.size < window or (c := _class(h)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(c)
                runs, at = _anchors(h, window)
                found = runs[np.unique(at)]
                keys.append(found)
                ids.append(np.full(found.size, c, dtype=np.int64))
                size += found.size
                if size > 200_000:
                    yield rows(keys, ids)
                    keys, ids, size = [], [], 0
            if keys:
                yield rows(keys, ids)

    return run


_ANCHORS = "key long, part int, class long"
_LOOKED = "key long, check int, part int, doc_id long, at long"


def _lookups(window: int, hot):
    """Rows (doc_id, text, texts: classes with their row number and shared anchors): the windows to look up.

    ``part`` is 0, or for a window with a hot anchor one of PARTS.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["key", "check", "part", "doc_id", "at"]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out, size = [], 0
            for i, h in enumerate(_hashed(*utf8(batch.column(1)))):
                if h.size < window:
                    continue
                c = _class(h)
                for text in batch.column(2)[i]:
                    if text["class"].as_py() == c:
                        runs, at = _anchors(h, window)
                        shared = np.isin(runs.view(np.int64), text["anchors"].values.to_numpy())
                        found = np.flatnonzero(shared[at])
                        check = (grams(mix(h ^ _OTHER), window)[found] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                        part = np.where(np.isin(runs[at[found]], hot.value), 1 + ids[i] % PARTS, 0).astype(np.int32)
                        out.append([grams(h, window)[found].view(np.int64), check, part, np.full(found.size, ids[i]), found + (text["row"].as_py() << _ROW)])
                        size += found.size
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    return run


_HIT = "key long, check int, doc_id long, at long, ref long, ref_at long"


def _found(batches: Iterator) -> Iterator:
    """Of windows sorted by key, check, part, doc_id and place, those with a smaller doc_id before them, and the first place there.

    The first document's windows of a part above 0 are given too, as places without a smaller doc_id so far; only these have a key.
    """
    import pyarrow as pa

    last = first = None
    for batch in batches:
        keys, checks, parts, docs, at = (batch.column(i).to_numpy() for i in range(5))
        if not keys.size:
            continue
        start = np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]) | (parts[1:] != parts[:-1]))
        begin = np.flatnonzero(start)
        least = np.stack([docs[begin], at[begin]])
        if last == (keys[0], checks[0], parts[0]):
            least[:, 0] = first
        ref = least[:, np.cumsum(start) - 1]
        last, first = (keys[-1], checks[-1], parts[-1]), least[:, -1]
        fresh = docs > ref[0]
        out = fresh | (parts > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[out], mask=fresh[out]), pa.array(checks[out]), pa.array(docs[out]), pa.array(at[out]), pa.array(ref[0][out]), pa.array(ref[1][out])],
            names=["key", "check", "doc_id", "at", "ref", "ref_at"],
        )


def factors(at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows and ends (in words) of the factors that hits make up: runs of windows at one offset of one block."""
    order = np.argsort(at, kind="stable")
    at, ref, ref_at = at[order], ref[order], ref_at[order]
    begin = np.append(True, (at[1:] != at[:-1] + 1) | (ref[1:] != ref[:-1]) | (ref_at[1:] != ref_at[:-1] + 1))
    return order[begin], at[np.append(begin[1:], True)] + window


_KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long,ref:long,ref_start:long>>"


def _kept(window: int):
    """Rows (doc_id, text, marks): words, removed words, the text that stays and the factors removed, with their reference."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(n, removed, texts, spans, ids):
            columns = [np.concatenate(x).astype(np.int64) for x in zip(*spans, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in spans)]), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "end", "ref", "ref_start"]))
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([t.decode() for t in texts], pa.string()), lists], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

        for batch in batches:
            n, removed, texts, spans = [], [], [], []
            data, offsets = utf8(batch.column(1))
            size = first = 0
            for i, h in enumerate(_hashed(data, offsets)):
                row = data[offsets[i] : offsets[i + 1]].tobytes().split()
                mine = [([], [], [], [])]
                c = _class(h) if h.size >= window else None
                for text in batch.column(2)[i].values or ():
                    if text["class"].as_py() != c:
                        continue
                    if text["head"].is_valid:
                        mine.append(([0], [h.size], [text["head"].as_py()], [0]))
                    elif text["found"].is_valid:
                        hits = text["found"].values
                        at, ref, place = (hits.field(name).to_numpy() for name in ("at", "ref", "ref_at"))
                        begin, end = factors(at, ref, place, window)
                        mine.append((at[begin], end, ref[begin], place[begin] & ((1 << _ROW) - 1)))
                spans.append([np.concatenate(x).astype(np.int64) for x in zip(*mine, strict=True)])
                edge = np.bincount(spans[-1][0], minlength=h.size + 1) - np.bincount(spans[-1][1], minlength=h.size + 1)
                keep = np.cumsum(edge[:-1]) <= 0
                n.append(h.size)
                removed.append(int(h.size - keep.sum()))
                texts.append(b" ".join(compress(row, keep.tolist()) if removed[-1] else row))
                size += offsets[i + 1] - offsets[i]
                if size > 1 << 23 or i == batch.num_rows - 1:
                    yield made(n, removed, texts, spans, batch.column(0).slice(first, i + 1 - first))
                    n, removed, texts, spans, size, first = [], [], [], [], 0, i + 1

    return run


def hot_anchors(texts: DataFrame, window: int, share: float = 0.01) -> np.ndarray:
    """Anchors that are in eight texts of a sample or more, and make up 1 / MOST of its anchors at least: so MOST of them at most."""
    none = texts.sparkSession.sparkContext.broadcast(np.zeros(0, dtype=np.uint64))
    sampled = texts.select("text").sample(share, SEED).mapInArrow(_indexed(window, none), _ANCHORS)
    counts = saved(sampled.select("key", "class").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")), "anchors")
    least = max(8, math.ceil((counts.agg(F.sum("n")).first()[0] or 0) / MOST))
    return np.sort(counts.filter(F.col("n") >= least).select("key").toArrow()["key"].to_numpy().view(np.uint64))


def without_repeats(docs: DataFrame, window: int = WINDOW, column: str = "text", key: str = "doc_id", share: float = 0.01) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words) and spans (words [start, end) repeat those of document ref from ref_start on) for rows of (key, column)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text"))
    counted = saved(texts.mapInArrow(_counted, "doc_id long, n_words long, class long"), "counted").filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    heads = counted.groupBy("class").agg(F.min("doc_id").alias("head"))
    row = F.row_number().over(Window.partitionBy("head").orderBy("class")) - 1
    heads = saved(heads.withColumn("row", row.cast("long")), "heads")

    named = texts.filter(F.col("doc_id").isNotNull())
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(named, window, share))
    keys = named.select("text").mapInArrow(_indexed(window, hot), _ANCHORS)
    shared = keys.repartition("key", "part").sortWithinPartitions("key", "part", "class").mapInArrow(shared_keys, "key long, class long")
    packed = shared.groupBy("class").agg(F.collect_list("key").alias("anchors"))
    packed = packed.join(heads, "class").groupBy(F.col("head").alias("doc_id")).agg(F.collect_list(F.struct("class", "row", "anchors")).alias("texts"))

    asked = texts.join(packed, "doc_id").select("doc_id", "text", "texts").mapInArrow(_lookups(window, hot), _LOOKED)
    looked = asked.repartition("key", "part").sortWithinPartitions("key", "check", "part", "doc_id", "at")
    hits = saved(looked.mapInArrow(_found, _HIT), "hits")
    found = hits.filter("key is null").select("doc_id", "at", "ref", "ref_at")
    if hot.value.size:
        firsts = hits.filter("key is not null")
        least = firsts.groupBy("key", "check").agg(F.min(F.struct("doc_id", "at")).alias("m"), F.max("doc_id").alias("last")).filter("last > m.doc_id").select("key", "check", F.col("m.doc_id").alias("ref"), F.col("m.at").alias("ref_at"))
        found = found.union(firsts.drop("ref", "ref_at").join(least, ["key", "check"]).filter("doc_id > ref").select("doc_id", "at", "ref", "ref_at"))
    place = F.struct("doc_id", F.shiftright("at", _ROW).alias("row"))
    hit = F.struct(F.col("at").bitwiseAND((1 << _ROW) - 1).alias("at"), "ref", "ref_at")
    found = found.groupBy(place.alias("p")).agg(F.collect_list(hit).alias("found")).select("p.doc_id", "p.row", "found")
    spans = found.join(heads, (found["doc_id"] == heads["head"]) & (found["row"] == heads["row"])).select("doc_id", "class", F.lit(None).cast("long").alias("head"), "found")
    copies = counted.join(heads, "class").filter("doc_id > head").select("doc_id", "class", "head", F.lit(None).cast("array<struct<at:bigint,ref:bigint,ref_at:bigint>>").alias("found")).dropDuplicates(["doc_id", "class"])
    marks = saved(spans.unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("class", "head", "found")).alias("marks")), "marks")
    return texts.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(_kept(window), _KEPT)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 13 words."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
