"""Shared helpers: written intermediate tables, and vectorised word hashing for Arrow tasks."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by exactly the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and all runs in one JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own()}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB for this session, unless it names a size other than Spark's own: a task then holds little beside its longest row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "64m"):
        spark.conf.set(name, "4m")


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="cellweave-")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors.

    Results are computed from these tables when they are read, so the tables stay until this process ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple] = []


@atexit.register
def forget() -> None:
    """Removes the intermediate tables that this process has written, and no other files."""
    while _written:
        files, at = _written.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone before us
            files.delete(at, True)


def n_words(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# -- vectorised hashing -------------------------------------------------------------------------

_P = 0xD6E8FEB86659FD93
_PINV = pow(_P, -1, 1 << 64)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _PINV):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of ``data`` from which span_hashes() reads the hash of any span."""
    sums = np.zeros(data.size + 1, dtype=np.uint64)
    power, _ = _powers(1 << max(16, int(data.size).bit_length()))
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: data.size], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``data``, equal for equal bytes."""
    sums = hash_sums(data) if sums is None else sums
    _, inverse = _powers(1 << max(16, int(data.size).bit_length()))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string array; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 21):
    """Runs of rows (first, last) of about ``limit`` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the rows, and for each row the index of its first word (one more at the end)."""
    inside = ~_SEPARATOR[data]
    edge = np.zeros(data.size + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(data.size, dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(data.size, dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, in order; shorter by k - 1 than the input."""
    n = hashes.size - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        out += hashes[i : i + n] * _WEIGHTS[i]
    return mix(out + np.uint64(k))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shared_keys(batches: Iterator) -> Iterator:
    """Of rows (key, class) or (key, part, class), sorted by all, those whose key has a second class, and those of parts above 0.

    Holds one row only, whatever the size of a group; equal rows are given once.
    """
    import pyarrow as pa

    last, given = None, False  # the last row so far, and whether it has been given out
    for batch in batches:
        key, *part, member = (c.to_numpy().astype(np.int64) for c in batch.columns)
        rows = np.stack([key, part[0] if part else np.zeros_like(key), member])
        held = last is not None
        if held:
            rows = np.concatenate([last, rows], axis=1)
        if rows.shape[1] == int(held):
            continue
        rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(0))]
        same = (rows[:2, 1:] == rows[:2, :-1]).all(0)
        out = np.append(same, False) | np.append(False, same) | (rows[1] > 0)
        now = bool(out[-1]) or (rows.shape[1] == 1 and held and given)
        if held and given:
            out[0] = False
        last, given = rows[:, -1:], now
        yield pa.RecordBatch.from_arrays([pa.array(rows[0, out]), pa.array(rows[2, out])], names=["key", "class"])
