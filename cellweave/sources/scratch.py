"""The shared folder for intermediate tables, and tables written once in it."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple] = []
_kept: dict[tuple[str, ...], str] = {}


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="cellweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only where none is named and all runs in one JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own()}"


def own(spark: SparkSession, path: str) -> None:
    """Name a folder of ours, to be removed when this process ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at))


#: Rows that a task sorts, about.
SORTED = 1 << 19


def kept(spark: SparkSession, name: tuple[str, ...], make: Callable[[], DataFrame], order: list[str] = (), rows: Callable[[], int] = lambda: 0) -> DataFrame:
    """A table written when it is first asked for and read from then on, until the application ends.

    With ``order`` its files hold sorted ranges of that, so filters on it read few of them; ``rows`` tells how many there
    are to sort, about, and so into how many tasks they go. Without, rows are written where they are made.
    """
    key = (spark.sparkContext.applicationId, *name)
    if key not in _kept:
        path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
        made = make()
        if order:
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, -(-rows() // SORTED))
            made = made.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        made.write.parquet(path)
        own(spark, path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


@atexit.register
def forget() -> None:
    """Removes the tables that this process has kept, and no other files."""
    while _written:
        files, at = _written.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone before us
            files.delete(at, True)
