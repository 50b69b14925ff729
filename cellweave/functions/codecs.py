"""Binary codecs of index values, for import and export of cells: lists of ids and of word positions, with variable-length integers.

Pandas UDFs: the bytes of one value follow from each other, which built-in expressions can't walk.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _packed(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _unpacked(raw: bytes, at: int) -> tuple[int, int]:
    """A number and the place behind it."""
    n = shift = 0
    while True:
        n |= (raw[at] & 127) << shift
        at += 1
        if raw[at - 1] < 128:
            return n, at
        shift += 7


def _texts(items) -> bytes:
    raw = [x.encode() for x in items]
    return _packed(len(raw)) + b"".join(_packed(len(x)) + x for x in raw)


def _read_texts(raw: bytes, at: int) -> tuple[list[str], int]:
    n, at = _unpacked(raw, at)
    out = []
    for _ in range(n):
        size, at = _unpacked(raw, at)
        if at + size > len(raw):
            raise IndexError(at)
        out.append(raw[at : at + size].decode())
        at += size
    return out, at


def pack_uids(count: int, uids, removed=(), ignore: bool = False) -> bytes:
    """Flags (1: only the count is kept), the count, ids and removed ids."""
    return bytes([int(ignore)]) + _packed(count) + _texts(uids) + _texts(removed)


def unpack_uids(raw: bytes | None) -> dict | None:
    """None if the bytes are no such list."""
    try:
        count, at = _unpacked(raw, 1)
        uids, at = _read_texts(raw, at)
        return {"ignore": bool(raw[0] & 1), "count": count, "uids": uids, "removed": _read_texts(raw, at)[0]}
    except (IndexError, TypeError, UnicodeDecodeError):
        return None


def pack_positions(offsets, skips=(), scores=()) -> bytes:
    """Three lists of numbers: word positions, the gaps before them and scores."""
    return b"".join(_packed(len(x)) + b"".join(_packed(int(n)) for n in x) for x in (offsets, skips, scores))


def unpack_positions(raw: bytes | None) -> dict | None:
    out, at = [], 0
    try:
        for _ in range(3):
            n, at = _unpacked(raw, at)
            some = []
            for _ in range(n):
                x, at = _unpacked(raw, at)
                some.append(x)
            out.append(some)
    except (IndexError, TypeError):
        return None
    return dict(zip(("offsets", "skips", "scores"), out, strict=True))


_TEXTS, _NUMBERS = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())


@F.pandas_udf(T.BinaryType())
def uids_value(count: pd.Series, uids: pd.Series, ignore: pd.Series) -> pd.Series:
    return pd.Series([pack_uids(int(c), u, (), bool(i)) for c, u, i in zip(count, uids, ignore, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("ignore", T.BooleanType()), T.StructField("count", T.LongType()), T.StructField("uids", _TEXTS), T.StructField("removed", _TEXTS)]))
def uids_of(value: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unpack_uids(v) or {} for v in value], columns=["ignore", "count", "uids", "removed"])


@F.pandas_udf(T.BinaryType())
def positions_value(offsets: pd.Series) -> pd.Series:
    return offsets.map(lambda x: pack_positions(x))


@F.pandas_udf(T.StructType([T.StructField(name, _NUMBERS) for name in ("offsets", "skips", "scores")]))
def positions_of(value: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unpack_positions(v) or {} for v in value], columns=["offsets", "skips", "scores"])
