"""Operator 5: SentencePiece encoding by streaming Viterbi, and decoding.

The vocabulary of a SentencePiece model gives the pieces. Its own scores are minus the rank, an order of
merges and no likelihood; by them two common pieces would always beat a rare longer one. So a piece of rank r
costs ln(r + 2) in whole units of 2^-20, which is minus the log of a likelihood that falls with the rank; a byte of
a character that no piece covers costs a little more than the last piece. The best path over a text is found
left to right with a window of as many boundaries as the longest piece has characters. Whenever the
back pointers of all boundaries in the window meet in one boundary, the ids before it are given out and
forgotten; so beside a row's text and ids memory does not grow with the text.

No piece of the vocabulary spans the start of a word or a mark after a Latin letter (this is verified when it is
read), so all surviving paths meet at these boundaries, whatever stands on both sides: there the window is one
boundary wide, and what is certain is given out. Between two of them the ids depend on the characters in
between only; for those met before they are taken from two generations of a bounded table instead of walked
again. Where no such boundary comes, as in text without blanks, the window alone decides. In a run of one
character repeated, paths may stay beside each other to its end; the window then holds that run.

Blanks are written as U+2581, with one in front of the text; a U+2581 in the text is written in bytes,
so every text comes back exactly. Null texts have null ids and come back null; empty texts have none.
Rows are handled one by one: repeated rows need no rule. Further columns stay; ``ids`` and ``decoded`` of the
input are replaced by encode() and decode(). Empty tables give empty results. Of two best paths the one with the
longer last piece counts.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from itertools import batched

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
GENERATION = 150_000
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-@\[-`{-~"  # Latin letters; the ASCII marks and digits
_WORD_END = re.compile(f"[{_LETTER}][{_MARK}]")


def _units(cost: float) -> float:
    """A cost in whole units: sums are exact, so ties don't hang on where a text is cut."""
    return float(round(cost * (1 << 20)))


class Vocabulary:
    """Pieces with their costs, and the ids of bytes. Read on the driver; its size is that of the model file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cost: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.cost[piece] = (_units(math.log(i + 2)), i)
                self.text.append(piece.replace(BLANK, " ").encode())
        self.byte_cost = _units(math.log(model.get_piece_size() + 2) + 1)
        self.longest = max(map(len, self.cost))
        #: By next character: cost and id of the piece that ends there (an endless cost if none does), and what may follow.
        self.follow: dict[str, list] = {}
        for piece, (cost, i) in self.cost.items():
            follow = self.follow
            for c in piece:
                node = follow.setdefault(c, [math.inf, -1, {}])
                follow = node[2]
            node[:2] = cost, i
        if any(BLANK in p.lstrip(BLANK) or "\n" in p or _WORD_END.search(p) for p in self.cost):
            raise ValueError("a piece spans the start of a word or line, or a mark after a letter")


def viterbi(text: str, vocabulary: Vocabulary) -> Iterator[int]:
    """Ids of the cheapest path over ``text``, given out as soon as they are certain."""
    first, longest, n = vocabulary.follow, vocabulary.longest, len(text)
    done = 0  # the boundary that the lists start at: cost so far, boundary before, piece taken (-1: bytes)
    room = min(n, 4 * longest) + 1
    cost, back, took = [math.inf] * room, [0] * room, [-1] * room
    cost[0] = 0.0

    def path(to: int) -> list[int]:
        steps = []
        while to > done:
            before, piece = back[to - done], took[to - done]
            steps.append((piece,) if piece >= 0 else [vocabulary.bytes[x] for x in text[before:to].encode()])
            to = before
        return [i for ids in reversed(steps) for i in ids]

    for start in range(n):
        if start - done + longest >= room and done + room <= n:
            # All later pieces start in the last ``longest`` boundaries: follow these back until one is left.
            alive = set(range(max(done, start - longest + 1), start + 1))
            while len(alive) > 1:
                latest = max(alive)
                alive.remove(latest)
                alive.add(back[latest - done])
            (met,) = alive
            yield from path(met)
            del cost[: met - done], back[: met - done], took[: met - done]
            done = met
            # Where paths run beside each other and don't meet, the next look comes when the window has doubled.
            more = max(0, max(4 * longest, start - done) + start - done + 1 - len(cost))
            cost, back, took = cost + [math.inf] * more, back + [0] * more, took + [-1] * more
            room = len(cost)
        at = start - done
        here, follow = cost[at], first
        for c in text[start : start + longest]:
            if c not in follow:
                break
            price, piece, follow = follow[c]
            at += 1
            total = here + price
            if total < cost[at]:
                cost[at] = total
                back[at] = start
                took[at] = piece
        at = start - done + 1
        if here + vocabulary.byte_cost < cost[at] and (total := here + vocabulary.byte_cost * len(text[start].encode())) < cost[at]:
            cost[at], back[at], took[at] = total, start, -1
    yield from path(n)


class _Words(dict):
    """Ids of words as packed integers; words of the generation before last are forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word == BLANK:
                found = [self.vocabulary.bytes[b] for b in word.encode()]
            else:
                found = viterbi(word.replace(" ", BLANK), self.vocabulary)
            ids = array("i", found).tobytes()
        if len(word) <= 64:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


_UNITS = re.compile(f" *[{_MARK}]*[{_LETTER}]++(?=[ \n{BLANK}{_MARK}]|\\Z)| *[^ \n{BLANK}]+| +|\n|{BLANK}")


def _walked(text: str, get) -> bytearray:
    """The ids of a text, from one boundary where all paths meet to the next, a few thousand of them at a time."""
    out = bytearray()
    for run in batched(_UNITS.finditer(text), 4096):
        out += b"".join([get(m[0]) for m in run])
    return out


def _encoder(vocabulary, at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = _Words(vocabulary.value)
        get = known.__getitem__
        for batch in batches:
            first, size, ids = 0, 0, []
            for i, text in enumerate(batch.column(at)):
                text = text.as_py()
                ids.append(text if text is None else bytes(_walked(" " + text, get)) if text else b"")
                size += len(text or "")
                if size > 1 << 22 or i == batch.num_rows - 1:
                    offsets = np.cumsum([0, *(len(x or b"") // 4 for x in ids)])
                    values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), dtype="<i4"))
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([x is None for x in ids]))
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, i + 1 - first) for c in batch.columns), lists], names=[*batch.schema.names, "ids"])
                    first, size, ids = i + 1, 0, []

    return run


def _decoder(vocabulary, at: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        get = vocabulary.value.text.__getitem__
        for batch in batches:
            step = 512
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                texts = [b"".join(map(get, x.values.to_numpy().tolist()))[1:].decode() if x.is_valid else None for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return run


def encode(df: DataFrame, column: str = "text", model: str = MODEL) -> DataFrame:
    """Adds ``ids`` (array<int>), the pieces of ``column``."""
    small_batches(df.sparkSession)
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(model))
    df = df.drop("ids")
    return df.mapInArrow(_encoder(vocabulary, df.columns.index(column)), T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, column: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds ``decoded``, the text of the pieces in ``column``."""
    small_batches(df.sparkSession)
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(model))
    df = df.drop("decoded")
    return df.mapInArrow(_decoder(vocabulary, df.columns.index(column)), T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their ids, and whether decoding gives the text back."""
    both = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
