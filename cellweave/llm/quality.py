"""Operator 6: quality classifier by co-training.

Two views of a document: its text content (which words, word beginnings and runs of marks it has) and
its page metadata (language, source, size, and layout figures: lines, their length, shares of capitals,
marks, digits and words said twice running). A logistic model on the presence of hashed features is fitted for each view on a
bounded sample of labelled rows. In each of ``rounds`` both views score every unlabelled document, and the
ones that a view is most sure of, by score over the whole table, join the other view's training rows:
as many good and bad ones as ``share`` of the labelled ones of that kind at most, so that pseudo-labels never
outweigh labels, with a calibrated likelihood above ``sure`` for what they are said to be. Of documents with the same text one counts, so copies don't crowd out the rest; equal
scores are ordered by a seeded hash of the id. Each view is calibrated on labelled rows held out from
training, where the combination of both views is fitted too. All documents are scored on their whole
texts; a document is rejected (``kept`` false) if it is more likely bad than not. Bad means quality 0 or
toxic 1; features are chosen for either by itself as well, as the words of one are few among all bad rows.

Bounds of fitting: ``sample`` labelled rows, drawn by a seeded hash of their id; per round and view
``share`` of these in pseudo-labels; 2^BITS weights a view, whatever the input. Only
features of these rows reach the driver, never texts. All features are cut to those whose presence differs
clearly between good and bad rows, so a long text's many rare words don't add up to noise.

Null texts count as empty, null metadata as values of their own. Labels with a null id or a null in
quality and toxic are left out; of several labels for an id all count. Of documents with an equal id the one
whose text has the smallest hash teaches. Without any label, or with one kind only, every document is kept
with a score of its frequency. Repeated rows get equal scores. Texts may be of any length: features are found in
slices of 2 MB. Columns p_text, p_page, score and kept of the input are replaced, further columns
stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import hash_sums, lowered, mix, saved, slices, small_batches, span_hashes, table, utf8

BITS = 18
SAMPLE, ROUNDS, SEED = 6000, 2, 17
_MASK = np.uint64((1 << BITS) - 1)
_KIND = np.full(256, 3, dtype=np.uint8)  # 0 blank, 1 letter, 2 digit, 3 mark
_KIND[0x80:] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def text_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row its distinct text features, or those among ``wanted`` (a mask), and its layout figures."""
    found, layout = [], []
    for first, last in slices(offsets):
        base = offsets[first]
        raw = data[base : offsets[last]]
        part, at = lowered(raw), offsets[first : last + 1] - base
        kind = _KIND[part]
        change = np.ones(part.size + 1, dtype=bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[at] = True
        cut = np.flatnonzero(change)
        start, end = cut[:-1], cut[1:]
        use = kind[start] > 0 if start.size else np.zeros(0, dtype=bool)
        start, end = start[use], end[use]
        sums = hash_sums(part)
        whole = span_hashes(part, start, end, sums)
        letters = (kind[start] == 1) & (end - start >= 5) if start.size else np.zeros(0, dtype=bool)
        heads = [mix(span_hashes(part, start[letters], start[letters] + n, sums) + np.uint64(n)) for n in (4, 5)]
        owner = np.searchsorted(at, start, side="right") - 1
        ids = (np.concatenate([whole, *heads]) & _MASK).astype(np.int64)
        rows = np.concatenate([owner, owner[letters], owner[letters]]).astype(np.int64)
        if wanted is not None:
            use = wanted[ids]
            ids, rows = ids[use], rows[use]
        both = np.unique((rows << BITS) | ids)
        bounds = np.searchsorted(both, np.arange(last - first + 1) << BITS)
        found += [(both[bounds[i] : bounds[i + 1]] & int(_MASK)).astype(np.int32) for i in range(last - first)]
        figures = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at] for x in (part != raw, kind == 3, kind == 2, part == 10, kind == 0)]
        again = np.zeros(start.size, dtype=bool)
        again[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1]) & (kind[start[1:]] == 1)
        repeats = np.bincount(owner[again], minlength=last - first)
        tokens = np.bincount(owner, minlength=last - first)
        layout.append(np.stack([np.diff(s) for s in figures] + [np.diff(at), repeats, tokens], axis=1))
    return found, np.concatenate(layout) if layout else np.zeros((0, 8), dtype=np.int64)


def _metadata(batch, layout: np.ndarray) -> list[np.ndarray]:
    """Features of the second view: one for each figure's range and each value."""
    import xxhash

    lang, source, chars = (batch.column(i).to_pylist() for i in (2, 3, 4))
    out = []
    for i, (caps, marks, digits, lines, blanks, size, repeats, tokens) in enumerate(layout.tolist()):
        n = max(size, 1)
        ranges = (int(np.log2(n)), int(np.log2(lines + 1)), int(np.log2(n / (lines + 1))), min(int(20 * repeats / max(tokens, 1)), 9), *(min(int(20 * x / n), 9) for x in (caps, marks, digits, blanks)), int(np.log2((chars[i] or 0) + 1)) if (chars[i] or 0) >= 0 else -1)
        names = [f"{j}:{r}" for j, r in enumerate(ranges)] + [f"lang:{lang[i]}", f"source:{source[i]}"]
        out.append(np.unique(np.array([xxhash.xxh3_64_intdigest(x) & int(_MASK) for x in names], dtype=np.int32)))
    return out


def _hash(row: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(row.tobytes())).astype(np.int64))


def _features(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.int32())
    for batch in batches:
        words, layout = text_features(*utf8(batch.column(1)))
        page = _metadata(batch, layout)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, kind), pa.array(page, kind), pa.array([_hash(np.concatenate([w, p])) for w, p in zip(words, page, strict=True)], pa.int64())], names=["doc_id", "words", "page", "hash"])


def _judged(model):
    """Of documents the two views' calibrated logits, and a hash of the text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            words, layout = text_features(data, offsets, m["words"][:-1] != 0)
            z = [a * logits(rows, m[v]) + b for v, rows, (a, b) in zip(VIEWS, (words, _metadata(batch, layout)), m["calibration"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, z), pa.array([_hash(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())], names=["doc_id", "words", "page", "same"])

    return run


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows], dtype=np.int64)
    return (np.concatenate(rows) if len(rows) else np.zeros(0)).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), n)


def telling(ids: np.ndarray, owner: np.ndarray, said: np.ndarray, both_ways: bool) -> np.ndarray:
    """The features whose presence among the rows of ``said`` differs clearly between those said and the others."""
    if said.size < owner.max(initial=-1) + 1:
        ids, owner = ids[owner < said.size], owner[owner < said.size]
    share = np.clip(said.mean(), 1e-3, 1 - 1e-3)
    hits = np.bincount(ids[said[owner] > 0], minlength=1 << BITS)
    seen = np.bincount(ids, minlength=1 << BITS)
    score = (hits - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    return (seen >= 3) & ((np.abs(score) if both_ways else score) >= 4.5)


def fit(rows: list[np.ndarray], bad: np.ndarray, both_ways: bool, kinds: list[np.ndarray] = (), steps: int = 150, pull: float = 2e-3) -> np.ndarray:
    """Weights of a logistic model on feature presence; the last one is the constant.

    Unless ``both_ways``, only features that speak for bad are used: a short text has few words that
    speak for good, and must not count as bad for that. ``kinds`` are the ways of being bad, told of the first rows:
    a feature of one rare kind stands out among those of that kind, and not among all bad rows.
    """
    ids, owner = _flat(rows)
    share = np.clip(bad.mean(), 1e-3, 1 - 1e-3)
    chosen = telling(ids, owner, bad, both_ways)
    for kind in kinds:
        chosen |= telling(ids, owner, kind, both_ways)
    keep = chosen[ids]
    columns = np.flatnonzero(chosen)
    ids, owner = np.searchsorted(columns, ids[keep]), owner[keep]
    w, b, n = np.zeros(columns.size), np.log(share / (1 - share)), len(rows)
    first, second = np.zeros(columns.size + 1), np.zeros(columns.size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[ids], minlength=n) + b, -30, 30)))
        slope = np.append(np.bincount(ids, weights=(p - bad)[owner], minlength=columns.size) / n + pull / 10 * w, (p - bad).mean())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros((1 << BITS) + 1, dtype=np.float32)
    out[columns], out[-1] = w, b
    return out


def logits(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    ids, owner = _flat(rows)
    return np.clip(np.bincount(owner, weights=w[ids], minlength=len(rows)) + w[-1], -30, 30)


def _small(x: np.ndarray, bad: np.ndarray, steps: int = 400) -> np.ndarray:
    """A logistic model on few dense columns, by Newton steps held back by a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - bad) + 1e-1 * w)
    return w


VIEWS = ("words", "page")


def calibrated(model: dict, views: list[list], bad: np.ndarray) -> dict:
    """The views' weights with their calibration and combination, fitted on rows held out."""
    z = np.column_stack([logits(rows, model[v]) for v, rows in zip(VIEWS, views, strict=True)])
    calibration = [_small(z[:, [j]], bad) for j in range(2)]
    even = np.column_stack([z[:, j] * calibration[j][0] + calibration[j][1] for j in range(2)])
    even = np.column_stack([even, even.max(1)])  # either view alone may know of something bad
    return {**model, "calibration": calibration, "both": _small(even, bad)}


def _scored(model, at: list[int]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = model.value
        for batch in batches:
            view = pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=["doc_id", "text", "lang", "source", "n_chars"])
            words, layout = text_features(*utf8(view.column(1)), m["words"][:-1] != 0)
            z = [logits(words, m["words"]), logits(_metadata(view, layout), m["page"])]
            z = [x * c[0] + c[1] for x, c in zip(z, m["calibration"], strict=True)]
            good = [1 / (1 + np.exp(x)) for x in (*z, m["both"] @ np.stack([*z, np.maximum(*z), np.ones(len(z[0]))]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, good)], names=[*batch.schema.names, "p_text", "p_page", "score"])

    return run


_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _lists(column) -> list[np.ndarray]:
    """The rows of an Arrow column of lists, as views of one array."""
    whole = column.combine_chunks()
    values, at = whole.values.to_numpy(), whole.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _gathered(docs: DataFrame, ids: DataFrame) -> dict:
    """Features by doc_id of the documents named in ``ids``, a table of bounded size."""
    rows = docs.select(*_COLUMNS).join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select(*_COLUMNS)
    found = rows.mapInArrow(_features, "doc_id long, words array<int>, page array<int>, hash long")
    found = found.groupBy("doc_id").agg(F.min_by(F.struct("words", "page"), "hash").alias("f")).select("doc_id", "f.words", "f.page").toArrow()
    return dict(zip(found["doc_id"].to_pylist(), zip(_lists(found["words"]), _lists(found["page"]), strict=True), strict=True))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, share: float = 0.05, sure: float = 0.98) -> DataFrame:
    """The columns of ``docs`` (documents) with p_text, p_page, score (likelihood of being good) and kept."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.drop("p_text", "p_page", "score", "kept")
    labels = labels.filter("doc_id is not null and quality is not null and toxic is not null").select("doc_id", (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") == 1).cast("int").alias("toxic")).withColumn("bad", F.greatest("low", "toxic"))
    by_hash = F.xxhash64(F.lit(SEED), "doc_id")
    marked = saved(labels.orderBy(by_hash, "doc_id", "low", "toxic").limit(sample), "labelled")
    features = _gathered(docs, marked)
    drawn = sorted((r["doc_id"], r["low"], r["toxic"]) for r in marked.toLocalIterator() if r["doc_id"] in features)  # ``sample`` rows at most
    low, toxic = np.array([x[1:] for x in drawn], dtype=float).reshape(-1, 2).T
    bad = np.maximum(low, toxic)
    held = np.arange(bad.size) % 4 == 3
    if len(set(bad[held])) < 2 or len(set(bad[~held])) < 2:
        even = F.lit(1 - float(bad.mean()) if bad.size else 1.0)
        return docs.withColumns({"p_text": even, "p_page": even, "score": even, "kept": F.lit(True)})
    rows = {v: [features[d][j] for (d, *_), h in zip(drawn, held, strict=True) if not h] for j, v in enumerate(VIEWS)}
    truth = {v: list(bad[~held]) for v in VIEWS}
    tested = [[features[d][j] for (d, *_), h in zip(drawn, held, strict=True) if h] for j in range(2)]
    kinds = [low[~held], toxic[~held]]
    fitted = lambda: calibrated({v: fit(rows[v], np.array(truth[v]), v == "page", kinds) for v in VIEWS}, tested, bad[held])
    model = fitted()
    taught: dict[str, set[int]] = {v: set() for v in VIEWS}
    for _ in range(rounds):
        scores = docs.filter("doc_id is not null").select(*_COLUMNS).mapInArrow(_judged(spark.sparkContext.broadcast(model)), "doc_id long, words double, page double, same long")
        scores = scores.join(labels.select("doc_id"), "doc_id", "left_anti").groupBy("same").agg(F.min(F.struct(by_hash.alias("h"), "doc_id", "words", "page")).alias("x"))
        scores = saved(scores.select("x.*"), "scores")
        least, chosen = float(np.log(sure / (1 - sure))), []
        for teacher, pupil in (VIEWS, VIEWS[::-1]):
            # A pupil has been taught at most rounds * share * sample documents.
            fresh = scores.filter(~F.col("doc_id").isin(sorted(taught[pupil]))) if taught[pupil] else scores
            for is_bad in (1.0, 0.0):
                most = math.ceil(share * int((bad[~held] == is_bad).sum()))
                z = F.col(teacher) if is_bad else -F.col(teacher)
                chosen.append(fresh.filter(z > least).orderBy(z.desc(), "h", "doc_id").limit(most).select("doc_id", F.lit(pupil).alias("pupil"), F.lit(is_bad).alias("bad")))
        chosen = saved(chosen[0].union(chosen[1]).union(chosen[2]).union(chosen[3]), "chosen")
        found = _gathered(docs, chosen)
        for r in sorted(chosen.toLocalIterator()):
            rows[r["pupil"]].append(found[r["doc_id"]][VIEWS.index(r["pupil"])])
            truth[r["pupil"]].append(r["bad"])
            taught[r["pupil"]].add(r["doc_id"])
        model = fitted()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = [docs.columns.index(c) for c in _COLUMNS]
    scored = docs.mapInArrow(_scored(spark.sparkContext.broadcast(model), at), f"{fields}, p_text double, p_page double, score double")
    return scored.withColumn("kept", F.col("score") >= 0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    out = classify(table(spark, sf_dir, "documents").select(*_COLUMNS), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_text", "p_page", "score", "kept")
