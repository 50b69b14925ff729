"""Operator 8: document fingerprints that can be subtracted, DataFrame expressions only.

A text's paragraphs (lines, long ones in pieces of ``PIECE`` code points) have 64-bit digests. Each
digest goes into one cell of each of three parts of a sketch: cells hold a count, the exclusive or of
the digests and that of their check sums. Subtracting two sketches leaves the differing digests, which
peeling recovers one by one from cells that hold a single one. Where peeling fails, the digests are
halved by their highest bit and each half gets a sketch of the same width, which doubles the cells; halves
that fail are halved again by the next bit, until all are peeled. A half by all 64 bits holds one digest,
so this ends with the exact difference. The second moment of the cell counts only tells how many sizes
to pass over as too small. Likeness is 1 - differing / (paragraphs of both), 1 for two empty texts.

The next document by ascending doc_id is found in ranges of ids: rows are dealt by range, a window gives
the next row in a range, and the first rows of the ranges (one each) the rest. Ranges come from
quantiles; only texts of one range meet in a task.

Null texts count as empty; null ids come last, in ranges by a hash of the text; equal ids are ordered
by text. A single row is its own next. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import table

PIECE, PARTS, WIDTH, CHECK = 200, 3, 12, 0xFFFFFFFF
_SHIFTS = (7, 23, 41)


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PIECE}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell(digest: Column, part: int, width: int) -> Column:
    return F.pmod(F.shiftright(digest, _SHIFTS[part]), F.lit(width)).cast("int")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(CHECK)


def sketch(found: Column, width: int) -> Column:
    """Cells (c, k, h) of an array of digests: counts, digests and check sums by exclusive or."""
    none = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    add = lambda a, d: F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(d).alias("k"), a["h"].bitwiseXOR(_check(d)).alias("h"))
    part = lambda j: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.aggregate(F.filter(found, lambda d: _cell(d, j, width) == c), none, add))
    return F.concat(*[part(j) for j in range(PARTS)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, width: int) -> Column:
    """Struct (ok, only_first, only_second): the digests that a subtracted sketch holds, all of them if ok."""
    single = lambda x: (F.abs(x["c"]) == 1) & (_check(x["k"]) == x["h"])
    keys = F.array().cast("array<bigint>")

    def without(s: Column, p: Column) -> Column:
        hit = lambda i: (i == _cell(p["k"], 0, width)) | (i == width + _cell(p["k"], 1, width)) | (i == 2 * width + _cell(p["k"], 2, width))
        less = lambda x: F.struct((x["c"] - p["c"]).alias("c"), x["k"].bitwiseXOR(p["k"]).alias("k"), x["h"].bitwiseXOR(p["h"]).alias("h"))
        grown = lambda name, sign: F.when(p["c"] == sign, F.concat(s[name], F.array(p["k"]))).otherwise(s[name]).alias(name)
        return F.struct(F.transform(s["cells"], lambda x, i: F.when(hit(i), less(x)).otherwise(x)).alias("cells"), grown("first", 1), grown("second", -1), F.lit(False).alias("stop"))

    def step(s: Column, _: Column) -> Column:
        stopped = F.struct(s["cells"].alias("cells"), s["first"].alias("first"), s["second"].alias("second"), F.lit(True).alias("stop"))
        # The one-element array binds the cell found, so that it is looked for once.
        moved = F.get(F.transform(F.slice(F.filter(s["cells"], single), 1, 1), lambda p: without(s, p)), F.lit(0))
        return F.when(s["stop"], s).otherwise(F.coalesce(moved, stopped))

    start = F.struct(cells.alias("cells"), keys.alias("first"), keys.alias("second"), F.lit(False).alias("stop"))
    empty = lambda x: (x["c"] == 0) & (x["k"] == 0)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(PARTS * width)), start, step,
        lambda s: F.struct(F.forall(s["cells"], empty).alias("ok"), s["first"].alias("only_first"), s["second"].alias("only_second")),
    )


def _estimate(cells: Column, width: int) -> Column:
    """Number of differing digests by the second moment of the counts."""
    squares = F.aggregate(cells, F.lit(0), lambda a, x: a + x["c"] * x["c"])
    net = F.aggregate(F.slice(cells, 1, width), F.lit(0), lambda a, x: a + x["c"])
    return (squares / PARTS - net * net / width) / (1 - 1 / width)


def recover(first: Column, second: Column, guess: Column, width: int = WIDTH) -> Column:
    """Struct (ok, only_first, only_second) of two arrays of digests whose sketches of one ``width`` don't peel, by doubled sketches."""
    keys = F.array().cast("array<bigint>")
    # About half as many digests as cells are left to a sketch at the first size that is tried.
    start = F.greatest(F.ceil(F.log2(F.greatest(guess, F.lit(1.0)) / (PARTS * width * 0.45))), F.lit(1))
    peeled = lambda x: F.coalesce(x["p"]["ok"], F.lit(False))

    def step(s: Column, bit: Column) -> Column:
        half = lambda x, v: F.struct(*[F.filter(x[name], lambda d: F.getbit(d, bit) == v).alias(name) for name in "ab"])
        halves = F.flatten(F.transform(s["todo"], lambda x: F.array(half(x, 0), half(x, 1))))
        tried = F.transform(halves, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.when(64 - bit >= start, peel(subtract(sketch(x["a"], width), sketch(x["b"], width)), width)).alias("p")))
        grown = lambda t, name: F.concat(s[name], F.flatten(F.transform(F.filter(t, peeled), lambda x: x["p"][name]))).alias(name)
        left = lambda t: F.transform(F.filter(t, lambda x: ~peeled(x)), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("todo")
        # The one-element array binds the sketches, so that they are peeled once.
        moved = F.get(F.transform(F.array(tried), lambda t: F.struct(left(t), grown(t, "only_first"), grown(t, "only_second"))), F.lit(0))
        return F.when(F.size(s["todo"]) == 0, s).otherwise(moved)

    whole = F.struct(F.array(F.struct(first.alias("a"), second.alias("b"))).alias("todo"), keys.alias("only_first"), keys.alias("only_second"))
    return F.aggregate(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), whole, step, lambda s: F.struct((F.size(s["todo"]) == 0).alias("ok"), s["only_first"].alias("only_first"), s["only_second"].alias("only_second")))


def compare(df: DataFrame, first: str, second: str, first_sketch: str, second_sketch: str, into: str) -> DataFrame:
    """Adds ``into``, the likeness of two columns of digests with sketches of the first size, and the peeled struct as ``{into}_peeled``."""
    total = (F.size(first) + F.size(second)).cast("double")
    df = df.withColumn("__less", subtract(F.col(first_sketch), F.col(second_sketch))).withColumn("__peeled", peel(F.col("__less"), WIDTH))
    df = df.withColumn("__guess", F.least(F.greatest(_estimate(F.col("__less"), WIDTH), F.lit(0.0)), total))
    again = F.when(F.col("__peeled.ok"), F.col("__peeled")).otherwise(recover(F.col(first), F.col(second), F.col("__guess")))
    df = df.withColumn(f"{into}_peeled", again)
    differing = (F.size(f"{into}_peeled.only_first") + F.size(f"{into}_peeled.only_second")).cast("double")
    return df.withColumn(into, F.when(total > 0, 1 - differing / total).otherwise(1.0)).drop("__less", "__peeled", "__guess")


def with_next(docs: DataFrame, extra: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Rows (doc_id, text, *extra) with the struct ``next`` of the same columns of the next row by doc_id."""
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    docs = docs.withColumn("__id", F.col("doc_id").cast("double"))
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="__id", outputCol="__in", handleInvalid="keep").transform(docs)
    else:
        docs = docs.withColumn("__in", F.lit(0.0))
    late = F.lit(len(splits)) + F.pmod(F.xxhash64("text"), F.lit(16))
    docs = docs.withColumn("__range", F.when(F.col("doc_id").isNull(), late).otherwise(F.col("__in")).cast("int")).drop("__id", "__in")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    columns = ["doc_id", "text", *extra]
    heads = docs.groupBy("__range").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text")).alias("h"))
    heads = heads.select("__range", F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text")).withColumns(extra).select(F.col("__range").alias("__of"), F.struct(*columns).alias("__h"))
    # The ranges are put in order by their numbers alone; then each gets the first row of the one behind it.
    everything = Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    behind = docs.select("__range").distinct().withColumn("__of", F.coalesce(F.lead("__range").over(Window.partitionBy().orderBy("__range")), F.first("__range").over(everything)))
    heads = behind.join(heads, "__of").drop("__of")
    docs = docs.repartition("__range").withColumns(extra)
    docs = docs.withColumn("__n", F.lead(F.struct(*columns)).over(Window.partitionBy("__range").orderBy(*order)))
    return docs.join(heads, "__range").withColumn("next", F.coalesce("__n", "__h")).drop("__n", "__h", "__range")


def _written(cells: str) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.when(x["c"] == 0, "").otherwise(F.concat(x["c"].cast("string"), F.lit(":"), F.hex(x["k"]), F.lit(":"), F.hex(x["h"])))), ",")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts, and their next documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs, {"d": digests(F.col("text")), "s": sketch(digests(F.col("text")), WIDTH)})
    tail = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - tail), F.substring("next.text", F.lit(1), tail))
    df = df.select("doc_id", F.length("text").cast("long").alias("n_chars"), "d", "s", edited.alias("edited"), F.col("next.d").alias("nd"), F.col("next.s").alias("ns"))
    df = df.withColumn("ed", digests(F.col("edited"))).withColumn("es", sketch(F.col("ed"), WIDTH))
    df = compare(compare(df, "d", "ed", "s", "es", "near_edited"), "d", "nd", "s", "ns", "near_next")
    peeled = lambda name: F.col(f"{name}_peeled")
    recovered = F.size(peeled("near_edited")["only_first"]) + F.size(peeled("near_edited")["only_second"])
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _written("s").alias("fingerprint"), _written("es").alias("edited_fingerprint"), "near_edited", "near_next", recovered.cast("long").alias("n_recovered"))
