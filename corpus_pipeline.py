"""A corpus pipeline: quality, near duplicates, personal data, mixing, tokens; each stage written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import n_words, saved, table
from cellweave.llm.mixing import repetitions
from cellweave.llm.near_dedup import near_duplicates
from cellweave.llm.pieces import encode
from cellweave.llm.pii import find_pii, redact
from cellweave.llm.quality import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    return classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the document with the smallest doc_id of each group stays; five-word shingles, likeness of 0.8.

    Rows with a null doc_id stay, as they are in no group; of rows equal in doc_id and text one stays.
    """
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs, k=5, num=80, den=100).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: spans become their kind in angle brackets."""
    clean = redact(find_pii(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each document as often as the mix takes it; weights 1, 2, 3 by source, three epochs at most."""
    docs = docs.select(*COLUMNS)
    sized = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    times = repetitions(sized).groupBy(F.col("doc_id").alias("__id")).agg(F.max("times").cast("int").alias("__times")).filter("__times > 0")
    mixed = docs.join(times, F.col("doc_id").eqNullSafe(F.col("__id")))
    return mixed.withColumn("__no", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: adds the ids of the pieces and their number."""
    return encode(docs.select(*COLUMNS)).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: A trained classifier has no equal in SQL; the stages are held against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
