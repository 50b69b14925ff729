"""Term postings and field-indexed documents. Documents are long rows (shard, datatype, uid, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.rank import knn

DOC = ["shard", "datatype", "uid"]


def by_terms(postings: DataFrame, terms: list[str], phrase: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """Ids of postings (term, id) with any of the terms, or with all of them (``phrase``); bounds apply to ids read as numbers."""
    hits = postings.filter(F.col("term").isin(terms) & (F.col("id") != ""))
    if low is not None or high is not None:
        n = F.col("id").try_cast("double")
        hits = hits.filter(n.isNotNull() & (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True)))
    if phrase:
        hits = hits.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(terms)))
    return hits.select("id").distinct()


def by_fields(index: DataFrame, terms: list[tuple[str, str]], op: str = "and", shards: list[str] | None = None, having: str | None = None) -> DataFrame:
    """Documents (shard, datatype, uid) whose fields have the values, all or any; none for no terms. ``having`` names a field that they must have with any value."""
    condition = F.lit(False)
    for field, value in terms:
        condition = condition | ((F.col("field") == field) & (F.col("value") == value))
    hits = index.filter(condition)
    if shards is not None:
        hits = hits.filter(F.col("shard").isin(shards))
    hits = hits.select(*DOC, "field", "value").distinct()
    if op == "and":
        hits = hits.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(terms)))
    found = hits.select(*DOC).distinct()
    return found if having is None else found.join(index.filter(F.col("field") == having).select(*DOC).distinct(), DOC, "left_semi")


def shards_of(forward: DataFrame, terms: list[tuple[str, str]], op: str = "and") -> DataFrame:
    """Shards in which all (any) of the terms occur, from the global index (term, field, shard)."""
    condition = F.lit(False)
    for field, value in terms:
        condition = condition | ((F.col("field") == field) & (F.col("term") == value))
    hits = forward.filter(condition).select("term", "field", "shard").distinct()
    if op == "and":
        hits = hits.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(terms)))
    return hits.select("shard").distinct()


def rebuilt(fields: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each document; of several values of a field the smallest, the first in key order. Without names, the fields that occur (an error above 10,000: they become columns)."""
    if names is None:
        names = sorted(r[0] for r in fields.select("field").distinct().limit(10_001).collect())
        if len(names) > 10_000:
            raise ValueError("more than 10,000 fields: name those to rebuild")
    smallest = [F.min(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names]
    return fields.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_fields"), *smallest).drop("n_fields")


#: Fixed value: ids that a global index value lists.
MOST_UIDS = 20


def forward_index(fields: DataFrame, lists: bool = True) -> DataFrame:
    """(term, field, shard, datatype, count, uids, ignore), the global index: all documents counted, the first MOST_UIDS ids listed, as stored. Without ``lists`` no uids.

    ``fields`` hold each value of a document once. Ids beyond are cut in every partition before the shuffle, so a
    common term is never gathered.
    """
    key = ["term", "field", "shard", "datatype"]
    rows = fields.select(F.col("value").alias("term"), "field", "shard", "datatype", "uid")
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("count"))
    if not lists:
        return counts.withColumn("ignore", F.col("count") > MOST_UIDS)
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("uid"))).filter(F.col("__n") <= MOST_UIDS)
    ids = first.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.array_sort(F.collect_list("uid")).alias("uids"))
    out = counts.join(ids, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return out.select(*key, "count", "uids", (F.col("count") > MOST_UIDS).alias("ignore"))


def document_knn(fields: DataFrame, vectors: DataFrame, terms: list[tuple[str, str]], query: list[float], k: int = 10, op: str = "and", uid: str | None = None, datatype: str | None = None) -> DataFrame:
    """(datatype, uid, score) of the k documents nearest to ``query`` among those with the field values; vectors (uid, vector). Without terms all documents count."""
    allowed = by_fields(fields, terms, op) if terms else fields.select(*DOC).distinct()
    if uid is not None:
        allowed = allowed.filter(F.col("uid") == uid)
    if datatype is not None:
        allowed = allowed.filter(F.col("datatype") == datatype)
    # The predicate comes before the ranking.
    return knn(vectors.join(allowed, "uid"), query, k, key="uid").select("datatype", "uid", "score")


def reverse_index(forward: DataFrame) -> DataFrame:
    return forward.withColumn("term", F.reverse("term"))
