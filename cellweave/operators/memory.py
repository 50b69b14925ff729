"""Memory of events: ingest as cells, hybrid retrieval over them, consolidation.

A retrieval touches a bounded set: ``anchors`` rows from each list and ``beam`` rows a hop.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import text as words
from cellweave.operators import rank
from cellweave.operators.cells import in_key_order, scan_range
from cellweave.operators.graph import cut
from cellweave.schema import ATTRIBUTE, CONTENT, EDGES, ENTITY, EVENT, POSTING, TERM, VECTOR, b

#: Edge weights by intent; all others weigh 0.5.
WEIGHTS = {"WHY": {"causal": 1.5}, "WHEN": {"temporal": 1.5}, "ENTITY": {"entity": 1.5}, "GENERAL": {"semantic": 1.0}}


# -- ingest ---------------------------------------------------------------------------------------


def with_previous(df: DataFrame, key: str, into: str) -> DataFrame:
    """Adds the largest key below a row's own (keys are unique), over the whole table: ranges are sorted by themselves, and told the last key before them."""
    dealt = cut(df.repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    ends = dealt.groupBy("__p").agg(F.max(key).alias("__last"))  # one row for each partition
    ends = ends.select("__p", F.lag("__last").over(Window.partitionBy().orderBy("__p")).alias("__before"))
    dealt = dealt.withColumn(into, F.lag(key).over(Window.partitionBy("__p").orderBy(key)))
    return dealt.join(F.broadcast(ends), "__p").withColumn(into, F.coalesce(into, "__before")).drop("__p", "__before")


def ingest(events: DataFrame, embed: Callable[[Column], Column], entities: Callable[[Column], Column] = words.entities, summarize: Callable[[Column], Column] = words.summary, families: list[str] | None = None) -> DataFrame:
    """Cells of events (id, text, ts_ms): text, summary, vector, time, the edge to the event before by id, entities, postings.

    ``embed``, ``entities`` and ``summarize`` make columns of the text, so that models of one's own can be put in. Each is
    computed once for a text, in passes that move no texts; only ids are put in order for the edges. ``families`` asks
    for the cells of these column families only.
    """
    rows = events.select("id", "text", F.col("ts_ms").alias("timestamp"), F.concat(F.lit(EVENT), "id").alias("row"))
    one, none = b(struct.pack(">f", 1.0)), F.array().cast("array<struct<row:binary,cf:binary,cq:binary,value:binary>>")
    asked = lambda *names: families is None or any(n in families for n in names)

    def made(*parts: tuple[Column, str, Column, Column]) -> Column:
        raw = lambda c: c.cast("binary")
        found = [F.struct(raw(row).alias("row"), raw(F.lit(cf)).alias("cf"), raw(cq).alias("cq"), raw(value).alias("value")) for row, cf, cq, value in parts if asked(cf)]
        return F.array(*found) if found else none

    def cells(df: DataFrame, found: Column) -> DataFrame:
        found = df.select("timestamp", F.explode(found).alias("c"))
        return found.select("c.row", "c.cf", "c.cq", F.lit("").cast("binary").alias("cv"), "timestamp", F.lit(False).alias("deleted"), "c.value")

    if asked(CONTENT):
        rows = rows.withColumn("summary", summarize(F.col("text")))
    if asked(POSTING):
        rows = rows.withColumn("terms", words.keywords(F.col("text")))
    row, column, label = F.col("row"), lambda name: F.col(name) if name in rows.columns else F.lit(None), F.lit
    found = made((row, CONTENT, label("text"), F.col("text")), (row, CONTENT, label("summary"), column("summary")), (row, ATTRIBUTE, label("timestamp_ms"), F.col("timestamp").cast("string")))
    if "terms" in rows.columns:
        found = F.concat(found, F.coalesce(F.transform("terms", lambda t: made((F.concat(F.lit(TERM), t), POSTING, F.col("id"), label("1")))[0]), none))
    out = cells(rows, found)
    # Vectors and entities may come from Python functions; each has a pass of its own.
    if asked(VECTOR):
        # As rows of one each, so that Spark does not fold the model's expression into the packing.
        held = rows.select("row", "timestamp", F.explode(F.array(embed(F.col("text")))).alias("vector"))
        out = out.unionByName(held.select(row.cast("binary").alias("row"), b(VECTOR).alias("cf"), b("embedding").alias("cq"), b("").alias("cv"), "timestamp", F.lit(False).alias("deleted"), words.pack_vector("vector").alias("value")))
    if asked(EDGES["entity"], CONTENT, ATTRIBUTE):
        of = lambda e: F.concat(F.lit(ENTITY), e["id"])
        named = F.transform("entities", lambda e: made((row, EDGES["entity"], e["id"], one), (of(e), CONTENT, label("label"), e["label"]), (of(e), ATTRIBUTE, label("type"), e["type"]), (of(e), ATTRIBUTE, label("extractedFrom"), F.col("id"))))
        said = rows.select("id", "row", "timestamp", entities(F.col("text")).alias("entities"))
        out = out.unionByName(cells(said, F.flatten(named)))
    if asked(EDGES["temporal"]):
        chain = with_previous(rows.select("id", "row", "timestamp"), "id", "before").filter("before is not null")
        out = out.unionByName(cells(chain, made((row, EDGES["temporal"], F.col("before"), one))))
    return out


def consolidate(nodes: DataFrame, edges: DataFrame, infer: Callable[[Column], Column], timestamp: int, hops: int = 2) -> DataFrame:
    """Edge cells from each node to those within ``hops`` of temporal edges, as ``infer`` says of the neighbourhood's text: causal (0.7), entity (0.5), both or none.

    nodes (id, content), edges (src, rel, dst). A neighbourhood is one row; it is what a model is asked about.
    """
    step = edges.filter("rel = 'temporal'").select("src", "dst").distinct()
    pairs = reach = step.select(F.col("src").alias("id"), F.col("dst").alias("to"))
    for _ in range(hops - 1):
        reach = reach.join(step, reach["to"] == step["src"]).select("id", F.col("dst").alias("to"))
        pairs = pairs.union(reach)
    pairs = pairs.filter("id <> to").distinct().join(nodes.select(F.col("id").alias("to"), "content"), "to")
    own = nodes.select("id", F.col("id").alias("to"), "content").join(pairs.select("id").distinct(), "id", "left_semi")
    around = pairs.select("id", "to", "content").union(own).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("to", "content"))).alias("near"))
    told = around.withColumn("told", infer(F.array_join(F.transform("near", lambda n: F.concat(n["to"], F.lit(" "), n["content"])), "\n")))
    found = told.select("id", "told", F.explode("near.to").alias("to")).filter("id <> to")
    raw = lambda c: c.cast("binary")

    def linked(kind: str, weight: float) -> DataFrame:
        rows = found.filter(F.contains("told", F.lit(kind)))
        return rows.select(raw(F.concat(F.lit(EVENT), "id")).alias("row"), raw(F.lit(EDGES[kind])).alias("cf"), raw(F.col("to")).alias("cq"), raw(F.lit("")).alias("cv"), F.lit(timestamp).cast("long").alias("timestamp"), F.lit(False).alias("deleted"), words.pack_weight(F.lit(weight)).alias("value"))

    return linked("causal", 0.7).union(linked("entity", 0.5))


# -- retrieval ------------------------------------------------------------------------------------


def analyze(question: str, day: str) -> dict:
    """Intent, keywords and, for a question about today, the rows of ``day`` (yyyyMMdd)."""
    said = re.findall("[a-z0-9]+", question.lower())
    intent = next((name for name, told in words.INTENTS.items() if set(told) & set(said)), "GENERAL")
    terms = sorted({w for w in said if len(w) >= 3 and w not in words.STOP})[:8]
    return {"intent": intent, "terms": terms, "rows": words.day_rows(day) if "today" in question.lower() else None}


def retrieve(
    nodes: DataFrame, edges: DataFrame, postings: DataFrame, query: list[float], terms: list[str], intent: str = "GENERAL",
    cells: DataFrame | None = None, rows: tuple[str, str] | None = None, anchors: int = 6, beam: int = 8, depth: int = 2,
) -> DataFrame:
    """(id, content, timestamp, score, depth, place) for nodes (id, content, vector, timestamp), edges (src, rel, dst), postings (term, id).

    Anchors are fused from the nearest vectors, the postings, and, with ``cells``, the events of the first 8 * anchors
    cells of ``rows`` or of all events. ``place`` is by time for WHEN, else by score.
    """
    near = rank.ranks(rank.knn(nodes.filter("vector is not null"), query, anchors), F.col("score").desc(), F.col("id"), limit=anchors)
    lists = [near, rank.ranks(postings.filter(F.col("term").isin(terms)).select("id").distinct(), F.col("id"), limit=anchors * 8)]
    if cells is not None:
        start, end = rows or (EVENT, EVENT[:-1] + chr(ord(EVENT[-1]) + 1))
        first = in_key_order(scan_range(cells, start, end, True, False), anchors * 8)
        ids = first.select(F.substring(F.col("row").cast("string"), len(EVENT) + 1, 1 << 30).alias("id")).distinct()
        lists.append(rank.ranks(ids, F.col("id"), limit=anchors * 8))
    fused = rank.fuse(lists).orderBy(F.col("score").desc(), "id").limit(anchors)
    weight = F.lit(0.5)
    for rel, w in WEIGHTS[intent].items():
        weight = F.when(F.col("rel") == rel, w).otherwise(weight)
    target = F.array(*[F.lit(float(x)) for x in query])
    alike = nodes.select("id", F.when(F.col("vector").isNotNull(), rank.similarity(F.col("vector"), target)).otherwise(0.0).alias("sim"))
    spark = nodes.sparkSession
    fields = "id string, score double, depth int"
    # At most ``anchors`` rows here, and ``beam`` a hop below.
    seen = frontier = [(r["id"], 1.0 / (1 + i), 0) for i, r in enumerate(sorted(fused.collect(), key=lambda r: (-r["score"], r["id"])))]
    for d in range(1, depth + 1):
        if not frontier:
            break
        start = spark.createDataFrame([(x[0],) for x in frontier], "src string")
        known = spark.createDataFrame([(x[0],) for x in seen], "id string")
        steps = edges.join(F.broadcast(start), "src").select(F.col("dst").alias("id"), weight.alias("w")).groupBy("id").agg(F.max("w").alias("w"))
        steps = steps.join(F.broadcast(known), "id", "left_anti").join(alike, "id")
        steps = steps.select("id", (F.col("w") * 0.7 + F.col("sim") * 0.3 + (depth - d + 1) * 0.01).alias("score"))
        frontier = [(r["id"], r["score"], d) for r in steps.orderBy(F.col("score").desc(), "id").limit(beam).collect()]
        seen = seen + frontier
    found = spark.createDataFrame(seen, fields)
    out = nodes.filter("content is not null").join(F.broadcast(found), "id").select("id", "content", "timestamp", "score", "depth")
    order = [F.col("timestamp"), F.col("id")] if intent == "WHEN" else [F.col("score").desc(), F.col("id")]
    return out.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))  # anchors + depth * beam rows


def synthesize(rows: list[tuple[int, str, str]], budget: int = 160) -> str:
    """Lines of (time, id, text) within a budget of words: what does not fit is cut, or left out once half the budget is used."""
    out, used = [], 0
    for when, ref, said in rows:
        said = said.split()
        if used + len(said) > budget:
            said = [] if used >= budget // 2 else said[: budget - used]
        if said:
            out.append(f"[<t:{when}> {' '.join(said)} <ref:{ref}>]")
            used += len(said)
    return "\n".join(out)
