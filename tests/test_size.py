"""Work that grew faster than its input, and rows that small tables do not have."""

import time

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from cellweave import catalog
from cellweave.operators import graph


def test_all_pairs_of_vectors_in_seconds(spark):
    """8 million pairs, against a product of matrices; took minutes when each pair was a row."""
    x = np.random.default_rng(1).normal(size=(4000, 64)).astype("f4")
    v = spark.createDataFrame([(i, row.tolist(), f"l{i % 2}") for i, row in enumerate(x)], "id long, vector array<float>, label string").cache()
    v.count()
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    p, q = np.nonzero(np.triu(unit @ unit.T >= 0.35, 1))
    began = time.time()
    found = {(r["src"], r["dst"]): r for r in graph.semantic_edges(v, 0.35, per_vertex=0, both_ways=False, block=700).collect()}
    cells = {(r["a"], r["b"]) for r in graph.latent_edges(v.select(F.lit("c").alias("cell"), "id", "vector", F.lit(1).alias("timestamp")), 0.35, block=1500).collect()}
    assert time.time() - began < 40
    assert set(found) == cells == set(zip(p.tolist(), q.tolist(), strict=True)) and len(cells) > 1000
    for (a, b), r in found.items():
        assert abs(r["similarity"] - unit[a] @ unit[b]) < 1e-12 and r["label"] == ("l0&l1" if a % 2 != b % 2 else f"l{a % 2}")


@pytest.mark.parametrize("threshold", [0.9, -0.5])
def test_pairs_of_odd_vectors(spark, threshold):
    """Zeros, nulls, NaN, other dimensions, repeated and missing ids: as similarity() has them."""
    from cellweave.operators.rank import similarity

    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 1e-9]), ("c", [0.0, 0.0]), ("d", [1.0, None]), ("e", [nan, 1.0]), ("f", [inf, 1.0]), ("g", [1.0]), ("h", [3.0]), ("i", []), ("j", []), ("k", None), (None, [1.0, 0.0]), ("a", [1.0, 0.1]), ("l", [-1.0, 0.2])]
    v = spark.createDataFrame(rows, "id string, vector array<float>").withColumn("label", F.lit(""))
    a, c = v.select(F.col("id").alias("a"), F.col("vector").alias("x")), v.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    wanted = a.join(c, F.col("a") < F.col("b")).filter(F.size("x") == F.size("y")).withColumn("s", similarity(F.col("x"), F.col("y"))).filter(F.col("s") >= threshold)
    found = graph.semantic_edges(v, threshold, per_vertex=0, both_ways=False, block=3)
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert plain(found.select("src", "dst", "similarity").collect()) == plain(wanted.select("a", "b", "s").collect())


def test_documents_without_keywords_and_terms_of_null_types(spark, duck, tmp_path):
    """The SQL of document_and finds documents with a keyword; that of the term counts has terms of a null language too."""
    rows = [(1, "see the example", "en", "src3"), (2, "a b !", "en", "src3"), (3, None, "en", "src3"), (4, "an example", None, "src3"), (5, "example", "de", "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("document_and", "document_or", "forward_index", "reverse_index", "term_phrase"):
        found, wanted = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.SQL[name])
        names = [d[0] for d in wanted.description]
        assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall())), name


def test_fields_are_made_in_one_pass(spark, capsys):
    """The shard is told once for a document, no row is sorted, and terms are counted without listing ids."""
    from cellweave.sources import tables

    tables.document_fields(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "octet_length" in plan and "octet_length" not in plan.split("Generate")[0] and "Exchange" not in plan
    for name in ("forward_index", "reverse_index"):
        catalog.QUERIES[name](spark, SF).explain()
        assert "Window" not in capsys.readouterr().out


def test_texts_are_ingested_without_a_shuffle(spark, capsys):
    """Entities are found in one pass, vectors in one; only ids are ordered."""
    from cellweave.functions import text

    catalog.QUERIES["memory_ingest"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("[entities(") == 1 and plan.count("[pack_vector(") == 1
    d = spark.createDataFrame([("One two",), ("",), (None,)], "t string")
    raw = lambda i: F.conv(F.substring(F.sha2(F.concat(i.cast("string"), F.lit(":"), F.lower("t")), 256), 1, 8), 16, 10).cast("long")
    v = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (raw(i) % 2_000_000) / F.lit(1_000_000.0) - 1.0)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    assert d.filter(~text.test_vector(F.col("t"), 4).eqNullSafe(F.transform(v, lambda x: (x / norm).cast("float")))).count() == 0


def test_cells_are_sorted_and_joined_in_bounded_tasks(spark, capsys, monkeypatch):
    """Sorted tables are dealt by their number of rows; row keys are hashed, not cells sorted; labels move no cell."""
    from cellweave.operators import cells, index, visibility
    from cellweave.schema import CELL
    from cellweave.sources import scratch

    monkeypatch.setattr(scratch, "SORTED", 100)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    held = scratch.kept(spark, ("test", "dealt"), lambda: df, ["x"], lambda: 1000)
    ranges = [tuple(r) for r in held.groupBy(F.input_file_name()).agg(F.min("x").alias("a"), F.max("x"), F.count("x")).orderBy("a").collect()]
    assert len(ranges) >= 8 and sum(r[3] for r in ranges) == 1000 and all(p[2] < q[1] for p, q in zip(ranges, ranges[1:], strict=False))
    raw = lambda x: bytearray(x.encode())
    rows = [(raw(f"r{i}"), raw("f"), raw("q"), raw(["", "A", "A&B", "B|A", "&"][i % 5]), i, False, raw("v")) for i in range(50)]
    table = spark.createDataFrame(rows, CELL).repartition(3).cache()
    keys = spark.createDataFrame([(raw("r1"),), (raw("r7"),), (raw("none"),)], "row binary")
    found = cells.of_rows(table, keys)
    found.explain()
    assert "ShuffledHashJoin" in capsys.readouterr().out and sorted(bytes(r["row"]) for r in found.collect()) == [b"r1", b"r7"]
    assert index.edge_expand(table, keys, hops=2).count() == 0
    seen = visibility.visible(table, ["A"])
    seen.explain()
    assert "Join" not in capsys.readouterr().out and sorted(r["timestamp"] for r in seen.collect()) == [i for i in range(50) if i % 5 in (0, 1, 3)]
