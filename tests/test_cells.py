"""Cell semantics on small tables."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import aggregate, cells, documents, graph, rank
from cellweave.operators.visibility import allows
from cellweave.schema import cells as made

#: The cells and ceilings of the as-of scenario that every reader of this model agrees on.
ROWS = [("r1", "cf", "a", "", 30, False, "v30"), ("r1", "cf", "a", "", 20, False, "v20"), ("r1", "cf", "a", "", 10, False, "v10"), ("r1", "cf", "b", "", 25, False, "b25"), ("r2", "cf", "a", "", 15, False, "r2a")]


def values(df):
    return sorted(bytes(r["value"]).decode() for r in df.collect())


@pytest.mark.parametrize(("ceiling", "wanted"), [(20, ["r2a", "v10", "v20"]), (None, ["b25", "r2a", "v10", "v20", "v30"]), (0, ["b25", "r2a", "v10", "v20", "v30"]), (-5, ["b25", "r2a", "v10", "v20", "v30"])])
def test_as_of(spark, ceiling, wanted):
    assert values(cells.as_of(made(spark, ROWS), ceiling)) == wanted


@pytest.mark.parametrize(("ceiling", "wanted"), [(15, ["v10"]), (35, ["v30"]), (50, [])])
def test_as_of_then_delete_then_version(spark, ceiling, wanted):
    table = made(spark, [("r1", "cf", "a", "", 40, True, ""), ("r1", "cf", "a", "", 30, False, "v30"), ("r1", "cf", "a", "", 10, False, "v10")])
    assert values(cells.resolve(table, ceiling)) == wanted


@pytest.mark.parametrize(("label", "auths", "wanted"), [("", [], True), ("A", [], False), ("A&B", ["A"], False), ("A|B&C", ["A"], True), ("(A|B)&C", ["C", "B"], True), ("(A|B)&C", ["A"], False), ('"x y"&A', ["x y", "A"], True), ("A&", ["A"], False), ("(A", ["A"], False)])
def test_labels(label, auths, wanted):
    assert allows(label, frozenset(auths)) is wanted


def test_versions_and_prefix_of_empty_table(spark):
    empty = made(spark, [])
    assert cells.versioning(empty, 2).count() == cells.scan_prefix(empty, "r").count() == cells.resolve(empty, auths=["A"]).count() == 0


def test_fail_on_tombstone(spark):
    table = made(spark, [("r", "f", "q", "", 1, True, "")])
    with pytest.raises(Exception, match="tombstone"):
        cells.deleting(table, behavior="fail").collect()


@pytest.mark.parametrize(("op", "wanted"), [("count", 4), ("sum", 9.0), ("min", 1.0), ("max", 5.0), ("avg", 3.0)])
def test_aggregates(spark, op, wanted):
    table = made(spark, [("r1", "m", str(i), "", 1, False, v) for i, v in enumerate(["1", "3", "5", "n/a"])])
    assert [r["result"] for r in aggregate.aggregate(table, op).collect()] == [wanted]


def test_binary_numbers(spark):
    import struct

    table = made(spark, [("r1", "m", "a", "", 1, False, struct.pack(">d", -2.5)), ("r1", "m", "b", "", 1, False, struct.pack(">f", 0.75))])
    assert aggregate.aggregate(table, "sum").first()["result"] == -1.75


def test_hops_stop_at_first_visit(spark):
    edges = spark.createDataFrame([("a", "t", "b"), ("b", "t", "c"), ("c", "t", "a"), ("a", "t", "c")], "src string, rel string, dst string")
    found = graph.expand_hops(edges, spark.createDataFrame([("a",)], "id string"), 3)
    assert sorted((r["id"], r["hop"]) for r in found.collect()) == [("b", 1), ("c", 1)]


def test_fusion_counts_a_repeated_id_once(spark):
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, rank int")
    assert {r["id"]: round(r["score"], 9) for r in rank.fuse([one, one]).collect()} == {"a": round(2 / 61, 9), "b": round(2 / 63, 9)}


def test_no_terms_find_nothing(spark):
    index = spark.createDataFrame([("s", "en", "1", "LANG", "en")], "shard string, datatype string, uid string, field string, value string")
    assert documents.by_fields(index, []).count() == 0
    assert documents.by_fields(index, [("LANG", "en")]).count() == 1


def test_derived_edges_have_no_caps(spark):
    """Vectors alike in pairs, more than the sizes at which edges were left out."""
    n = 10_050
    v = spark.range(n).withColumn("h", F.floor(F.col("id") / 2)).select(
        "id", F.concat(F.array(F.cos(F.col("h") * 0.001), F.sin(F.col("h") * 0.001)), F.array_repeat(F.lit(0.0), (F.col("h") % 50).cast("int"))).alias("vector"), F.lit("").alias("label"), F.lit("c").alias("cell"), F.lit(1).alias("timestamp"))
    small = 1 - 1e-9
    wanted = {(i, i + 1) for i in range(0, n, 2)}
    assert {(r["a"], r["b"]) for r in graph.latent_edges(v.filter("id < 1200"), small, block=256).collect()} == {p for p in wanted if p[0] < 1200}
    assert {(r["src"], r["dst"]) for r in graph.semantic_edges(v, small).collect()} == wanted | {(b, a) for a, b in wanted}
