"""The data-pipeline operators against SQL, brute force, round trips and held-out labels, and their edge cases."""

import hashlib
import re
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from cellweave.llm import chat, common, components, fingerprint, mixing, near_dedup, pieces, pii, quality, sharding, substring_dedup, topk
from cellweave.llm.queries import QUERIES, SQL

SEPARATORS = r"[^\x20\x09-\x0D]+"
LONG = "lorem ipsum " * 40_000
ODD = [
    (1, "a b c d e f g h i j k l m n o p", "en", "s1", 31), (2, "a b c d e f g h i j k l m n o p", "en", None, 31), (2, "a b c d e f g h i j k l m n o p", "en", None, 31),
    (3, None, None, "s1", None), (4, "", "en", "s2", 0), (None, "x y z", "de", "s2", 5), (5, LONG, "en", "s3", 480_000), (6, "one two", None, None, 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "clash") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, size long, kept string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(same, name):
    same(QUERIES[name], SQL[name])


# -- 1 --------------------------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall(SEPARATORS, (text or "").lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and (n := len(sets[a] & sets[b])) * den >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in sets}


def test_near_duplicates_five_words(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], *([f"u{i}"] if i % 3 else []), *base[30:]])) for i in range(40)]
    rows += [(100 + i, " ".join([*base[:12], *(f"o{i}x{j}" for j in range(30))])) for i in range(40)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute_components(rows, 5, 80, 100)


def test_near_duplicates_odd_rows(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert (by_id[3]["n_shingles"], by_id[3]["component_id"], by_id[6]["n_shingles"]) == (0, 3, 1)
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_in_plans_of_bounded_size(spark, docs, monkeypatch):
    """Each table is written by a plan of few exchanges, as the driver runs all of a plan's at once; one had dozens."""
    counts = []

    def counted(df, label):
        counts.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return common.saved(df, label)

    for module in (near_dedup, components):
        monkeypatch.setattr(module, "saved", counted)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert len(counts) > 10 and max(counts) <= 7
    assert found == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)


# -- 2 --------------------------------------------------------------------------------------------


def test_chat_windows_keep_to_the_budget(spark):
    turns = [(1, 0, "system", "be kind"), *[(1, i, "user" if i % 2 else "assistant", f"turn {i} " * 20) for i in range(1, 60)], (2, 0, None, None), (3, 0, "assistant", "\\b<|im_end|>\\n<\\|"), (3, 0, "assistant", "\\b<|im_end|>\\n<\\|")]
    made = chat.windows(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), budget=300, history=60)
    got = chat.read_back(made).orderBy("conv_id", "window").collect()
    assert all(len(r["formatted"].encode()) / 4 <= 300 for r in got)
    ones = [r for r in got if r["conv_id"] == 1]
    assert all(r["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>") for r in ones) and any(r["n_repeated"] > 1 for r in ones)
    assert [t for r in ones for t in r["targets"]] == [t[3] for t in turns if t[0] == 1 and t[2] == "assistant"]
    told = {c: [(t["role"], t["text"]) for r in got if r["conv_id"] == c for t in r["turns"]] for c in (1, 2, 3)}
    assert told == {c: [(t[2] or "", t[3] or "") for t in turns if t[0] == c] for c in (1, 2, 3)}


def test_chat_history_beyond_one_window(spark, tmp_path):
    import duckdb

    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", "s" * 4096 if t == 0 else "w" * (20 + (37 * t + c) % 90)) for c in range(3) for t in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    wanted = con.execute(SQL["op2_chat"])
    names = [d[0] for d in wanted.description]
    assert sorted(tuple(r) for r in QUERIES["op2_chat"](spark, str(tmp_path)).select(*names).collect()) == sorted(wanted.fetchall())


# -- 3 --------------------------------------------------------------------------------------------


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (7, [1.0, 2.0, 3.0]), (8, [])]
    got = topk.top_k(spark.createDataFrame(rows, "id long, v array<double>"), F.col("id") == 0, 5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 5), (2, 2, 5)]


# -- 4 --------------------------------------------------------------------------------------------


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    text, out = text or "", []
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for k, (pattern, good) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return hashlib.sha256(",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(out)).encode()).hexdigest()


def test_pii_matches_plain_patterns(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in QUERIES["op4_pii"](spark, SF).collect():
        assert r["base_sha256"] == brute_base(texts[r["doc_id"]]), r["doc_id"]


def test_pii_kinds_and_redaction(spark):
    rows = [("mail a.b@c.de, 💡 card 4111 1111 1111 1111", "mail <EMAIL>, 💡 card <CARD>"), ("my bank iban DE89370400440532013000", "my bank iban <IBAN>"), ("999.1.1.1 then 10.0.0.1", "999.1.1.1 then <IP>"), ("call +49 (30) 1234-5678", "call <PHONE>"), ("config password=abcdefghijklmnop", "config <SECRET>"), (None, None), ("", ""), ("plain", "plain")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, text string")
    assert [r["text"] for r in pii.redact(pii.find_pii(df)).orderBy("i").collect()] == [r[1] for r in rows]


# -- 5 --------------------------------------------------------------------------------------------


def plain_cost(text, v):
    best = [0.0] + [float("inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + v.byte_cost * len(text[end - 1].encode())
        for start in range(max(0, end - v.longest), end):
            if text[start:end] in v.cost:
                best[end] = min(best[end], best[start] + v.cost[text[start:end]][0])
    return best[-1]


def test_viterbi_is_cheapest():
    v = pieces.Vocabulary()
    price = {i: c for c, i in v.cost.values()} | dict.fromkeys(v.bytes, v.byte_cost)
    for text in ("▁The▁quick▁brown▁fox", "▁" + "abcde" * 60, "▁Größe▁漢字💡", "▁" + "=" * 200):
        assert sum(price[i] for i in pieces.viterbi(text, v)) == pytest.approx(plain_cost(text, v))


def test_round_trip(spark, odd):
    assert QUERIES["op5_sentencepiece"](spark, SF).filter("not round_trip").count() == 0
    for r in pieces.decode(pieces.encode(odd)).collect():
        assert r["decoded"] == r["text"] and (r["ids"] is None) == (r["text"] is None)


# -- 6 --------------------------------------------------------------------------------------------


def test_quality_on_labels_left_out(spark):
    sf = "/root/testdata/sf0.1"  # 974 labels held out; at sf0.01 it is 96, and the rest teaches little
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("test", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    out = quality.classify(docs, labels.filter("not test").drop("test"))
    tested = out.join(labels.filter("test"), "doc_id").select("kept", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    right = tested.filter("kept = good").count() / tested.count()
    assert right >= 0.9, right


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(odd.drop("kept"), none)
    assert out.count() == len(ODD) and out.filter("not kept").count() == 0


# -- 7 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("sizes", "weights"), [([100, 10, 5], [1, 2, 3]), ([1, 1, 1000], [1, 2, 3]), ([50], [1]), ([0, 10], [1, 2]), ([7, 7, 7, 7000, 3], [1, 2, 3, 1, 2])])
def test_water_filling_matches_rounds(spark, sizes, weights):
    rows = [(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
    got = {r["source"]: r["target"] for r in mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight int")).collect()}
    wanted, free, total = {}, list(rows), float(sum(sizes))
    while free:
        unit = (total - sum(wanted.values())) / sum(w for *_, w in free)
        above = [r for r in free if unit * r[2] > 3 * r[1]]
        if not above:
            wanted |= {n: unit * w for n, _, w in free}
            break
        wanted |= {n: 3.0 * s for n, s, _ in above}
        free = [r for r in free if r not in above]
    assert got == pytest.approx(wanted)


def test_mix_meets_its_targets(spark):
    rows = QUERIES["op7_mixing"](spark, SF).collect()
    again = {r["doc_id"]: r["taken"] for r in QUERIES["op7_mixing"](spark, SF).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.02 * t + 50 for s, t in target.items())


# -- 8 --------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs):
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op8_fingerprint"](spark, SF).collect()}
    seen = {}
    for (i, text), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (edited != text or r["near_edited"] == 1)
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        parts = [set(re.findall(r"[^\n]{1,200}", t)) for t in (text, edited, following)]
        likeness = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0
        assert r["n_recovered"] == len(parts[0] ^ parts[1])
        assert r["near_edited"] == pytest.approx(likeness(parts[0], parts[1])) and r["near_next"] == pytest.approx(likeness(parts[0], parts[2]))


def test_fingerprints_recover_large_differences(spark):
    pairs = [(n, n + m, m) for n in (1, 40, 300, 1500) for m in (1, 30, 150, 700)]
    df = spark.createDataFrame([("\n".join(f"l{i}" for i in range(n)), "\n".join(f"l{i}" for i in range(m, k))) for n, k, m in pairs], "a string, b string")
    df = df.select(*[fingerprint.digests(F.col(c)).alias(c) for c in "ab"])
    df = df.select("a", "b", *[fingerprint.sketch(F.col(c), 12).alias(f"s{c}") for c in "ab"])
    for r in fingerprint.compare(df, "a", "b", "sa", "sb", "near").collect():
        a, b, p = set(r["a"]), set(r["b"]), r["near_peeled"]
        assert p["ok"] and sorted(p["only_first"]) == sorted(a - b) and sorted(p["only_second"]) == sorted(b - a)
        assert r["near"] == pytest.approx(1 - len(a ^ b) / (len(a) + len(b)))


# -- 9 --------------------------------------------------------------------------------------------


def test_repeats_odd_rows(odd):
    got = substring_dedup.without_repeats(odd).collect()
    assert len(got) == len(ODD)
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got}
    assert removed[1] == (16, 0) and removed[2] == (16, 16) and removed[3] == removed[4] == (0, 0) and removed[5] == (80_000, 0) and removed[None] == (3, 0)
    assert substring_dedup.without_repeats(odd.limit(0)).count() == 0


# -- 10 -------------------------------------------------------------------------------------------


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 2000, 7)]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), 16).alias("s")).collect()
    assert all((r["s"]["shard"], r["s"]["grown"]) == (jump(r["k"], 16), jump(r["k"], 17)) for r in got)


def test_slots_are_gapless(spark, odd):
    rows = QUERIES["op10_sharding"](spark, SF).collect()
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    assert sharding.shard(odd, "doc_id", 16, ["doc_id"]).count() == len(ODD)
    assert sharding.shard(odd.limit(0), "doc_id", 16, ["doc_id"]).count() == 0


# -- the other operators on empty tables and odd rows ----------------------------------------------


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert pii.redact(pii.find_pii(none)).count() == pieces.encode(none).count() == 0
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "id long, v array<double>"), F.lit(True), 5).count() == 0
    assert mixing.repetitions(none.select("doc_id", "source", "size")).count() == 0
    assert mixing.repetitions(odd.select("doc_id", "source", F.lit(3).cast("long").alias("size"))).count() == len(ODD)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    before = docs
    for name, stage in p.STAGES:
        after = stage(spark, before, SF)
        assert after.columns == p.COLUMNS + (["ids", "n_ids"] if name == "sentencepiece" else []), name
        rows = after.collect()
        if name in ("quality", "near_dedup"):
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.select("doc_id").collect()} and len(rows) > 0.5 * before.count()
        before = spark.createDataFrame(rows, after.schema)
    assert p.run(spark, SF).count() == before.count()
