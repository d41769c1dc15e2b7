import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions.vectors import cosine, hash_embedding
from gridlark.operators import documents as C
from gridlark.operators import search as Q


def reference_vector(text):
    out = []
    for i in range(48):
        out += [(b - 128) / 128 for b in hashlib.sha256(f"{text.lower()}_{i}".encode()).digest()]
    return out


@pytest.mark.parametrize("text", ["", "Hello World", "Éléphant №1", "a" * 5000])
def test_hash_embedding_twice_the_same(spark, text):
    expected = reference_vector(text)
    assert list(Q.hash_vector(text)) == expected
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(hash_embedding(F.col("t"))).first()[0] == expected
    assert df.select(hash_embedding(F.col("t"), 40)).first()[0] == expected[:40]
    assert Q.embed(df, "t").first()["embedding"] == expected


def test_embed_builds_the_encoder_in_the_task(spark):
    def factory():
        return lambda texts: [np.array([float(len(t)), 1.0]) for t in texts]

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r["embedding"] for r in Q.embed(df, "t", factory).collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_cosine_of_nothing_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] is None and math.isclose(got[1], 1.0)


def texts(spark):
    rows = [(f"d{i:02d}", t) for i, t in enumerate(
        ["alpha beta", "ALPHA", "gamma", "alphabet soup", "", "beta gamma delta", None, "to be"] * 3
    )]
    return spark.createDataFrame(rows, "id string, body string")


def test_keyword_against_brute_force(spark):
    query = "Alpha, to gamma gamma!"
    df = texts(spark)
    words = re.findall(r"\b\w+\b", query.lower())
    long = [w for w in words if len(w) > 2]
    hits = []
    for r in df.collect():
        body = (r["body"] or "").lower()
        if r["body"] is not None and any(w in body for w in words):
            hits.append((-round(sum(w in body for w in long) / len(long), 6), r["id"]))
    expected = [(i, -s) for s, i in sorted(hits)[:10]]
    got = Q.keyword_search(query, {"c": Q.Collection(df, "id", "body")})
    assert [(r["hit_id"], r["score"]) for r in got.collect()] == expected


def test_keyword_limits_per_collection_and_overall(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("alpha").alias("body"))
    tables = {n: Q.Collection(df, "id", "body") for n in ("a", "b", "c")}
    got = Q.keyword_search("alpha", tables).groupBy("collection").count().collect()
    assert {r["collection"]: r["count"] for r in got} == {"a": 10, "b": 10}


def test_short_words_find_but_do_not_score(spark):
    got = Q.keyword_search("to", {"c": Q.Collection(texts(spark), "id", "body")}).collect()
    assert {r["score"] for r in got} == {0.0} and len(got) == 3


def vectors(spark, n=300, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.integers(-3, 4, size=(n, dims)).astype(float)
    data[5] = 0.0
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "doc_id bigint, embedding array<double>")


def brute(query, data, k):
    scored = []
    for i, v in enumerate(data):
        length = np.linalg.norm(v) * np.linalg.norm(query)
        if length > 0:
            scored.append((-round(float(query @ v) / length, 6) + 0.0, i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_near_ties_are_ranked_by_the_full_score(spark):
    rows = spark.createDataFrame([(1, "far", [1.0, 3e-4]), (2, "near", [1.0, 0.0])], "id int, text string, embedding array<double>")
    table = {"v": Q.Collection(rows, "id", "text")}
    assert [r["hit_id"] for r in Q.vector_search([1.0, 0.0], table, k=1).collect()] == ["2"]
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<double>")
    many = Q.vector_search_batch(queries, rows.withColumnRenamed("id", "doc_id"), 1).collect()
    assert [(r["doc_id"], r["score"]) for r in many] == [(2, 1.0)]


def test_answer_names_a_missing_collection(spark):
    with pytest.raises(ValueError, match="rag_sigint"):
        Q.answer("strong radar emission", {}, "keyword")


def test_vector_search_is_exact(spark):
    data, df = vectors(spark)
    rows = df.select(F.lpad(F.col("doc_id").cast("string"), 4, "0").alias("id"), "embedding", F.lit("t").alias("text"))
    got = Q.vector_search(data[0], {"v": Q.Collection(rows, "id", "text")}, k=7).collect()
    assert [(int(r["hit_id"]), r["score"]) for r in got] == [(i, pytest.approx(s)) for i, s in brute(data[0], data, 7)]


@pytest.mark.parametrize("block_bytes", [64, 500, 1 << 20])
def test_batch_search_is_exact_for_any_block_size(spark, block_bytes):
    data, df = vectors(spark)
    queries = df.where(F.col("doc_id") < 12).withColumnRenamed("doc_id", "query_id")
    got = Q.vector_search_batch(queries, df.repartition(5), 6, block_bytes=block_bytes)
    by_query = {}
    for r in got.orderBy("query_id", "rank").collect():
        by_query.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert set(by_query) == set(range(12)) - {5}
    for q, hits in by_query.items():
        assert hits == [(i, pytest.approx(s, abs=1e-9)) for i, s in brute(data[q], data, 6)]


def test_batch_search_without_queries(spark):
    _, df = vectors(spark, 9)
    none = df.where("false").withColumnRenamed("doc_id", "query_id")
    assert Q.vector_search_batch(none, df, 3).count() == 0


def test_hybrid_merges_known_ids_only(spark):
    def hits(rows):
        return spark.createDataFrame(
            rows, "collection string, hit_id string, text string, line string, merge_key string, score double, priority int"
        )

    keyword = hits([("a", "1", "t", "l", "1", 0.5, 0), ("k", "9", "t", "l", "k/9", 0.4, 1)])
    semantic = hits([("b", "1", "t", "l", "1", 0.9, 0), ("k", "9", "t", "l", "k/9", 0.8, 1), ("a", "2", "t", "l", "2", 0.7, 0)])
    got = Q.union_hybrid_results(keyword, semantic).orderBy("rank").collect()
    assert [(r["collection"], r["hit_id"], r["origin"]) for r in got] == [
        ("a", "1", "keyword"), ("k", "9", "keyword"), ("k", "9", "semantic"), ("a", "2", "semantic"),
    ]
    assert {r["total"] for r in got} == {4}


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], "rank int, total int, collection string, line string")
    row = Q.summarise(none, "q?", None).first()
    assert row["result_count"] == 0 and row["response"].startswith("No results found for your query: 'q?'")


def test_intent(spark):
    cases = {
        "hostile Russian jets": ("AIR", "RU", "HOSTILE", None),
        "status of the fleet": ("MARITIME", "US", None, None),
        "russian and chinese malware, critical or high": ("CYBER", "CN", None, "CRITICAL"),
        "russia": (None, "RU", None, None),
        "friendly radar high": ("SIGINT", None, "FRIENDLY", "HIGH"),
        "zzz": (None, None, None, None),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").withColumn("i", Q.extract_intent(F.col("q")))
    for r in df.select("q", "i.domain", "i.filters.*").collect():
        assert (r["domain"], r["country"], r["iff_mode"], r["severity"]) == cases[r["q"]]
        assert Q.intent_of(r["q"]) == r["domain"]


@pytest.mark.parametrize("separator", ["\n\n", "\n", "|", "--"])
def test_chunks_against_python(spark, separator):
    docs = ["one" + separator + "  two words\t" + separator + separator + " " + separator + "três é\nx", "", "   ", "solo"]
    df = spark.createDataFrame(list(enumerate(docs)), "document_id int, content string")
    expected = []
    for i, content in enumerate(docs):
        parts = [p.strip() for p in content.split(separator) if p.strip()]
        expected += [(f"{i}-{n:03d}", p, len(p.split()), len(p)) for n, p in enumerate(parts)]
    got = C.chunk(df, separator).collect()
    assert sorted((r["chunk_id"], r["content"], r["word_count"], r["char_count"]) for r in got) == sorted(expected)


def test_chunk_index_grows_past_its_width(spark):
    df = spark.createDataFrame([("d", "\n\n".join(str(i) for i in range(1002)))], "document_id string, content string")
    ids = {r["chunk_id"] for r in C.chunk(df).collect()}
    assert "d-007" in ids and "d-1001" in ids


def test_embedding_text_is_whole(spark):
    df = spark.createDataFrame(
        [(["x", "y"], (1, "z"), "long " * 300), (None, None, "  ")],
        "tags array<string>, s struct<a: int, b: string>, body string",
    )
    got = C.embedding_text(df, ("tags", "s", "absent", "body"), 20).collect()
    assert [r["text_preview"] for r in got] == ["x y 1 z long long lo"]
    assert len(got[0]["text_content"]) > 1000


def test_naval_document_without_aircraft(make):
    base = {"vessel_id": "V", "iff_mode": "FRIENDLY", "country": "ZZ", "displacement_tons": 12000, "lat": 1.0, "lon": -2.0}
    docs = C.build_documents(make("naval", [{**base, "aircraft_capacity": n} for n in (0, 40, None)]), "naval")
    texts_ = [r["rag_text"] for r in docs.orderBy("seq").collect()]
    assert texts_[0].endswith("Weapons: Unknown.") and texts_[2] == texts_[0]
    assert texts_[1].endswith("Aircraft capacity: 40 aircraft.")
    assert "12,000 tons" in texts_[0] and "is a friendly unknown class vessel" in texts_[0]
    first = docs.first()
    assert first["location"]["coordinates"] == [-2.0, 1.0] and first["threat_level"] == "FRIENDLY"


def test_answer_routes_by_domain(spark):
    df = texts(spark).withColumn("embedding", F.array(F.lit(1.0)))
    tables = {n: Q.Collection(df, "id", "body") for n in Q.DEFAULT_ROUTE}
    page, summary = Q.answer("which aircraft has alpha", tables, "keyword")
    assert {r["collection"] for r in page.collect()} == {"rag_aircraft", "kb_equipment"}
    assert summary.first()["response"].startswith("**AIR Intelligence Summary**")
    with pytest.raises(ValueError):
        Q.answer("", tables)
