"""The stored index: what a delivery embeds, batch answers against single ones, blocks that bounds rule out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import DATA
from gridlark.operators import blocks, word_index
from gridlark.operators import index as I
from gridlark.operators import search as Q
from gridlark.plans import catalog

ROWS = "collection string, priority int, hit_id string, merge_key string, text string, line string"


def marked(value):
    """An encoder whose vectors tell which delivery made them."""
    return lambda: lambda texts: [np.array([float(value), 1.0]) for _ in texts]


def stored(spark, path):
    return {(r["collection"], r["hit_id"]): (r["text"], r["line"], r["embedding"][0]) for r in I.current(spark, path).collect()}


def test_only_changed_texts_are_embedded(spark, tmp_path):
    path = str(tmp_path / "index")

    def rows(*lines):
        return spark.createDataFrame([("c", 0, i, i, text, line) for i, text, line in lines], ROWS)

    I.deliver(spark, path, rows(("1", "one", "a"), ("2", "two", "b"), ("3", "three", "c"), ("4", None, "d")), 0, encoder=marked(1))
    I.deliver(spark, path, rows(("1", "one", "a"), ("2", "TWO", "b"), ("3", "three", "new"), ("5", "five", "e")), 1, encoder=marked(2))
    assert stored(spark, path) == {
        ("c", "1"): ("one", "a", 1.0), ("c", "2"): ("TWO", "b", 2.0), ("c", "3"): ("three", "new", 1.0),
        ("c", "4"): (None, "d", 1.0), ("c", "5"): ("five", "e", 2.0),
    }
    # what did not change is not written again; a replay of the batch gives the same
    assert {r["hit_id"] for r in spark.read.parquet(f"{path}/batch_id=1").collect()} == {"2", "3", "5"}
    before = stored(spark, path)
    I.deliver(spark, path, rows(("1", "one", "a"), ("2", "TWO", "b"), ("3", "three", "new"), ("5", "five", "e")), 1, encoder=marked(2))
    assert stored(spark, path) == before


def test_deleted_ids_take_their_vectors_along(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("c", 0, str(i), str(i), f"t{i}", "l") for i in range(6)], ROWS)
    I.deliver(spark, path, rows, 0, encoder=marked(1))
    gone = spark.createDataFrame([("c", "0"), ("c", "77")], "collection string, hit_id string")
    I.deliver(spark, path, rows.limit(0), 1, deleted=gone, encoder=marked(2))
    assert set(stored(spark, path)) == {("c", str(i)) for i in range(1, 6)}
    I.deliver(spark, path, rows.where("hit_id IN ('0', '3')"), 2, complete=True, encoder=marked(3))
    assert stored(spark, path) == {("c", "0"): ("t0", "l", 3.0), ("c", "3"): ("t3", "l", 1.0)}
    I.deliver(spark, path, rows.where("hit_id = '3'"), 3, model="other", encoder=marked(4))
    assert stored(spark, path)["c", "3"] == ("t3", "l", 4.0)  # another model: embedded again


WORDS = ["alpha", "beta", "gamma", "alphabet", "to", "in", "Été", "x1", "a", "ship", "jet", "malware", "über_all"]


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    """A small published index with equal texts, texts without words and null texts, in small blocks."""
    rng, root = random.Random(3), tmp_path_factory.mktemp("some")
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) for _ in range(80)] + [None, "", "...", "same"] + ["same"] * 30
    rows = []
    for place, name in enumerate(Q.DEFAULT_ROUTE):
        for i, text in enumerate(rng.sample(texts, len(texts))):
            known = None if name == "kb_threat_actors" else f"{name[:8]}{i}"
            rows.append((name, place, f"{i}", known or f"{name}/{i}", text, f"line {i}"))
    I.deliver(spark, f"{root}/log", spark.createDataFrame(rows, ROWS).repartition(3), 0)
    return I.publish(spark, f"{root}/log", f"{root}/out")


QUESTIONS = ["alpha ship", "jet to the BETA", "malware gamma gamma", "?!", "to", "été über_all", "nothing matches zzz", "a", "same"]


def flat(hits):
    columns = ("rank", "total", "collection", "hit_id", "origin", "score")
    return [tuple(r[c] for c in columns) for r in hits.orderBy("rank").collect()]


@pytest.mark.parametrize("kind", ["keyword", "semantic", "hybrid"])
def test_a_table_of_questions_is_answered_like_each_of_them(spark, some, kind, monkeypatch):
    monkeypatch.setattr(word_index, "BLOCK_ROWS", 7)
    asked = spark.createDataFrame([(q,) for q in QUESTIONS * 2 + ["", None]], "query string")
    many = I.answer_many(asked, some, search_type=kind)
    logged = {r["query"]: r["result_count"] for r in I.log_answers(asked, many, kind, 5).distinct().collect()}
    for query in QUESTIONS:
        one = flat(I.ask(query, some, kind, Q.ROUTES.get(Q.intent_of(query), Q.DEFAULT_ROUTE)))
        assert flat(many.where(F.col("query") == query)) == one, query
        assert logged[query] == len(one)
    assert set(logged) == set(QUESTIONS)


def test_a_question_without_a_word_finds_every_text(spark, some):
    assert {r["score"] for r in I.keyword("?!", some).collect()} == {0.0}
    rows = spark.createDataFrame([("1", "x"), ("2", None), ("3", "")], "id string, body string")
    got = Q.keyword_search("!", {"c": Q.Collection(rows, "id", "body")}).collect()
    assert [(r["hit_id"], r["score"]) for r in got] == [("1", 0.0), ("3", 0.0)]


def test_words_are_found_inside_words():
    block = word_index.Block(["a", "b", "c"], "alpha\nalphabet\nbet", np.array([2, 1, 1], np.uint16).tobytes(), np.array([0, 2, 1, 2], np.uint16).tobytes())
    assert block.having("bet").tolist() == [1, 2] and block.having("alpha").tolist() == [0, 1, 2]
    assert block.having("alphabeta").tolist() == [] and block.having("p").tolist() == [0, 1, 2]
    assert word_index.Block([], "", b"", b"").having("x").tolist() == []


def test_questions_embed_no_corpus(spark):
    index = catalog._index_of(spark, DATA)
    for plan in (I.ask(catalog.QUESTION, index), I.semantic(catalog.QUESTION, index), I.answer(catalog.QUESTION, index)[0]):
        text = plan._jdf.queryExecution().toString()
        assert "_hash_batch" not in text
    hybrid = contract.queries()["search_hybrid"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "_hash_batch" not in hybrid and hybrid.count("MapInArrow") == 1 and "ArrowEvalPython" not in hybrid


def test_index_follows_the_tables(spark, tmp_path):
    """Equal files: the same published index. Changed files: a delivery of what changed."""
    folder = tmp_path / "tables"
    for name in ("events", "part", "supplier"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(40).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    first = catalog._index_of(spark, str(folder)).rows
    assert catalog._index_of(spark, str(folder)).rows.inputFiles() == first.inputFiles()
    known = spark.sparkContext.applicationId, str(folder), "index"
    assert catalog._STORED[known][1][1] == 0
    spark.read.parquet(f"{DATA}/part.parquet").limit(50).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part.parquet")
    rows = catalog._index_of(spark, str(folder)).rows
    path, batch, _ = catalog._STORED[known][1]
    assert batch == 1 and rows.where("collection = 'kb_equipment'").count() == 50
    assert spark.read.parquet(f"{path}/batch_id=1").count() == 10


# --- blocks --------------------------------------------------------------------------------------------------------------
def clustered(spark, centres=12, each=40, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    data = np.concatenate([m + rng.normal(size=(each, dims)) * 0.02 for m in middle])
    rows = [(i, [float(x) for x in v], "a" if i % 7 else "b") for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "id bigint, embedding array<double>, scope string")


def nearest(data, q, k, allowed):
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    scores = unit @ unit[q]
    return sorted(allowed, key=lambda i: (-scores[i], i))[:k]


@pytest.mark.parametrize("scoped", [False, True])
def test_bounds_skip_most_blocks_and_lose_nothing(spark, tmp_path, scoped, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 2)
    data, df = clustered(spark)
    scope = "scope" if scoped else None
    docs = blocks.pack(df.coalesce(1), "id", "embedding", str(tmp_path / "docs"), scope, block_bytes=8 * 6 * 20)
    asked = blocks.pack(df.where("id % 10 = 3").coalesce(1), "id", "embedding", str(tmp_path / "asked"), scope, block_bytes=8 * 6 * 4)
    met = blocks.search(asked, docs, 5, "query_id", "doc_id")
    found = {}
    for r in met.hits.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    own = lambda q: [i for i in range(len(data)) if not scoped or bool(i % 7) == bool(q % 7)]
    assert found == {q: nearest(data, q, 5, own(q)) for q in range(3, len(data), 10)}
    assert met.share() < 0.5 and met.visited.count() == met.visited.distinct().count()


def test_one_query_over_blocks(spark, tmp_path):
    data, df = clustered(spark)
    stored = blocks.pack(df.coalesce(1), "id", "embedding", str(tmp_path / "one"), "scope", block_bytes=8 * 6 * 20)
    for q, scopes in ((3, None), (14, ["b"]), (100, ["a", "b"])):
        got = [r["id"] for r in blocks.nearest(stored, data[q], 7, scopes).collect()]
        assert got == nearest(data, q, 7, [i for i in range(len(data)) if scopes != ["b"] or i % 7 == 0])
    assert blocks.nearest(stored, [0.0] * 6, 7).count() == blocks.nearest(stored, [1.0], 7).count() == 0


def test_blocks_hold_neighbours_within_their_radius(spark, tmp_path):
    data, df = clustered(spark)
    for r in blocks.pack(df, "id", "embedding", str(tmp_path / "b"), block_bytes=8 * 6 * 9).collect():
        unit = np.frombuffer(r["unit"], np.float64).reshape(r["rows"], r["width"])
        centre = np.frombuffer(r["centre"], np.float64)
        assert len(r["ids"]) == r["rows"] <= 9
        assert np.linalg.norm(unit - centre, axis=1).max() <= r["radius"] + 1e-12


def test_equal_vectors_fill_many_blocks(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(200)], "doc_id bigint, embedding array<double>")
    queries = rows.where("doc_id < 6").withColumnRenamed("doc_id", "query_id")
    got = Q.vector_search_batch(queries, rows.coalesce(1), 4, block_bytes=16 * 10)
    by_query = {}
    for r in got.orderBy("query_id", "rank").collect():
        by_query.setdefault(r["query_id"], []).append(r["doc_id"])
    assert by_query == {q: [i for i in range(20) if bool(i % 3) == bool(q % 3)][:4] for q in range(6)}


# --- what is stored and moved ---------------------------------------------------------------------------------------------
def test_vectors_are_published_once_a_byte_for_each_component(some):
    assert "embedding" not in some.rows.columns
    size = some.vectors.agg(F.sum(F.octet_length("unit")).alias("bytes"), F.sum("rows").alias("rows")).first()
    assert size["rows"] == some.rows.count() and size["bytes"] == 1536 * size["rows"]


def test_a_log_of_one_batch_is_read_without_a_join(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("c", 0, str(i), str(i), f"t{i}", "l") for i in range(4)], ROWS)
    I.deliver(spark, path, rows, 0, encoder=marked(1))
    assert "Join" not in I.current(spark, path)._jdf.queryExecution().executedPlan().toString()
    I.deliver(spark, path, rows.limit(1).withColumn("text", F.lit("new")), 1, encoder=marked(2))
    assert sorted(r["embedding"][0] for r in I.current(spark, path).collect()) == [1.0, 1.0, 1.0, 2.0]


def test_stored_vectors_keep_their_numbers():
    rng = np.random.default_rng(5)
    for code, data in (
        ("i1", rng.integers(-128, 128, (9, 6)) / 128), ("f4", rng.normal(size=(9, 6)).astype(np.float32).astype(np.float64)),
        ("f4", np.full((2, 3), 1.0)), ("f8", rng.normal(size=(9, 6))), ("f8", np.full((1, 2), 1e100)),
    ):
        found, kept = blocks.narrow(data)
        unit, _ = blocks.unit_rows(data)
        assert found == code
        held = (unit if code == "f8" else kept).tobytes()
        assert (blocks.stored_rows(code, held, data.shape[1]) == unit).all()


@pytest.mark.parametrize("grid", [False, True])
def test_stored_vectors_are_not_moved_for_few_queries_and_a_grid_finds_the_same(spark, tmp_path, grid, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 2)
    if grid:
        monkeypatch.setattr(blocks, "GROUP_BYTES", 1000)
        monkeypatch.setattr(blocks, "HELD_HITS", 20)
    data, df = clustered(spark)
    df = df.unionByName(df.limit(1).select((F.col("id") + 10_000).alias("id"), "embedding", "scope"))  # a tie
    docs = blocks.pack(df.coalesce(1), "id", "embedding", str(tmp_path / "docs"), block_bytes=8 * 6 * 20)
    asked = blocks.pack(df.where("id % 10 = 0 AND id < 10000").coalesce(1), "id", "embedding", str(tmp_path / "asked"), block_bytes=8 * 6 * 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = blocks.search(asked, docs, 5, "query_id", "doc_id").hits
        joins = hits._jdf.queryExecution().executedPlan().toString()
        found = {}
        for r in hits.orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["doc_id"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ("SortMergeJoin" in joins) == grid
    want = {q: nearest(data, q, 5, range(len(data))) for q in range(0, len(data), 10)}
    own = {q: [0, 10_000, *ids[1:4]] if q == 0 else [10_000 if i == -1 else i for i in ids] for q, ids in want.items()}
    assert {q: ids for q, ids in found.items() if 10_000 not in ids} == {q: ids for q, ids in own.items() if 10_000 not in found[q]}
    assert found[0] == own[0]


@pytest.mark.parametrize("grid", [False, True])
def test_words_are_not_moved_for_few_questions_and_a_grid_finds_the_same(spark, some, grid, monkeypatch):
    if grid:
        monkeypatch.setattr(word_index, "GROUP_BYTES", 60)
        monkeypatch.setattr(word_index, "HELD_HITS", 15)
    asked = spark.createDataFrame([(q, list(Q.DEFAULT_ROUTE)) for q in QUESTIONS], "query string, route array<string>").repartition(4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = word_index.search(asked, some.words, "query", "query", "route", 3, Q.MIN_SCORED_LENGTH)
        joins = hits._jdf.queryExecution().executedPlan().toString()
        rows = hits.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ("SortMergeJoin" in joins) == grid
    assert len(rows) == len({(r["key"], r["scope"], r["id"]) for r in rows})
    texts = [(r["collection"], r["block_id"], r["text"]) for r in some.rows.where("text IS NOT NULL").withColumn("block_id", I._block_id()).collect()]
    for query in QUESTIONS:
        words = Q.query_words(query)
        scored = [w for w in words if len(w) >= Q.MIN_SCORED_LENGTH]
        for name in Q.DEFAULT_ROUTE:
            met = [(-sum(w in t.lower() for w in scored), i) for c, i, t in texts if c == name and (not words or any(w in t.lower() for w in words))]
            got = sorted((-r["points"], r["id"]) for r in rows if r["key"] == query and r["scope"] == name)
            assert got == sorted(met)[:3], (query, name)


def test_fingerprints_are_what_spark_writes_and_need_one_pass(spark):
    vectors = [[0.0, -1.0, 127 / 128], None, [], [None, 0.25], [5.0, -9.0, 1e4], [0.013, -0.7]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id int, embedding array<double>")
    text = F.concat_ws(",", F.transform("embedding", lambda x: (x * 128 + 128).cast("int").cast("string")))
    want = {r["id"]: r["f"] for r in rows.select("id", F.md5(text).alias("f")).collect()}
    assert {r["id"]: r["f"] for r in rows.select("id", Q.fingerprint("embedding")["fingerprint"].alias("f")).collect()} == want
    plan = contract.queries()["emb_rows_operational"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    evaluated = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    assert evaluated.split("], [")[0].count("_hash_batch(") == 1
