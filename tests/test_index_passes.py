"""The stored index at size: vectors stored once, never moved for many questions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.operators import blocks
from gridlark.operators import index as I
from gridlark.operators import search as Q
from test_index import ROWS, WORDS, clustered, flat, marked, nearest


def texts(spark, count, seed=5):
    rng = random.Random(seed)
    rows = [("rag_aircraft" if i % 3 else "kb_equipment", int(i % 3 > 0), str(i), str(i), " ".join(rng.choices(WORDS, k=5)), "l") for i in range(count)]
    return spark.createDataFrame(rows, ROWS)


def test_a_log_of_one_batch_is_published_without_another_copy_of_its_vectors(spark, tmp_path):
    I.deliver(spark, f"{tmp_path}/log", texts(spark, 600).coalesce(1), 0)
    out = I.publish(spark, f"{tmp_path}/log", f"{tmp_path}/out")
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 600 * 1536 < stored < 600 * 1536 * 1.5
    # a second delivery: the current rows are written together, deleted and replaced ones are not in it
    more = texts(spark, 610, seed=6).where("hit_id >= 590")
    I.deliver(spark, f"{tmp_path}/log", more, 1, deleted=texts(spark, 9).select("collection", "hit_id"))
    new = I.publish(spark, f"{tmp_path}/log", f"{tmp_path}/new")
    assert out.vectors.count() == 600 and new.vectors.count() == new.rows.count() == 601
    one = flat(I.ask("alpha ship", new, "hybrid", ["rag_aircraft", "kb_equipment"]))
    assert one == flat(Q.hybrid_search("alpha ship", {
        name: Q.Collection(Q.embed(new.rows.where(F.col("collection") == name), "text").drop("collection"), "hit_id", "text", "merge_key")
        for name in ("kb_equipment", "rag_aircraft")
    }))


def test_vectors_beside_rows_keep_their_numbers(spark, tmp_path):
    given = [[0.5, -1.0], [1 / 3, 2.0], [1e100, 1.0], [0.25], [], [0.1, 0.2, 0.3]]
    kept = blocks.beside(pa.array(given, pa.list_(pa.float64())))
    assert [v["width"] for v in kept.to_pylist()] == [2, 2, 2, 1, 0, 3] and blocks._lists(kept).to_pylist() == given
    assert blocks.beside(pa.array([], pa.list_(pa.float64()))).to_pylist() == []
    I.deliver(spark, f"{tmp_path}/log", texts(spark, 5), 0, encoder=marked(1 / 3))
    assert {tuple(r["embedding"]) for r in I.current(spark, f"{tmp_path}/log").collect()} == {(1 / 3, 1.0)}


@pytest.mark.parametrize("hits", [500_000, 20])
def test_rows_are_not_moved_to_meet_queries(spark, tmp_path, hits, monkeypatch):
    monkeypatch.setattr(blocks, "HELD_HITS", hits)
    monkeypatch.setattr(blocks, "ROWS_BYTES", 6 * 8 * 100)
    monkeypatch.setattr(blocks, "ROWS_EACH", 9)
    data, df = clustered(spark)
    beside = df.select(F.col("id"), "scope", F.arrow_udf(blocks.beside, blocks.BESIDE)("embedding").alias("held"))
    beside.union(beside.limit(1).selectExpr("id + 10000", "scope", "held")).write.parquet(f"{tmp_path}/rows")  # a tie
    rows = spark.read.parquet(f"{tmp_path}/rows").select("id", "scope", "held.*")
    for scopes, own in (("a\nb", lambda i: True), ("b", lambda i: i % 7 == 0)):
        queries = df.where("id % 10 = 3").withColumn("route", F.lit(scopes)).repartition(4)
        asked = blocks.pack(queries, "id", "embedding", f"{tmp_path}/asked-{len(scopes)}", "route", block_bytes=8 * 6 * 4)
        got = blocks.search_rows(asked, rows, 5, "query_id", "doc_id")
        if hits == 20:
            assert not [f for f in got.inputFiles() if "/rows/" in f]
        found = {}
        for r in got.orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["doc_id"])
        ids, vectors = [*range(len(data)), 10_000], np.concatenate((data, data[:1]))
        want = {q: nearest(vectors, q, 5, [p for p, i in enumerate(ids) if own(i % 10_000)]) for q in range(3, len(data), 10)}
        assert found == {q: [ids[p] for p in places] for q, places in want.items()}
    assert [r["id"] for r in blocks.nearest_rows(rows, data[3], 7, ["b"]).collect()] == [14, 21, 7, 35, 0, 10_000, 28]
