"""Many questions over the inverted index: documents that stand alike, slices, passes."""

import random

import pytest

from gridlark.operators import search as Q
from gridlark.operators import word_index


@pytest.mark.parametrize("cells", [8 << 20, 40])
def test_documents_that_stand_alike_and_questions_in_slices(spark, tmp_path, cells, monkeypatch):
    monkeypatch.setattr(word_index, "CELLS", cells)
    monkeypatch.setattr(word_index, "SLICE", 2)
    monkeypatch.setattr(word_index, "BLOCK_ROWS", 50)
    rng = random.Random(4)
    held = [(f"{i:04}", " ".join(rng.choices(["alpha", "beta", "to", "überalles", "x"], k=rng.choice((0, 1, 1, 2, 3))))) for i in range(400)]
    rows = spark.createDataFrame(held, "id string, text string").repartition(3)
    index = word_index.index_words(rows, "id", "text", f"{tmp_path}/words")
    questions = ["alpha", "to be", "lph bet bet", "über", "?", "zzz", "eta to x", "a"] * 2
    asked = spark.createDataFrame([(f"{n}", q, [""]) for n, q in enumerate(questions)], "key string, query string, route array<string>")
    found = word_index.search(asked.coalesce(1), index, "key", "query", "route", 7, 3).collect()
    for n, query in enumerate(questions):
        words = Q.query_words(query)
        want = sorted((-sum(w in t for w in words if len(w) >= 3), i) for i, t in held if not words or any(w in t for w in words))[:7]
        assert sorted((-r["points"], r["id"]) for r in found if r["key"] == str(n)) == want, query
    # the index is read for every group of questions and stays where it is
    monkeypatch.setattr(word_index, "HELD_HITS", 10)
    monkeypatch.setattr(word_index, "QUESTIONS", 4)
    passes = word_index.search(asked.coalesce(1), index, "key", "query", "route", 7, 3)
    assert not [f for f in passes.inputFiles() if "/words/" in f]
    assert sorted(map(tuple, passes.collect())) == sorted(map(tuple, found))
