"""Near-duplicate classes and nearest neighbours against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlark.llm import dart_minhash, multi_index
from gridlark.llm import queries as Q
from llm.conftest import DATA


def shingle_set(text):
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else None


def brute_classes(rows, least=0.8):
    """Class id of each (id, text): the smallest id of its component of similar rows."""
    sets = [shingle_set(t) for _, t in rows]
    total = [sum(s.values()) if s else 0 for s in sets]
    having, common, parent = defaultdict(list), Counter(), list(range(len(rows)))
    for i, s in enumerate(sets):
        for name, n in (s or {}).items():
            for j, m in having[name]:
                common[j, i] += min(n, m)
            having[name].append((i, n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in common.items():
        if n >= least * (total[i] + total[j] - n) - 1e-9:
            parent[top(i)] = top(j)
    members = defaultdict(list)
    for i, s in enumerate(sets):
        members[top(i)].append(rows[i][0])
    out = []
    for i, s in enumerate(sets):
        ids = [m for m in members[top(i)] if m is not None]
        out.append((rows[i][0], rows[i][0] if s is None else min(ids, default=None), 1 if s is None else len(members[top(i)])))
    return out


def test_classes_query(spark, texts):
    got = sorted(tuple(r) for r in Q.QUERIES["op8_dart_minhash"](spark, DATA).collect())
    expected = sorted(brute_classes(sorted(texts.items())))
    assert got == expected and any(r[2] > 1 for r in got)


def family(rng, n, words=120, edits=3, start=0):
    """A base text and near copies of it, some of them nearer to the base than to each other."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [(start, " ".join(base))]
    for k in range(1, n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((start + k, " ".join(copy)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("pairs, names", [(8, 1 << 22), (0, 0)], ids=["few", "rounds and shuffles only"])
def test_classes_of_near_copies(spark, monkeypatch, pairs, names):
    monkeypatch.setattr(dart_minhash, "PAIRS_PER_NODE", pairs)
    monkeypatch.setattr(dart_minhash, "BROADCAST_NAMES", names)
    rng = random.Random(3)
    rows = [r for f in range(5) for r in family(rng, 12, edits=2 + f, start=100 * f)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in dart_minhash.classes(df).collect())
    assert got == sorted(brute_classes(rows))


def test_classes_awkward(awkward, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    got = [tuple(r) for r in dart_minhash.classes(awkward).collect()]
    assert sorted(got, key=order) == sorted(brute_classes(rows), key=order)
    assert dart_minhash.classes(no_documents).count() == 0
    assert dart_minhash.first_of_each(no_documents).count() == 0


def test_one_row_of_each_class_stays(awkward):
    kept = dart_minhash.first_of_each(awkward)
    assert kept.columns == awkward.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    every = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    wordless = {r for r in every if shingle_set(r[1]) is None}
    assert wordless <= set(rows)
    classes = {c[1] for r, c in zip(every, brute_classes(every)) if r not in wordless}
    assert sorted(r[0] for r in rows if r not in wordless) == sorted(classes)


def test_outlines_bound_similarity_from_above():
    rng = np.random.default_rng(6)
    names = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) << np.uint64(1))
    counts = rng.integers(1, 4, len(names))
    for cut in (10, 500, 2000):
        a, b = (names[:-cut], counts[:-cut]), (names[cut:], counts[cut:][::-1].copy())
        exact = dart_minhash.similarity(a, b)
        bound = dart_minhash.similarity(dart_minhash.outline(*a), dart_minhash.outline(*b))
        assert exact <= bound <= exact + 0.05
        assert dart_minhash.outline(*a)[1].sum() == a[1].sum()
    # names that share their first bits fall together and add up
    assert [x.tolist() for x in dart_minhash.outline(np.array([1, 2, 1 << 48], np.uint64), np.array([2, 3, 4]))] == [[0, 1], [5, 4]]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    names = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = rng.integers(1, 6, 400), rng.integers(1, 6, 400)
    darts = [dart_minhash.signature(names[:350], a[:350], 2000), dart_minhash.signature(names[50:], b[50:], 2000)]
    exact = dart_minhash.similarity((names[:350], a[:350]), (names[50:], b[50:]))
    assert abs((darts[0] == darts[1]).mean() - exact) < 0.04


# --- nearest neighbours ---------------------------------------------------------------------------------------------


def brute_search(rows, is_query, k):
    """(query, rank, id, score) over usable rows of the usual width."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, v) for i, v in good if len(v) == width]
    out = []
    for i, v in good:
        if is_query(i):
            found = sorted(((-float(v @ u), j) for j, u in good if j != i))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return out


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = Q.QUERIES["op10_multi_index"](spark, DATA).collect()
    expected = brute_search(rows, lambda i: i % 20 == 0, 20)
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert np.mean([(q, j) in found for q, _, j, _ in expected]) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    assert all(abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-12 for r in got)
    assert len(got) == len(expected)


def recall_of(df, **options):
    """The share of the exact 20 nearest that the search finds for every twentieth row, without ties."""
    rows = df.select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = defaultdict(set)
    for r in multi_index.search(df, F.col("vec_id") % 20 == 0, **options).collect():
        found[r["query_id"]].add(r["vec_id"])
    shares = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        shares.append(len(found[ids[i]] & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    return np.mean(shares)


@pytest.mark.parametrize("count", [6000, 12_000])
def test_recall_above_the_least_number_of_visits(spark, tmp_path, count):
    vectors = np.random.default_rng(5).normal(size=(count, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    columns = [pa.array(range(count), pa.int64()), pa.array(list(vectors), pa.list_(pa.float64()))]
    pq.write_table(pa.Table.from_arrays(columns, ["vec_id", "embedding"]), f"{tmp_path}/v.parquet")
    assert recall_of(spark.read.parquet(f"{tmp_path}/v.parquet")) >= 0.92


def test_recall_of_the_share_alone(spark):
    larger = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall_of(larger, visit_least=0) >= 0.91


def test_search_is_exact_where_all_cells_are_visited(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 2.0, 0.0, 0.0, 0.5]) for i in range(60)]  # one common vector
    rows += [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [float("nan")] + [1.0] * 5)]
    rows += [(2005, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (2007, [1.0, 2.0]), (7, rows[7][1]), (2008, [-0.0, 1.0, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = df.withColumn("cell", F.lit("clash")).withColumn("entry", F.lit("clash")).withColumn("rank", F.lit(0))
    got = sorted(tuple(r) for r in multi_index.search(df, F.col("vec_id") % 4 == 0, k=5, visit_share=1.0).collect())
    expected = sorted(brute_search([*{repr(r): r for r in rows}.values()], lambda i: i % 4 == 0, 5))
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in got], [r[3] for r in expected], atol=1e-12)


def test_queries_meet_chunks_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=6).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole, cut = (multi_index.search(df, F.col("vec_id") % 2 == 0, k=5, visit_least=0, **o) for o in ({}, {"query_block": 50}))
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    plan = cut._jdf.queryExecution().toString()
    assert re.search(r"FlatMapCoGroupsInArrow \[block", plan) and "explode(sequence(0, 11," in plan


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multi_index.search(empty, F.col("vec_id") % 20 == 0).count() == 0
    zeros = spark.createDataFrame([(0, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert multi_index.search(zeros, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [0.5])], "vec_id long, embedding array<float>")
    assert multi_index.search(one, F.col("vec_id") % 20 == 0).count() == 0


def test_walk_goes_by_descending_sum():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=7), rng.normal(size=5)
    order = list(multi_index.walk(a, b))
    sums = [a[i] + b[j] for i, j in order]
    assert len(set(order)) == 35 and sums == sorted(sums, reverse=True)
