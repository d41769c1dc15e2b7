"""Packing and the code store against the library's own encoding of whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlark.llm import dac, packing
from gridlark.llm import queries as Q
from gridlark.llm.tokens import encoder, vocabulary_path
from llm.conftest import DATA

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name):
    whole = Tokenizer.from_file(vocabulary_path(name))
    whole.encode_special_tokens = True
    return lambda t: whole.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE, WORD])
@given(st.text(st.sampled_from("ab zÀß,.'stre1²\n\t\r\x0b\x85\xa0é<|endoftext|>"), max_size=40))
@settings(max_examples=60, deadline=None)
def test_ids_equal_the_librarys(name, text):
    assert encoder(vocabulary_path(name)).ids(text).tolist() == library(name)(text)


@pytest.mark.parametrize("text", ["", " ", "a  b", "日本 語", "Σ ς", "İ", "x" * 5000, "don't we'll", "á é"])
def test_ids_of_odd_texts(text):
    for name in (BYTE, WORD):
        assert encoder(vocabulary_path(name)).ids(text).tolist() == library(name)(text)


def plain(name):
    """The library as it comes: added tokens that are written out in a text have ids of their own."""
    whole = Tokenizer.from_file(vocabulary_path(name))
    return lambda t: whole.encode(t or "", add_special_tokens=False).ids


MARKED = ["x <|endoftext|> y", "<|startoftext|>", "a<|endoftext|><|startoftext|>b", "日 <|endoftext|>  don't", "<|EndOfText|> <|endoftext|"]


@pytest.mark.parametrize("name", [BYTE, WORD])
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", " ", "A b", "é", "日", "\n"]), max_size=8).map("".join))
@settings(max_examples=60, deadline=None)
def test_added_tokens_in_a_text_equal_the_librarys(name, text):
    assert encoder(vocabulary_path(name)).ids(text).tolist() == plain(name)(text)


def test_added_tokens_in_the_store_and_in_pieces(spark, tmp_path):
    assert encoder(vocabulary_path(BYTE)).ids(MARKED[0]).tolist() == [87, 220, 50256, 331]
    df = spark.createDataFrame([*enumerate(MARKED), (9, "the last one")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    dac.write(df, str(tmp_path / "store"), vocabulary_path(WORD))
    expected, start = [], 0
    for doc_id, text in sorted(texts.items()):
        ids = [*plain(WORD)(text), 1]
        expected.append((doc_id, start, ids))
        start += len(ids)
    read = dac.read(spark, str(tmp_path / "store")).collect()
    assert sorted((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read) == expected
    rows = packing.pack(df, vocabulary_path(BYTE)).collect()
    check_pieces(rows, {i: [[*plain(BYTE)(t), 1]] for i, t in texts.items()}, 2048)


def test_memory_of_words_is_bounded():
    own, other = encoder.__wrapped__(vocabulary_path(BYTE), 3), library(BYTE)
    for text in ("one two three four", "five six seven", "one two"):
        assert own.ids(text).tolist() == other(text)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000))
@settings(max_examples=30, deadline=None)
def test_codes_give_any_place(ids):
    levels = dac.encode(np.array(ids, np.uint32))
    places = np.random.default_rng(1).permutation(len(ids))
    assert dac.access(places, *levels).tolist() == [ids[p] for p in places]
    assert dac.decode(len(ids), *levels[:2]).tolist() == ids


def check_store(rows, texts):
    encode, start = library(WORD), 0
    expected = []
    for doc_id in sorted(texts):
        ids = np.array([*encode(texts[doc_id]), 1], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows)) == expected


def test_store_query(spark, texts):
    check_store(Q.QUERIES["op7_addressable_codes"](spark, DATA).collect(), texts)


def test_store_awkward(spark, awkward, tmp_path):
    dac.write(awkward, str(tmp_path / "store"), vocabulary_path(WORD))
    encode = library(WORD)
    rows = dac.read(spark, str(tmp_path / "store")).collect()
    given_ = [(r["doc_id"], [*encode(r["text"]), 1]) for r in awkward.select("doc_id", "text").collect()]
    read = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]
    assert sorted(map(repr, read)) == sorted(map(repr, given_))
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1])
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    flat = [i for r in ordered for i in np.frombuffer(r["ids"], "<u4").tolist()]
    assert dac.tokens_at(spark, str(tmp_path / "store"), 3, 40) == flat[3:40]


def test_reading_goes_by_the_rank_directories(spark, documents, tmp_path):
    dac.write(documents, str(tmp_path / "store"), vocabulary_path(WORD))
    zeros = F.transform("ranks", lambda r: F.unhex(F.repeat(F.lit("00"), F.length(r))))
    spark.read.parquet(str(tmp_path / "store")).withColumn("ranks", zeros).write.parquet(str(tmp_path / "wrong"))
    right, wrong = ({r["doc_id"]: bytes(r["ids"]) for r in dac.read(spark, str(tmp_path / k)).collect()} for k in ("store", "wrong"))
    assert right.keys() == wrong.keys() and sum(right[i] != wrong[i] for i in right) > len(right) / 2


def test_store_empty(spark, no_documents, tmp_path):
    dac.write(no_documents, str(tmp_path / "store"), vocabulary_path(WORD))
    assert dac.read(spark, str(tmp_path / "store")).count() == 0


def check_pieces(rows, documents, size):
    """documents: id -> list of token lists with that id."""
    lies, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        lies[r["doc_id"]].append((r["start"], r["doc_tokens"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, wanted in documents.items():
        for ids in {tuple(w) for w in wanted}:
            mine = [p for p in lies[doc_id] if p[1] == len(ids) and list(ids[p[0] : p[0] + len(p[2])]) == p[2]]
            assert sum(len(p[2]) for p in mine) == len(ids) * wanted.count(list(ids))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size and end & (end - 1) == 0


def test_packing_query(spark, texts, documents):
    rows = packing.pack(documents, vocabulary_path(BYTE)).collect()
    encode = library(BYTE)
    check_pieces(rows, {i: [[*encode(t), 1]] for i, t in texts.items()}, 2048)
    digests = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in rows}
    query = Q.QUERIES["op3_curve_packing"](spark, DATA).collect()
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in query} == digests


def test_packing_awkward(awkward, no_documents):
    encode, wanted = library(BYTE), defaultdict(list)
    for r in awkward.select("doc_id", "text").collect():
        wanted[r["doc_id"]].append([*encode(r["text"]), 1])
    check_pieces(packing.pack(awkward, vocabulary_path(BYTE), size=64).collect(), wanted, 64)
    assert packing.pack(no_documents, vocabulary_path(BYTE)).count() == 0


def test_hilbert_curve_is_a_path_through_all_cells():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    points = np.arctanh(np.clip(((cells + 0.5) / side) * 2 - 1, -0.999999, 0.999999)) / 4
    keys = packing.hilbert_keys(points, bits=3)
    assert sorted(keys) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_like_documents_lie_together():
    a, b = b"the cat sat on the mat and the dog ran " * 20, b"xq zj kv wq pz jx qv zk xj wv qz kx " * 20
    data = np.frombuffer(a + b + a[5:] + b[7:], np.uint8)
    v = packing.vectors(data, np.cumsum([0, len(a), len(b), len(a) - 5, len(b) - 7]))
    assert np.linalg.norm(v[0] - v[2]) < 0.1 < np.linalg.norm(v[0] - v[1]) and np.linalg.norm(v[1] - v[3]) < 0.1
