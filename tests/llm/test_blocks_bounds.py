"""Groups that stay open are compared in blocks: pairs are rows only where outlines are close."""

import random

import numpy as np

from gridlark.llm import dart_minhash
from llm.test_neighbours import brute_classes, family


def test_common_weights_of_all_pairs():
    rng = np.random.default_rng(7)
    sets = []
    for n in (1, 5, 300, 40, 2000):
        names = np.unique(rng.integers(0, 4000, n)).astype(np.uint16)
        sets.append((names, rng.integers(1, 5, len(names))))
    sets.append((np.array([7], np.uint16), np.array([1 << 20])))
    got = dart_minhash.overlaps(sets[:4], sets)
    for i, a in enumerate(sets[:4]):
        for j, b in enumerate(sets):
            other = dict(zip(b[0].tolist(), b[1].tolist()))
            assert got[i, j] == sum(min(c, other.get(n, 0)) for n, c in zip(a[0].tolist(), a[1].tolist()))


def test_a_group_that_stays_open_is_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = family(rng, 120, edits=9, start=0) + family(rng, 30, edits=2, start=1000)
    pairs, blocks = [], []
    appended, close = dart_minhash._appended, dart_minhash._close_in_blocks
    monkeypatch.setattr(dart_minhash, "PAIRS_PER_NODE", 0)
    monkeypatch.setattr(dart_minhash, "ROUND_PAYS", 0)
    monkeypatch.setattr(dart_minhash, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(dart_minhash, "_appended", lambda df, *a: pairs.append(df.count()) or appended(df, *a))
    monkeypatch.setattr(dart_minhash, "_close_in_blocks", lambda *a: blocks.append(1) or close(*a))
    got = sorted(tuple(r) for r in dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute_classes(rows))
    assert blocks == [1] and len(pairs) == 1
