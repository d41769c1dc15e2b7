"""Digests of vectors are written some rows at a time, others one by one."""

import hashlib

import numpy as np
import pyarrow as pa

from gridlark.operators import search


def digest(vector):
    return hashlib.md5(",".join(str(int(x * 128 + 128)) for x in vector or [] if x is not None).encode()).hexdigest()


def test_byte_vectors_are_written_together(monkeypatch):
    rng = np.random.default_rng(4)
    odd = [None, [], [None, 0.25], [5.0, -9.0, 1e4], [0.013, -0.7], [0.5]]
    rows = [(rng.integers(-128, 128, 40) / 128).tolist() for _ in range(150)]
    for given in (rows, rows[:64] + odd, odd, []):
        got = search._digests(pa.array(given, pa.list_(pa.float64()))).to_pylist()
        assert got == [{"dimensions": None if v is None else len(v), "fingerprint": digest(v)} for v in given]
    monkeypatch.setattr(search, "_text_of", None)
    texts = ["one", None, "Ünder", ""]
    vectors = search._hash_batch(pa.array(texts, pa.string()))
    assert [v["fingerprint"] for v in search._digests(vectors).to_pylist()] == [digest(search.hash_vector(t or "").tolist()) for t in texts]
    assert len(search._hash_batch(pa.array([], pa.string()))) == 0
