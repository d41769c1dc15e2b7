"""Classifiers learn in memory that does not grow with the sample."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gridlark.llm import language


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_classifier_learns_in_bounded_memory():
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 2500, 2400)
    feature = rng.integers(0, 1 << language.FEATURE_BITS, sizes.sum()).astype(np.uint16)
    share, signs = rng.random(len(feature)).astype(np.float32), np.where(rng.random(len(sizes)) < 0.5, 1.0, -1.0)
    _, most = peak(lambda: language._logistic(sizes, feature, share, signs))
    assert most < 16 * len(feature)


def test_a_classifier_does_not_depend_on_its_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([0, 3, 0, 700, 1, 40, 0, 256, 0])
    feature = rng.integers(0, 1 << language.FEATURE_BITS, sizes.sum()).astype(np.uint16)
    share, signs = rng.random(len(feature)).astype(np.float32), np.where(np.arange(len(sizes)) % 2, 1.0, -1.0)
    whole = language._logistic(sizes, feature, share, signs)
    monkeypatch.setattr(language, "_WEIGHED", 16)
    parts = language._logistic(sizes, feature, share, signs)
    assert whole[0].tolist() == parts[0].tolist() and whole[1:] == parts[1:]
    assert language._logistic(np.zeros(3, np.int64), feature[:0], share[:0], signs[:3])[0].tolist() == [0] * (1 << language.FEATURE_BITS)


def test_a_batch_is_counted_in_bounded_memory():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 123, 16_384).astype(np.uint8)) for _ in range(256)]
    table = {"text": pa.array(texts, pa.binary()), "draw": pa.array(range(256), pa.int64()), "language": pa.array([0, 1] * 128, pa.int32())}
    batch = pa.RecordBatch.from_arrays(list(table.values()), names=list(table))
    found, most = peak(lambda: sum(b.num_rows for b in language._counted(iter([batch]))))
    assert found == 256 and most < 10 * 256 * 16_384


def test_a_classifier_weighs_little_at_a_time():
    rng = np.random.default_rng(8)
    sizes = rng.integers(0, 2500, 2400)
    feature = rng.integers(0, 1 << language.FEATURE_BITS, sizes.sum()).astype(np.uint16)
    share, signs = rng.random(len(feature)).astype(np.float32), np.where(rng.random(len(sizes)) < 0.5, 1.0, -1.0)
    _, most = peak(lambda: language._logistic(sizes, feature, share, signs))
    assert most < 8 << 20
