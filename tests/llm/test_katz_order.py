"""Back-off models of any order against plain dictionaries."""

import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from gridlark.llm import katz
from gridlark.llm import queries as Q
from llm.conftest import DATA
from llm.test_text import lm_words


def brute(rows, order):
    """P(word | history) by dictionaries, the history being a tuple of at most ``order`` - 1 words."""
    one, grams, follow = Counter(), [Counter() for _ in range(order + 1)], defaultdict(Counter)
    for i, text in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            seq = ["<s>", *lm_words(text)]
            for j in range(1, len(seq)):
                one[seq[j]] += 1
                for length in range(2, min(order, j + 1) + 1):
                    grams[length][tuple(seq[j - length + 1 : j + 1])] += 1
                    follow[tuple(seq[j - length + 1 : j])][seq[j]] += 1
    having = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, 7)])
    d = {1: katz.discounts(having(one))} | {n: katz.discounts(having(grams[n])) for n in range(2, order + 1)}
    cut = lambda r, n: r * (d[n][r - 1] if r <= 5 else 1)
    total = sum(one.values())
    left = 1 - sum(cut(c, 1) for c in one.values()) / total

    @cache
    def of_history(h):
        seen, n = follow[h], len(h) + 1
        whole, taken = sum(seen.values()), {w: cut(r, n) for w, r in seen.items()}
        if taken == seen:  # nothing is discounted
            whole += 1
        rest = 1 - sum(taken.values()) / whole
        return whole, taken, rest / (1 - sum(p(h[1:], w) for w in seen))

    @cache
    def p(h, w):
        if not h:
            return cut(one[w], 1) / total if one[w] else left
        if h not in follow:
            return p(h[1:], w)
        whole, taken, alpha = of_history(h)
        return taken[w] / whole if w in taken else alpha * p(h[1:], w)

    return one, dict(follow), p


def check(got, rows, order):
    one, follow, p = brute(rows, order)
    for found, (i, text) in zip(got, rows, strict=True):
        seq = ["<s>", *lm_words(text)]
        want = sum(math.log10(p(tuple(seq[max(0, j - order + 1) : j]), seq[j])) for j in range(1, len(seq)))
        assert (found["doc_id"], found["n_tokens"]) == (i, len(seq) - 1)
        assert math.isclose(found["score"], want, rel_tol=1e-7, abs_tol=1e-7)
    longest = [h for h in follow if len(h) == order - 1]
    for h in [*longest[:10], *longest[-10:], ("<s>",), ("never", "seen")[: order - 1]]:
        assert math.isclose(sum(p(h, w) for w in one) + p(h, "new word"), 1, rel_tol=1e-9)


@pytest.mark.parametrize("order", [3, 4])
def test_longer_histories(awkward, order):
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"])
    got = sorted(katz.score(awkward, order=order).collect(), key=key)
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    check(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(lm_words(r[1])))), order)


def test_trigrams_of_the_supplied_texts(spark, texts):
    got = sorted(Q.QUERIES["op5_trigram_katz_backoff"](spark, DATA).collect(), key=lambda r: r["doc_id"])
    check(got, sorted(texts.items()), 3)
    pairs = {r["doc_id"]: r["score"] for r in Q.QUERIES["op5_katz_backoff"](spark, DATA).collect()}
    assert sum(pairs[r["doc_id"]] != r["score"] for r in got) > len(got) / 2


def test_texts_without_words_and_orders_that_are_none(spark, no_documents):
    assert katz.score(no_documents, order=3).count() == 0
    empty = spark.createDataFrame([(1, ""), (2, None), (3, "")], "doc_id long, text string")
    assert {r["n_tokens"] for r in katz.score(empty, order=4).collect()} == {1}
    with pytest.raises(ValueError):
        katz.score(empty, order=1)
