"""Katz back-off scores of whole texts, from Good-Turing discounted counts of the training rows.

    P(w | g h) = d(r) r / c(g h)        for an n-gram seen r times, g h being the words before w
    P(w | g h) = alpha(g h) P(w | h)    else; alpha(g h) = left over by g h / left over by P(. | h) at the words seen after g h
    P(w)       = d(r) r / N             for a word seen r times
    P(new)     = what the discounts of all words leave over, for any word never seen

with as many words before w as the order of the model allows, and the start of the text before them; words at the start have
a shorter history. Every sum is exact: the probabilities of the words after a history add up to one. Counts live in tables of
n-grams that are partitioned by hash: words by themselves, longer ones by their history. A history so frequent that it holds
more than a bucket's share of all tokens is spread over several buckets by the last word, and what they know of it is summed.
Documents are dealt to groups; a group sends each distinct word and n-gram of it to their bucket once, with its count,
and gets the corpus's counts back (see ``support``), one length after the other: a longer n-gram needs the shorter one's P.

Words and histories are told apart by 64-bit hashes (48 further bits for the last word of an n-gram).
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlark.llm import support as S

#: Good-Turing discounts apply to counts up to this.
MOST_DISCOUNTED = 5
_R = MOST_DISCOUNTED + 1
#: Stand for the end of a text and for the place before its first word.
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_())]
    + [(k, pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")]
    + [(k, pa.float64()) for k in ("base_score", "score")]
)


def is_held_out(doc_id: int | None, folds: int = 10) -> bool:
    """Rows not learned from: the id's checksum is a multiple of ``folds``, or there is no id."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def discounts(having: np.ndarray) -> np.ndarray:
    """d(1) .. d(MOST_DISCOUNTED) from how many n-grams were seen 1, 2, .. MOST_DISCOUNTED + 1 times.

    Katz's correction of Good-Turing, for the largest range of counts in which every discount lies between 0 and 1;
    if there is none (small or odd tables), absolute discounting.
    """
    n = np.asarray(having, np.float64)
    for k in range(MOST_DISCOUNTED, 0, -1):
        if (n[: k + 1] > 0).all():
            r = np.arange(1, k + 1)
            ratio, cut = (r + 1) * n[1 : k + 1] / (r * n[:k]), (k + 1) * n[k] / n[0]
            if cut < 1:
                d = (ratio - cut) / (1 - cut)
                if ((d > 0) & (d < 1)).all():
                    return np.concatenate((d, np.ones(MOST_DISCOUNTED - k)))
    r = np.arange(1, MOST_DISCOUNTED + 1)
    return 1 - (n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5) / r


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    factor = np.concatenate(([1.0], d, [1.0]))
    return counts * factor[np.minimum(counts, _R).astype(np.int64)]


class _Group:
    """The tokens of one group's documents: distinct words and pairs, and which token is which."""

    def __init__(self, table: pa.Table):
        self.ids = table["doc_id"].to_pylist()
        self.held = np.array([is_held_out(i) for i in self.ids], bool)
        tokens, docs, first = [], [], 0
        for batch in S.slices(table.to_batches()):
            data, bounds = S.joined(batch.column("text"))
            starts, ends, row = S.words(data, bounds, S.NOT_SPACE)
            rows = np.arange(batch.num_rows)
            tokens += [S.range_hashes(data, starts, ends, S.FOLDED_VALUES), np.full(batch.num_rows, END)]
            docs += [row + first, rows + first]
            first += batch.num_rows
        doc = np.concatenate(docs)
        order = np.argsort(doc, kind="stable")  # the end of a text was put after its words
        self.doc = doc[order]
        self.words, self.word = np.unique(np.concatenate(tokens)[order], return_inverse=True)
        self.learned = ~self.held[self.doc]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.learned], minlength=len(self.words))

    def find_grams(self, order: int) -> list[_Grams]:
        """N-grams of each length from two to ``order``. Histories of pairs are places in ``words``, the start of a text one
        beyond; those of longer ones are the shorter ones that end a word before. A text's first words are in no longer ones."""
        n = len(self.words)
        new = np.diff(self.doc, prepend=-1) != 0
        before = np.concatenate(([n], self.word[:-1]))
        before[new] = n
        names, at, lower, out = np.append(self.words, START), np.arange(len(self.doc)), None, []
        for length in range(2, order + 1):
            codes, number = np.unique(before * (n + 1) + self.word[at], return_inverse=True)
            first, second = codes // (n + 1), codes % (n + 1)
            shorter = second
            if lower is not None:
                shorter = np.empty(len(codes), np.int64)
                shorter[number] = lower
            out.append(_Grams(length, at, number, first, second, names, np.bincount(number[self.learned[at]], minlength=len(codes)), shorter))
            if length < order:  # a longer one at each place whose place before has one of this length, of the same text
                place = np.full(len(self.doc), -1)
                place[at] = number
                names = S.mix(S.mix(names)[first] + self.words[second])
                at = at[~new[at]]
                at = at[place[at - 1] >= 0]
                before, lower = place[at - 1], place[at]
        return out


class _Grams(NamedTuple):
    """A group's distinct n-grams of one length: ``number`` tells which one ends at each token of ``at``."""

    length: int
    at: np.ndarray
    number: np.ndarray
    #: Of each: the number of its history (of which ``histories`` has the names), its last word, how often the rows to learn
    #: from have it, and the n-gram without its first word (a word for a pair).
    first: np.ndarray
    second: np.ndarray
    histories: np.ndarray
    counts: np.ndarray
    lower: np.ndarray


def _slices(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    bounds = np.searchsorted(S.bucket_of(keys, buckets), np.arange(buckets + 1))
    return [(b, slice(bounds[b], bounds[b + 1])) for b in range(buckets)]


def _ask_words(buckets: int):
    def question(number: int, table: pa.Table, _) -> pa.Table:
        group = _Group(table)
        counts = group.word_counts().astype(np.uint32)
        rows = [(b, number, group.words[s].tobytes(), S.packed(counts[s])) for b, s in _slices(group.words, buckets)]
        return S.messages(rows)

    return question


def _count_words(number: int, asked: list[dict]) -> pa.Table:
    """Answers: the corpus's count of every word asked for, and this bucket's share of N, V and the counts of counts."""
    keys = [np.frombuffer(r["a"], np.uint64) for r in asked]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate([S.unpacked(r["b"], np.uint32) for r in asked])).astype(np.uint64)
    known = np.array([total.sum(), (total > 0).sum(), *_having(total)], np.int64).tobytes()
    rows, at = [], 0
    for r, k in zip(asked, keys):
        rows.append((r["sender"], number, b"words", S.packed(total[which[at : at + len(k)]]), known))
        at += len(k)
    return S.messages(rows)


def _having(counts: np.ndarray) -> np.ndarray:
    """How many of the counts are 1, 2, .. MOST_DISCOUNTED + 1."""
    return np.bincount(np.minimum(counts, _R + 1).astype(np.int64), minlength=_R + 2)[1 : _R + 1]


class _Unigram:
    """P(w) from N, V and the counts of counts."""

    def __init__(self, known: np.ndarray):
        self.known = np.asarray(known, np.int64)
        self.tokens, self.distinct = int(known[0]), int(known[1])
        self.d, self.n, r = discounts(self.known[2:]), max(self.tokens, 1), np.arange(1, _R)
        # words never seen get what the discounts take from words seen 1 .. MOST_DISCOUNTED times
        self.left = float(((1 - self.d) * r * self.known[2 : 2 + MOST_DISCOUNTED]).sum()) / self.n
        if not self.tokens:
            self.left = 1.0
        elif self.left == 0:  # only frequent words: as if one more token had been new
            self.left, self.d, self.n = 1 / (self.tokens + 1), np.ones(MOST_DISCOUNTED), self.tokens + 1

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, _discounted(count, self.d) / self.n, self.left)


class _Words(_Unigram):
    """The word level of the model and the corpus's counts of a group's words, from the answers to the group."""

    def __init__(self, answers: list[dict]):
        answers = [r for r in answers if r["a"] == b"words"]
        self.count = np.concatenate([S.unpacked(r["b"], np.uint64) for r in answers]).astype(np.int64)
        super().__init__(np.sum([np.frombuffer(r["c"], np.int64) for r in answers], axis=0))


def _bucket_spread(count: np.ndarray, tokens: int, buckets: int) -> np.ndarray:
    """Over how many buckets histories with these counts are spread: their share of all tokens, in buckets."""
    return np.clip(-(-count * buckets // max(tokens, 1)), 1, buckets)


def _gram_order(group: _Group, grams: _Grams, spread: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram, and their order by (bucket, history, word)."""
    home = S.bucket_of(S.mix(grams.histories), buckets)
    second = (S.mix(group.words)[grams.second] >> np.uint64(20)).astype(np.int64)
    bucket = (home[grams.first] + second % spread[grams.first]) % buckets
    return bucket, np.argsort(bucket, kind="stable")


def _history_rows(grams: _Grams, spread: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, history) of every question about a history, ordered: a spread one is asked for in all of its buckets."""
    n = len(grams.histories)
    home = S.bucket_of(S.mix(grams.histories), buckets)
    used = np.zeros(n, bool)
    used[grams.first] = True
    wide = np.flatnonzero(used)
    h = np.repeat(wide, spread[wide])
    step = np.arange(len(h)) - np.repeat(np.cumsum(spread[wide]) - spread[wide], spread[wide])
    code = np.sort((home[h] + step) % buckets * n + h)
    return code // n, code % n


class _Model:
    """P of a group's n-grams, one length after the other, as far as the answers to the group go."""

    def __init__(self, table: pa.Table, answers: pa.Table, order: int, buckets: int):
        answers = S.received(answers)
        self.group, self.words = group, words = _Group(table), _Words(answers)
        end = group.words.searchsorted(END)  # the start of a text is as frequent as its end
        p, count = words.p(words.count), np.append(words.count, words.count[end])
        #: What is known of each length answered, and of the next one: the n-grams, their shorter ones' P, the buckets.
        self.known: list[tuple[_Grams, np.ndarray]] = []
        for self.grams in group.find_grams(order):
            self.lower, self.spread = p[self.grams.lower], _bucket_spread(count, words.tokens, buckets)
            told = [r for r in answers if r["a"] == _answer_to(self.grams.length)]
            if not told:
                break
            p, count = self._answered(told, buckets)
            self.known.append((self.grams, p))

    def _answered(self, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        grams, spread = self.grams, self.spread
        _, order = _gram_order(self.group, grams, spread, buckets)
        _, asked = _history_rows(grams, spread, buckets)
        total = np.empty(len(order), np.int64)
        total[order] = np.concatenate([S.unpacked(r["b"], np.uint32) for r in answers])
        stats = np.concatenate([S.unpacked(r["c"], np.uint64).reshape(_R, -1) for r in answers], axis=1)
        n = len(grams.histories)
        count, *having = (np.bincount(asked, s, n) for s in stats)
        mass = np.bincount(asked, np.concatenate([S.unpacked(r["d"], np.float64) for r in answers]), n)
        d = discounts(np.sum([np.frombuffer(r["e"], np.int64) for r in answers], axis=0))
        return probabilities(total, grams.first, self.lower, count, np.array(having), mass, d), total


def _answer_to(length: int) -> bytes:
    return f"{length} words".encode()


def _ask_grams(length: int, buckets: int):
    def question(number: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        model = _Model(table, answers, length, buckets)
        group, grams, spread = model.group, model.grams, model.spread
        bucket, order = _gram_order(group, grams, spread, buckets)
        asked_bucket, asked = _history_rows(grams, spread, buckets)
        # n-grams of each asked (bucket, history); a history may have none in one of its buckets
        n = len(grams.histories)
        runs = np.bincount(np.searchsorted(asked_bucket * n + asked, bucket * n + grams.first), minlength=len(asked))
        gram_at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        asked_at = np.searchsorted(asked_bucket, np.arange(buckets + 1))
        second = (S.mix(group.words) >> np.uint64(16))[grams.second]
        rows = []
        for b in range(buckets):
            mine, hs = order[gram_at[b] : gram_at[b + 1]], slice(asked_at[b], asked_at[b + 1])
            low = second[mine].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            counts = grams.counts[mine].astype(np.uint32)
            # of the words seen after the history: how often they come at all, or what P gives to them after a shorter one
            seen = mine[counts > 0]
            of_word = model.words.count[grams.second[seen]] if length == 2 else model.lower[seen]
            history = grams.histories[asked[hs]].tobytes()
            rows.append((b, number, history, S.packed(runs[hs].astype(np.uint32)), low, S.packed(counts), model.words.known.tobytes() + S.packed(of_word)))
        return S.messages(rows)

    return question


def _count_grams(length: int):
    """Answers: the corpus's count of every n-gram asked for; of every history its count, how many words were seen 1 ..
    MOST_DISCOUNTED times after it, and what P gives to all words seen after it, after its shorter one; this bucket's counts
    of counts."""

    def reply(number: int, asked: list[dict]) -> pa.Table:
        head = 8 * (_R + 2)
        histories = [np.frombuffer(r["a"], np.uint64) for r in asked]
        names, which = np.unique(np.concatenate(histories), return_inverse=True)
        history = np.repeat(which, np.concatenate([S.unpacked(r["b"], np.uint32) for r in asked]))
        low = np.zeros((len(history), 8), np.uint8)
        low[:, :6] = np.frombuffer(b"".join(r["c"] for r in asked), np.uint8).reshape(-1, 6)
        counts = [S.unpacked(r["d"], np.uint32) for r in asked]
        sizes = [len(c) for c in counts]
        count = np.concatenate(counts)
        prints = S.mix(S.mix(names)[history] + low.view(np.uint64)[:, 0])
        _, first, gram = np.unique(prints, return_index=True, return_inverse=True)
        total = np.bincount(gram, count, len(first)).astype(np.int64)
        kind = np.int64 if length == 2 else np.float64
        of_word = np.zeros(len(first), kind)
        of_word[gram[count > 0]] = np.concatenate([S.unpacked(r["e"][head:], kind) for r in asked])
        mine, n = history[first], len(names)
        seen = total > 0
        rows = [np.bincount(mine, total, n)]
        rows += [np.bincount(mine[total == r], minlength=n) for r in range(1, _R)]
        stats = np.array(rows, np.uint64)
        p = _Unigram(np.frombuffer(asked[0]["e"][:head], np.int64)).p(of_word[seen]) if length == 2 else of_word[seen]
        mass = np.bincount(mine[seen], p, n).astype(np.float64)
        having = _having(total).astype(np.int64).tobytes()
        out, at, h = [], 0, 0
        for r, size, names_asked in zip(asked, sizes, histories):
            own = which[h : h + len(names_asked)]
            answer = S.packed(total[gram[at : at + size]].astype(np.uint32))
            out.append((r["sender"], number, _answer_to(length), answer, S.packed(stats[:, own]), S.packed(mass[own]), having))
            at, h = at + size, h + len(names_asked)
        return S.messages(out)

    return reply


def _score(order: int, buckets: int):
    def result(_: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        model = _Model(table, answers, order, buckets)
        group, words = model.group, model.words
        of_token = np.zeros(len(group.doc))
        for grams, p in model.known:  # the longest that a token has stays
            of_token[grams.at] = np.log10(p)[grams.number]
        docs = len(group.ids)
        base = np.log10((words.count + 0.1) / (words.tokens + 0.1 * (words.distinct + 1)))
        known = words.count > 0
        columns = [
            group.ids,
            group.held,
            np.bincount(group.doc, minlength=docs),
            np.bincount(group.doc[known[group.word]], minlength=docs),
            np.full(docs, words.tokens),
            np.bincount(group.doc, base[group.word], docs),
            np.bincount(group.doc, of_token, docs),
        ]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCORED_ARROW.types)], schema=_SCORED_ARROW)

    return result


def probabilities(
    total: np.ndarray, first: np.ndarray, p: np.ndarray, count: np.ndarray, having: np.ndarray, mass: np.ndarray, d: np.ndarray
) -> np.ndarray:
    """P(w | h) of n-grams seen ``total`` times, ``p`` being what the shorter history gives to w.

    Of history h = ``first``: ``count`` is c(h), ``having`` how many words follow it once, twice, .., ``mass`` what the shorter
    one gives to all words that follow it. A history never seen backs off with weight 1. One that is only followed by
    frequent words has no discount to hand down: it counts as if one more token had been new.
    """
    r = np.arange(1, _R)[:, None]
    left = ((1 - d)[:, None] * r * having).sum(axis=0)
    bare = (left == 0) & (count > 0)
    whole = np.where(bare, count + 1, np.maximum(count, 1))
    left = np.where(count > 0, np.where(bare, 1, left) / whole, 1.0)
    alpha = left / np.where(count > 0, 1 - mass, 1.0)
    taken = np.where(bare[first], total, _discounted(total, d))
    return np.where(total > 0, np.maximum(taken, 1e-300) / whole[first], alpha[first] * p)


def score(df: DataFrame, text: str = "text", id_column: str = "doc_id", order: int = 2) -> DataFrame:
    """Scores of all whole texts by a model of those that are not held out, of n-grams up to ``order`` words. A row for each row
    of ``df``.

    Words are what lies between ASCII white space, A-Z lower-cased; one end token follows each text, also a null or
    empty one. Rows without an id are held out; repeated rows count and score as often as they come.
    """
    if order < 2:
        raise ValueError("a model has at least pairs")
    docs = S.documents(df, text, id_column)
    count = S.share_count(df)
    dealt = S.deal(docs, count)
    answers = S.answer(S.ask(dealt, _ask_words(count)), _count_words)
    for length in range(2, order + 1):
        answers = answers.unionAll(S.answer(S.ask(dealt, _ask_grams(length, count), answers), _count_grams(length)))
    return S.finish(dealt, answers, _score(order, count), SCORED, _SCORED_ARROW.empty_table())
