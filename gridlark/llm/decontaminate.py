"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton recognises every run of words inside an item. Training words stream through it: after each word its state
stands for the longest run that ends there, and the run's length is known. Once that length reaches the window (or the
whole of an item shorter than a window) the last words are a hit. Words are numbered by the benchmark's vocabulary, and
only stretches whose neighbouring word pairs all occur in the benchmark reach the automaton: elsewhere the longest run
is shorter than the shortest window.

Long items are cut into pieces that overlap by a window less one word, so that every window lies in one of them. Pieces
are dealt by a running word count to blocks of at most about twice ``BLOCK_WORDS`` words, in a table in the shared
folder. Each block is broadcast on its own, and every document passes through ``RESIDENT`` of them in one read; only
the blocks of that read pass through the driver. A larger benchmark takes more reads: what was found so far is then
written to a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.support import slices
from gridlark.plans.session import scratch_path

WINDOW = 13
#: Item words in one automaton: at most twice as many states, some two hundred bytes each.
BLOCK_WORDS = 100_000
#: Automata that a worker holds at a time.
RESIDENT = 4
#: Hit words of a document that make it contaminated, as a share of its words: one in twenty.
ONE_IN = 20
PIECES = "item long, body binary, part int, before long, n long"
_PIECE_ARROW = pa.schema([("item", pa.int64()), ("body", pa.binary()), ("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64())])
FOUND = "n_words long, n_hit long, hit_spans array<struct<start:int,end:int>>, items array<bigint>"
_FOUND_ARROW = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("hit_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.int64())),
    ]
)
#: Lower-cases A-Z and makes a space of every byte that is not in a word (0-9, a-z, and all beyond ASCII).
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class Automaton:
    """The generalised suffix automaton of items (id, words), over word numbers."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        ends: list[tuple[int, int]] = []  # states of the prefixes of items of a window and more, with the item
        whole: dict[int, list[int]] = {}  # states of shorter items as a whole
        for item, words in items:
            state = 0
            for n, word in enumerate(words, 1):
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if n >= window and len(words) >= window:
                    ends.append((state, item))
            if 0 < len(words) < window:
                whole.setdefault(state, []).append(item)
        self.shortest = min((min(len(w), window) for _, w in items if w), default=window)
        self._collect(ends, whole)

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # the run is known already, maybe inside a longer one
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(-1)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the shorter runs of q, which are found in more places."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _collect(self, ends: list[tuple[int, int]], whole: dict[int, list[int]]) -> None:
        """For each state that holds runs of a window: the items they occur in. For each: the short items it ends with."""
        of: dict[int, set[int]] = {}
        for state, item in ends:
            while state > 0 and self.length[state] >= self.window and item not in of.setdefault(state, set()):
                of[state].add(item)
                state = self.link[state]
        self.items_of = of
        # a short item's state may stand for shorter runs too, so its own length decides
        self.short = {s: (self.length[s], found) for s, found in whole.items()}
        self.next_short: list[int] = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.next_short[s] = up if up in self.short else self.next_short[up] if up > 0 else -1

    def pairs(self) -> np.ndarray:
        """Codes of all neighbouring word pairs of the items."""
        base = len(self.vocabulary) + 1
        found = {a * base + b for a, s in self.next[0].items() for b in self.next[s]}
        return np.array(sorted(found), np.int64)

    def hits(self, words: list[int], state: int = 0, length: int = 0) -> Iterator[tuple[int, int, list[int]]]:
        """(end, length, items) of every window that ends at a word of this stretch."""
        follow, link, size, window = self.next, self.link, self.length, self.window
        for end, c in enumerate(words, 1):
            while state and c not in follow[state]:
                state = link[state]
                length = size[state]
            state = follow[state].get(c, 0)
            length = length + 1 if state else 0
            if length >= window:
                s = state
                while size[link[s]] >= window:
                    s = link[s]
                yield end, window, list(self.items_of.get(s, ()))
            s = state if state in self.short else self.next_short[state] if state else -1
            while s >= 0:
                need, items = self.short[s]
                if length >= need:
                    yield end, need, items
                s = self.next_short[s]


class Scanner:
    """An automaton and the filter in front of it, built once for each worker."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.automaton = Automaton(items, window)
        self.known = self.automaton.vocabulary
        self.base = len(self.known) + 1
        self.pairs = self.automaton.pairs()

    def scan(self, words: list[bytes], hit: np.ndarray, items: set[int]) -> None:
        """Marks the hit words and adds the items that occur."""
        least = self.automaton.shortest
        if len(words) < least or not self.known:
            return
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if least == 1:
            good = codes >= 0
            starts, ends = _runs(good)
        else:
            both = codes[:-1] * self.base + codes[1:]
            both[(codes[:-1] < 0) | (codes[1:] < 0)] = -1
            place = np.minimum(np.searchsorted(self.pairs, both), max(len(self.pairs) - 1, 0))
            good = self.pairs[place] == both if len(self.pairs) else np.zeros(len(both), bool)
            starts, ends = _runs(good)
            ends = ends + 1
        for start, end in zip(starts, ends):
            if end - start >= least:
                for stop, length, found in self.automaton.hits(codes[start:end].tolist()):
                    hit[start + stop - length : start + stop] = True
                    items.update(found)


def _runs(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], good.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, items: list, window: int) -> Scanner:
    """This worker's scanner of a block; only the blocks of one benchmark are kept."""
    if key not in _SCANNERS:
        owner = key.rpartition("/")[0]
        for other in [k for k in _SCANNERS if k.rpartition("/")[0] != owner]:
            del _SCANNERS[other]
        _SCANNERS[key] = Scanner([(i, words_of(t)) for i, t in items], window)
    return _SCANNERS[key]


def store_blocks(benchmark: DataFrame, block_words: int, text: str, id_column: str, window: int = WINDOW) -> DataFrame:
    """The distinct items, cut into pieces and stored by block: (item, body, block). No block has as many as
    2 * ``block_words`` + ``window`` words. Items without an id or without words have no windows.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_column).cast("long").alias("item"), F.col(text).cast("binary").alias("body"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "body"):
            rows = []
            for item, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist()):
                words = words_of(body)
                for at in range(0, max(len(words) - window, 0) + 1 if words else 0, block_words):
                    piece = words[at : at + block_words + window - 1]
                    rows.append((item, b" ".join(piece), part, before, len(piece)))
                    before += len(piece)
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_ARROW.types)], schema=_PIECE_ARROW)

    cut, folder = scratch_path(spark, "pieces"), scratch_path(spark, "blocks")
    items.where(F.col("item").isNotNull()).distinct().mapInArrow(pieces, PIECES).write.parquet(cut)
    stored = spark.read.schema(PIECES).parquet(cut)
    # only one row for each written file goes through the running total
    sums = stored.groupBy("part").agg(F.sum("n").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    block = F.floor((F.col("part_start") + F.col("before")) / F.lit(block_words)).cast("long")
    stored.join(starts, "part").select("item", "body", block.alias("block")).write.partitionBy("block").parquet(folder)
    return spark.read.schema("item long, body binary, block long").parquet(folder)


def scan(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    prefix: str = "",
) -> DataFrame:
    """All rows and columns of ``df`` and what was found in each: n_words, n_hit, hit_spans (word numbers), items.

    ``prefix`` goes before those four names, for inputs that have such columns. Null text has no words. Repeated rows
    are judged alike. An empty benchmark contaminates nothing. Items are distinct by id in the result.
    """
    spark = df.sparkSession
    body, names = f"{prefix}body", [prefix + f.name for f in _FOUND_ARROW]
    stored = store_blocks(benchmark, block_words, item_text, item_id, window)
    numbers = [r["block"] for r in stored.select("block").distinct().orderBy("block").collect()]
    shared: list = []
    fields = T._parse_datatype_string(FOUND).fields
    out = T.StructType([*df.schema.fields, *(T.StructField(prefix + f.name, f.dataType) for f in fields)])
    for first in range(0, max(len(numbers), 1), RESIDENT):
        source = df.withColumn(body, F.col(text).cast("binary"))
        if first:
            folder = scratch_path(spark, "decontaminate")
            df.write.parquet(folder)
            source = spark.read.parquet(folder).withColumn(body, F.col(text).cast("binary"))
        for b in shared:
            b.destroy()  # that read is written
        held: dict[int, list] = {b: [] for b in numbers[first : first + RESIDENT]}
        for r in stored.where(F.col("block").isin(list(held))).collect():
            held[r["block"]].append((r["item"], bytes(r["body"])))
        shared = [spark.sparkContext.broadcast(sorted(items)) for items in held.values()]
        df = source.mapInArrow(_judge(shared, window, body, names, bool(first)), out)
    return df


def _judge(shared: list, window: int, body: str, names: list[str], again: bool):
    """The function for one read: words, hits (with those of earlier reads) and items of each row."""
    owner = str([b._jbroadcast.id() for b in shared])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [_scanner(f"{owner}/{i}", b.value, window) for i, b in enumerate(shared)]
        for batch in slices(batches, body):
            rows = []
            earlier = [batch.column(n).to_pylist() for n in names[2:]] if again else []
            for r, raw in enumerate(batch.column(body).to_pylist()):
                words = words_of(raw)
                hit, items = np.zeros(len(words), bool), set(earlier[1][r] if again else ())
                for span in earlier[0][r] if again else ():
                    hit[span["start"] : span["end"]] = True
                for s in scanners:
                    s.scan(words, hit, items)
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(*_runs(hit))]
                rows.append((len(words), int(hit.sum()), spans, sorted(items)))
            new = [pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 4, _FOUND_ARROW.types)]
            kept = [n for n in batch.schema.names if n != body and n not in (names if again else ())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + new, names=kept + names)

    return judge


def contaminated(n_hit, n_words, one_in: int = ONE_IN):
    """The contract's rule as a Column: something was hit, and at least a twentieth of the words."""
    return (n_hit > 0) & (one_in * n_hit >= n_words)
