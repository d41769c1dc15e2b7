"""Keyword search for a whole table of questions over a stored inverted index.

The index is a table of blocks. A block holds some documents of one collection, the distinct words of their texts and,
for each word, the documents that have it. A word of a question is found in a text where it is part of one of the text's
words, so a block's few thousand words are searched instead of its texts. Questions are packed in blocks too, with their
distinct words; a group of them that fits in memory is broadcast and meets the blocks of the collections that it is routed to,
one pass over the index for each group, so that the index is never moved. Of a block's documents that have the same of all words
asked for only the first k can be wanted; questions are scored against the different ones by a matrix product. A task keeps k
documents for each question and collection over all the blocks that it has met, and no pair of a question and a document is a
row before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.operators.blocks import groups_of, in_passes
from gridlark.plans.session import scratch_path

#: A word is a longest run of these.
WORD = r"[\p{L}\p{N}_]+"
#: Documents and bytes of words of an index block, questions and bytes of their words of a question block.
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20
QUESTIONS, QUESTION_BYTES = 2048, 1 << 20
#: Question blocks that meet the index in one pass, by their bytes, and documents that a task holds for them.
GROUP_BYTES, HELD_HITS = 64 << 20, 500_000
#: Questions that are scored at a time, words times documents that are, and bytes that a block remembers of words asked before.
SLICE, CELLS, KNOWN_BYTES = 256, 8 << 20, 32 << 20
#: Bits of the table of four-byte pieces that a block's words have.
PIECE_BITS = 20

INDEX = "block long, scope string, ids array<string>, words string, counts binary, places binary"
_INDEX = pa.schema(
    [
        ("block", pa.int64()), ("scope", pa.string()), ("ids", pa.list_(pa.string())), ("words", pa.string()),
        ("counts", pa.binary()), ("places", pa.binary()),
    ]
)


def words_of(text: Column) -> Column:
    """Words of a text in lower case, repeated ones as often as they occur."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def index_words(df: DataFrame, id_column: str, text_column: str, folder: str, scope: str | None = None) -> DataFrame:
    """Writes the inverted index of every row that has a text and returns the stored table. Each task indexes the rows
    that it reads: nothing is shuffled, and the words of a row leave Spark's own expressions only to be packed."""
    rows = df.where(F.col(text_column).isNotNull()).select(
        F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("scope") if scope else F.lit("").alias("scope"),
        F.col(id_column).cast("string").alias("id"),
        F.array_distinct(words_of(F.col(text_column))).alias("words"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, size, rows_held = TaskContext.get(), {}, 0, 0
        number = (context.partitionId() if context else 0) << 32

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for scope_name, documents in held.items():
                documents.sort(key=lambda d: d[0])
                having: dict[str, list[int]] = {}
                for place, (_, words) in enumerate(documents):
                    for word in words:
                        having.setdefault(word, []).append(place)
                names = sorted(having)
                counts = np.array([len(having[w]) for w in names], np.uint16)
                places = np.concatenate([np.array(having[w], np.uint16) for w in names] or [np.empty(0, np.uint16)])
                row = (number, scope_name, [d[0] for d in documents], "\n".join(names), counts.tobytes(), places.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _INDEX.types)], schema=_INDEX)
                number += 1
            held.clear()

        for batch in batches:
            for scope_name, ident, words in zip(*(batch.column(c).to_pylist() for c in ("scope", "id", "words"))):
                held.setdefault(scope_name, []).append((ident, words))
                size, rows_held = size + sum(map(len, words)), rows_held + 1
                if rows_held >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield from packed()
                    size = rows_held = 0
        yield from packed()

    rows.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _pieces(codes: np.ndarray) -> np.ndarray:
    """Where pieces of up to four bytes have their bit."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - PIECE_BITS)


def _windows(data: np.ndarray) -> np.ndarray:
    """The four bytes from each place on, as a number; zeros follow the last one."""
    wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    return wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24


_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


class Block:
    """One index block: which of its documents have a word."""

    def __init__(self, ids: list[str], words: str, counts: bytes, places: bytes):
        self.ids, self.text = ids, words.encode()
        data = np.frombuffer(self.text, np.uint8)
        ends = np.flatnonzero(data == 10)
        self.starts = np.concatenate(([0], ends + 1)) if len(data) else np.empty(0, np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(np.frombuffer(counts, np.uint16), dtype=np.int64)))
        self.places = np.frombuffer(places, np.uint16)
        self.known: dict[bytes, np.ndarray | None] = {}
        self.known_bytes, self.tables = 0, None

    def having(self, word: str) -> np.ndarray:
        """Places of the documents that have a word with ``word`` in it."""
        return np.flatnonzero(np.unpackbits(found, count=len(self.ids))) if (found := self._having(word.encode())) is not None else np.empty(0, np.int64)

    def _having(self, word: bytes) -> np.ndarray | None:
        """A bit for each document; None where no document has the word."""
        if word not in self.known:
            found, at = [], self.text.find(word)
            while at >= 0:
                found.append(at)
                end = self.text.find(b"\n", at)  # on to the next word of the block
                at = self.text.find(word, end) if end >= 0 else -1
            if self.known_bytes > KNOWN_BYTES:
                self.known.clear()
                self.known_bytes = 0
            self.known[word] = None
            if found:
                bits = np.zeros(len(self.ids), bool)
                hits = np.searchsorted(self.starts, found, side="right") - 1
                bits[np.concatenate([self.places[self.bounds[h] : self.bounds[h + 1]] for h in hits])] = True
                self.known[word] = np.packbits(bits)
                self.known_bytes += self.known[word].nbytes
        return self.known[word]

    def met(self, asked: Asked) -> tuple[np.ndarray, list[np.ndarray]]:
        """Numbers of the asked words that the block has, and a bit for each document of each. Most words are ruled out by a
        piece that no word of the block has."""
        if self.tables is None:
            windows = _windows(np.frombuffer(self.text, np.uint8))
            self.tables = np.zeros((5, 1 << PIECE_BITS), bool)
            for size in range(1, 5):
                self.tables[size, _pieces(windows & _MASKS[size])] = True
        likely = np.flatnonzero(self.tables[asked.sizes[:, None], asked.pieces].all(axis=1))
        found = [(n, bits) for n in likely.tolist() if (bits := self._having(asked.word(n))) is not None]
        return np.array([n for n, _ in found], np.int64), [bits for _, bits in found]


class Asked:
    """A block of questions: its distinct words, and which question has which of them, how often."""

    def __init__(self, scopes: list[str], keys: list[str], words: str, ends: bytes, numbers: bytes, least_length: int):
        self.scopes, self.keys, self.text = scopes, keys, words.encode()
        self.numbers = np.frombuffer(numbers, np.int32)
        own = np.diff(np.frombuffer(ends, np.int32), prepend=0)
        self.question = np.repeat(np.arange(len(keys)), own)
        self.wordless = np.flatnonzero(own == 0)
        data = np.frombuffer(self.text, np.uint8)
        stops = np.append(np.flatnonzero(data == 10), len(data)) if len(data) else np.empty(0, np.int64)
        self.starts, self.stops = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops, stops
        sizes = self.stops - self.starts
        # a character has one byte that does not go on with another one
        characters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.long = characters[self.stops] - characters[self.starts] >= least_length
        self.scored = np.bincount(self.question[self.long[self.numbers]], minlength=len(keys))
        # the first, the last and the middle piece of each word
        self.sizes = np.minimum(sizes, 4)
        at = self.starts[:, None] + np.stack((np.zeros_like(sizes), sizes - self.sizes, (sizes - self.sizes) // 2), axis=1)
        self.pieces = _pieces(_windows(data)[at] & _MASKS[self.sizes][:, None]) if len(data) else np.empty((0, 3), np.uint64)

    def word(self, number: int) -> bytes:
        return self.text[self.starts[number] : self.stops[number]]


class Best:
    """The k best documents so far of each question of a block in one collection."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k = asked, k
        self.hits: list[list[tuple[int, str]]] = [[] for _ in asked.keys]
        self.points, self.last = np.full(len(asked.keys), -1), [""] * len(asked.keys)

    def _add(self, q: int, found: list[tuple[int, str]]) -> None:
        own = self.hits[q] = sorted([*self.hits[q], *found], key=lambda hit: (-hit[0], hit[1]))[: self.k]
        if len(own) == self.k:
            self.points[q], self.last[q] = own[-1]

    def meet(self, block: Block) -> None:
        """The documents of a block with any of a question's words that have most of its longer ones, ties to the smaller id.
        Without a word every document has the same standing."""
        asked, k, ids = self.asked, self.k, block.ids
        for q in self.asked.wordless.tolist():
            if self.points[q] < 0 or ids[0] < self.last[q]:
                self._add(q, [(0, i) for i in ids[:k]])
        met, bits = block.met(asked)
        if not len(met):
            return
        bits, step = np.stack(bits), max(8, CELLS // len(met) & ~7)
        for start in range(0, len(ids), step):
            self._meet_some(ids[start : start + step], met, np.unpackbits(bits[:, start // 8 : (start + step) // 8], axis=1, count=min(step, len(ids) - start)))

    def _meet_some(self, ids: list[str], met: np.ndarray, has: np.ndarray) -> None:
        """Documents of which ``has`` tells, word by word, which of the words ``met`` they have."""
        asked, k = self.asked, self.k
        # documents that have the same of the words stand alike: their ids ascend, so only the first k of them count
        told = np.ascontiguousarray(np.packbits(has.T, axis=1))
        _, first, kind = np.unique(told.view(f"V{told.shape[1]}")[:, 0], return_index=True, return_inverse=True)
        order = np.argsort(kind, kind="stable")
        rank = np.arange(len(order)) - np.repeat(np.flatnonzero(np.diff(kind[order], prepend=-1)), np.bincount(kind))
        places = np.sort(order[rank < k])
        kinds = has[:, first].astype(np.float32)
        column = np.full(len(asked.starts), -1)
        column[met] = np.arange(len(met))
        at, long = column[asked.numbers], asked.long[met]
        known = at >= 0
        question, at = asked.question[known], at[known]
        bounds = np.searchsorted(question, np.arange(0, len(asked.keys) + SLICE, SLICE))
        width = len(ids) + 1
        for start, lo, hi in zip(range(0, len(asked.keys), SLICE), bounds[:-1], bounds[1:]):
            if lo == hi:
                continue
            rows = min(SLICE, len(asked.keys) - start)
            often = np.bincount((question[lo:hi] - start) * len(met) + at[lo:hi], minlength=rows * len(met)).reshape(rows, -1).astype(np.float32)
            points, other = often[:, long] @ kinds[long], often[:, ~long] @ kinds[~long]
            points[(points == 0) & (other == 0)] = -1
            # points first, then the smaller place, in one whole number; none of the words is below all others
            best = (points.astype(np.float64) * width - first).max(axis=1)
            top = np.ceil(best / width)
            could = np.flatnonzero((top >= 0) & (top >= self.points[start : start + rows]))
            better = [
                i for i, t, p in zip(could.tolist(), top[could].tolist(), (top * width - best)[could].tolist())
                if t > self.points[start + i] or ids[int(p)] < self.last[start + i]
            ]
            if better:
                score = points[better][:, kind[places]].astype(np.float64) * width - places
                kept = np.argpartition(-score, k - 1, axis=1)[:, :k] if len(places) > k else np.tile(np.arange(len(places)), (len(better), 1))
                for i, row, own in zip(better, kept.tolist(), score):
                    self._add(start + i, [(int(np.ceil(own[c] / width)), ids[places[c]]) for c in row if own[c] > -width])


def pack_questions(questions: DataFrame, key: str, text: str, scopes: str, folder: str) -> DataFrame:
    """Blocks (block, scopes, keys, words, and by question the numbers of its words) of questions with the same route, as a
    stored table."""
    rows = questions.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"), F.col(scopes).alias("scopes"))
    fields = [
        ("q_block", T.LongType(), pa.int64()), ("scopes", T.ArrayType(T.StringType()), pa.list_(pa.string())),
        ("keys", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("asked", T.StringType(), pa.string()),
        ("ends", T.BinaryType(), pa.binary()), ("numbers", T.BinaryType(), pa.binary()),
    ]
    schema = T.StructType([T.StructField(name, kind) for name, kind, _ in fields])
    arrow = pa.schema([(name, kind) for name, _, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, sizes = TaskContext.get(), {}, {}
        number = (context.partitionId() if context else 0) << 32

        def packed(route: tuple[str, ...]) -> pa.RecordBatch:
            nonlocal number
            keys, asked = zip(*held.pop(route))
            sizes.pop(route)
            number += 1
            names = {w: n for n, w in enumerate(sorted({w for words in asked for w in words}))}
            ends = np.cumsum([len(words) for words in asked], dtype=np.int32)
            numbers = np.array([names[w] for words in asked for w in words], np.int32)
            row = (number, list(route), list(keys), "\n".join(names), ends.tobytes(), numbers.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types)], schema=arrow)

        for batch in batches:
            for name, words, route in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "scopes"))):
                route = tuple(dict.fromkeys(route or ()))
                held.setdefault(route, []).append((name, words or []))
                sizes[route] = sizes.get(route, 0) + sum(map(len, words or []))
                if len(held[route]) >= QUESTIONS or sizes[route] >= QUESTION_BYTES:
                    yield packed(route)
        for route in list(held):
            yield packed(route)

    rows.mapInArrow(run, schema).write.parquet(folder)
    return questions.sparkSession.read.parquet(folder)


HITS = "q_block long, place int, scope string, id string, points long, scored long"
_HITS = pa.schema(
    [("q_block", pa.int64()), ("place", pa.int32()), ("scope", pa.string()), ("id", pa.string()), ("points", pa.int64()), ("scored", pa.int64())]
)


def _meeting(rows: list, k: int, least_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with the index blocks it reads: all of them meet the blocks of questions in ``rows`` (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(r[0], Asked(r[1], r[2], r[3], r[4], r[5], least_length)) for r in rows.value]
        held: dict[tuple[int, str], Best] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                scope, *parts = (batch.column(c)[r].as_py() for c in ("scope", "ids", "words", "counts", "places"))
                block = None
                for number, own in asked:
                    if scope in own.scopes:
                        block = block or Block(*parts)
                        if (number, scope) not in held:
                            held[number, scope] = Best(own, k)
                        held[number, scope].meet(block)
        for (number, scope), best in held.items():
            found = [(number, q, scope, ident, points, n) for q, (own, n) in enumerate(zip(best.hits, best.asked.scored.tolist())) for points, ident in own]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _HITS.types)], schema=_HITS)

    return run


def search(questions: DataFrame, index: DataFrame, key: str, text: str, scopes: str, k: int, least_length: int) -> DataFrame:
    """For each question and each collection that it is routed to (``scopes``, an array column): the k documents with any
    of its words that have most of the longer ones: (key, scope, id, points, scored), of which ``scored`` is the number of
    the question's longer words. Repeated words count as often; ties go to the smaller id.

    Groups of questions pass over the index one after the other; each pass stores the tasks' best."""
    spark, folder = index.sparkSession, scratch_path(index.sparkSession, "questions")
    asked = pack_questions(questions, key, text, scopes, f"{folder}/asked")
    size = F.octet_length("asked") + F.octet_length("ends") + F.octet_length("numbers")
    sizes = asked.select("q_block", size.alias("bytes"), (F.size("keys") * F.size("scopes") * k).alias("hits")).orderBy("q_block").collect()
    groups = groups_of([(r["q_block"], r["bytes"], r["hits"]) for r in sizes], GROUP_BYTES, HELD_HITS)
    blocks = index.select("scope", "ids", "words", "counts", "places").coalesce(spark.sparkContext.defaultParallelism)

    held = asked.select("q_block", "scopes", "keys", "asked", "ends", "numbers")
    met = in_passes(held, "q_block", groups, lambda rows: blocks.mapInArrow(_meeting(rows, k, least_length), HITS), f"{folder}/hits")
    order = Window.partitionBy("q_block", "place", "scope").orderBy(F.col("points").desc(), "id")
    best = met.withColumn("standing", F.row_number().over(order)).where(F.col("standing") <= k)
    names = asked.select("q_block", F.posexplode("keys").alias("place", "key"))
    names = F.broadcast(names) if len(groups) <= 1 else names
    return best.join(names, ["q_block", "place"]).select("key", "scope", "id", "points", "scored")
