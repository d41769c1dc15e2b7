"""Packing along a space-filling curve: like documents share sequences, and next to nothing is padded.

Every document becomes a vector of hashed byte four-grams, projected to three dimensions by fixed random signs. The
place of that point on a Hilbert curve is the sort key. Places are found once and stored with the texts; how many bytes
lie in each stretch of the curve tells where to cut it, so that every partition of the sort gets about as many bytes of
neighbouring documents. There they are laid end to end and cut into sequences. What is left at the end of a partition is
cut into sequences whose sizes are powers of two, so it needs no padding either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.support import documents, joined, mix, share_count, slices
from gridlark.llm.tokens import MEMORY, encoder
from gridlark.plans.session import scratch_path

DIMENSIONS, BITS = 3, 10
#: What a document weighs besides its text.
ROW_BYTES = 64
SEQUENCE_TOKENS = 2048
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_PIECE_ARROW = pa.schema([(k, pa.binary() if k == "ids" else pa.int64()) for k in (c.split()[0] for c in PIECES.split(", "))])
#: Signs of the projection: rows of -1 and 1 from a hash of the feature's number.
_SIGNS = ((mix(np.arange(1, (1 << 16) + 1))[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1


#: The signs of all dimensions as one number, a field of bits for each; bytes whose sums fit a field.
_FIELD = 20
_PACKED = (((_SIGNS > 0).astype(np.int64)) << (np.arange(DIMENSIONS) * _FIELD)).sum(axis=1)
_RUN = (1 << _FIELD) - 1
#: Text bytes whose places are found at a time, or that are encoded: both take many times their memory.
_AT_ONCE = 1 << 20


def vectors(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A point in [-1, 1]**3 for each row: the mean of its features' signs; rows of under four bytes are at 0."""
    sizes = np.maximum(np.diff(bounds) - 3, 0)
    out = np.zeros((len(sizes), DIMENSIONS))
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    w = data.astype(np.uint32)
    mixed = (w[:-3] | w[1:-2] << 8 | w[2:-1] << 16 | w[3:] << 24) * np.uint32(0x9E3779B1)
    signs = np.append(_PACKED[mixed >> 16], 0)
    # runs of features whose sums fit the fields, and after each row what isn't its own; then the runs of a row together
    first, last = bounds[some], bounds[some] + sizes[some]
    runs = -(-sizes[some] // _RUN)
    row = np.repeat(np.arange(len(some)), runs)
    start = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)) * _RUN
    cuts = np.stack((start, np.minimum(start + _RUN, last[row])), axis=1).reshape(-1)
    sums = np.add.reduceat(signs, cuts)[::2]
    for d in range(DIMENSIONS):
        positive = np.bincount(row, (sums >> (d * _FIELD)) & _RUN, len(some))
        out[some, d] = (2 * positive - sizes[some]) / sizes[some]
    return out


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve through the grid of 2**bits cells a side (Skilling's transpose form)."""
    n = points.shape[1]
    grid = np.clip(((np.tanh(4 * points) + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    x = [grid[:, i].copy() for i in range(n)]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(grid), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(len(grid), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] ^ turn) >> bit & 1
    return key


def curve_places(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, text (bytes) and place, the document's place on the curve."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=_AT_ONCE):
            yield batch.append_column("place", pa.array(hilbert_keys(vectors(*joined(batch.column("text"))))))

    return documents(df, text, id_column).mapInArrow(places, "doc_id long, text binary, place long")


def pack(
    df: DataFrame,
    vocabulary: str,
    size: int = SEQUENCE_TOKENS,
    end_id: int = 1,
    text: str = "text",
    id_column: str = "doc_id",
    memory: int = MEMORY,
) -> DataFrame:
    """Pieces of documents and where they lie: sequence and offset, without gaps, in sequences of at most ``size`` ids.

    A document's ids are its whole text's and then ``end_id``; null text counts as empty. ``start`` counts the
    document's ids before the piece, ``ids`` are little-endian unsigned 32-bit. Every sequence has ``size`` ids or a
    power of two (``size`` itself should be one), so none needs padding. Rows with one place are ordered by id and
    text, so copies may be dealt to several partitions. ``memory`` bounds the words that a worker remembers.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, held, used = encoder(vocabulary, memory).ids, TaskContext.get().partitionId() << 40, [], 0
        for batch in slices(batches, limit=_AT_ONCE):
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode((raw or b"").decode()), np.uint32(end_id)).astype("<u4")
                start = 0
                while start < len(ids):
                    part = ids[start : start + size - used]
                    held.append((doc_id, start, part, len(ids), number, used))
                    start, used = start + len(part), used + len(part)
                    if used == size:
                        rows += held
                        held, used, number = [], 0, number + 1
            yield _pieces(rows)
        yield _pieces(list(_powers_of_two(held, used, number)))

    dealt = along_curve(df, text, id_column)
    return dealt.mapInArrow(pieces, PIECES)


#: Stretches that the curve is cut into to weigh them; their sizes are all that the driver gets to see.
STRETCH_BITS = 16


def along_curve(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text) in the order of the curve, in partitions of about equal bytes. A stretch that alone holds more than
    a partition, such as a group of copies, is dealt to several, by a hash of id and text."""
    spark, folder = df.sparkSession, scratch_path(df.sparkSession, "curve")
    shift = DIMENSIONS * BITS - STRETCH_BITS
    placed = curve_places(df, text, id_column).withColumn("stretch", F.shiftright("place", shift).cast("int"))
    placed.write.parquet(folder)
    stored = spark.read.parquet(folder)
    weighed = stored.groupBy("stretch").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(b""))) + F.lit(ROW_BYTES)).alias("bytes"))
    sizes = sorted((r["stretch"], r["bytes"]) for r in weighed.collect())
    stretch, size = (np.array(c, np.int64) for c in zip(*sizes)) if sizes else (np.empty(0, np.int64),) * 2
    target = max(int(size.sum()) // share_count(df), 1)
    first = (np.cumsum(size) - size) // target
    spread = np.maximum(size // target, 1)
    cuts = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(stretch, first, spread)], "stretch int, first int, spread int")
    count = int((first + spread).max()) if len(size) else 1
    told = stored.join(F.broadcast(cuts), "stretch").withColumn("tie", F.xxhash64("text"))  # at most 2**16 rows
    part = F.col("first") + F.pmod(F.xxhash64("doc_id", "tie"), F.col("spread")).cast("int")
    ordered = told.repartitionById(count, part.cast("int")).sortWithinPartitions("place", "doc_id", "tie")
    return ordered.select("doc_id", "text")


def _powers_of_two(held: list[tuple], total: int, number: int) -> Iterator[tuple]:
    """An unfinished sequence's pieces, dealt to sequences of 2**k ids, the largest first."""
    bounds = np.cumsum([0, *(1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1)])
    for doc_id, start, ids, doc_tokens, _, offset in held:
        while len(ids):
            k = int(np.searchsorted(bounds, offset, side="right")) - 1
            part = ids[: bounds[k + 1] - offset]
            yield doc_id, start, part, doc_tokens, number + k, offset - int(bounds[k])
            start, offset, ids = start + len(part), offset + len(part), ids[len(part) :]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*((d, s, len(p), p.tobytes(), t, n, o) for d, s, p, t, n, o in rows))) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_ARROW.types)], schema=_PIECE_ARROW)
