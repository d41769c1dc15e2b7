"""Token ids in directly addressable codes: any token can be read without decoding the ones before it.

An id is split into chunks of eight bits, lowest first. Level 1 holds the first chunk of every id, level 2 the second
chunk of those ids that need one, and so on. A bitmap of each level says which ids go on, and a directory of ranks
(ones before every 64th bit) leads from a place in one level to its place in the next.

A store is a Parquet table of segments, a row each: where the segment lies, the documents in it and its levels. Spark
writes and reads it, so it can live in any file system that the cluster knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.support import documents, share_count, slices
from gridlark.llm.tokens import encoder

SEGMENT_BYTES = 8 << 20
SEGMENTS = (
    "part int, segment int, before long, tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)
READ = "doc_id long, start long, n_tokens long, ids binary"
_SEGMENT_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64())]
    + [(k, pa.list_(pa.int64())) for k in ("doc_ids", "doc_tokens")]
    + [(k, pa.list_(pa.binary())) for k in ("chunks", "bitmaps", "ranks")]
)
_READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, bitmaps and rank directories of the levels."""
    chunks, bitmaps, ranks = [], [], []
    rest = np.asarray(ids, np.uint32)
    while True:
        chunks.append((rest & 255).astype(np.uint8).tobytes())
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % 8, np.uint8)))  # whole words of 64 bits
        ones = np.cumsum(np.bitwise_count(bits.view("<u8")), dtype=np.uint32)
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate(([0], ones[:-1])).astype("<u4").tobytes())
        if not more.any():
            return chunks, bitmaps, ranks
        rest = rest[more] >> 8


def access(places: np.ndarray, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> np.ndarray:
    """The ids at these places of a segment, in any order and number."""
    out = np.zeros(len(places), np.uint32)
    at, who = np.asarray(places, np.int64), np.arange(len(places))
    for level, chunk in enumerate(chunks):
        out[who] |= np.frombuffer(chunk, np.uint8)[at].astype(np.uint32) << np.uint32(8 * level)
        words, bit = np.frombuffer(bitmaps[level], "<u8"), (at & 63).astype(np.uint64)
        word = words[at >> 6]
        goes_on = (word >> bit) & np.uint64(1) == 1
        at, who, word, bit = at[goes_on], who[goes_on], word[goes_on], bit[goes_on]
        if not len(at):
            break
        before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        at = np.frombuffer(ranks[level], "<u4")[at >> 6].astype(np.int64) + before
    return out


def decode(count: int, chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment, from its levels one after the other."""
    out, who = np.zeros(count, np.uint32), np.arange(count)
    for level, (chunk, bits) in enumerate(zip(chunks, bitmaps)):
        out[who] |= np.frombuffer(chunk, np.uint8).astype(np.uint32) << np.uint32(8 * level)
        who = who[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(who), bitorder="little").view(bool)]
    return out


def write(df: DataFrame, folder: str, vocabulary: str, end_id: int = 1, text: str = "text", id_column: str = "doc_id") -> None:
    """Encode every whole text and store the ids, ``end_id`` after each document, in ascending id order.

    Null text counts as empty. Documents without an id come first; rows with one id are ordered by a hash of their text.
    """
    docs = documents(df, text, id_column).withColumn("tie", F.xxhash64("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, part, before = encoder(vocabulary).ids, TaskContext.get().partitionId(), 0
        for number, batch in enumerate(slices(batches, "text", SEGMENT_BYTES)):
            found = [np.append(encode_text((t or b"").decode()), np.uint32(end_id)) for t in batch.column("text").to_pylist()]
            ids = np.concatenate(found).astype(np.uint32)
            row = [part, number, before, len(ids), batch.column("doc_id").to_pylist(), [len(f) for f in found], *encode(ids)]
            before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENT_ARROW.types)], schema=_SEGMENT_ARROW)

    (
        docs.repartitionByRange(share_count(df), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .mapInArrow(segments, SEGMENTS)
        .write.parquet(folder)
    )


def segments_of(spark: SparkSession, folder: str) -> DataFrame:
    """The stored segments and ``start``, the number of ids in the store before each.

    Only one row for each written file goes through the running total.
    """
    stored = spark.read.schema(SEGMENTS).parquet(folder)
    sums = stored.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("part_start"))
    return stored.join(starts, "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part_start")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every stored document, each by its places."""

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                levels = row["chunks"], row["bitmaps"], row["ranks"]
                blobs = [access(np.arange(e - n, e), *levels).astype("<u4").tobytes() for e, n in zip(ends, sizes)]
                columns = [row["doc_ids"], row["start"] + ends - sizes, sizes, blobs]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _READ_ARROW.types)], schema=_READ_ARROW)

    return segments_of(spark, folder).mapInArrow(documents_of, READ)


def tokens_at(spark: SparkSession, folder: str, start: int, stop: int) -> list[int]:
    """The ids at places start to stop of the whole store: only the segments that hold them are read."""
    hit = segments_of(spark, folder).where((F.col("start") < stop) & (F.col("start") + F.col("tokens") > start))
    out: list[int] = []
    for row in hit.select("start", "tokens", "chunks", "bitmaps", "ranks").orderBy("start").toLocalIterator():
        places = np.arange(max(start - row["start"], 0), min(stop - row["start"], row["tokens"]))
        out += access(places, row["chunks"], row["bitmaps"], row["ranks"]).tolist()
    return out
