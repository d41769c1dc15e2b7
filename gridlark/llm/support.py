"""What the operators share: narrow inputs, bounded slices of Arrow batches, hashing of byte ranges, bucket exchange.

Several operators need facts about the whole corpus for every token or passage of a document. They use one scheme:
documents are dealt to *groups* of bounded size; each group asks hash *buckets* about its distinct keys (so a key
counts once per group, however often it occurs); each bucket answers every group. Questions and answers are binary
columns, a row for each (group, bucket), and keep one order, so that an answer lines up with its question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task handles at once.
SLICE_BYTES = 4 << 20
#: Bytes of input files for each group and bucket; their number grows with the input.
GROUP_BYTES = 8 << 20
#: Sizes from here on are Spark's stand-in for an unknown size.
_UNKNOWN = 1 << 58
MESSAGE = "to int, sender int, a binary, b binary, c binary, d binary, e binary"
_MESSAGE = pa.schema([("to", pa.int32()), ("sender", pa.int32()), *((k, pa.binary()) for k in "abcde")])


def documents(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Only (doc_id long, text as UTF-8 bytes), whatever other columns the input has."""
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))


def share_count(df: DataFrame, bytes_each: int = GROUP_BYTES) -> int:
    """How many shares of about ``bytes_each`` the input has, and at least the session's shuffle partitions.

    Where Spark does not know the input's size (rows that are not from files), it is the session's number.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shares = -(-size // bytes_each) if size < _UNKNOWN else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(shares, 1 << 20))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each; a longer row comes alone."""
    for batch in batches:
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and the bounds of its rows there; null counts as empty."""
    sizes = lengths(column)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v), np.uint8), bounds


def ids_of(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(column, missing).to_numpy(zero_copy_only=False).astype(np.int64)


# --- hashing ------------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of SplitMix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, of: np.uint64 = _ODD) -> np.ndarray:
    """of**0 .. of**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), of, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
#: The same, with A-Z as a-z.
FOLDED_VALUES = BYTE_VALUES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]


#: Bytes of which range_hashes keeps prefix sums at a time (40 bytes each), and more only for longer ranges.
_BLOCK = 1 << 18


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hashes of data[start:end], a function of those bytes alone; starts ascend."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.append(np.searchsorted(starts, np.arange(0, max(len(data), 1), _BLOCK)), len(starts))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo < hi:
            base, stop = int(starts[lo]), int(ends[lo:hi].max())
            forth, back = _factors(stop - base + 1)
            prefix = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(values[data[base:stop]] * forth[: stop - base], out=prefix[1:])
            first, last = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = (prefix[last] - prefix[first]) * back[first] + (last - first).astype(np.uint64) * _ODD
    return mix(out)


@lru_cache(maxsize=4)
def _power_table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(1 << bits), powers(1 << bits, _INVERSE)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    forth, back = _power_table(max(n, 2).bit_length())
    return forth[:n], back[:n]


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes for which ``inside`` holds; runs stop at row ends."""
    keep = np.zeros(len(data) + 2, np.int8)
    keep[1:-1] = inside[data]
    step = np.diff(keep)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[(keep[cuts] == 1) & (keep[cuts + 1] == 1)])  # a run that goes on into the next row
    starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


WORD_BYTES = np.array([chr(b).isascii() and (chr(b).isdigit() or chr(b).isalpha()) or b >= 128 for b in range(256)])
NOT_SPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


# --- exchange between groups and buckets --------------------------------------------------------------------


def deal(df: DataFrame, groups: int) -> DataFrame:
    """Documents with the group they belong to: by content, so rows without an id or with one id spread as well."""
    return df.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))


def packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def bucket_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Buckets in ascending order of the keys, by their high bits."""
    return (((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def messages(rows: list[tuple]) -> pa.Table:
    """Rows of (to, sender, up to five binary values)."""
    filled = [(*r, *[None] * (7 - len(r))) for r in rows]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*filled) if filled else [[]] * 7, _MESSAGE.types)], schema=_MESSAGE)


def received(table: pa.Table) -> list[dict]:
    """Messages in the order of their senders: results don't depend on the order in which they arrive."""
    return sorted(table.to_pylist(), key=lambda r: r["sender"])


def ask(dealt: DataFrame, question: Callable, answers: DataFrame | None = None) -> DataFrame:
    """Messages to buckets. question(group number, its documents, answers so far) -> table of messages."""
    if answers is None:
        return dealt.groupBy("grp").applyInArrow(lambda t: question(t["grp"][0].as_py(), t, None), MESSAGE)
    return (
        dealt.groupBy("grp")
        .cogroup(answers.groupBy("to"))
        .applyInArrow(lambda t, a: question(t["grp"][0].as_py(), t, a) if t.num_rows else messages([]), MESSAGE)
    )


def answer(asked: DataFrame, reply: Callable) -> DataFrame:
    """Messages to groups. reply(bucket number, messages) -> table of messages."""
    return asked.groupBy("to").applyInArrow(lambda t: reply(t["to"][0].as_py(), received(t)), MESSAGE)


def finish(dealt: DataFrame, answers: DataFrame, result: Callable, schema: str, empty: pa.Table) -> DataFrame:
    """Result rows of each group from its documents and all answers to it."""
    return (
        dealt.groupBy("grp")
        .cogroup(answers.groupBy("to"))
        .applyInArrow(lambda t, a: result(t["grp"][0].as_py(), t, a) if t.num_rows else empty, schema)
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
