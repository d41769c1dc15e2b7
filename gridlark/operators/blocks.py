"""Vectors packed in blocks of bounded size, and exact nearest-neighbour search of many queries over blocks.

A block holds unit vectors that lie close together, with their centre and the radius around it. The triangle inequality
bounds what a query block can score in a document block. Every query block first meets the few document blocks that may
score best; the worst of its queries' k-th scores then rules out all blocks whose bound is lower, and only the others
are compared. Query blocks that fit in memory are broadcast, so that stored vectors are not moved; others meet in cells of
a grid. A task keeps k per query over all the blocks that it has met, and its k-th scores rule out more as it goes on.

Vectors are stored in the narrowest type that holds their numbers exactly, and scaled to length one where they are read.

Vectors may also lie beside the rows they belong to (``beside``), a binary column each, and be searched there: by one vector in
one scan, by a table of them in one pass for each group of query blocks that is broadcast. Nothing is copied into blocks then;
a task forms them of the rows that it has read.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridlark.plans.session import scratch_path

BLOCK_BYTES = 4 << 20
#: A task sorts so many blocks' rows at a time into this many groups for each block.
BUFFER_BLOCKS, GROUPS_PER_BLOCK = 8, 2
#: Document blocks that each query block meets before bounds are known to rule others out. Where there are few pairs of
#: blocks in all, comparing them costs less than finding out which can be left out, and each is met.
SEEDS, FEW = 2, 64
#: Blocks of one side whose centres one task compares.
SHARD = 1024
SLICE_ROWS = 256
#: Query blocks that meet a document block in one task: bytes as stored, and hits that a task holds of them.
GROUP_BYTES, HELD_HITS = 64 << 20, 500_000
#: Bytes of query vectors that a task keeps ready for the next document block, and cells of the grid for each core.
READY_BYTES, CELLS = 64 << 20, 3
#: More than a product of unit vectors, or a distance of two, can be off by.
NOISE = 1e-9
SLACK = 1e-6

log = logging.getLogger(__name__)


def matrix_of(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow list column as a matrix, and which rows had one of that width."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = width or int(lengths.max(initial=0))
    usable = (lengths == width) & (width > 0)
    values = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(-1, max(width, 1)), usable


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows had a finite length at all."""
    length = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(length) & (length > 0)
    return matrix[usable] / length[usable, None], usable


#: How numbers are stored: bytes in 128ths (what the hash embedding gives), single and double precision. The last one holds
#: vectors that are scaled to length one already.
BYTES, SINGLE, DOUBLE = "i1", "f4", "f8"


def narrow(matrix: np.ndarray) -> tuple[str, np.ndarray]:
    """The narrowest type that holds these numbers exactly, and the numbers in it; doubles have no such type."""
    parts = matrix * 128
    if np.abs(parts).max(initial=0) <= 128 and parts.max(initial=0) <= 127 and (parts == np.rint(parts)).all():
        return BYTES, parts.astype(np.int8)
    with np.errstate(over="ignore"):
        single = matrix.astype(np.float32)
    return (SINGLE, single) if (single == matrix).all() else (DOUBLE, matrix)


def stored_rows(code: str, held, width: int) -> np.ndarray:
    """Unit rows of a stored block."""
    rows = np.frombuffer(held, code).reshape(-1, width)
    if code == DOUBLE:
        return rows
    rows = rows.astype(np.float64)
    return unit_rows(rows / 128 if code == BYTES else rows)[0]


def spread_centres(unit: np.ndarray, count: int) -> np.ndarray:
    """The group of each row: groups form around rows that lie far from each other, at most ``count`` of them."""
    group, nearest, centre = np.zeros(len(unit), np.int64), np.full(len(unit), np.inf), 0
    for number in range(count):
        distance = 1.0 - unit @ unit[centre]
        closer = distance < nearest
        group[closer], nearest[closer] = number, distance[closer]
        centre = int(np.argmax(nearest))
        if nearest[centre] <= SLACK:
            break
    return group


def _schema(id_type: T.DataType) -> T.StructType:
    fields = {
        "block": T.LongType(), "scope": T.StringType(), "width": T.IntegerType(), "rows": T.IntegerType(),
        "ids": T.ArrayType(id_type), "code": T.StringType(), "unit": T.BinaryType(), "centre": T.BinaryType(), "radius": T.DoubleType(),
    }
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def pack(df: DataFrame, id_column: str, vector_column: str, folder: str, scope: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Writes the vectors as blocks and returns the stored table. Rows of one ``scope`` (a column of names) and width
    share blocks. Each task packs what it reads, so nothing is shuffled; vectors without a finite length are left out."""
    spark, schema = df.sparkSession, _schema(df.schema[id_column].dataType)
    arrow = to_arrow_schema(schema)
    scopes = F.coalesce(F.col(scope).cast("string"), F.lit("")) if scope else F.lit("")
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"), scopes.alias("scope"))

    def blocks_of(scope_name: str, width: int, ids: list, given: np.ndarray, first: int) -> Iterator[tuple]:
        unit, _ = unit_rows(given)
        limit = max(1, block_bytes // (8 * width))
        group = spread_centres(unit, GROUPS_PER_BLOCK * -(-len(unit) // limit)) if len(unit) > limit else np.zeros(len(unit), np.int64)
        for number in np.unique(group):
            members = np.flatnonzero(group == number)
            for start in range(0, len(members), limit):
                own = members[start : start + limit]
                held = unit[own]
                centre = held.mean(axis=0)
                radius = float(np.sqrt(((held - centre) ** 2).sum(axis=1)).max())
                code, kept = narrow(given[own])
                kept = held if code == DOUBLE else kept
                yield first, scope_name, width, len(own), [ids[i] for i in own], code, kept.tobytes(), centre.tobytes(), radius
                first += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, held, size = (context.partitionId() if context else 0) << 32, {}, 0

        def packed():
            nonlocal number
            for (scope_name, width), (ids, parts) in held.items():
                for block in blocks_of(scope_name, width, ids, np.concatenate(parts), number):
                    number = block[0] + 1
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block, arrow.types)], schema=arrow)
            held.clear()

        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("vector")), 0)
            keys = pa.table({"scope": batch.column("scope"), "width": lengths}).group_by(["scope", "width"]).aggregate([])
            for key in keys.to_pylist():
                if not key["width"]:
                    continue
                mine = pc.and_(pc.equal(batch.column("scope"), key["scope"]), pc.equal(lengths, key["width"]))
                matrix, _ = matrix_of(batch.column("vector").filter(mine), key["width"])
                _, usable = unit_rows(matrix)
                ids = batch.column("id").filter(mine).filter(pa.array(usable)).to_pylist()
                if ids:
                    into = held.setdefault((key["scope"], key["width"]), ([], []))
                    into[0].extend(ids)
                    into[1].append(matrix[usable])
                    size += into[1][-1].nbytes
            if size >= BUFFER_BLOCKS * block_bytes:
                yield from packed()
                size = 0
        yield from packed()

    rows.mapInArrow(run, schema).write.parquet(folder)
    return spark.read.parquet(folder)


@dataclass
class Met:
    """Hits of a search, and which pairs of blocks it compared out of how many that could meet."""

    hits: DataFrame
    visited: DataFrame
    pairs: DataFrame

    def share(self) -> float:
        pairs = self.pairs.count()
        return self.visited.count() / pairs if pairs else 0.0


def _directory(blocks: DataFrame, side: str, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")
    return blocks.select(
        F.col("block").alias("number"), "scope", "width", "centre", "radius", shard.alias(f"{side}_shard")
    )


def _bounds(asked: DataFrame, stored: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """(q, d, bound) of all pairs of blocks of one scope and width: the highest score that they can hold.

    Centres are compared by the matrix, shard by shard: the two directories repeat once per shard of the other one.
    """
    q_shards, d_shards = (-(-count // SHARD) or 1 for count in counts)
    left = _directory(asked, "q", q_shards).withColumn("d_shard", F.explode(F.sequence(F.lit(0), F.lit(d_shards - 1))))
    right = _directory(stored, "d", d_shards).withColumn("q_shard", F.explode(F.sequence(F.lit(0), F.lit(q_shards - 1))))

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        q, d, bound = [], [], []
        if one.num_rows and other.num_rows:
            width = one["width"][0].as_py()
            (qn, qc, qr), (dn, dc, dr) = (
                (t["number"].to_numpy(), np.frombuffer(b"".join(t["centre"].to_pylist()), np.float64).reshape(-1, width), t["radius"].to_numpy())
                for t in (one, other)
            )
            apart = (qc**2).sum(axis=1)[:, None] + (dc**2).sum(axis=1)[None] - 2 * qc @ dc.T
            least = np.maximum(np.sqrt(np.maximum(apart, 0)) - qr[:, None] - dr[None] - SLACK, 0)
            q, d, bound = np.repeat(qn, len(dn)), np.tile(dn, len(qn)), (1 - least**2 / 2).reshape(-1)
        return pa.table({"q": pa.array(q, pa.int64()), "d": pa.array(d, pa.int64()), "bound": pa.array(bound, pa.float64())})

    keys = ["scope", "width", "q_shard", "d_shard"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "q long, d long, bound double")


def search(asked: DataFrame, stored: DataFrame, k: int, query_id: str, doc_id: str) -> Met:
    """The k best stored vectors for each vector of ``asked`` by cosine, ties to the smaller id: (query_id, rank, doc_id,
    score). Both are stored tables of blocks. A query only meets documents of its scope and width."""
    spark = asked.sparkSession
    partial = T.StructType(
        [
            T.StructField(query_id, asked.schema["ids"].dataType.elementType),
            T.StructField(doc_id, stored.schema["ids"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    scorer = _scorer(k, to_arrow_schema(partial))

    def best(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(doc_id))
        # the rank limit is applied before the exchange too, so a task sends k rows per query
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def result(hits: DataFrame) -> DataFrame:
        return best(hits).select(query_id, "rank", doc_id, "score")

    size = asked.agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum(F.octet_length("unit")).alias("bytes")).first()
    counts = size["n"], stored.count()
    groups = max(1, -(-(size["bytes"] or 0) // GROUP_BYTES), -(-k * (size["rows"] or 0) // HELD_HITS))

    def scored(limits: DataFrame | None, wanted: DataFrame | None = None) -> DataFrame:
        """Hits of all query blocks (q, of ``limits``: with the least score that can matter) in all document blocks, or in those
        that ``wanted`` (d, qs) names."""
        queries = asked.select(
            "scope", "width", *[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "code", "unit", "centre", "radius")]
        )
        if limits is not None:
            queries = queries.join(F.broadcast(limits), F.col("q") == F.col("q_block"), "left").drop("q")
        queries = queries.withColumn("least", F.coalesce("least", F.lit(-2.0)) if limits is not None else F.lit(-2.0))
        docs = stored.drop("rows")
        if wanted is not None:
            docs = docs.join(F.broadcast(wanted), F.col("d") == F.col("block")).drop("d")
        if groups == 1:
            met = docs.join(F.broadcast(queries), ["scope", "width"])
        else:
            shards = -(-CELLS * spark.sparkContext.defaultParallelism // groups)
            docs = docs.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
            queries = queries.withColumn("group", F.pmod(F.xxhash64("q_block"), F.lit(groups)).cast("int"))
            queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
            met = docs.join(queries, ["scope", "width", "group", "shard"])
        if wanted is not None:
            met = met.where(F.array_contains("qs", F.col("q_block")))
        return met.select(*PAIR).mapInArrow(scorer, partial)

    if counts[0] * counts[1] <= FEW:
        pairs = asked.select("scope", "width", F.col("block").alias("q")).join(stored, ["scope", "width"]).select("q", F.col("block").alias("d"))
        return Met(result(scored(None)), pairs, pairs)
    folder = scratch_path(spark, "block-pairs")
    nearest = Window.partitionBy("q").orderBy(F.col("bound").desc(), "d")
    _bounds(asked, stored, counts).withColumn("first", F.row_number().over(nearest) <= SEEDS).write.parquet(f"{folder}/bounds")
    pairs = spark.read.parquet(f"{folder}/bounds")
    seeds = pairs.where("first").groupBy("d").agg(F.collect_set("q").alias("qs"))
    best(scored(None, seeds)).write.parquet(f"{folder}/first")
    found = spark.read.parquet(f"{folder}/first")
    # a query's k-th score over all that it has met; -2, which every bound reaches, where it has not met so many
    reached = found.groupBy(query_id).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("kth"))
    members = asked.select(F.col("block").alias("q"), F.explode("ids").alias(query_id))
    least = members.join(reached, query_id, "left").groupBy("q").agg(F.min(F.coalesce("kth", F.lit(-2.0))).alias("least"))
    least.write.parquet(f"{folder}/least")
    limits = spark.read.parquet(f"{folder}/least")
    visited = pairs.join(limits, "q").where(F.col("first") | (F.col("bound") >= F.col("least") - NOISE)).select("q", "d")
    met = Met(result(scored(limits)), visited, pairs)
    if log.isEnabledFor(logging.INFO):
        log.info("visited %.1f %% of the block pairs", 100 * met.share())
    return met


def nearest(stored: DataFrame, vector, k: int, scopes: Sequence[str] | None = None) -> DataFrame:
    """(id, score): the k best stored vectors for one vector by cosine, ties to the smaller id. A task scores a block only
    if its bound can still beat the k that the task has found."""
    unit, usable = unit_rows(np.asarray(vector, np.float64)[None])
    kind = stored.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    rows = stored.where((F.col("width") == unit.shape[1]) & F.lit(bool(usable[0])))
    rows = rows.where(F.col("scope").isin(*scopes)) if scopes else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, held = unit[0], []
        for batch in batches:
            centres, radii = batch.column("centre"), batch.column("radius").to_pylist()
            for r in range(batch.num_rows):
                centre = np.frombuffer(centres[r].as_buffer(), np.float64)
                apart = max(np.sqrt(((query - centre) ** 2).sum()) - radii[r] - SLACK, 0.0)
                if len(held) == k and 1 - apart**2 / 2 < held[-1][0] - NOISE:
                    continue
                docs = stored_rows(batch.column("code")[r].as_py(), batch.column("unit")[r].as_buffer(), len(query))
                rough = docs @ query
                limit = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
                if len(held) == k:
                    limit = max(limit, held[-1][0])
                near = np.flatnonzero(rough >= limit - NOISE)
                names, scores = batch.column("ids")[r].values.take(pa.array(near)).to_pylist(), np.einsum("nd,d->n", docs[near], query)
                held = sorted([*held, *zip(scores.tolist(), names)], key=lambda h: (-h[0], h[1]))[:k]
        columns = ([h[1] for h in held], [h[0] for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    hits = rows.select("ids", "code", "unit", "centre", "radius").mapInArrow(run, schema)
    return hits.orderBy(F.col("score").desc(), "id").limit(k)


# --- vectors beside their rows ---------------------------------------------------------------------------------------------
#: How a vector lies beside its row: its numbers as they are (not scaled), in the narrowest type that has them exactly.
BESIDE = "struct<width: int, code: string, unit: binary>"
_BESIDE = pa.struct([("width", pa.int32()), ("code", pa.string()), ("unit", pa.binary())])
#: Rows of which a task forms blocks at a time, by the bytes of their numbers as doubles, and rows of a block.
ROWS_BYTES, ROWS_EACH = 24 << 20, 512
#: Query vectors, as stored, that pass over the rows at a time: the driver hands them on, and every worker holds them.
PASS_BYTES = 24 << 20


def beside(vectors: pa.Array) -> pa.Array:
    """The vectors of a column as ``BESIDE``, for an Arrow function."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    if len(lengths) and lengths[0] and (lengths == lengths[0]).all():
        width, n = int(lengths[0]), len(lengths)
        code, held = narrow(matrix_of(vectors, width)[0])
        size = held.itemsize * width
        numbers = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(held))])
        return pa.StructArray.from_arrays([pa.array(np.full(n, width, np.int32)), pa.array([code] * n, pa.string()), numbers], fields=list(_BESIDE))
    rows = []
    for r, length in enumerate(lengths.tolist()):
        code, held = narrow(matrix_of(vectors.slice(r, 1), length)[0]) if length else (DOUBLE, np.empty(0))
        rows.append({"width": length, "code": code, "unit": np.ascontiguousarray(held).tobytes()} if vectors[r].is_valid else None)
    return pa.array(rows, _BESIDE)


def numbers_of(code: str, held, width: int) -> np.ndarray:
    """The numbers of vectors as they lie beside their rows, as doubles."""
    rows = np.frombuffer(held, code).reshape(-1, width).astype(np.float64)
    return rows / 128 if code == BYTES else rows


def _lists(held: pa.Array) -> pa.Array:
    rows = zip(*(held.field(f.name).to_pylist() for f in _BESIDE))
    return pa.array([numbers_of(c, u, w)[0] if w else None if u is None else [] for w, c, u in rows], pa.list_(pa.float64()))


def as_lists(column: str) -> Column:
    """Vectors beside their rows as an array column again."""
    return F.arrow_udf(_lists, "array<double>")(column)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    """(scope, width, ids, unit rows) of the rows of a batch (id, scope, width, code, unit) that have a finite length."""
    names = ["scope", "width", "code"]
    keys = pa.table({n: batch.column(n) for n in names}).group_by(names).aggregate([]).to_pylist()
    for key in keys:
        if key["width"]:
            mine = pc.and_(pc.equal(batch.column("scope"), key["scope"]), pc.and_(pc.equal(batch.column("width"), key["width"]), pc.equal(batch.column("code"), key["code"])))
            part = batch if len(keys) == 1 else batch.filter(mine)
            units = part.column("unit")
            offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
            rows = numbers_of(key["code"], units.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])), key["width"])
            unit, usable = unit_rows(rows)
            ids = part.column("id")
            yield key["scope"], key["width"], ids if usable.all() else ids.filter(pa.array(usable)), unit


def nearest_rows(stored: DataFrame, vector, k: int, scopes: Sequence[str] | None = None) -> DataFrame:
    """(id, score): the k best of the vectors beside rows (id, scope, width, code, unit) for one vector by cosine, ties to
    the smaller id. One scan; every vector is scored."""
    unit, usable = unit_rows(np.asarray(vector, np.float64)[None])
    schema = T.StructType([T.StructField("id", stored.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    rows = stored.where((F.col("width") == unit.shape[1]) & F.lit(bool(usable[0])))
    rows = rows.where(F.col("scope").isin(*scopes)) if scopes else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, held = unit[0], []
        for batch in batches:
            for _, _, ids, docs in _read(batch):
                rough = docs @ query
                limit = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
                if len(held) == k:
                    limit = max(limit, held[-1][0])
                near = np.flatnonzero(rough >= limit - NOISE)
                names, scores = ids.take(pa.array(near)).to_pylist(), np.einsum("nd,d->n", docs[near], query)
                held = sorted([*held, *zip(scores.tolist(), names)], key=_order)[:k]
        columns = ([h[1] for h in held], [h[0] for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    hits = rows.select("id", "scope", "width", "code", "unit").mapInArrow(run, schema)
    return hits.orderBy(F.col("score").desc(), "id").limit(k)


def groups_of(sizes: Sequence[tuple[int, int, int]], most_bytes: int, most_hits: int) -> list[list[int]]:
    """Blocks (number, bytes, hits that a task may hold of it) in groups that stay within both limits; at least one a group."""
    groups, held = [], (0, 0)
    for number, size, hits in sizes:
        if not groups or held[0] + size > most_bytes or held[1] + hits > most_hits:
            groups.append([])
            held = (0, 0)
        groups[-1].append(number)
        held = held[0] + size, held[1] + hits
    return groups


def in_passes(blocks: DataFrame, number: str, groups: list[list[int]], meet: Callable, folder: str) -> DataFrame:
    """What ``meet`` finds for each group of blocks, which it gets as a broadcast list of rows. One group is left to the plan;
    of several, each pass is stored, so that only one group is held at a time."""
    spark = blocks.sparkSession

    def held(numbers: list[int]):
        rows = blocks.where(F.col(number).isin(numbers)).orderBy(number).collect() if numbers else []
        return spark.sparkContext.broadcast([tuple(r) for r in rows])

    if len(groups) <= 1:
        return meet(held(groups[0] if groups else []))
    for place, numbers in enumerate(groups):
        rows = held(numbers)
        meet(rows).write.option("compression", "zstd").parquet(f"{folder}/{place}")
        rows.destroy()
    return spark.read.parquet(*[f"{folder}/{place}" for place in range(len(groups))])


class _Queries:
    """A block of queries, as it is stored, and the k best hits so far of each."""

    def __init__(self, row: tuple, k: int):
        self.number, self.scopes, self.width, self.code, self.held = row[0], frozenset(row[1].split("\n")), row[2], row[3], row[4]
        self.centre, self.radius, self.k = np.frombuffer(row[5], np.float64), row[6], k
        self.size = len(self.held) // (np.dtype(self.code).itemsize * self.width)
        self.hits: list[list[tuple[float, object]]] = [[] for _ in range(self.size)]
        self.floor = np.full(self.size, -2.0)
        # what a single-precision product of unit vectors can be off by
        self.noise = 1.01 * (self.width + 4) * 2.0**-24

    def meet(self, blocks: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, float]]) -> None:
        near = []
        for block in blocks:
            apart = max(float(np.sqrt(((self.centre - block[3]) ** 2).sum())) - self.radius - block[4] - SLACK, 0.0)
            near.append((1 - apart**2 / 2, block))
        unit = None
        for bound, (ids, docs, single, _, _) in sorted(near, key=lambda n: -n[0]):
            if bound < self.floor.min() - NOISE:
                break
            unit = stored_rows(self.code, self.held, self.width) if unit is None else unit
            for start in range(0, self.size, SLICE_ROWS):
                part = unit[start : start + SLICE_ROWS]
                rough = part.astype(np.float32) @ single.T
                could = rough >= (self.floor[start : start + SLICE_ROWS] - self.noise).astype(np.float32)[:, None]
                for i in np.flatnonzero(could.any(axis=1)).tolist():
                    places = np.flatnonzero(could[i])
                    if len(places) > self.k:
                        own = rough[i, places]
                        places = places[own >= np.partition(own, len(own) - self.k)[len(own) - self.k] - 2 * self.noise]
                    # near the top by single precision: summed again as doubles, in one order wherever the pair lies
                    scores, q = np.einsum("nd,d->n", docs[places], part[i]), start + i
                    best = scores >= self.floor[q]
                    if best.any():
                        names = ids.take(pa.array(places[best])).to_pylist()
                        self.hits[q] = sorted([*self.hits[q], *zip(scores[best].tolist(), names)], key=_order)[: self.k]
                        if len(self.hits[q]) == self.k:
                            self.floor[q] = self.hits[q][-1][0]


def search_rows(asked: DataFrame, stored: DataFrame, k: int, query_id: str, doc_id: str) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of the vectors beside rows (id, scope, width, code, unit) for each query by
    cosine, ties to the smaller id. ``asked`` is a stored table of blocks; its scopes are names with line feeds between them.

    The rows stay where they are: groups of query blocks are broadcast and pass over them one after the other. A task forms
    blocks of neighbours of what it reads, leaves out those that a query block's k-th scores rule out, and keeps k hits a query.
    """
    spark, folder = asked.sparkSession, scratch_path(asked.sparkSession, "vector-hits")
    sizes = asked.select("block", F.octet_length("unit").alias("bytes"), (F.col("rows") * k).alias("hits")).orderBy("block").collect()
    groups = groups_of([tuple(r) for r in sizes], PASS_BYTES, HELD_HITS)
    schema = T.StructType(
        [
            T.StructField("q_block", T.LongType()), T.StructField("place", T.IntegerType()),
            T.StructField(doc_id, stored.schema["id"].dataType), T.StructField("score", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    rows = stored.select("id", "scope", "width", "code", "unit").coalesce(spark.sparkContext.defaultParallelism)

    def meeting(broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = [_Queries(row, k) for row in broadcast.value]
            held: dict[tuple[str, int], list[tuple[pa.Array, np.ndarray]]] = {}
            size = 0

            def met() -> None:
                for (scope, width), parts in held.items():
                    own = [q for q in queries if q.width == width and scope in q.scopes]
                    if not own:
                        continue
                    ids, unit = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    group = spread_centres(unit, GROUPS_PER_BLOCK * -(-len(unit) // ROWS_EACH)) if len(unit) > ROWS_EACH else np.zeros(len(unit), np.int64)
                    blocks = []
                    for number in np.unique(group):
                        docs = unit[members := np.flatnonzero(group == number)]
                        centre = docs.mean(axis=0)
                        blocks.append((ids.take(pa.array(members)), docs, docs.astype(np.float32), centre, float(np.sqrt(((docs - centre) ** 2).sum(axis=1)).max())))
                    for query in own:
                        query.meet(blocks)
                held.clear()

            for batch in batches:
                for scope, width, ids, unit in _read(batch):
                    if len(unit):
                        held.setdefault((scope, width), []).append((ids, unit))
                        size += unit.nbytes
                if size >= ROWS_BYTES:
                    met()
                    size = 0
            met()
            for query in queries:
                flat = [(query.number, q, ident, score) for q, hits in enumerate(query.hits) for score, ident in hits]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*flat)), arrow.types)], schema=arrow)

        return rows.mapInArrow(run, schema)

    found = in_passes(asked.select("block", "scope", "width", "code", "unit", "centre", "radius"), "block", groups, meeting, folder)
    order = Window.partitionBy("q_block", "place").orderBy(F.col("score").desc(), F.col(doc_id))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select(F.col("block").alias("q_block"), F.posexplode("ids").alias("place", query_id))
    names = F.broadcast(names) if len(groups) <= 1 else names
    return best.join(names, ["q_block", "place"]).select(query_id, "rank", doc_id, "score")


# --- blocks that meet --------------------------------------------------------------------------------------------------------
#: What a task gets of two blocks that meet.
_SIDE = ("block", "ids", "code", "unit", "centre", "radius")
PAIR = (*_SIDE, *[f"q_{c}" for c in _SIDE], "width", "least")


def _order(hit: tuple[float, object]) -> tuple:
    """Best score first, ties to the smaller id, null before others."""
    return -hit[0], hit[1] is not None, hit[1]


class _Block:
    """One side of a pair as a task reads it."""

    def __init__(self, batch: pa.RecordBatch, r: int, width: int, prefix: str = ""):
        value = lambda name: batch.column(prefix + name)[r]
        self.unit = stored_rows(value("code").as_py(), value("unit").as_buffer(), width)
        self.centre, self.radius = np.frombuffer(value("centre").as_buffer(), np.float64), value("radius").as_py()
        self.ids = value("ids").as_py()


class _Held:
    """The k best hits so far of each query of a block."""

    def __init__(self, queries: _Block, k: int, least: float):
        self.ids, self.k = queries.ids, k
        self.hits: list[list[tuple[float, object]]] = [[] for _ in self.ids]
        self.floor = np.full(len(self.ids), least)

    def meet(self, queries: _Block, docs: _Block) -> None:
        apart = max(float(np.sqrt(((queries.centre - docs.centre) ** 2).sum())) - queries.radius - docs.radius - SLACK, 0.0)
        if 1 - apart**2 / 2 < self.floor.min() - NOISE:
            return
        for start in range(0, len(self.ids), SLICE_ROWS):
            part = queries.unit[start : start + SLICE_ROWS]
            # a matrix product's last bits depend on the block: what it puts near the top is summed again, pair by pair,
            # so that equal vectors tie exactly wherever they lie
            rough = part @ docs.unit.T
            near = rough >= (self.floor[start : start + SLICE_ROWS] - NOISE)[:, None]
            for i in np.flatnonzero(near.any(axis=1)):
                places = np.flatnonzero(near[i])
                if len(places) > self.k:
                    own = rough[i, places]
                    places = places[own >= np.partition(own, len(own) - self.k)[len(own) - self.k] - NOISE]
                scores = np.einsum("nd,d->n", docs.unit[places], part[i]).tolist()
                q = start + i
                self.hits[q] = sorted([*self.hits[q], *zip(scores, [docs.ids[p] for p in places])], key=_order)[: self.k]
                if len(self.hits[q]) == self.k:
                    self.floor[q] = max(self.floor[q], self.hits[q][-1][0])


def _scorer(k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Held] = {}
        ready: dict[int, _Block] = {}
        number, docs, queries_held, bytes_ready = None, None, 0, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for own in held.values():
                flat = [(q, ident, score) for q, hits in zip(own.ids, own.hits) for score, ident in hits]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*flat)), schema.types)], schema=schema)
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                width, d, q = (batch.column(c)[r].as_py() for c in ("width", "block", "q_block"))
                if d != number:
                    number, docs = d, _Block(batch, r, width)
                queries = ready.get(q) or _Block(batch, r, width, "q_")
                if q not in ready and bytes_ready + queries.unit.nbytes <= READY_BYTES:
                    ready[q], bytes_ready = queries, bytes_ready + queries.unit.nbytes
                if q not in held:
                    if queries_held and (queries_held + len(queries.ids)) * k > 2 * HELD_HITS:
                        yield from flushed()
                        queries_held = 0
                    held[q], queries_held = _Held(queries, k, batch.column("least")[r].as_py()), queries_held + len(queries.ids)
                held[q].meet(queries, docs)
        yield from flushed()

    return run
