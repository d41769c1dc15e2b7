"""Nearest neighbours by largest inner product, with an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a vector's cell is the pair of its halves' centroids.
A query ranks the centroids of each half by inner product and walks the pairs by their summed score with a heap, until
the cells that it has passed hold enough vectors. Those vectors are then scored exactly, in double precision.

Equal vectors are one entry of the index with their smallest ids, so a vector that fills a third of the table costs
no more than any other; equal queries are searched for once. The codebooks are fitted on a bounded sample; the index
holds every vector. Neighbouring cells lie on a shelf, and a shelf is cut into chunks of a bounded number of entries;
queries are dealt to blocks of a bounded number too. A shuffle brings every chunk together with those queries of a block
that visit cells there, once for each block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.support import mix

#: Rows that the codebooks are fitted on, at most about, and rounds of k-means.
FIT_ROWS, FIT_ROUNDS = 20_000, 12
#: Entries for each cell on average decide how many centroids a half has, within these bounds.
CELL_ENTRIES, CENTROIDS = 8, (2, 1024)
#: A query visits cells until they hold this share of all entries, and so many at least. Vectors without clusters, as
#: the supplied ones, need a large share, and the more the fewer they are; with clusters a few hundredths do. The share
#: alone, without the least number, has to give the recall.
VISIT_SHARE, VISIT_LEAST = 0.65, 3000
#: Entries of a chunk, and distinct queries of a block on average.
CHUNK, QUERY_BLOCK = 8192, 4096
_VECTOR = "array<double>"
NEIGHBOURS = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def entries(df: DataFrame, keep: int, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids: (vector, ids). The ids are cut before the shuffle too."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast(_VECTOR).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(
        "id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")  # -0.0 is 0.0
    )
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("id")))
    return ranked.where(F.col("rank") <= keep).groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def kmeans(points: np.ndarray, count: int) -> np.ndarray:
    """Centroids of the points; deterministic: spread starting points, empty centroids stay where they are."""
    points = np.unique(points, axis=0)
    start = np.argsort(mix(np.arange(1, len(points) + 1)), kind="stable")[:count]
    centres = points[np.sort(start)]
    for _ in range(FIT_ROUNDS):
        near = nearest(points, centres)
        number = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
        centres = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centroid of each point, in blocks of points."""
    own = (centres**2).sum(axis=1)
    return np.concatenate([np.empty(0, np.int64), *(np.argmin(own - 2 * points[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(points), 4096))])


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of places by descending sum of two scores: the multi-sequence walk over a heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    vector: str = "embedding",
    id_column: str = "vec_id",
    visit_share: float = VISIT_SHARE,
    visit_least: int = VISIT_LEAST,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest found rows of each query row, by inner product, ties to the smaller id; never the row itself.

    ``is_query`` tells by the id column. Rows without an id and unusable vectors take no part. A repeated id counts as
    one row with each of its vectors. Vectors should have one width; those of another width than most are left out.
    """
    spark = df.sparkSession
    index = entries(df, k + 1, vector, id_column)
    width_rows = index.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not width_rows:
        return spark.createDataFrame([], NEIGHBOURS)
    width, total = width_rows[0]["w"], width_rows[0]["n"]
    half = max(width // 2, 1)
    index = index.where(F.size("vector") == width).withColumn("entry", F.xxhash64("vector"))
    drawn = index.where(F.pmod("entry", F.lit(1 << 30)) < F.lit(int(min(1.0, FIT_ROWS / total) * (1 << 30))))
    sample = np.array([r["vector"] for r in drawn.select("vector", "entry").orderBy("entry").collect()] or [[0.0] * width])
    count = int(np.clip(round((total / CELL_ENTRIES) ** 0.5), *CENTROIDS))
    books = kmeans(sample[:, :half], count), kmeans(sample[:, half:], count) if width > 1 else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(books)
    columns = len(books[1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            points = _matrix(batch.column("vector"), width)
            cell = nearest(points[:, :half], one) * columns + nearest(points[:, half:], two)
            yield batch.append_column("cell", pa.array(cell.astype(np.int64)))

    placed = index.mapInArrow(cells, T.StructType([*index.schema.fields, T.StructField("cell", T.LongType())]))
    sizes = np.zeros((len(books[0]), columns), np.int64)  # as many numbers as centroids squared
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes.flat[r["cell"]] = r["n"]
    # shelves: runs of first centroids with about a chunk of entries, or one centroid with more
    shelf_of = (np.cumsum(sizes.sum(axis=1)) - sizes.sum(axis=1)) // CHUNK
    shelf_of = np.unique(shelf_of, return_inverse=True)[1]
    chunks = [int(-(-sizes[shelf_of == s].sum() // CHUNK)) for s in range(shelf_of.max() + 1)]
    bounds = np.searchsorted(shelf_of, np.arange(len(chunks) + 1))
    held = spark.sparkContext.broadcast((sizes, bounds, chunks))
    enough = max(visit_least, int(visit_share * total))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), (sizes, bounds, chunks) = shared.value, held.value
        held_by = sizes.tolist()
        for batch in batches:
            points = _matrix(batch.column("vector"), width)
            first, second = points[:, :half] @ one.T, points[:, half:] @ two.T
            for r in range(len(points)):
                found, seen = 0, np.zeros(sizes.shape, bool)
                for i, j in walk(first[r], second[r]):
                    if n := held_by[i][j]:
                        seen[i, j] = True
                        found += n
                        if found >= enough:
                            break
                shelves = [s for s in range(len(chunks)) if seen[bounds[s] : bounds[s + 1]].any()]
                where = [(s, c) for s in shelves for c in range(chunks[s])]
                bits = {s: np.packbits(seen[bounds[s] : bounds[s + 1]]).tobytes() for s in shelves}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("entry")[r].as_py()] * len(where), pa.int64()),
                        pa.array([points[r]] * len(where), pa.list_(pa.float64())),
                        pa.array([s for s, _ in where], pa.int32()),
                        pa.array([c for _, c in where], pa.int32()),
                        pa.array([bits[s] for s, _ in where], pa.binary()),
                    ],
                    names=["query", "vector", "shelf", "chunk", "cells"],
                )

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, bounds, chunks = held.value
        for batch in batches:
            shelf = np.searchsorted(bounds, batch.column("cell").to_numpy() // columns, side="right") - 1
            chunk = batch.column("entry").to_numpy().view(np.uint64) % np.array(chunks, np.uint64)[shelf]
            batch = batch.append_column("shelf", pa.array(shelf.astype(np.int32)))
            yield batch.append_column("chunk", pa.array(chunk.astype(np.int32)))

    on_shelf = T.StructType([*placed.schema.fields, T.StructField("shelf", T.IntegerType()), T.StructField("chunk", T.IntegerType())])
    stored = placed.mapInArrow(shelved, on_shelf)
    asked_ids = df.where(is_query).select(F.col(id_column).cast("long").alias("query_id"), F.col(vector).cast(_VECTOR).alias("vector"))
    asked_ids = asked_ids.where(F.col("query_id").isNotNull() & usable(F.col("vector")) & (F.size("vector") == width)).distinct()
    asked_ids = asked_ids.select("query_id", F.xxhash64(F.transform("vector", lambda x: x + F.lit(0.0))).alias("entry"))
    asked_entries = asked_ids.select("entry").distinct()
    blocks = max(1, -(-asked_entries.count() // query_block))
    queries = placed.select("entry", "vector").join(asked_entries, "entry", "left_semi")
    visited = queries.mapInArrow(visits, f"query long, vector {_VECTOR}, shelf int, chunk int, cells binary")
    visited = visited.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _CANDIDATES.empty_table()
        asked, points = _matrix(left["vector"], width), _matrix(right["vector"], width)
        names, ids, bounds = left["query"].to_pylist(), right["ids"].to_pylist(), held.value[1]
        by = np.lexsort((np.array([i[0] for i in ids]), right["cell"].to_numpy()))  # within a cell by smallest id
        points, ids, cell = points[by], [ids[i] for i in by], right["cell"].to_numpy()[by]
        shelf = left["shelf"][0].as_py()
        low, count = bounds[shelf] * columns, (bounds[shelf + 1] - bounds[shelf]) * columns
        visit = np.stack([np.unpackbits(np.frombuffer(c, np.uint8), count=count) for c in left["cells"].to_pylist()])
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        rows = []
        for at in range(0, len(asked), 512):
            block = asked[at : at + 512]
            scores = np.full((len(block), len(points)), -np.inf)
            for a, b in zip(starts, [*starts[1:], len(cell)]):
                who = np.flatnonzero(visit[at : at + 512, cell[a] - low])
                scores[who, a:b] = np.einsum("qd,pd->qp", block[who], points[a:b])
            for name, own in zip(names[at : at + 512], scores):
                best = np.argpartition(-own, k)[: k + 1] if len(own) > k + 1 else np.arange(len(own))
                least = own[best].min()
                best = np.flatnonzero(own >= least) if least > -np.inf else np.flatnonzero(own > -np.inf)  # with all ties
                rows += [(name, float(own[p]), ids[p]) for p in best]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, _CANDIDATES.types)], schema=_CANDIDATES)

    keys = ("block", "shelf", "chunk")
    met = visited.groupBy(*keys).cogroup(stored.groupBy(*keys))
    best = met.applyInArrow(scored, "query long, score double, ids array<long>")
    # of each distinct query vector: the k + 1 best rows, then of each query row: without itself
    rows = best.select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).drop("rank")
    own = asked_ids.join(rows.withColumnRenamed("query", "entry"), "entry").where(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    own = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_CANDIDATES = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
