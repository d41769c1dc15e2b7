"""Hard negatives by a vertical scan: dimensions are read column by column, in each anchor's order of magnitude.

What the dimensions not yet read can still add to a candidate lies between the sums of their least and greatest
products, known from each column's minimum and maximum. Candidates whose bounds rule them out leave the bitmap; those
that stay to the end have exact scores. The first scan finds an anchor's positives among the rows of its label, the
second its negatives in the window of scores that each positive opens.

Rows are dealt to *shelves* of a bounded number by a hash of their id, anchors to groups of a bounded number; a shuffle
brings every shelf together with every group of anchors, in blocks. A shelf keeps k rows for each anchor (and window);
the best of all shelves are ranked by Spark, which cuts each task's share to k before the exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.plans.session import scratch_path

#: Rows of a shelf and anchors of a group on average (a shelf is held by one task), and rows that share bounds.
SHELF, GROUP, CHUNK = 1 << 17, 1 << 16, 1 << 13
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Components beyond this would take sums of products out of 64 bits.
GREATEST = float(1 << 22)
POSITIVES = "anchor_id long, id long, score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def coded(df: DataFrame, scale: int, vector: str, id_column: str, label: str) -> DataFrame:
    """(id, label, codes): floor(scale * x) of every component, one row for each id."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= GREATEST))
    rows = df.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    named = rows.select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.cast("array<int>").alias("codes")
    )
    return named.groupBy("id").agg(F.min(F.struct("label", "codes")).alias("r")).select("id", "r.label", "r.codes")


class Shelf:
    """Rows of one width, column by column, ordered by label; a chunk of them shares bounds."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.chunks = []
        for start in range(0, len(ids), CHUNK):
            columns = np.ascontiguousarray(matrix[order[start : start + CHUNK]].T)
            self.chunks.append((start, columns, columns.min(axis=1), columns.max(axis=1)))

    def own(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))

    def scan(self, anchor: np.ndarray, start: int, rows: np.ndarray, possible: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Those of a chunk's ``rows`` that stay possible, with their exact scores.

        possible(lower bounds, upper bounds) -> which candidates stay.
        """
        _, columns, low, high = self.chunks[start // CHUNK]
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        ends = np.stack((anchor[order] * low[order], anchor[order] * high[order]))
        least, most = (np.append(np.cumsum(side[::-1])[::-1], 0) for side in (ends.min(axis=0), ends.max(axis=0)))
        partial = np.zeros(len(rows), np.int64)
        for at in range(0, len(order), STEP):
            read = order[at : at + STEP]
            for d in read:
                partial += anchor[d] * columns[d, rows]
            done = at + len(read)
            stay = possible(partial + least[done], partial + most[done])
            if not stay.all():
                rows, partial = rows[stay], partial[stay]
            if not len(rows):
                break
        return rows, partial


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th greatest value, if there are so many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest_own(shelf: Shelf, anchor_id: int, label: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best other rows of the anchor's label on this shelf."""
    first, last = shelf.own(label)
    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(first // CHUNK * CHUNK, last, CHUNK):
        rows = np.arange(max(first, start), min(last, start + CHUNK)) - start
        rows = rows[shelf.ids[start + rows] != anchor_id]
        reached = _kth(scores, k)

        def possible(lower, upper):
            limit = max((x for x in (reached, _kth(lower, k)) if x is not None), default=None)
            return np.ones(len(upper), bool) if limit is None else upper >= limit

        rows, found = shelf.scan(vector, start, rows, possible)
        ids, scores = np.append(ids, shelf.ids[start + rows]), np.append(scores, found)
        best = _best(ids, scores, k)
        ids, scores = ids[best], scores[best]
    return ids, scores


def in_windows(shelf: Shelf, label: int, vector: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window, ids and scores of the k best rows of other labels with a score inside, on this shelf."""
    first, last = shelf.own(label)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
    for start, columns, _, _ in shelf.chunks:
        rows = np.arange(columns.shape[1])
        rows = rows[(rows + start < first) | (rows + start >= last)]
        reached = [_kth(scores, k) for _, scores in found]

        def possible(lower, upper):
            stay = np.zeros(len(lower), bool)
            for (low, high), limit in zip(windows, reached):
                inside = lower[(lower >= low) & (upper <= high)]
                least = max(low, *(x for x in (limit, _kth(inside, k)) if x is not None), low)
                stay |= (upper >= least) & (lower <= high)
            return stay

        rows, scores = shelf.scan(vector, start, rows, possible)
        for w, (low, high) in enumerate(windows):
            fits = (scores >= low) & (scores <= high)
            ids, own = np.append(found[w][0], shelf.ids[start + rows[fits]]), np.append(found[w][1], scores[fits])
            best = _best(ids, own, k)
            found[w] = ids[best], own[best]
    return found


def shelves_of(table: pa.Table) -> dict[int, Shelf]:
    """A shelf for each width of the rows."""
    ids, labels = (table[c].to_numpy() for c in ("id", "label"))
    out = {}
    for width, (rows, matrix) in _matrices(table["codes"]).items():
        out[width] = Shelf(ids[rows], labels[rows], matrix)
    return out


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    array = column.combine_chunks()
    sizes = array.value_lengths().to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        values = array.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        out[int(width)] = rows, values.astype(np.int64).reshape(len(rows), int(width))
    return out


def _rows(columns: list[list], types: list[str]) -> pa.Table:
    return pa.table({name: pa.array(np.concatenate(c) if c else [], pa.int64()) for name, c in zip(types, columns)})


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _find_positives(k: int) -> Callable:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows and anchors.num_rows:
            shelves, ids, labels = shelves_of(rows), anchors["id"].to_numpy(), anchors["label"].to_numpy()
            for width, (places, matrix) in _matrices(anchors["codes"]).items():
                for place, vector in zip(places, matrix):
                    if width in shelves:
                        near, scores = nearest_own(shelves[width], ids[place], labels[place], vector, k)
                        for column, values in zip(out, (np.full(len(near), ids[place]), near, scores)):
                            column.append(values)
        return _rows(out, _names(POSITIVES))

    return run


def _find_negatives(k: int, least: int, most: int, whole: int) -> Callable:
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if rows.num_rows and anchors.num_rows:
            shelves, ids, labels = shelves_of(rows), anchors["id"].to_numpy(), anchors["label"].to_numpy()
            positives = anchors["positives"].to_pylist()
            for width, (places, matrix) in _matrices(anchors["codes"]).items():
                for place, vector in zip(places, matrix):
                    windows = [(-(-least * p["score"] // whole), most * p["score"] // whole) for p in positives[place]]
                    if width in shelves:
                        for p, (near, scores) in zip(positives[place], in_windows(shelves[width], labels[place], vector, windows, k)):
                            n = len(near)
                            values = (np.full(n, ids[place]), np.full(n, p["id"]), np.full(n, p["score"]), near, scores)
                            for column, value in zip(out, values):
                                column.append(value)
        return _rows(out, _names(NEGATIVES))

    return run


def mine(
    df: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int, int] = (30, 90, 100),
    scale: int = 256,
    vector: str = "embedding",
    id_column: str = "vec_id",
    label: str = "label",
    shelf: int = SHELF,
    group: int = GROUP,
) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of its label: the best ``negatives`` rows of other labels
    whose score is between window[0]/window[2] and window[1]/window[2] of the positive's.

    ``is_anchor`` tells by the id column. Scores are inner products of floor(scale * component); ties go to the smaller id.
    No part is taken by rows without an id or label, with a null vector, or with a component that is null, not finite or
    beyond 2**22 once scaled (its products would leave 64 bits). Of rows with one id the one with the least label and
    codes counts, so repeated rows count once. Rows are compared with rows of their own width; an empty vector scores 0.
    A positive of a negative score has no window, so no row. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "coded")
    coded(df, scale, vector, id_column, label).write.parquet(folder)
    rows, again = spark.read.parquet(folder), spark.read.parquet(folder)
    chosen = again.withColumnRenamed("id", id_column).where(is_anchor).withColumnRenamed(id_column, "id")
    anchor_here = F.coalesce(is_anchor, F.lit(False)).cast("long")
    counts = rows.withColumnRenamed("id", id_column).agg(F.count("*").alias("rows"), F.sum(anchor_here).alias("anchors")).first()
    shelves = max(-(-counts["rows"] // shelf), int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(-(-(counts["anchors"] or 0) // group), 1)
    # every shelf once for each group of anchors, every anchor once for each shelf
    held = rows.withColumn("shelf", F.pmod(F.xxhash64("id"), F.lit(shelves)).cast("int")).withColumn(
        "anchor_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    own_group = F.pmod(F.xxhash64("id", F.lit("group")), F.lit(groups)).cast("int")

    def met(anchors: DataFrame, task: Callable, schema: str) -> DataFrame:
        asked = anchors.withColumn("anchor_group", own_group).withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
        both = held.groupBy("shelf", "anchor_group").cogroup(asked.groupBy("shelf", "anchor_group"))
        return both.applyInArrow(task, schema)

    def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = ranked(met(chosen, _find_positives(positives), POSITIVES), ["anchor_id"], positives)
    listed = near.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))  # a few for each
    asking = chosen.join(listed.withColumnRenamed("anchor_id", "id"), "id")
    hard = ranked(met(asking, _find_negatives(negatives, *window), NEGATIVES), ["anchor_id", "positive_id"], negatives)
    return hard.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
