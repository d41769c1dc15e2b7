"""Near-duplicate classes by DartMinHash signatures of weighted five-word shingles.

A document is a weighted set: its shingles and how often each occurs. Every unit of weight of a shingle owns a region,
into which darts fall in an order and with ranks that depend on the region alone; each dart belongs to one coordinate of
the signature. A document throws only the darts with ranks below a bound that shrinks with its total weight, so that
about k ln k darts hit, and keeps the earliest dart of each coordinate. Two documents keep the same dart with the
probability of their weighted Jaccard similarity. (Coordinates without a dart get another throw with a doubled bound.)

Signatures are cut into bands; documents that share a band are candidates, and candidates are compared exactly: first by
outlines, which are a sixth as large and bound the similarity from above, and the pairs that pass by their sets. Equal
shingle sets are one node from the start, and a band's nodes form groups of similar weights. In a group each round compares
all nodes of other classes with some pivots, from the largest classes first, and joins what is similar, as long as rounds
pay. What is left between classes is compared pair by pair if it is no more than a few pairs for each node, and else in
blocks: a row holds the outlines of hundreds of nodes, and two blocks of a group are compared by one product of matrices.
So no link between different texts is lost, and pairs become rows only where outlines say that they may be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.support import FOLDED_VALUES, WORD_BYTES, documents, joined, mix, range_hashes, slices, words
from gridlark.plans.session import scratch_path

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bands and coordinates in each: a pair at 0.8 shares none of the bands with a probability of 7e-5.
BANDS, ROWS = 24, 5
#: Pivots of a group in the first round; each round takes twice as many.
FIRST_PIVOTS = 2
#: Names (of 8 bytes) up to which they are broadcast to pick rows of a larger table; more are met in a shuffle.
BROADCAST_NAMES = 1 << 22
#: Pairs for each node up to which the classes' remaining candidates are compared pair by pair.
PAIRS_PER_NODE = 8
#: A further round is worth while if the one before left at most this share of the pairs between classes.
ROUND_PAYS = 0.6
#: Bytes of outlines in a block, what a node counts there besides, block pairs that travel to a worker at once, and columns
#: of a product.
BLOCK_BYTES, NODE_BYTES, BLOCK_PAIRS, COLUMNS = 1 << 18, 256, 16, 1 << 12
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words (all words of a row with fewer), and their row numbers."""
    starts, ends, row = words(data, bounds, WORD_BYTES)
    word = range_hashes(data, starts, ends, FOLDED_VALUES)
    count = np.bincount(row, minlength=len(bounds) - 1)
    first = np.cumsum(count) - count
    if not len(word):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    size = np.minimum(count, width)[row]
    begins = np.arange(len(word)) - first[row] <= (count - np.minimum(count, width))[row]
    out = np.zeros(len(word), np.uint64)
    for i in range(width):
        use = i < size
        at = np.minimum(np.arange(len(word)) + i, len(word) - 1)
        out = np.where(use, mix(out * _GOLD + word[at] + np.uint64(1)), out)
    return out[begins], row[begins]


def weighted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and how often each occurs."""
    names, counts = np.unique(hashes, return_counts=True)
    return names, counts.astype(np.int64)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def signature(names: np.ndarray, counts: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """k hashes: the earliest dart of each coordinate. Empty sets have no signature."""
    # one region for each unit of weight: (shingle, unit)
    unit = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    region = mix(np.repeat(names, counts) + unit.astype(np.uint64) * _GOLD)
    bound = (k * np.log(k) + 2 * k) / len(region)
    while True:
        darts, ranks = _darts(region, bound)
        name = mix(darts ^ _GOLD)
        coordinate = (name % np.uint64(k)).astype(np.int64)
        order = np.lexsort((ranks, coordinate))
        first = order[np.flatnonzero(np.diff(coordinate[order], prepend=-1))]
        if len(first) == k:
            return name[first]
        bound *= 2


def _darts(region: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """All darts of the regions with ranks below ``bound``. A region's ranks are a Poisson process of rate one."""
    draw = mix(region + np.uint64(1))
    at = -np.log(_uniform(draw))
    hit = at < bound
    live, at, thrown = region[hit], at[hit], 1
    darts, ranks = [draw[hit]], [at]
    step = int(bound + 4 * np.sqrt(bound)) + 2  # mostly all further darts of a region
    while len(live):
        draw = mix(live[:, None] + np.arange(thrown + 1, thrown + step + 1, dtype=np.uint64))
        further = at[:, None] - np.cumsum(np.log(_uniform(draw)), axis=1)
        hit = further < bound
        darts.append(draw[hit])
        ranks.append(further[hit])
        on = hit[:, -1]
        live, at, thrown = live[on], further[on, -1], thrown + step
    return np.concatenate(darts), np.concatenate(ranks)


def bands(darts: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of a signature; bands of different places differ."""
    out = np.arange(1, count + 1, dtype=np.uint64) * _GOLD
    for r in range(rows):
        out = mix(out + darts.reshape(count, rows)[:, r])
    return out


def set_id(names: np.ndarray, counts: np.ndarray) -> bytes:
    """A 128-bit name of a weighted set."""
    with np.errstate(over="ignore"):
        each = names + counts.astype(np.uint64) * _GOLD
        return mix(np.array([np.sum(mix(each), dtype=np.uint64), np.sum(mix(each ^ _GOLD), dtype=np.uint64)])).tobytes()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights over the sum of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, shingles, counts) of the rows that have words."""
    hashes, row = shingles(*joined(batch.column("text")))
    at = np.searchsorted(row, np.arange(batch.num_rows + 1))
    for r in np.flatnonzero(np.diff(at)):
        yield int(r), *weighted(hashes[at[r] : at[r + 1]])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row, node, total, bands) of documents: the set's name, its weight and its band keys; all null for texts
    without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in slices(batches, limit=1 << 20):
            node, total, keys = ([None] * batch.num_rows for _ in range(3))
            for r, names, counts in _rows_of(batch):
                node[r], total[r] = set_id(names, counts), int(counts.sum())
                if node[r] not in known:  # copies have equal signatures
                    if len(known) > 10_000:
                        known.clear()
                    known[node[r]] = bands(signature(names, counts)).view(np.int64).tolist()
                keys[r] = known[node[r]]
            columns = (
                batch.column("doc_id"), batch.column("row"), pa.array(node, pa.binary()), pa.array(total, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
            )
            yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "row", "node", "total", "bands"])

    return docs.mapInArrow(sketch, "doc_id long, row string, node binary, total long, bands array<long>")


def outline(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set with 16 bits of each name; names that become equal add up. No pair is less similar by its outlines."""
    short = (names >> np.uint64(48)).astype(np.uint16)  # names ascend
    first = np.flatnonzero(np.diff(short.astype(np.int32), prepend=-1))
    return short[first], np.add.reduceat(counts, first)


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, names, counts, short, sums): each document's shingle set and its outline, as binary columns. Counts that are
    all one are null."""

    def packed(counts: np.ndarray) -> bytes | None:
        return counts.astype(np.uint32).tobytes() if counts.max() > 1 else None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            rows = []
            for _, n, c in _rows_of(batch):
                short, sums = outline(n, c)
                rows.append((set_id(n, c), n.tobytes(), packed(c), short.tobytes(), packed(sums)))
            columns = zip(("node", "names", "counts", "short", "sums"), zip(*rows) if rows else [[]] * 5)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary()) for k, v in columns})

    return docs.mapInArrow(build, "node binary, names binary, counts binary, short binary, sums binary")


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    folder = scratch_path(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _picked(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among ``names``, by 64-bit hashes: a few others may stay (harmless here). The
    names are counted first, and a bounded number of them is broadcast, so that rows not picked are not shuffled."""
    hashes = _written(names.select(F.xxhash64(column).alias("picked")).distinct(), "picked")
    if hashes.count() <= BROADCAST_NAMES:
        hashes = F.broadcast(hashes)
    return df.join(hashes, F.xxhash64(column) == F.col("picked"), "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, x, y) whose sets are similar enough. Outlines rule out most others, so that whole sets travel only
    for the pairs that pass."""
    ends = F.explode(F.array("a", "b")).alias("node")
    outlines = sets.select("node", F.col("short").alias("names"), F.col("sums").alias("counts"))
    close = _written(_compared(pairs, _picked(outlines, "node", pairs.select(ends)), 2, least), "close")
    return _verified(close, sets, least)


def _verified(close: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, x, y) whose whole sets are similar enough."""
    ends = F.explode(F.array("a", "b")).alias("node")
    return _compared(close, _picked(sets.select("node", "names", "counts"), "node", close.select(ends)), 8, least)


def overlaps(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What every set of ``a`` has in common with every set of ``b``: the sums of the smaller weights.

    A weight is the sum of its steps over the weights that its name has anywhere, so the sums are products of matrices,
    a bounded number of columns at a time.
    """
    sizes = np.array([len(n) for n, _ in a + b])
    names = np.concatenate([n for n, _ in a + b]).astype(np.uint64)
    row, count = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([c for _, c in a + b]).astype(np.uint64)
    steps, step = np.unique(names << np.uint64(32) | count, return_inverse=True)
    named, value = steps >> np.uint64(32), (steps & np.uint64(0xFFFFFFFF)).astype(np.float64)
    new = np.diff(named, prepend=named[:1] + np.uint64(1)) != 0
    rise = value - np.where(new, 0, np.concatenate(([0], value[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(steps)), 0))[step]
    each = step - first + 1
    column = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
    order = np.argsort(column, kind="stable")
    column, row = column[order], np.repeat(row, each)[order]
    out = np.zeros((len(a), len(b)))
    for low in range(0, len(steps), COLUMNS):
        i, j = np.searchsorted(column, (low, low + COLUMNS))
        dense = np.zeros((len(sizes), min(COLUMNS, len(steps) - low)))
        dense[row[i:j], column[i:j] - low] = 1
        out += (dense[: len(a)] * rise[low : low + COLUMNS]) @ dense[len(a) :].T
    return out


def _blocks(state: DataFrame, outlines: DataFrame) -> DataFrame:
    """The members of each group in blocks of about ``BLOCK_BYTES``, by class, and each block's first and last class."""
    by_class = Window.partitionBy("key").orderBy("label", "node")
    size = F.octet_length("names") + F.coalesce(F.octet_length("counts"), F.lit(0)) + F.lit(NODE_BYTES)
    placed = state.join(outlines, "node").withColumn("block", F.floor(F.sum(size).over(by_class) / F.lit(BLOCK_BYTES)))
    members = F.collect_list(F.struct("node", "label", "names", "counts")).alias("members")
    return placed.groupBy("key", "block").agg(members, F.min("label").alias("low"), F.max("label").alias("high"))


def _close_in_blocks(state: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, x, y) of nodes of one group and different classes whose outlines are similar enough."""
    spark = state.sparkSession
    outlines = sets.select("node", F.col("short").alias("names"), F.col("sums").alias("counts"))
    blocks = _written(_blocks(state, outlines), "blocks")
    one, two = (blocks.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "low", "high")]) for side in "ab")
    several = ~((F.col("low_a") == F.col("high_b")) & (F.col("high_a") == F.col("low_b")))  # not all of one class
    met = one.join(two, "key").where((F.col("block_a") <= F.col("block_b")) & several).select("key", "block_a", "block_b")
    for side in "ba":
        met = met.join(blocks.select("key", F.col("block").alias(f"block_{side}"), F.col("members").alias(side)), ["key", f"block_{side}"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = (batch.column(side)[r].values for side in "ab")
                first, second = ([_set(n, c, 2) for n, c in zip(m.field("names").to_pylist(), m.field("counts").to_pylist())] for m in (a, b))
                common = overlaps(first, second)
                total = np.add.outer([c.sum() for _, c in first], [c.sum() for _, c in second])
                i, j = np.nonzero(common >= (least - 1e-12) * (total - common))
                nodes, labels = ([(np.array(m.field(k).to_pylist(), object)[at]) for m, at in ((a, i), (b, j))] for k in ("node", "label"))
                keep = np.flatnonzero(labels[0] != labels[1])
                rows = [(p, q, x, y) if p < q else (q, p, y, x) for p, q, x, y in zip(*(v[keep].tolist() for v in (*nodes, *labels)))]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in (zip(*rows) if rows else [[]] * 4)], names=["a", "b", "x", "y"])

    pairs = met.select("a", "b").mapInArrow(compare, "a binary, b binary, x binary, y binary").distinct()
    at_once = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_PAIRS))  # a row holds two blocks
    try:
        return _written(pairs, "close")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)


def _compared(pairs: DataFrame, sets: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b, x, y) whose sets (names of ``width`` bytes) are similar enough. Hot nodes are split by the adaptive
    joins."""
    b = sets.select(F.col("node").alias("b"), F.col("names").alias("b_names"), F.col("counts").alias("b_counts"))
    a = sets.select(F.col("node").alias("a"), F.col("names").alias("a_names"), F.col("counts").alias("a_counts"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b_names"):
            keep, last, left = [], None, None
            rows = {k: batch.column(k).to_pylist() for k in ("a", "a_names", "a_counts", "b_names", "b_counts")}
            for r in range(batch.num_rows):
                if rows["a"][r] != last:
                    last, left = rows["a"][r], _set(rows["a_names"][r], rows["a_counts"][r], width)
                keep.append(similarity(left, _set(rows["b_names"][r], rows["b_counts"][r], width)) >= least - 1e-12)
            yield batch.select(["a", "b", "x", "y"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").join(b, "b").join(a, "a").mapInArrow(compare, "a binary, b binary, x binary, y binary")


def _set(names: bytes, counts: bytes | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    each = np.frombuffer(names, f"u{width}")
    return each, np.ones(len(each), np.int64) if counts is None else np.frombuffer(counts, np.uint32).astype(np.int64)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches, by rounds of large and small stars.

    In a round every node hands the smallest node it knows to its neighbours; links shorten until each class is a star.
    """
    links = _written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # stars: every node has one link, and none that it is linked to has another
        ends = links.select(F.col("a").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(links.select("b", F.lit(0), F.lit(1)))
        each = ends.groupBy("n").agg(F.sum("i").alias("i"), F.max("o").alias("o"))
        if each.where((F.col("i") > 1) | ((F.col("i") > 0) & (F.col("o") > 0))).isEmpty():
            break
        # large star: larger neighbours of a node are linked to the smallest node around it
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        # small star: a node and its smaller neighbours are linked to the smallest of them
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
            least.select("a", F.col("least").alias("b"))
        )
        links = _written(small.where("a <> b").distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _appended(df: DataFrame, folder: str, number: int) -> DataFrame:
    """Rows added to a table of the shared folder as its part ``number``, and the whole table with the column ``part``: its
    plan is one scan however often it grew."""
    df.write.parquet(f"{folder}/part={number}")
    return df.sparkSession.read.parquet(folder)


def _relabelled(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows whose class has become part of another one get that one's label."""
    new = changes.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return rows.join(new, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def candidates(nodes: DataFrame, least: float) -> DataFrame:
    """(key, node): nodes that share a band and may have similar weights, in groups of two at least.

    Sets whose weights differ by more than the similarity allows can't be similar. Weights fall in classes as wide as
    that (and a little more, for rounding); a node is in the groups of its class and of the next, so nodes of one class or
    of neighbouring ones meet, and no others.
    """
    width = -np.log(least) * (1 + 1e-6)
    own = F.floor(F.log(F.col("total").cast("double")) / F.lit(float(width)))
    banded = nodes.select("node", F.explode("bands").alias("band"), own.alias("own"))
    # most bands are of one node: they go before the rest is repeated for two classes
    banded = _written(banded.join(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band"), "banded")
    keyed = banded.select(F.explode(F.array(F.xxhash64("band", "own"), F.xxhash64("band", F.col("own") + 1))).alias("key"), "node")
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keyed.join(size, "key")


def classes_of_nodes(docs: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame | None:
    """(node, label) among the nodes of rows (row, node, total, bands) that are similar to others; None if none can be.

    ``docs`` has the texts of the rows. Sets are built only of nodes that share a band, from one row of each.

    A round takes pivots in every group that still has several classes, twice as many as the round before, compares them
    with the group's nodes of other classes and takes them out of the group. Rounds end once few pairs are left between
    classes, or once a round has hardly lessened them: the groups that are open then are compared in blocks.

    Rounds hand on what they know as tables: labels change by what the round has linked, and a round's plan is as large
    as that of the first one.
    """
    spark = docs.sparkSession
    nodes = rows.where("node is not null").select("node", "total", "bands").dropDuplicates(["node"])
    state = _written(candidates(nodes, least).select("key", "node", F.col("node").alias("label")), "groups")
    wanted = state.select("node").distinct()
    wanted = _written(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")), "wanted")
    count = wanted.count()
    if not count:
        return None
    own = _picked(docs, "row", wanted.select("row")).dropDuplicates(["row"]).select("text")
    sets = _written(sets_of(own), "sets")
    folder, labels, tried, chosen, number, before = scratch_path(spark, "tried"), None, None, FIRST_PIVOTS, 0, None
    while True:
        # groups with several classes are still open
        members = state.groupBy("key", "label").agg(F.count("*").alias("m"))
        live = members.groupBy("key").agg(
            F.count("*").alias("classes"), (F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("left")
        )
        left = live.where("classes > 1").agg(F.sum("left")).first()[0]
        if not left:
            break
        last = tried is not None and left <= 2 * PAIRS_PER_NODE * count
        if not last and before is not None and left > ROUND_PAYS * before:
            close = _close_in_blocks(state.join(live.where("classes > 1").select("key"), "key", "left_semi"), sets, least)
            changes = components(_verified(close, sets, least).select(F.col("x").alias("a"), F.col("y").alias("b")))
            return _written(_relabelled(labels, changes), "labels")
        before = left
        if last:
            one = state.select("key", F.col("node").alias("a"), F.col("label").alias("x"))
            two = state.select("key", F.col("node").alias("b"), F.col("label").alias("y"))
            pairs = one.join(two, "key").where("a < b and x <> y")
        else:
            # the largest classes first: their pivots meet only what is outside, and most of that is similar to some of them
            each = members.withColumn("classes", F.count("*").over(Window.partitionBy("key"))).where("classes > 1")
            best = Window.partitionBy("key").orderBy(F.desc("m"), "node")
            ordered = state.join(each, ["key", "label"]).withColumn("n", F.row_number().over(best))
            pivots = ordered.where(F.col("n") <= chosen).select("key", F.col("node").alias("pivot"), F.col("label").alias("z"))
            pivots = _written(pivots, "pivots")
            met = state.join(pivots, "key").where("node <> pivot and label <> z")
            first = F.col("node") < F.col("pivot")
            sides = {"a": ("node", "pivot"), "b": ("pivot", "node"), "x": ("label", "z"), "y": ("z", "label")}
            pairs = met.select(*[F.when(first, F.col(c)).otherwise(F.col(d)).alias(k) for k, (c, d) in sides.items()])
        pairs = pairs.select("a", "b", "x", "y").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        tried = _appended(pairs, folder, number)
        pairs = tried.where(F.col("part") == number)
        changes = components(_similar(pairs, sets, least).select(F.col("x").alias("a"), F.col("y").alias("b")))
        old = wanted.select("node", F.col("node").alias("label")) if labels is None else labels
        labels = _written(_relabelled(old, changes), "labels")
        if last:
            break
        done = pivots.select("key", F.col("pivot").alias("node"))
        open_ = state.join(pivots.select("key").distinct(), "key", "left_semi").join(done, ["key", "node"], "left_anti")
        state = _written(_relabelled(open_, changes).select("key", "node", "label"), "groups")
        chosen, number = chosen * 2, number + 1
    return labels


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _classed(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, row, node, label) of documents with a row name; label is null for texts without words."""
    rows = _written(sketches(docs), "sketches")
    return _labelled(rows.select("doc_id", "row", "node"), classes_of_nodes(docs, rows, least))


def _row_name(id_column: Column, text: Column) -> Column:
    """A 128-bit name of a row by its id and text; a null text has another one than an empty text."""
    ident, body = id_column.cast("long").cast("string"), text.cast("binary")
    return F.md5(F.concat(F.coalesce(ident, F.lit("-")).cast("binary"), F.when(text.isNull(), F.lit("?").cast("binary")).otherwise(F.concat(F.lit(":").cast("binary"), body))))


def classes(df: DataFrame, least: float = SIMILARITY, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, class_size) of every row.

    Rows are in a class if a chain of links joins them; a link is a weighted Jaccard similarity of five-word shingles
    of at least ``least`` (texts with fewer words are one shingle). class_id is the class's smallest doc_id, null if no
    row of it has an id. Texts without words, null ones too, are alone: class_id is their doc_id and class_size 1.
    """
    docs = documents(df, text, id_column).withColumn("row", _row_name(F.col("doc_id"), F.col("text")))
    rows = _classed(docs, least)
    named = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = F.col("node").isNull()
    return rows.join(named, "label", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def first_of_each(df: DataFrame, least: float = SIMILARITY, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``df`` with one row of each class: the one with the smallest id (rows without one come last).

    Of rows with equal id and text one stays. Texts without words are alone, so they stay.
    """
    name = "_".join([*df.columns, "row"])  # no column has this name
    docs = documents(df, text, id_column).withColumn("row", _row_name(F.col("doc_id"), F.col("text")))
    rows = _classed(docs, least)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.where("label is not null").groupBy("label").agg(F.min(order).alias("first")).select("first.row")
    kept = first.unionAll(rows.where("label is null").select("row")).distinct().withColumnRenamed("row", name)
    named = df.withColumn(name, _row_name(F.col(id_column), F.col(text)))
    return named.join(kept, name).dropDuplicates([name]).select(*df.columns)
