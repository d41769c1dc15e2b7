"""The search index: texts and their vectors stored once, kept up to date by content, and read by every question.

A delivery is compared with what is stored by the hash of its texts: only new and changed texts are embedded, a row whose
text is the same keeps its vector, and an id that is gone takes its vector along. ``publish`` makes what questions read: the
current rows with their vectors, which are those of the log as long as it has one batch, and an inverted index of their words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions import vectors as V
from gridlark.functions.numbers import round_stat
from gridlark.operators import blocks, search, word_index
from gridlark.plans.session import scratch_path
from gridlark.sources.sinks import BATCH, committed_batches, write_batch

KEY = ("collection", "hit_id")
#: What a stored row carries besides its key.
CONTENT = ("priority", "merge_key", "text", "line")
HASH_MODEL = "sha256-hash"


def searchable(tables: dict[str, search.Collection]) -> DataFrame:
    """Rows of several collections as an index takes them."""
    parts = [search._hits(name, place, table, F.lit(None).cast("double")).drop("score") for place, (name, table) in enumerate(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    folders = committed_batches(spark, path)
    return spark.read.option("basePath", path).parquet(*folders) if folders else None


def _newest(stored: DataFrame) -> DataFrame:
    """(collection, hit_id, batch) of the newest record of each key: a fold of narrow rows in two hash steps."""
    return stored.groupBy(*KEY).agg(F.max(BATCH).alias(BATCH))


def _held(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their vectors beside them, one for each key that has not been deleted."""
    stored = _log(spark, path)
    if stored is None:
        raise FileNotFoundError(f"nothing is stored in {path}")
    if len(committed_batches(spark, path)) == 1:  # every record is the newest of its key: vectors are not moved to find out
        return stored.where("NOT deleted AND collection IS NOT NULL").drop("deleted", BATCH)
    return stored.join(_newest(_log(spark, path)), [*KEY, BATCH], "left_semi").where("NOT deleted").drop("deleted", BATCH)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their vectors, one for each key that has not been deleted."""
    return _held(spark, path).withColumn("embedding", blocks.as_lists("held")).drop("held")


def deliver(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    batch_id: int,
    complete: bool = False,
    deleted: DataFrame | None = None,
    encoder=None,
    model: str = HASH_MODEL,
    tasks: int | None = None,
) -> None:
    """Brings the index at ``path`` up to date with a delivery of searchable rows, one for each (collection, hit_id); rows
    without an id are left out.

    ``complete``: the delivery is all there is, so ids that are not in it are deleted; otherwise ``deleted`` may name
    some. A batch holds what changed and nothing else: an unchanged row is not written again. A replayed batch replaces
    its folder and is compared with the batches before it. ``tasks`` deals changed texts (and nothing else) to so many
    tasks before they are embedded, for deliveries that one task would read.
    """
    new = rows.where(F.col("hit_id").isNotNull()).select(*KEY, *CONTENT).withColumn("text_hash", F.sha2("text", 256))
    stored = _log(spark, path)
    stored = stored.where(F.col(BATCH) < batch_id) if stored is not None else None
    if stored is None:
        changed, moved, gone = new, None, None
    else:
        # two narrow joins by unique keys find out what changed; vectors are read for moved rows only
        newest = stored.join(_newest(stored), [*KEY, BATCH], "left_semi").where("NOT deleted")
        before = newest.select(
            *[F.col(c).alias(f"old_{c}") for c in KEY], F.col("text_hash").alias("old_hash"), F.col("model").alias("old_model"),
            F.struct(*[c for c in CONTENT if c != "text"]).alias("old_content"),
        )
        same_key = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"old_{c}") for c in KEY])
        met = new.join(before, same_key, "left")
        same_text = F.col("old_hash").eqNullSafe(F.col("text_hash")) & (F.col("old_model") == model)
        same_rest = F.struct(*[c for c in CONTENT if c != "text"]).eqNullSafe(F.col("old_content"))
        changed = met.where(F.col("old_collection").isNull() | ~same_text).select(*new.columns)
        held = newest.select(*KEY, "model", "dimensions", "held")
        moved = met.where(F.col("old_collection").isNotNull() & same_text & ~same_rest).select(*new.columns).join(held, list(KEY))
        missing = newest.select(*KEY)
        gone = missing.join(new, list(KEY), "left_anti") if complete else missing.join(deleted, list(KEY), "left_semi") if deleted is not None else None
    # a vector leaves the worker that makes it as the bytes that are stored, and is stored once: questions read the log's
    out = search.embed(changed, "text", encoder, tasks=tasks).withColumn("held", F.arrow_udf(blocks.beside, blocks.BESIDE)("embedding"))
    out = out.withColumns({"model": F.lit(model), "dimensions": F.col("held.width")}).drop("embedding")
    if moved is not None:
        out = out.unionByName(moved)
    out = out.withColumn("deleted", F.lit(False))
    if gone is not None:
        out = out.unionByName(gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
    write_batch(out, path, batch_id, compression="zstd")


def embedding_rows(texts: DataFrame, encoder=None, model: str = HASH_MODEL, tasks: int | None = None) -> DataFrame:
    """Rows of ``text_content`` with their vector, the model that made it and its dimensions."""
    out = search.embed(texts, "text_content", encoder, tasks=tasks)
    # the width of the hash embedding is known: asking each vector would bring it out of the worker
    dimensions = F.size("embedding") if encoder else F.lit(V.HASH_DIMENSIONS)
    return out.withColumns({"embedding_model": F.lit(model), "dimensions": dimensions})


@dataclass(frozen=True)
class Published:
    """What questions read: rows, words in blocks, vectors beside ids. Ids are ``priority/hit_id``."""

    rows: DataFrame
    words: DataFrame
    vectors: DataFrame


def _block_id() -> Column:
    """An id that sorts like (priority, hit_id)."""
    return F.concat(F.lpad(F.col("priority").cast("string"), 4, "0"), F.lit("/"), "hit_id")


def publish(spark: SparkSession, path: str, target: str) -> Published:
    """The searchable form of the index at ``path``, as far as it needs a form of its own written to a new folder. A log of
    one batch has each row once and is read as it is; of more batches the current rows are written together."""
    held = _held(spark, path)
    if len(committed_batches(spark, path)) > 1:
        held.write.option("compression", "zstd").parquet(f"{target}/rows")
        held = spark.read.parquet(f"{target}/rows")
    rows = held.drop("held").withColumn("block_id", _block_id())
    words = word_index.index_words(rows, "block_id", "text", f"{target}/words", "collection")
    return Published(rows, words, held.select(_block_id().alias("id"), F.col("collection").alias("scope"), F.lit(1).alias("rows"), "held.*"))


# --- one question --------------------------------------------------------------------------------------------------
def _of(rows: DataFrame, collections: Sequence[str] | None) -> DataFrame:
    return rows.where(F.col("collection").isin(*collections)) if collections else rows


def keyword(query: str, index: Published, collections: Sequence[str] | None = None) -> DataFrame:
    """Keyword hits of one question: one scan of the texts; each task keeps its best rows of each collection."""
    words = search.query_words(query)
    scored = [w for w in words if len(w) >= search.MIN_SCORED_LENGTH]
    hits = _of(index.rows, collections).select(*search.HIT[:5], search._keyword_score("text", words, scored).alias("score"), "priority")
    order = Window.partitionBy("collection").orderBy(F.col("score").desc(), "hit_id")
    ranked = hits.where("score IS NOT NULL").withColumn("place", F.row_number().over(order))
    return search._best(ranked.where(F.col("place") <= search.KEYWORD_PER_COLLECTION).drop("place"), search.KEYWORD_LIMIT)


def semantic(query: str, index: Published, collections: Sequence[str] | None = None, k: int = search.VECTOR_LIMIT) -> DataFrame:
    """Semantic hits of one question: one scan of the stored vectors, nothing but the question is embedded. What a hit says
    is looked up for the k that are left."""
    hits = blocks.nearest_rows(index.vectors, search.hash_vector(query), k, collections)
    told = _of(index.rows, collections).withColumn("id", _block_id()).join(F.broadcast(hits), "id")
    return search._best(told.select(*search.HIT), k)


def ask(query: str, index: Published, search_type: str = "hybrid", collections: Sequence[str] | None = None) -> DataFrame:
    """All ranked results of one question over the stored index."""
    if search_type == "keyword":
        return search._numbered(search._ordered(keyword(query, index, collections), "keyword"))
    if search_type == "semantic":
        return search._numbered(search._ordered(semantic(query, index, collections), "semantic"))
    return search.union_hybrid_results(keyword(query, index, collections), semantic(query, index, collections))


def answer(query: str, index: Published, search_type: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """A question in words, routed by its domain: the first page of results and the one-row summary."""
    if not query:
        raise ValueError("No query provided")
    domain = search.intent_of(query)
    results = ask(query, index, search_type, search.ROUTES.get(domain, search.DEFAULT_ROUTE))
    return search.results_page(results), search.summarise(results, query, domain)


# --- a table of questions ----------------------------------------------------------------------------------------------
def answer_many(questions: DataFrame, index: Published, query: str = "query", search_type: str = "hybrid") -> DataFrame:
    """Ranked results of every distinct, non-empty question: (query, rank, total, collection, hit_id, origin, score,
    first), one plan for all of them. ``total`` is the number of a question's results.

    Equal questions are answered once. Words meet the stored inverted index, vectors the stored ones; each keeps its
    limit per question before anything else, so a question has at most thirty rows from there on.
    """
    spark, folder = questions.sparkSession, scratch_path(questions.sparkSession, "answers")
    distinct = questions.where(F.coalesce(F.col(query), F.lit("")) != "").select(F.col(query).alias("query")).distinct()
    domain = search.extract_intent(F.col("query"))["domain"]
    distinct.select(F.sha2("query", 256).alias("key"), "query", search.query_route(domain).alias("route")).write.parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    parts = []
    if search_type != "semantic":
        found = word_index.search(asked, index.words, "key", "query", "route", search.KEYWORD_PER_COLLECTION, search.MIN_SCORED_LENGTH)
        score = F.when(F.col("scored") > 0, round_stat(F.col("points") / F.col("scored"), V.SCORE_PLACES)).otherwise(0.0)
        ranked = Window.partitionBy("key").orderBy(F.col("score").desc(), "id")
        found = found.withColumn("score", score).withColumn("place", F.row_number().over(ranked))
        found = found.where(F.col("place") <= search.KEYWORD_LIMIT)
        parts.append(found.select("key", "id", "score", F.lit("keyword").alias("origin"), F.lit(0).alias("first")))
    if search_type != "keyword":
        embedded = search.embed(asked, "query").select("key", "embedding", F.array_join("route", "\n").alias("route"))
        packed = blocks.pack(embedded, "key", "embedding", f"{folder}/vectors", "route")
        near = blocks.search_rows(packed, index.vectors, search.VECTOR_LIMIT, "key", "id")
        parts.append(near.select("key", "id", "score", F.lit("semantic").alias("origin"), F.lit(1).alias("first")))
    hits = reduce(DataFrame.unionByName, parts)
    names = index.rows.select(_block_id().alias("id"), "collection", "hit_id", "merge_key")
    told = hits.join(names, "id")
    # an id is shown where it is found first; a row without a known id never merges with the other list
    own = F.col("merge_key").startswith(F.concat("collection", F.lit("/")))
    merge = F.when(own | (search_type != "hybrid"), F.concat("origin", F.lit(":"), "id")).otherwise(F.col("merge_key"))
    shown = told.withColumn("merge", merge)
    best = Window.partitionBy("key", "merge").orderBy("first", F.col("score").desc(), "id")
    merged = shown.withColumn("n", F.row_number().over(best)).where("n = 1")
    every = Window.partitionBy("key")
    order = every.orderBy("first", F.col("score").desc(), "id")
    numbered = merged.withColumns({"rank": F.row_number().over(order), "total": F.count("*").over(every).cast("int")})
    return numbered.join(asked.select("key", "query"), "key").select(
        "query", "rank", "total", "collection", "hit_id", "origin", V.score(F.col("score")).alias("score")
    )


def log_answers(questions: DataFrame, answers: DataFrame, search_type: str, now_ms: int, query: str = "query") -> DataFrame:
    """Rows of the question log, one for each question asked, with the number of its results."""
    counts = answers.where("rank = 1").select(F.col("query").alias("answered"), "total")
    asked = questions.where(F.coalesce(F.col(query), F.lit("")) != "")
    counted = asked.join(counts, F.col(query) == F.col("answered"), "left").withColumn("result_count", F.coalesce("total", F.lit(0)))
    return search.log_queries(counted.withColumnRenamed(query, "query") if query != "query" else counted, search_type, now_ms)
