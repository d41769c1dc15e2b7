"""Keyword, vector and hybrid search; query intent, routing and summaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import vectors as V
from gridlark.functions.conditions import literal
from gridlark.functions.numbers import stat_sql
from gridlark.operators import blocks
from gridlark.operators.blocks import matrix_of
from gridlark.operators.state import merge_first_wins
from gridlark.plans.session import scratch_path

# Sizes of result lists and how long a word must be to count.
KEYWORD_PER_COLLECTION = 10
KEYWORD_LIMIT = 20
VECTOR_LIMIT = 10
RESULT_LIMIT = 10
SUMMARY_PER_COLLECTION = 5
MIN_SCORED_LENGTH = 3


@dataclass(frozen=True)
class Collection:
    """A searchable table. ``merge_id`` is the id hybrid results are merged by (or none),
    ``line`` the text a summary prints for one of its rows."""

    df: DataFrame
    id_column: str
    text_column: str = "rag_text"
    merge_id: str | None = None
    line: Callable[[], Column] | None = None


HIT = ("collection", "hit_id", "text", "line", "merge_key", "score", "priority")


def _hits(name: str, place: int, table: Collection, score: Column) -> DataFrame:
    line = table.line() if table.line else F.concat(F.substring(table.text_column, 1, 200), F.lit("..."))
    key = F.col(table.merge_id) if table.merge_id else F.concat(F.lit(f"{name}/"), F.col(table.id_column).cast("string"))
    return table.df.select(
        F.lit(name).alias("collection"),
        F.col(table.id_column).cast("string").alias("hit_id"),
        F.col(table.text_column).alias("text"),
        line.alias("line"),
        key.cast("string").alias("merge_key"),
        score.alias("score"),
        F.lit(place).alias("priority"),
    )


def _best(hits: DataFrame, n: int) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), "priority", "hit_id").limit(n)


def query_words(query: str) -> list[str]:
    return re.findall(r"\b\w+\b", query.lower())


def keyword_search(
    query: str,
    tables: dict[str, Collection],
    per_collection: int = KEYWORD_PER_COLLECTION,
    limit: int = KEYWORD_LIMIT,
) -> DataFrame:
    """Rows whose text contains any word of the query, scored by the share of its longer words.

    Every matching row is scored; each collection contributes its best ``per_collection``.
    Substring tests on the lowered text replace one alternation pattern.
    """
    words = query_words(query)
    scored = [w for w in words if len(w) >= MIN_SCORED_LENGTH]
    out = None
    for place, (name, table) in enumerate(tables.items()):
        score = _keyword_score(table.text_column, words, scored)
        # rows without a match have no score and sort last: they are dropped after the limit, so
        # that matching and scoring share one pass over the text
        part = _best(_hits(name, place, table, score), per_collection).where("score IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return _best(out, limit)


def _keyword_score(text_column: str, words: list[str], scored: list[str]) -> Column:
    """Share of the longer words that occur, NULL where no word does. A query without a word finds every text."""
    found = {w: f"contains(lower({text_column}), {literal(w)})" for w in words}
    if not words:
        return F.when(F.col(text_column).isNotNull(), 0.0)
    points = " + ".join(f"cast({found[w]} AS int)" for w in scored) or "0"
    share = stat_sql(f"cast({points} AS double) / {literal(float(max(len(scored), 1)))}", V.SCORE_PLACES)
    return F.expr(f"CASE WHEN {' OR '.join(found.values())} THEN {share} END")


_NUMBERS = [f"_{i}".encode() for i in range(-(-V.HASH_DIMENSIONS // V.HASH_BYTES))]


def _hash_bytes(text: str, dimensions: int) -> bytes:
    """The bytes of a text's hash embedding; the common prefix is digested only once."""
    copy, needed, digests = hashlib.sha256(text.lower().encode()).copy, -(-dimensions // V.HASH_BYTES), []
    for number in _NUMBERS[:needed] if needed <= len(_NUMBERS) else [f"_{i}".encode() for i in range(needed)]:
        digest = copy()
        digest.update(number)
        digests.append(digest.digest())
    return b"".join(digests)[:dimensions]


def _as_numbers(raw: bytes) -> np.ndarray:
    return (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128.0) / 128.0


def hash_vector(text: str, dimensions: int = V.HASH_DIMENSIONS) -> np.ndarray:
    """The hash embedding of one text."""
    return _as_numbers(_hash_bytes(text, dimensions))


def _as_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


def _hash_batch(texts: pa.Array) -> pa.Array:
    raw = b"".join([_hash_bytes(t or "", V.HASH_DIMENSIONS) for t in texts.to_pylist()])
    return _as_lists(_as_numbers(raw).reshape(-1, V.HASH_DIMENSIONS))


def embed(
    df: DataFrame,
    text_column: str,
    encoder: Callable[[], Callable[[Sequence[str]], np.ndarray]] | None = None,
    output: str = "embedding",
    tasks: int | None = None,
) -> DataFrame:
    """Encode the text of every row, batch by batch. The factory runs once per task, so a
    model is loaded where it is used. Default: the hash embedding.

    A column rather than a map over the rows: only the text travels to Python, and the
    column is pruned where nothing reads it. ``tasks`` deals the rows to so many tasks first, which pays where one task
    would read them all (a file of one row group) and the columns are few: moving a text costs less than encoding it.
    """
    if tasks:
        df = df.repartition(tasks)
    if encoder is None:
        encode = F.arrow_udf(_hash_batch, "array<double>")
    else:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = encoder()
            for texts in batches:
                yield pa.array([list(v) for v in model([t or "" for t in texts.to_pylist()])], pa.list_(pa.float64()))

        encode = F.arrow_udf(run, "array<double>")
    return df.withColumn(output, encode(text_column))


#: The 256 values of a byte as they are written, each with a comma, in words of four bytes.
_WRITTEN = np.frombuffer(b"".join(f",{i}".encode().ljust(4, b"\0") for i in range(256)), np.uint32)
_SIZES = np.array([len(f",{i}") for i in range(256)], np.uint8)
_TOLD = pa.struct([("dimensions", pa.int32()), ("fingerprint", pa.string())])


#: Rows whose components are written at a time.
_WRITTEN_ROWS = 64


def _digests(vectors: pa.Array) -> pa.Array:
    """Length of each vector, and MD5 of its components as 128ths from -128: whole numbers between commas, without null ones."""
    parts = (vectors.slice(start, _WRITTEN_ROWS) for start in range(0, len(vectors), _WRITTEN_ROWS))
    out = [hashlib.md5(text).hexdigest() for part in parts for text in _byte_texts(part) or map(_text_of, part)]
    return pa.StructArray.from_arrays([pc.list_value_length(vectors).cast(pa.int32()), pa.array(out, pa.string())], fields=list(_TOLD))


def _byte_texts(vectors: pa.Array) -> list[memoryview] | None:
    """The texts of vectors of one width whose components are all written as 0 to 255; else None."""
    lengths = pc.list_value_length(vectors)
    width = 0 if lengths.null_count else lengths[0].as_py()
    if not width or not pc.all(pc.equal(lengths, width)).as_py() or (values := vectors.flatten()).null_count:
        return None
    whole = np.trunc(values.to_numpy() * 128.0 + 128.0)
    if not (whole.min() >= 0 and whole.max() <= 255):
        return None
    told = whole.astype(np.uint8).reshape(-1, width)
    text = memoryview(_WRITTEN[told].tobytes().translate(None, b"\0"))
    ends = np.cumsum(_SIZES[told].sum(axis=1, dtype=np.int64)).tolist()
    return [text[first + 1 : end] for first, end in zip([0, *ends], ends)]  # without the first comma


def _text_of(vector: pa.Scalar) -> bytes:
    values = vector.values.drop_null().to_numpy() if vector.is_valid else np.empty(0)
    return ",".join(str(int(x)) for x in np.trunc(values * 128.0 + 128.0)).encode()


def fingerprint(vector_column: str) -> Column:
    """(dimensions, fingerprint): a vector as one comparable text, every byte value, digested. One function gives both, so
    that a vector which nothing else reads stays in the worker that makes it."""
    return F.arrow_udf(_digests, "struct<dimensions: int, fingerprint: string>")(vector_column)


def _cosine_to(query: np.ndarray):
    """Column function: cosine of a vector column with one query; NULL without a length."""
    length = float(np.sqrt((query * query).sum()))

    def run(column: pa.Array) -> pa.Array:
        scores = np.full(len(column), np.nan)
        docs, usable = matrix_of(column, len(query))
        with np.errstate(divide="ignore", invalid="ignore"):
            scores[usable] = (docs @ query) / (np.sqrt((docs * docs).sum(axis=1)) * length)
        return pa.array(scores, mask=~np.isfinite(scores))

    return F.arrow_udf(run, "double")


def vector_search(
    query_vector,
    tables: dict[str, Collection],
    k: int = VECTOR_LIMIT,
    vector_column: str = "embedding",
    where: Column | None = None,
) -> DataFrame:
    """Exact cosine top-k over every row that has a vector, optionally filtered first.

    There is no candidate cap: each task keeps its own best k, so only k rows per task travel. Rows are ranked by the
    full score; it is rounded to six places only where it is shown.
    """
    similarity = _cosine_to(np.asarray(query_vector, dtype=np.float64))
    out = None
    for place, (name, table) in enumerate(tables.items()):
        usable = table.df.where(where) if where is not None else table.df
        source = Collection(usable, table.id_column, table.text_column, table.merge_id, table.line)
        part = _hits(name, place, source, similarity(vector_column))
        out = part if out is None else out.unionByName(part)
    # rows without a score come last: dropping them after the limit keeps the scoring to one pass
    return _best(out, k).where("score IS NOT NULL")


def shown(hits: DataFrame, column: str = "score") -> DataFrame:
    """Hits with the score as it is reported, at six places."""
    return hits.withColumn(column, V.score(F.col(column)))


def index_score(similarity: Column) -> Column:
    """Score as a vector index reports it: cosine mapped to 0..1."""
    return (similarity + 1.0) / 2.0


def semantic_search(query: str, tables: dict[str, Collection], k: int = VECTOR_LIMIT) -> DataFrame:
    """Vector search with the hash embedding of the query text."""
    return vector_search(hash_vector(query), tables, k)


# --- many queries at once --------------------------------------------------------------------------
def vector_search_batch(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector_column: str = "embedding",
    block_bytes: int = blocks.BLOCK_BYTES,
) -> DataFrame:
    """Exact top-k documents for every query. Both sides are packed into blocks and stored, so each vector is made once.
    Vectors without a length, or of a width that the other side does not have, match nothing."""
    folder = scratch_path(docs.sparkSession, "blocks")
    asked = blocks.pack(queries, query_id, vector_column, f"{folder}/queries", block_bytes=block_bytes)
    stored = blocks.pack(docs, doc_id, vector_column, f"{folder}/docs", block_bytes=block_bytes)
    return shown(blocks.search(asked, stored, k, query_id, doc_id).hits)


# --- hybrid ------------------------------------------------------------------------------------------
def hybrid_search(query: str, tables: dict[str, Collection]) -> DataFrame:
    """Keyword results, then semantic ones whose id is not there yet, in one ranked list."""
    return union_hybrid_results(keyword_search(query, tables), semantic_search(query, tables))


def union_hybrid_results(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Merge by id. A row without a known id is keyed by its whole content, which includes
    the score, so it never merges with the other list."""
    parts = []
    for origin, part in (("keyword", keyword), ("semantic", semantic)):
        own = F.col("merge_key").startswith(F.concat("collection", F.lit("/")))
        key = F.when(own, F.concat(F.lit(f"{origin}:"), "merge_key")).otherwise(F.col("merge_key"))
        parts.append(_ordered(part, origin).withColumn("merge_key", key))
    merged = merge_first_wins(parts, F.col("merge_key"), ("_order", "priority", "hit_id"))
    return _numbered(merged)


def _ordered(hits: DataFrame, origin: str) -> DataFrame:
    return hits.withColumns({"origin": F.lit(origin), "_order": -F.col("score")})


def _numbered(hits: DataFrame) -> DataFrame:
    """Rank of each result and their number. Search results are few by construction (the
    limits above), so they are numbered in one small sort."""
    first = F.when(F.col("origin") == "keyword", 0).otherwise(1)
    fields = ("_first", "_order", "priority", "hit_id", "collection", "text", "line", "origin", "score")
    rows = hits.withColumn("_first", first).groupBy().agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    numbered = rows.select(F.size("rows").alias("total"), F.posexplode("rows").alias("position", "r"))
    return shown(
        numbered.select(
            (F.col("position") + 1).alias("rank"), "total", "r.collection", "r.hit_id", "r.origin", "r.score",
            "r.line", "r.text",
        )
    )


def search(query: str, tables: dict[str, Collection], search_type: str = "hybrid") -> DataFrame:
    """Ranked results of one of the three kinds of search. Only hybrid results are merged by id."""
    if search_type == "keyword":
        return _numbered(_ordered(keyword_search(query, tables), "keyword"))
    if search_type == "semantic":
        return _numbered(_ordered(semantic_search(query, tables), "semantic"))
    return hybrid_search(query, tables)


def answer(query: str, tables: dict[str, Collection], search_type: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """A question in words: route it by its domain, search, and sum the results up.

    Returns the first page of results and the one-row summary.
    """
    if not query:
        raise ValueError("No query provided")
    domain = intent_of(query)
    route = ROUTES.get(domain, DEFAULT_ROUTE)
    if missing := [name for name in route if name not in tables]:
        raise ValueError(f"questions about {domain or 'no domain'} search {', '.join(route)}; not given: {', '.join(missing)}")
    routed = {name: tables[name] for name in route}
    results = search(query, routed, search_type)
    return results_page(results), summarise(results, query, domain)


def results_page(hybrid: DataFrame, n: int = RESULT_LIMIT) -> DataFrame:
    return hybrid.where(F.col("rank") <= n)


# --- intent, route, summary ------------------------------------------------------------------------------
# Words that reveal a domain, a country, an attitude or a severity, and the
# collections searched for each domain.
DOMAIN_WORDS = (
    ("AIR", ("aircraft", "plane", "jet", "fighter", "bomber", "uav", "drone", "flying")),
    ("MARITIME", ("ship", "vessel", "naval", "carrier", "destroyer", "submarine", "fleet")),
    ("CYBER", ("cyber", "attack", "hacker", "apt", "intrusion", "malware", "threat actor")),
    ("INFRASTRUCTURE", ("base", "facility", "camp", "airfield", "station")),
    ("SIGINT", ("signal", "sigint", "radar", "emission", "intercept")),
)
COUNTRY_WORDS = (
    ("US", ("us", "american", "united states")),
    ("RU", ("russian", "russia")),
    ("CN", ("chinese", "china")),
    ("IR", ("iranian", "iran")),
)
ATTITUDE_WORDS = (("HOSTILE", ("hostile",)), ("FRIENDLY", ("friendly",)))
SEVERITY_WORDS = (("CRITICAL", ("critical",)), ("HIGH", ("high",)))
ROUTES = {
    "AIR": ("rag_aircraft", "kb_equipment"),
    "MARITIME": ("rag_naval", "kb_equipment"),
    "CYBER": ("rag_cyber_incidents", "kb_threat_actors"),
    "INFRASTRUCTURE": ("rag_facilities",),
    "SIGINT": ("rag_sigint",),
}
DEFAULT_ROUTE = ("rag_aircraft", "rag_naval", "rag_cyber_incidents", "kb_equipment", "kb_threat_actors")


def _first_group(text: Column, groups) -> Column:
    out = None
    for value, words in groups:
        cond = reduce(or_, [F.contains(text, F.lit(w)) for w in words])
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def extract_intent(query: Column) -> Column:
    """Domain of the first matching word group; the last matching country wins. Plain
    substring tests, as specified ("us" also matches inside longer words)."""
    text = F.lower(query)
    return F.struct(
        _first_group(text, DOMAIN_WORDS).alias("domain"),
        F.lit("search").alias("action"),
        F.struct(
            _first_group(text, reversed(COUNTRY_WORDS)).alias("country"),
            _first_group(text, ATTITUDE_WORDS).alias("iff_mode"),
            _first_group(text, SEVERITY_WORDS).alias("severity"),
        ).alias("filters"),
    )


def query_route(domain: Column) -> Column:
    """Collections searched for a domain."""
    out = None
    for value, names in ROUTES.items():
        route = F.array(*[F.lit(n) for n in names])
        out = F.when(domain == value, route) if out is None else out.when(domain == value, route)
    return out.otherwise(F.array(*[F.lit(n) for n in DEFAULT_ROUTE]))


def intent_of(query: str) -> str | None:
    """Domain of a single query text (driver-side twin of ``extract_intent``)."""
    lowered = query.lower()
    return next((d for d, words in DOMAIN_WORDS if any(w in lowered for w in words)), None)


def summarise(hybrid: DataFrame, query: str, domain: str | None) -> DataFrame:
    """One row: a heading, then the first results grouped by collection."""
    page = results_page(hybrid)
    title = F.initcap(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("collection", "rag_", ""), "kb_", ""), "_", " ")
    )
    groups = page.groupBy("collection").agg(
        F.min("rank").alias("first"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"),
    )
    body = F.concat(
        F.lit("**"), title, F.lit(":**\n"),
        F.concat_ws(
            "",
            F.transform(
                F.slice("lines", 1, SUMMARY_PER_COLLECTION),
                lambda r: F.concat(F.lit("• "), F.coalesce(r["line"], F.lit("")), F.lit("\n")),
            ),
        ),
        F.lit("\n"),
    )
    folded = groups.select("first", "total", body.alias("body")).groupBy().agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("first", "body"))).alias("parts")
    )
    found = F.concat(
        F.lit(f"**{domain} Intelligence Summary**\n_Query: {query}_\n_Found "), F.col("total").cast("string"),
        F.lit(" relevant items_\n\n"), F.concat_ws("", "parts.body"),
    )
    nothing = F.lit(
        f"No results found for your query: '{query}'. Try asking about aircraft, naval vessels, "
        "cyber threats, or facilities."
    )
    return folded.select(
        F.coalesce("total", F.lit(0)).alias("result_count"),
        F.when(F.col("total") > 0, found).otherwise(nothing).alias("response"),
    )


def log_queries(queries: DataFrame, search_type: str, now_ms: Column | int) -> DataFrame:
    """Rows for the query log."""
    intent = extract_intent(F.col("query"))
    return queries.select(
        "query", intent.alias("intent"), F.lit(search_type).alias("search_type"), "result_count",
        (F.lit(now_ms) if isinstance(now_ms, int) else now_ms).alias("timestamp"),
    )


def recent_queries(logged: DataFrame, now_ms: int, hours: int = 24) -> DataFrame:
    """How many questions were logged in the last hours, and how many of them found nothing."""
    recent = logged.where(F.col("timestamp") >= now_ms - hours * 3_600_000)
    return recent.agg(F.count("*").alias("recent_queries"), F.count_if(F.col("result_count") == 0).alias("without_results"))
