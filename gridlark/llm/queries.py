"""The queries over the operators of this package, each over its whole table, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import (
    bwt_dedup, dac, dart_minhash, decontaminate, hard_negatives, html_text, katz, language, multi_index, packing, quotes, secrets,
    turn_repair,
)
from gridlark.llm.support import table
from gridlark.llm.tokens import vocabulary_path
from gridlark.plans.session import prepare, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op2_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows that are not held out."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces of sequences of 2,048 tokens, along a Hilbert curve."""
    packed = packing.pack(table(prepare(spark), sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in reply order: what it answers, its quotes, and the checksum of what it says itself."""
    linked = quotes.conversations(table(prepare(spark), sf_dir, "conversations"))
    return linked.withColumn("body_sha256", F.sha2("body", 256)).drop("body")


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-off bigram scores of every document, learned from rows that are not held out."""
    return katz.score(table(prepare(spark), sf_dir, "documents"))


def op5_trigram_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a model that looks back two words, and backs off word by word."""
    return katz.score(table(prepare(spark), sf_dir, "documents"), order=3)


def op6_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: by pattern, and by few characters per token."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, vocabulary_path("byte_bpe_50k.tiktoken"))
    base = secrets.listing(F.col("found"), secrets.KINDS[:3])
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(base, 256).alias("base_sha256"),
        secrets.listing(F.col("found")).alias("spans"),
    )


def op7_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written in directly addressable codes and read back."""
    folder = scratch_path(prepare(spark), "dac")
    dac.write(table(spark, sf_dir, "documents"), folder, vocabulary_path("word_bpe_49k.json"))
    return dac.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return dart_minhash.classes(table(prepare(spark), sf_dir, "documents"))


def op9_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that an earlier one has."""
    cleaned = bwt_dedup.clean(table(prepare(spark), sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return multi_index.search(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired at the least cost."""
    return turn_repair.check(table(prepare(spark), sf_dir, "conversations"))


def op12_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op13_vertical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has a wrong label."""
    vectors = table(prepare(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


_FUNCTIONS = (
    op1_suffix_automaton, op2_output_codes, op3_curve_packing, op4_quotation_links, op5_katz_backoff, op5_trigram_katz_backoff,
    op6_token_efficiency, op7_addressable_codes, op8_dart_minhash, op9_merged_transforms, op10_multi_index, op11_hirschberg_repair,
    op12_tree_scoring, op13_vertical_scan,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _FUNCTIONS}
ORACLE: dict[str, str] = {"op4_quotation_links": quotes.SQL}
