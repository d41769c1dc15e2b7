"""The training-data pipeline: language, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import dart_minhash, decontaminate, language, packing, secrets
from gridlark.llm.support import table
from gridlark.llm.tokens import vocabulary_path
from gridlark.plans.session import prepare_vectors as prepare
from gridlark.plans.session import returning_memory, scratch_path


def _own(docs: DataFrame) -> str:
    """A prefix that no column of the documents has."""
    return "_".join([*docs.columns, ""])


@returning_memory
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without a letter or between two languages go."""
    own = _own(docs)
    prepare(spark)
    found = language.predict(docs, language.train(docs), prefix=own)
    clear = (F.col(f"{own}lang_pred") != language.UNDETERMINED) & ~F.col(f"{own}ambiguous")
    return found.where(clear).select(*docs.columns)


@returning_memory
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    prepare(spark)
    return dart_minhash.first_of_each(docs)


@returning_memory
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages, unchanged; the others go."""
    own = _own(docs)
    prepare(spark)
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), prefix=own)
    return found.where(~decontaminate.contaminated(F.col(f"{own}n_hit"), F.col(f"{own}n_words"))).select(*docs.columns)


@returning_memory
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text where it changed."""
    own = _own(docs)
    prepare(spark)
    found = secrets.scan(docs, vocabulary_path("byte_bpe_50k.tiktoken"), prefix=own, redacted=True)
    if "n_chars" in docs.columns:
        changed = F.size(f"{own}found") > 0
        found = found.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


@returning_memory
def pack_along_curve(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens. The workers live on, so they remember fewer words than packing alone may."""
    prepare(spark)
    pieces = packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), memory=250_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack_along_curve),
]

#: SQL cannot tell most stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from what the one before has written."""
    docs = table(prepare(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            folder = scratch_path(spark, f"stage-{number}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
