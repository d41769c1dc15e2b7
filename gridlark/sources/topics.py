"""Schema-declared JSON topics: Kafka, or JSON / Parquet files that stand for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gridlark.sources.schemas import KEYS, TOPICS, stream_schema

CORRUPT = "_corrupt_record"


def read_messages(
    spark: SparkSession,
    servers: str,
    topics: list[str],
    streaming: bool = True,
    starting: str = "earliest",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Raw Kafka messages of one or several topics. Needs the Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting)
        .options(**(options or {}))
        .load()
        .select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            "topic",
            "partition",
            "offset",
        )
    )


def read_feed(spark: SparkSession, path: str, schema: StructType, streaming: bool = False) -> DataFrame:
    """A directory of JSON records, read with a declared schema (never inferred)."""
    return (spark.readStream if streaming else spark.read).schema(schema).json(path)


def feed_topic_parts(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Path segments of a slash-separated feed topic."""
    parts = F.split(F.col(topic), "/")
    return df.withColumns(
        {"feed": parts[0], "feed_kind": F.try_element_at(parts, F.lit(2)), "feed_key": F.try_element_at(parts, F.lit(3))}
    )


def parse_messages(
    df: DataFrame,
    schema: StructType,
    key_column: str | None = None,
    value: str = "value",
    key: str = "key",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """JSON value -> declared columns. The message key, when named, replaces the JSON
    field of the same name: joins and LIKE filters work on the key."""
    out = df.withColumn("_v", F.from_json(F.col(value), schema))
    columns: list[Column] = []
    for field in schema.fields:
        source = F.col(key).cast("string") if field.name == key_column else F.col(f"_v.{field.name}")
        columns.append(source.alias(field.name))
    return out.select(*columns, *keep)


def read_topic(
    spark: SparkSession,
    stream: str,
    servers: str,
    profile: str = "current",
    streaming: bool = True,
    starting: str = "earliest",
) -> DataFrame:
    """One raw stream straight from its topic; ``seq`` orders records of a key."""
    messages = read_messages(spark, servers, [TOPICS[stream]], streaming, starting)
    parsed = parse_messages(messages, stream_schema(stream, profile), KEYS[stream], keep=("offset",))
    return parsed.withColumnRenamed("offset", "seq")


def quarantine(
    df: DataFrame, schema: StructType, value: str = "value", keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Split into well-formed rows and rejected texts; a bad record never fails the job."""
    permissive = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = df.withColumn(
        "_v",
        F.from_json(F.col(value), permissive, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}),
    )
    broken = F.col(value).isNull() | F.col("_v").isNull() | F.col(f"_v.{CORRUPT}").isNotNull()
    good = parsed.where(~broken).select(*[F.col(f"_v.{f.name}") for f in schema.fields], *keep)
    bad = parsed.where(broken).select(F.col(value).alias("rejected"), *keep)
    return good, bad


def route(messages: DataFrame, streams: list[str], profile: str = "current") -> dict[str, DataFrame]:
    """One DataFrame per stream from messages of several topics."""
    return {
        stream: parse_messages(
            messages.where(F.col("topic") == TOPICS[stream]), stream_schema(stream, profile), keep=_kept(messages)
        )
        for stream in streams
    }


def _kept(messages: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in ("seq",) if c in messages.columns)


def as_messages(df: DataFrame, key: str, topic: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as (key, value, topic) messages, the inverse of parsing."""
    body = [c for c in df.columns if c not in keep]
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*body)).alias("value"),
        F.lit(topic).alias("topic"),
        *keep,
    )


def mixed_fields(messages: DataFrame, fields: dict[str, dict[str, tuple[str, str]]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns from messages of several topics, of which every value is parsed once.

    ``fields`` names, for each output column and stream, the JSON field and its type. The value becomes a variant, from
    which each topic's own fields are taken; messages of other topics, and values that are no JSON, are left out.
    """
    streams = sorted({stream for by_stream in fields.values() for stream in by_stream})
    parsed = messages.where(F.col("topic").isin([TOPICS[s] for s in streams])).withColumn("_v", F.try_parse_json("value"))
    parsed = parsed.where("_v IS NOT NULL")

    def of_topic(values: dict[str, Column]) -> Column:
        out = None
        for stream, value in values.items():
            own = F.col("topic") == TOPICS[stream]
            out = F.when(own, value) if out is None else out.when(own, value)
        return out

    columns = [
        of_topic({s: F.try_variant_get("_v", f"$.{name}", kind) for s, (name, kind) in by_stream.items()}).alias(column)
        for column, by_stream in fields.items()
    ]
    return parsed.select(of_topic({s: F.lit(s) for s in streams}).alias("stream"), *columns, *keep)


def from_offsets(messages: DataFrame, committed: DataFrame, reset: str = "latest") -> DataFrame:
    """The messages that a consumer gets: those after its committed offset in each partition of a topic. Where it has
    committed none, ``earliest`` gives it all that is stored and ``latest`` nothing but what comes later."""
    if reset not in ("earliest", "latest"):
        raise ValueError(f"no offset reset named {reset}")
    place = committed.groupBy("topic", "partition").agg(F.max("offset").alias("_committed"))
    known = messages.join(place, ["topic", "partition"], "left")
    fresh = F.col("offset") > F.col("_committed")
    return known.where(F.coalesce(fresh, F.lit(reset == "earliest"))).drop("_committed")
