"""Quotation linking: which message a quote comes from, and conversations in reply order without the quotes.

Lines that begin with `>` are quotes, one level for each mark. A passage is a run of lines of one level without a blank
line in it. Quoted passages are joined by the hash of their normalised text to what other messages of the conversation
wrote themselves (a passage, a line, or a whole message); the earliest earlier one is the original. A message answers the
latest message that it quotes at the first level, or else the one before it.

Everything is DataFrame expressions. Conversations are never gathered: places and predecessors come from blocks of turns,
so a conversation that holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation that are ordered in one window; windows over whole conversations see a row for each block.
BLOCK_TURNS = 1024
_MARKS = r"^[ \t]*(>[ \t]*)+"


def normalised(text: Column) -> Column:
    """Lower case, white space as single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")))


def _hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def _lines(text: Column) -> Column:
    """Of each line: its quote level, the line without marks, and whether anything is left."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, _MARKS, ""), r"[ \t\r]+$", "")
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(parts, lambda x: F.struct(_level(x).alias("level"), bare(x).alias("text"), (F.trim(bare(x)) != "").alias("full")))


def _starts() -> Column:
    """Numbers of the lines that begin a passage."""

    def begins(i: Column) -> Column:
        line, before = F.element_at("lines", i), F.element_at("lines", F.greatest(i - 1, F.lit(1)))
        return line["full"] & ((i == 1) | ~before["full"] | (before["level"] != line["level"]))

    return F.filter(F.sequence(F.lit(1), F.size("lines")), begins)


def _passages() -> Column:
    """(level, text) of each passage, from ``lines`` and ``starts``."""

    def passage(j: Column) -> Column:
        first = F.element_at("starts", j)
        after = F.when(j < F.size("starts"), F.element_at("starts", F.least(j + 1, F.size("starts")))).otherwise(F.size("lines") + 1)
        own = F.filter(F.slice("lines", first, after - first), lambda x: x["full"])
        return F.struct(F.element_at("lines", first)["level"].alias("level"), F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"))

    return F.when(F.size("starts") > 0, F.transform(F.sequence(F.lit(1), F.size("starts")), passage)).otherwise(
        F.array().cast("array<struct<level:int,text:string>>")
    )


def messages(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct messages (conv_id, turn, role, text) with passages and body; repeated rows are one message."""
    rows = df.select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    rows = rows.withColumn("message", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256)).dropDuplicates(["message"])
    rows = rows.withColumn("lines", _lines(F.col("text"))).withColumn("starts", _starts()).withColumn("passages", _passages())
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["text"])
    body = F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\A\s+|\s+\z", ""), r"\n{3,}", "\n\n")
    return rows.withColumn("body", body).drop("starts")


def _originals(rows: DataFrame) -> DataFrame:
    """(conv_id, hash, original_turn): the earliest message that wrote this itself, as a passage, a line or a whole."""
    unquoted = F.filter("passages", lambda p: p["level"] == 0)
    lines = F.transform(F.filter("lines", lambda x: (x["level"] == 0) & x["full"]), lambda x: x["text"])
    whole = F.array(F.array_join(F.transform(unquoted, lambda p: p["text"]), " "))
    keys = F.array_distinct(F.transform(F.concat(F.transform(unquoted, lambda p: p["text"]), lines, whole), _hash))
    keys = F.array_remove(keys, F.sha2(F.lit(""), 256))
    written = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(keys).alias("hash"))
    return written.groupBy("conv_id", "hash").agg(F.min("turn").alias("original_turn"))


def links(rows: DataFrame) -> DataFrame:
    """(message, conv_id, turn, passage, level, hash, original_turn) of every quoted passage; null if nothing matches."""
    quoted = rows.select("message", "conv_id", "turn", F.posexplode("passages").alias("passage", "p")).where("p.level > 0")
    quoted = quoted.select("message", "conv_id", "turn", "passage", F.col("p.level").alias("level"), _hash(F.col("p.text")).alias("hash"))
    found = quoted.join(_originals(rows), ["conv_id", "hash"], "left")
    return found.withColumn("original_turn", F.when(F.col("original_turn") < F.col("turn"), F.col("original_turn")))


def places(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, position, previous_turn) of every distinct turn: 1, 2, .. in the conversation's order."""
    turns = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn").distinct()
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    turns = turns.withColumn("n", F.row_number().over(inside)).withColumn("near", F.lag("turn").over(inside))
    blocks = turns.groupBy("conv_id", "block").agg(F.count("*").alias("size"), F.max("turn").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"), F.max("last").over(before).alias("far"))
    joined = turns.join(blocks, ["conv_id", "block"])
    return joined.select("conv_id", "turn", (F.col("n") + F.col("earlier")).alias("position"), F.coalesce("near", "far").alias("previous_turn"))


def conversations(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every distinct message once: conv_id, turn, role, position, parent_turn, linked, n_quotes, n_linked, max_level, body.

    ``position`` orders a conversation so that answers follow what they answer; messages of one turn share it. ``body``
    is the text without quotes. Messages without a conversation or a turn have neither position nor parent. Null text
    counts as empty.
    """
    rows = messages(df, conversation, turn, role, text)
    found = links(rows).groupBy("message").agg(
        F.count("*").alias("n_quotes"),
        F.count("original_turn").alias("n_linked"),
        F.max("level").alias("max_level"),
        F.max(F.when(F.col("level") == 1, F.col("original_turn"))).alias("quoted_turn"),
    )
    out = rows.drop("lines", "passages", "text").join(found, "message", "left").join(places(rows), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.col("position").cast("long").alias("position"),
        F.coalesce("quoted_turn", "previous_turn").alias("parent_turn"),
        F.col("quoted_turn").isNotNull().alias("linked"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"),
        "body",
    )


#: The same for tables of plain text, in DuckDB: conv_id, turn, ... and the body's checksum.
SQL = r"""
WITH message AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS message FROM message),
raw AS (
  SELECT message, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
  FROM numbered),
line AS (
  SELECT message, conv_id, turn, i,
    length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+', 0), '[^>]', '', 'g')) AS level,
    regexp_replace(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), '[ \t\r]+$', '') AS body
  FROM raw),
marked AS (
  SELECT *, trim(body) <> '' AS is_full,
    lag(level) OVER w AS level_before, coalesce(lag(trim(body) <> '') OVER w, false) AS full_before
  FROM line WINDOW w AS (PARTITION BY message ORDER BY i)),
run AS (
  SELECT *, sum(CASE WHEN is_full AND (NOT full_before OR level_before <> level) THEN 1 ELSE 0 END)
    OVER (PARTITION BY message ORDER BY i) AS passage
  FROM marked),
passage AS (
  SELECT message, conv_id, turn, passage, any_value(level) AS level, string_agg(body, ' ' ORDER BY i) AS body
  FROM run WHERE is_full GROUP BY message, conv_id, turn, passage),
own AS (
  SELECT conv_id, turn, body FROM passage WHERE level = 0
  UNION ALL SELECT conv_id, turn, body FROM run WHERE level = 0 AND is_full
  UNION ALL SELECT conv_id, turn, string_agg(body, ' ' ORDER BY passage) FROM passage WHERE level = 0
    GROUP BY message, conv_id, turn),
original AS (
  SELECT conv_id, sha256(lower(trim(regexp_replace(body, '[ \t\r\f\x0B]+', ' ', 'g')))) AS hash, min(turn) AS first
  FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
linked AS (
  SELECT p.message, p.level, CASE WHEN o.first < p.turn THEN o.first END AS first
  FROM passage p LEFT JOIN original o ON o.conv_id = p.conv_id
    AND o.hash = sha256(lower(trim(regexp_replace(p.body, '[ \t\r\f\x0B]+', ' ', 'g'))))
  WHERE p.level > 0),
found AS (
  SELECT message, count(*) AS n_quotes, count(first) AS n_linked, max(level) AS max_level,
    max(CASE WHEN level = 1 THEN first END) AS quoted_turn
  FROM linked GROUP BY message),
turns AS (SELECT DISTINCT conv_id, turn FROM message WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
place AS (
  SELECT conv_id, turn, row_number() OVER w AS position, lag(turn) OVER w AS previous_turn
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
written AS (
  SELECT message, string_agg(body, chr(10) ORDER BY i) AS body FROM line WHERE level = 0 GROUP BY message)
SELECT m.conv_id, m.turn, m.role, p.position, coalesce(f.quoted_turn, p.previous_turn) AS parent_turn,
  f.quoted_turn IS NOT NULL AS linked, coalesce(f.n_quotes, 0) AS n_quotes, coalesce(f.n_linked, 0) AS n_linked,
  coalesce(f.max_level, 0)::BIGINT AS max_level,
  sha256(regexp_replace(regexp_replace(coalesce(w.body, ''), '\A\s+|\s+\z', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS body_sha256
FROM numbered m LEFT JOIN found f USING (message) LEFT JOIN written w USING (message)
LEFT JOIN place p ON p.conv_id = m.conv_id AND p.turn = m.turn
"""
