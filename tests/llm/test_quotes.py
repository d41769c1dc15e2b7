"""Quotation linking against its SQL statement, on the supplied table and on threads full of quotes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gridlark.llm import queries as Q
from gridlark.llm import quotes
from llm.conftest import DATA

ROWS = "conv_id long, turn long, role string, text string"


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    result = con.execute(quotes.SQL)
    names = [d[0] for d in result.description]
    return sorted(repr(sorted(zip(names, r))) for r in result.fetchall())


def by_spark(df):
    df = df.withColumn("body_sha256", F.sha2("body", 256)).drop("body")
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def thread(seed):
    """Messages that quote earlier ones, wrapped, nested, in part or with words that nobody wrote."""
    rng, said, rows = random.Random(seed), [], []
    for turn in range(14):
        text = []
        for _ in range(rng.randrange(3)):
            if said:
                level = rng.choice([1, 1, 2, 3])
                mark = rng.choice([">" * level + " ", "> " * level, " >" * level])
                text += [mark + line for line in rng.choice(said).upper().split("\n")] + rng.choice([[""], []])
        own = [" ".join(rng.choice(["one", "two", "Éa", "ö  k"]) + str(rng.randrange(60)) for _ in range(4)) for _ in range(rng.randrange(1, 4))]
        said += [own[0], "\n".join(own), "nobody wrote this"]
        rows.append((seed % 3, turn * 700, rng.choice(["user", "assistant"]), "\n".join(text + own + rng.choice([[], ["", "bye"]]))))
    return rows


AWKWARD = [
    (None, 1, "user", "no conversation"), (7, None, "user", "no turn"), (7, 1, None, None), (7, 2, "user", ""),
    (7, 3, "user", " \n\n > \n"), (7, 4, "user", "same"), (7, 4, "user", "same"), (7, 4, "assistant", "other"),
    (7, 5, "user", "> same\r\n> OTHER\nyes"), (7, 6, "user", ">> same\n>yes\n"), (7, 7, "user", "x " * 20000 + "\n>same"),
    (7, 9, "user", "> same\n\n\n\n> other"), (None, None, None, None),
]


@pytest.mark.parametrize("rows", [[r for s in range(9) for r in thread(s)], AWKWARD, []], ids=["threads", "awkward", "empty"])
def test_as_in_sql(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("message", F.lit("clash")).withColumn("hash", F.lit(1))
    got = by_spark(quotes.conversations(df))
    assert got == by_sql(rows)


def test_links_and_bodies(spark):
    rows = [(1, 0, "a", "Hello there\nfriend"), (1, 1, "b", "Unrelated"), (1, 2, "c", "> hello  THERE\n> friend\nHi!"), (1, 3, "d", ">> hello there friend\n> Hi!\nBye")]
    got = {r["turn"]: r for r in quotes.conversations(spark.createDataFrame(rows, ROWS)).collect()}
    assert [got[t]["parent_turn"] for t in range(4)] == [None, 0, 0, 2]
    assert [got[t]["n_linked"] for t in range(4)] == [0, 0, 1, 2] and got[3]["max_level"] == 2
    assert [got[t]["body"] for t in (2, 3)] == ["Hi!", "Bye"] and [got[t]["position"] for t in range(4)] == [1, 2, 3, 4]


def test_query(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = Q.QUERIES["op4_quotation_links"](spark, DATA)
    assert sorted(repr(sorted(r.asDict().items())) for r in got.collect()) == by_sql([tuple(r) for r in df.collect()])


def test_no_python_on_the_executors(spark):
    plan = Q.QUERIES["op4_quotation_links"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
