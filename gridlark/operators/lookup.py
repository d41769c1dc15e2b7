"""The one join shape of the rules: many facts against a table with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, table: DataFrame, fact_key: Column, table_key: str, how: str = "left") -> DataFrame:
    """Join facts with a table that has one row per key and may itself be an aggregate.

    The key is joined together with its hash. The hash adds nothing to the condition,
    but it keeps the planner from reusing the aggregate's own partitioning: both sides
    then pass through an exchange made for this join, which is what AQE needs to split a
    hot key's partition, or to switch to a broadcast once the table's size is known.
    No hint is given: neither side has a size that is known beforehand.
    """
    left = facts.withColumns({"_key": fact_key, "_hash": F.xxhash64(fact_key)})
    right = table.withColumnsRenamed({table_key: "_key"}).withColumn("_hash", F.xxhash64("_key"))
    return left.join(right, ["_key", "_hash"], how).drop("_hash")
