"""Rounding and safe arithmetic shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stat_sql(expr: str, places: int) -> str:
    """Round an aggregate so that the answer does not depend on summation order.

    A double average differs in its last bits with the order in which partitions
    are merged. Ten places are enough to keep such noise out of the one rounding that counts.
    """
    return f"cast(round(cast({expr} AS decimal(28,10)), {places}) AS double)"


def round_stat(col: Column, places: int) -> Column:
    return F.round(col.cast("decimal(28,10)"), places).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))
