"""Small condition vocabulary in which the rule tables are written.

Every helper returns a SQL expression as text. Rule tables stay plain module data, and a
whole rule reaches Spark as one expression instead of one call per operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Cond = str


def literal(value) -> str:
    """A Python value as a SQL literal; every float is a DOUBLE."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _compare(limits: dict[str, float], op: str, glue: str) -> Cond:
    return "(" + f" {glue} ".join(f"{c} {op} {literal(float(v))}" for c, v in limits.items()) + ")"


def any_below(**limits: float) -> Cond:
    return _compare(limits, "<", "OR")


def all_at_least(**limits: float) -> Cond:
    return _compare(limits, ">=", "AND")


def any_above(**limits: float) -> Cond:
    return _compare(limits, ">", "OR")


def at_most(**limits: float) -> Cond:
    return _compare(limits, "<=", "AND")


def is_in(column: str, *values: str) -> Cond:
    return f"({column} IN ({', '.join(literal(v) for v in values)}))"


def is_true(column: str) -> Cond:
    return f"({column})"


def contains_any(column: str, *pieces: str) -> Cond:
    """Case-sensitive substring test."""
    return "(" + " OR ".join(f"contains({column}, {literal(p)})" for p in pieces) + ")"


def starts_with_any(column: str, *prefixes: str) -> Cond:
    return "(" + " OR ".join(f"startswith({column}, {literal(p)})" for p in prefixes) + ")"


def both(*conds: Cond) -> Cond:
    return "(" + " AND ".join(conds) + ")"


def either(*conds: Cond) -> Cond:
    return "(" + " OR ".join(conds) + ")"


def steps_sql(steps: Sequence[tuple[Cond, object]], default: str) -> str:
    """First matching step wins; the default is SQL text."""
    arms = " ".join(f"WHEN {cond} THEN {literal(value)}" for cond, value in steps)
    return f"CASE {arms} ELSE {default} END" if steps else default


def ladder(steps: Sequence[tuple[Cond, object]], default) -> Column:
    """First matching step wins, else the default."""
    return F.expr(steps_sql(steps, literal(default)))


def lookup(column: str, table: dict[str, object], default) -> Column:
    """Value for a category; unknown and NULL categories get the default."""
    return ladder([(is_in(column, key), value) for key, value in table.items()], default)


def limits(column: str, steps: Sequence[tuple[float | None, object]], op: str = "<=") -> str:
    """Label of the first limit that holds; the last step, without a limit, is the rest."""
    *bounded, (_, rest) = steps
    return steps_sql([(f"{column} {op} {literal(float(edge))}", value) for edge, value in bounded], literal(rest))
