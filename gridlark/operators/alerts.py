"""Breakout filters and rule-driven alerts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.conditions import is_in, ladder, literal, steps_sql
from gridlark.functions.text import template, template_sql
from gridlark.plans.profiles import ALERTS, BREAKOUTS, AlertRule

ALERT_COLUMNS = (
    "alert_id", "alert_type", "severity", "alert_message", "entity_id", "grid_square", "lat", "lon", "timestamp",
)

# Columns a message needs but no stream has.
MESSAGE_INPUTS = {"flight_level": lambda: F.col("altitude_ft") / 100.0}


def breakout(enriched: DataFrame, name: str) -> DataFrame:
    """Rows of an enriched stream that belong to a named breakout."""
    return enriched.where(BREAKOUTS[name][1])


def _severity(rule: AlertRule) -> str:
    return rule.severity_column or steps_sql(rule.tiers, literal(rule.otherwise))


def _with_inputs(df: DataFrame, rules: Iterable[AlertRule]) -> DataFrame:
    needed = {n: make() for n, make in MESSAGE_INPUTS.items() if any("{" + n in r.message for r in rules)}
    return df.withColumns(needed) if needed else df


def alert(df: DataFrame, rule: AlertRule) -> DataFrame:
    """One alert stream with the columns of its rule."""
    kept = [F.col(c).alias(rule.renames.get(c, c)) for c in rule.keep]
    severity = [] if "severity" in rule.keep else [F.expr(_severity(rule)).alias("severity")]
    return _with_inputs(df, [rule]).where(rule.when).select(
        *kept,
        F.lit(rule.alert_type).alias("alert_type"),
        *severity,
        template(rule.message).alias("alert_message"),
        "timestamp",
    )


def alert_for(df: DataFrame, profile: str, name: str) -> DataFrame:
    return alert(df, ALERTS[profile][name])


def _common_row(rule: AlertRule) -> str:
    """The rule's alert as a struct in the common schema, NULL where it does not fire."""
    fields = {
        "alert_id": template_sql(rule.prefix + "{" + rule.entity + "}" + ("-{timestamp}" if rule.id_has_time else "")),
        "alert_type": literal(rule.alert_type),
        "severity": _severity(rule),
        "alert_message": template_sql(rule.message),
        "entity_id": rule.entity,
        "grid_square": rule.grid,
        "lat": rule.lat,
        "lon": rule.lon,
        "timestamp": "timestamp",
    }
    row = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return f"CASE WHEN {rule.when} THEN named_struct({row}) END"


def alerts_one_pass(df: DataFrame, rules: Iterable[AlertRule], keep: tuple[str, ...] = ()) -> DataFrame:
    """Every alert that any of the rules raises, from a single scan of ``df``; ``keep``
    names input columns to carry along (event time, in a stream).

    A UNION ALL of one filter per rule would read and enrich the input once per rule.
    The rows of rules that did not fire are dropped after the explode rather than with a
    higher-order filter on the array: explode and filter stay inside generated code.
    """
    rules = list(rules)
    rows = F.expr("array(" + ", ".join(_common_row(r) for r in rules) + ")")
    exploded = _with_inputs(df, rules).select(F.explode(rows).alias("a"), *keep)
    return exploded.where("a IS NOT NULL").select("a.*", *keep)


def alerts_by_union(df: DataFrame, rules: Iterable[AlertRule]) -> DataFrame:
    """Same rows, one branch per rule; kept to check the single pass against."""
    out = None
    for rule in rules:
        branch = _with_inputs(df, [rule]).where(rule.when).select(
            F.expr(_common_row(rule)).alias("a")
        ).select("a.*")
        out = branch if out is None else out.unionByName(branch)
    return out


def part_by_alert_id(alerts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Re-key by alert id. Only useful in front of a sink that needs the partitioning."""
    return alerts.repartition(partitions, "alert_id") if partitions else alerts.repartition("alert_id")


# Flags whose vessels are always of the highest interest.
CRITICAL_FLAGS = ("IR", "KP")


def vessels_of_interest(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", ladder([(is_in("flag_country", *CRITICAL_FLAGS), "CRITICAL")], "HIGH"))
