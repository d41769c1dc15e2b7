"""Tumbling-window aggregates. Metrics are data; each profile names the ones it reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.conditions import is_in
from gridlark.functions.numbers import stat_sql
from gridlark.plans.profiles import SEVERE_IMPACTS

# Window sizes in minutes.
GRID_MINUTES = 5
INTERFERENCE_MINUTES = 15
TARGET_MINUTES = 30


def with_event_time(df: DataFrame, col: str = "timestamp", delay: str | None = None) -> DataFrame:
    """Add ``ts`` from an epoch-millisecond column; ``delay`` sets a watermark."""
    out = df.withColumn("ts", F.timestamp_millis(F.col(col)))
    return out.withWatermark("ts", delay) if delay else out


def _window(minutes: int) -> Column:
    return F.window("ts", f"{minutes} minutes")


def flatten_window(df: DataFrame) -> DataFrame:
    """Replace the window struct by its bounds in epoch milliseconds."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.unix_millis("window.start").alias("window_start"),
        F.unix_millis("window.end").alias("window_end"),
        *rest,
    )


# --- metric vocabulary (SQL aggregates as text) ---------------------------------------------
ROWS = "count(1)"


def _avg(column: str, places: int = 1) -> str:
    return stat_sql(f"avg({column})", places)


def _low(column: str, places: int = 1) -> str:
    return stat_sql(f"min({column})", places)


def _high(column: str, places: int | None = None) -> str:
    return f"max({column})" if places is None else stat_sql(f"max({column})", places)


def _sum(column: str) -> str:
    return f"sum(cast({column} AS bigint))"


def _count_if(cond: str) -> str:
    return f"count_if({cond})"


def _distinct(column: str) -> str:
    return f"count(DISTINCT {column})"


def _flag(cond: str) -> str:
    return f"max(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def _latest(column: str) -> str:
    """Last non-NULL value by event time, arrival number breaking ties."""
    return f"max_by({column}, CASE WHEN {column} IS NOT NULL THEN struct(timestamp, seq) END)"


def _streamable(metric: str) -> str:
    """Streams cannot shuffle for a distinct count: they keep the set of values instead."""
    return re.sub(r"count\(DISTINCT (\w+)\)", r"cast(size(collect_set(\1)) AS bigint)", metric)


_EFFECT_READY = _count_if(is_in("combat_effectiveness", "COMBAT_READY"))
_ENGAGED = _count_if(is_in("mission_status", "ENGAGED"))

METRICS: dict[str, dict[str, str]] = {
    "grid_force": {
        "unit_count": ROWS,
        "avg_readiness": _avg("readiness_score"),
        "min_readiness": _low("readiness_score"),
        "combat_ready_count": _EFFECT_READY,
        "critical_count": _count_if(is_in("combat_effectiveness", "CRITICAL")),
        "engaged_count": _ENGAGED,
        "total_personnel": _sum("personnel_count"),
        "avg_fuel": _avg("fuel_level_pct"),
        "min_fuel": _low("fuel_level_pct"),
        "avg_ammo": _avg("ammo_level_pct"),
        "min_ammo": _low("ammo_level_pct"),
    },
    "grid_threat": {
        "intercept_count": ROWS,
        "unique_emitters": _distinct("emitter_classification"),
        "max_threat_score": _high("threat_score"),
        "avg_threat_score": _avg("threat_score"),
        "avg_signal_strength": _avg("signal_strength_dbm"),
        "critical_threats": _count_if(is_in("threat_level", "CRITICAL")),
        "high_threats": _count_if(is_in("threat_level", "HIGH")),
        "air_defense_count": _count_if("is_air_defense"),
    },
    "grid_isr": {
        "image_count": ROWS,
        "satellites_covering": _distinct("source_id"),
        "sensor_types": _distinct("sensor_type"),
        "avg_effectiveness": _avg("isr_effectiveness"),
        "best_effectiveness": _high("isr_effectiveness", 1),
        "avg_cloud_cover": _avg("cloud_cover_pct"),
        "avg_resolution": _avg("resolution_m", 2),
        "good_coverage_count": _count_if(is_in("coverage_quality", "GOOD")),
    },
    "force_composition": {
        "unit_count": ROWS,
        "avg_readiness": _avg("readiness_score"),
        "total_personnel": _sum("personnel_count"),
        "avg_fuel": _avg("fuel_level_pct"),
        "avg_ammo": _avg("ammo_level_pct"),
        "engaged_count": _ENGAGED,
        "combat_ready": _EFFECT_READY,
    },
    "hostile_aircraft": {
        "aircraft_count": ROWS,
        "aircraft_types": _distinct("aircraft_type"),
        "intercepting": _count_if(is_in("status", "INTERCEPT")),
        "on_strike": _count_if(is_in("status", "STRIKE")),
        "patrolling": _count_if(is_in("status", "PATROL")),
        "high_value_targets": _count_if(is_in("role", "STEALTH", "BOMBER", "STRATEGIC_BOMBER")),
        "avg_altitude_ft": _avg("altitude_ft", 0),
        "avg_speed_kts": _avg("speed_kts", 0),
    },
    "active_threats": {
        "threat_count": ROWS,
        "max_threat": _high("threat_score"),
        "primary_threat": _latest("emitter_classification"),
        "highest_threat_level": _latest("threat_level"),
    },
    "jammers_country": {
        "incident_count": ROWS,
        "unique_systems": _distinct("jammer_system"),
        "satellites_targeted": _distinct("target_satellite"),
        "total_affected_units": _sum("affected_unit_count"),
        "critical_incidents": _count_if(is_in("severity", "CRITICAL")),
        "avg_geolocation_accuracy": _avg("cep_km", 2),
    },
    "satcom_status": {
        "jamming_incidents": ROWS,
        "attacking_countries": _distinct("jammer_country"),
        "total_affected_units": _sum("affected_unit_count"),
        "avg_degradation": _avg("comms_degradation_pct"),
        "has_denial": _flag(is_in("mission_impact", "COMMS_DENIED")),
        "current_recommendation": _latest("recommended_response"),
    },
    "strike_targets": {
        "location": _latest("jammer_location"),
        "country": _latest("jammer_country"),
        "system": _latest("jammer_system"),
        "strike_lat": _latest("strike_coords_lat"),
        "strike_lon": _latest("strike_coords_lon"),
        "latest_cep_km": _latest("cep_km"),
        "viability": _latest("strike_viability"),
        "incident_count": ROWS,
        "caused_mission_impact": _flag(is_in("mission_impact", *SEVERE_IMPACTS)),
    },
}

# Metrics each profile reports, in its column order.
REPORTED: dict[tuple[str, str], tuple[str, ...]] = {
    ("grid_force", "classic"): (
        "unit_count", "avg_readiness", "min_readiness", "combat_ready_count", "critical_count",
        "engaged_count", "total_personnel", "avg_fuel", "avg_ammo",
    ),
    ("grid_force", "setup"): (
        "unit_count", "avg_readiness", "min_readiness", "avg_fuel", "min_fuel", "avg_ammo", "min_ammo",
        "combat_ready_count", "critical_count", "engaged_count", "total_personnel",
    ),
    ("grid_force", "deploy"): (
        "unit_count", "avg_readiness", "min_fuel", "min_ammo", "combat_ready_count", "engaged_count",
        "total_personnel",
    ),
    ("grid_threat", "classic"): (
        "intercept_count", "max_threat_score", "avg_signal_strength", "critical_threats", "high_threats",
        "air_defense_count",
    ),
    ("grid_threat", "setup"): (
        "intercept_count", "unique_emitters", "max_threat_score", "avg_threat_score", "avg_signal_strength",
        "critical_threats", "high_threats", "air_defense_count",
    ),
    ("grid_threat", "deploy"): (
        "intercept_count", "max_threat_score", "critical_threats", "air_defense_count",
    ),
    ("grid_isr", "classic"): (
        "image_count", "satellites_covering", "sensor_types", "avg_effectiveness", "best_effectiveness",
        "avg_cloud_cover", "avg_resolution", "good_coverage_count",
    ),
    ("grid_isr", "setup"): (
        "image_count", "satellites_covering", "sensor_types", "avg_effectiveness", "best_effectiveness",
        "avg_cloud_cover", "good_coverage_count",
    ),
    ("grid_isr", "deploy"): ("image_count", "satellites_covering", "avg_effectiveness"),
    ("force_composition", "classic"): tuple(METRICS["force_composition"]),
    ("force_composition", "setup"): tuple(METRICS["force_composition"]),
    ("force_composition", "deploy"): ("unit_count", "avg_readiness", "total_personnel", "avg_fuel"),
    ("active_threats", "classic"): ("threat_count", "max_threat", "primary_threat"),
    ("active_threats", "setup"): tuple(METRICS["active_threats"]),
    ("active_threats", "deploy"): ("threat_count", "max_threat", "primary_threat"),
}


def windowed(df: DataFrame, name: str, key: str, minutes: int, profile: str | None = None) -> DataFrame:
    """Aggregate per tumbling window and key; the window stays a struct so that several
    results can be joined on (window, key) without another exchange."""
    metrics = METRICS[name]
    chosen = REPORTED.get((name, profile), tuple(metrics))
    prepared = {m: _streamable(metrics[m]) if df.isStreaming else metrics[m] for m in chosen}
    return df.groupBy(_window(minutes), key).agg(*[F.expr(sql).alias(m) for m, sql in prepared.items()])


# --- distinct counts of streams, in two steps -------------------------------------------------------------
_NESTED = r"(?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*"
_CALL = re.compile(rf"\b(count_if|count|avg|min|max|sum)\((DISTINCT )?({_NESTED})\)")


def _split(metric: str, name: str) -> tuple[dict[str, str], str]:
    """A metric as parts that are kept for each value, and how the parts of all values merge. The counted value itself
    is the key of the parts, so how many there are is how many rows."""
    parts: dict[str, str] = {}

    def merged(call: re.Match) -> str:
        function, distinct, inner = call.groups()
        place = f"{name}_{len(parts)}"
        if distinct:
            return f"count({inner})"
        if function == "avg":
            parts[place] = f"sum(cast({inner} AS decimal(28,10)))"
            parts[f"{place}_n"] = f"count({inner})"
            return f"cast(sum({place}) AS double) / sum({place}_n)"
        parts[place] = call.group(0)
        return f"{function if function in ('min', 'max') else 'sum'}({place})"

    return parts, _CALL.sub(merged, metric)


def _chosen(name: str, profile: str | None) -> dict[str, str]:
    return {m: METRICS[name][m] for m in REPORTED.get((name, profile), tuple(METRICS[name]))}


def _counted(name: str, profile: str | None) -> str:
    values = {v for sql in _chosen(name, profile).values() for v in re.findall(r"count\(DISTINCT (\w+)\)", sql)}
    if len(values) != 1:
        raise ValueError(f"{name} counts {len(values)} columns' values; parts are kept for those of one")
    return values.pop()


def windowed_parts(df: DataFrame, name: str, key: str, minutes: int, profile: str | None = None) -> DataFrame:
    """First step of a windowed aggregate with a distinct count: one row of fixed size for each (window, key, value). As a
    stream's state it is spread over the tasks by the value too, and no set of values is ever held."""
    parts = {p: sql for m, metric in _chosen(name, profile).items() for p, sql in _split(metric, m)[0].items()}
    return df.groupBy(_window(minutes), key, _counted(name, profile)).agg(*[F.expr(sql).alias(p) for p, sql in parts.items()])


def merged_parts(parts: DataFrame, name: str, key: str, profile: str | None = None) -> DataFrame:
    """Second step: the parts of all values of a window and key, flattened bounds and all."""
    merged = {m: _split(sql, m)[1] for m, sql in _chosen(name, profile).items()}
    return parts.groupBy("window_start", "window_end", key).agg(*[F.expr(sql).alias(m) for m, sql in merged.items()])


def grid_force(enriched: DataFrame, profile: str = "classic") -> DataFrame:
    return windowed(enriched, "grid_force", "grid_square", GRID_MINUTES, profile)


def grid_threat(enriched: DataFrame, profile: str = "classic") -> DataFrame:
    return windowed(enriched, "grid_threat", "grid_square", GRID_MINUTES, profile)


def grid_isr(enriched: DataFrame, profile: str = "classic") -> DataFrame:
    return windowed(enriched, "grid_isr", "grid_square", GRID_MINUTES, profile)


def force_composition(enriched: DataFrame, profile: str = "classic") -> DataFrame:
    return windowed(enriched, "force_composition", "unit_type", GRID_MINUTES, profile)


def hostile_aircraft(enriched: DataFrame) -> DataFrame:
    """Aircraft per country. The name is historical: no hostile filter is applied."""
    return windowed(enriched, "hostile_aircraft", "country", GRID_MINUTES)


def active_threats(enriched: DataFrame, profile: str = "classic") -> DataFrame:
    strong = enriched.where(
        F.col("threat_level").isin("CRITICAL", "HIGH") & (F.col("signal_strength_dbm") > -70)
    )
    return windowed(strong, "active_threats", "grid_square", GRID_MINUTES, profile)


def jammers_by_country(enriched: DataFrame) -> DataFrame:
    return windowed(enriched, "jammers_country", "jammer_country", INTERFERENCE_MINUTES)


def satcom_status(enriched: DataFrame) -> DataFrame:
    return windowed(enriched, "satcom_status", "target_satellite", INTERFERENCE_MINUTES)


def strike_targets(enriched: DataFrame) -> DataFrame:
    located = enriched.where(F.col("cep_km") <= 5.0)
    return windowed(located, "strike_targets", "jammer_id", TARGET_MINUTES).withColumnRenamed(
        "latest_cep_km", "cep_km"
    )
