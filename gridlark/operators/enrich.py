"""Per-row enrichment. One function per stream; the profile picks the formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.conditions import contains_any, is_in, ladder, limits, lookup, starts_with_any
from gridlark.functions.geo import grid_square
from gridlark.functions.numbers import ratio
from gridlark.functions.text import template
from gridlark.plans import profiles as P
from gridlark.sources.schemas import stream_columns

CARRIED = ("seq", "ts")


def _project(df: DataFrame, columns: list[str], computed: dict[str, Column]) -> DataFrame:
    """Declared columns, then the computed ones, then arrival number and event time if present."""
    carried = [c for c in CARRIED if c in df.columns]
    return df.select(*columns, *[col.alias(name) for name, col in computed.items()], *carried)


def _columns(stream: str, drop=(), add=()) -> list[str]:
    return [c for c in stream_columns(stream) if c not in drop] + list(add)


def _grid(profile: str, lat: str = "lat", lon: str = "lon") -> Column:
    return grid_square(lat, lon, P.GRID_SCHEME[profile])


# --- ground units --------------------------------------------------------------------
def readiness_score(profile: str) -> Column:
    rule = P.READINESS[profile]
    total = F.col("fuel_level_pct") * rule.fuel + F.col("ammo_level_pct") * rule.ammo
    if rule.equipment:
        total = total + lookup("equipment_status", P.EQUIPMENT_SCORES, P.EQUIPMENT_FLOOR) * rule.equipment
    if rule.comms:
        total = total + lookup("comms_status", P.COMMS_SCORES, P.COMMS_FLOOR) * rule.comms
    if rule.bonus:
        full, rest = rule.bonus
        total = total + lookup("equipment_status", {"FULLY_OPERATIONAL": full}, rest)
    if rule.constant:
        total = total + rule.constant
    return total if rule.places is None else F.round(total, rule.places)


def endurance_hours(profile: str) -> tuple[str, Column]:
    kind = P.ENDURANCE[profile]
    level, rate = F.col("fuel_level_pct"), F.col("fuel_consumption_rate")
    # the WHEN already excludes zero; try_divide keeps the branch safe if it is hoisted
    if kind == "level":
        hours = F.try_divide(level, rate)
    else:
        hours = F.round(F.try_divide(level / 100.0 * P.TANK_UNITS, rate), 1)
    return P.ENDURANCE_COLUMN[kind], F.when(rate > 0, hours).otherwise(P.ENDURANCE_UNKNOWN)


def enrich_gps(df: DataFrame, profile: str = "current") -> DataFrame:
    drop = {
        "setup": ("altitude_m",),
        "deploy": ("altitude_m",),
        "clean": ("altitude_m", "fuel_consumption_rate"),
    }.get(profile, ())
    computed = {"grid_square": _grid(profile)}
    if profile in P.ENDURANCE:
        name, hours = endurance_hours(profile)
        computed[name] = hours
    computed["readiness_score"] = readiness_score(profile)
    computed["combat_effectiveness"] = ladder(*P.EFFECTIVENESS[profile])
    return _project(df, _columns("gps", drop), computed)


# --- aircraft ------------------------------------------------------------------------
def enrich_aircraft(df: DataFrame, profile: str = "current") -> DataFrame:
    if profile == "current":
        computed = {
            "grid_square": _grid(profile),
            "threat_classification": lookup("iff_mode", P.IFF_CLASSES, P.IFF_CLASS_DEFAULT),
        }
        return _project(df, _columns("aircraft"), computed)
    computed = {"computed_threat": ladder(*P.ROLE_THREAT[profile])}
    if profile == "clean":
        return _project(df, _columns("aircraft", ("weapons",)), computed)
    computed = {
        "track_id": template("{country}-{aircraft_type}-{tail_number}"),
        **computed,
        "posture": ladder(*P.FLIGHT_POSTURE),
    }
    return _project(
        df, _columns("aircraft", ("weapons",), ("altitude_m", "speed_kph", "threat_level")), computed
    )


# --- signals -------------------------------------------------------------------------
def enrich_sigint(df: DataFrame, profile: str = "current") -> DataFrame:
    brief = ("bandwidth_khz", "modulation", "bearing_deg")
    columns = {
        "current": _columns("sigint"),
        "classic": _columns("sigint", add=("elevation_deg",)),
    }.get(profile, _columns("sigint", brief))
    computed = {
        "grid_square": _grid(profile),
        "is_air_defense": ladder(
            [(contains_any("emitter_classification", *P.AIR_DEFENSE_MARKS[profile]), True)], False
        ),
        "threat_score": lookup("threat_level", P.SIGNAL_LEVEL_SCORES[profile], P.LOWEST_SCORE),
    }
    if profile == "current":
        computed["signal_quality"] = F.col("signal_strength_dbm") * F.col("confidence_pct") / 100.0
    elif profile != "clean":
        computed["signal_quality"] = ladder(*P.SIGNAL_STRENGTH_LABELS)
    return _project(df, columns, computed)


def enrich_sigint_context(enriched: DataFrame) -> DataFrame:
    """Emitter country and posture on top of the enriched signals."""
    country = ladder(
        [(starts_with_any("emitter_classification", prefix), name) for prefix, name in P.EMITTER_COUNTRIES],
        P.EMITTER_COUNTRY_UNKNOWN,
    )
    posture = lookup("emission_pattern", P.EMISSION_POSTURES, P.EMISSION_POSTURE_DEFAULT)
    return enriched.select(
        "intercept_id",
        "timestamp",
        "signal_type",
        "frequency_mhz",
        "signal_strength_dbm",
        F.col("lat").alias("signal_lat"),
        F.col("lon").alias("signal_lon"),
        "emitter_classification",
        "threat_level",
        "emission_pattern",
        "collector_id",
        "grid_square",
        "threat_score",
        "signal_quality",
        "is_air_defense",
        country.alias("emitter_country"),
        posture.alias("threat_posture"),
    )


# --- imagery -------------------------------------------------------------------------
def enrich_satellite(df: DataFrame, profile: str = "current") -> DataFrame:
    clear = F.lit(1.0) - F.col("cloud_cover_pct") / 100.0
    seen = F.col("quality_score") * 100.0 * clear
    computed = {"grid_square": _grid(profile, "center_lat", "center_lon")}
    if profile == "current":
        # a resolution of zero has no finite score: NULL instead of a failed job
        computed["isr_effectiveness"] = seen * (ratio(F.lit(1.0), F.col("resolution_m")) * 10.0)
        return _project(df, _columns("satellite"), computed)
    computed["isr_effectiveness"] = F.round(seen * F.expr(limits("resolution_m", P.RESOLUTION_FACTORS)), 1)
    computed["coverage_quality"] = ladder(*P.COVERAGE_LABELS[profile])
    extra = (
        ("acquisition_time", "sun_elevation_deg", "off_nadir_angle_deg", "processing_status")
        if profile == "classic"
        else ()
    )
    return _project(df, _columns("satellite", add=extra), computed)


def enrich_satellite_pass(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("collection_quality", ladder(*P.PASS_QUALITY))


# --- interference, vessels, cyber, emitter tracks --------------------------------------
def enrich_jsir(df: DataFrame) -> DataFrame:
    computed = {
        "jammer_grid": grid_square("jammer_lat", "jammer_lon", "degree"),
        "severity": ladder(*P.IMPACT_SEVERITY),
        "strike_viability": F.expr(limits("cep_km", P.ACCURACY_LABELS)),
        "recommended_response": ladder(*P.RESPONSE_LABELS),
    }
    return _project(df, _columns("jsir"), computed)


def enrich_naval(df: DataFrame, profile: str = "current") -> DataFrame:
    computed = {
        "grid_square": _grid(profile),
        "threat_classification": lookup("iff_mode", P.IFF_CLASSES, P.IFF_CLASS_DEFAULT),
        "vessel_category": ladder([(is_in("vessel_type", *P.CAPITAL_SHIPS), "CAPITAL")], "SUPPORT"),
    }
    return _project(df, _columns("naval", ("displacement_tons", "aircraft_capacity")), computed)


def enrich_cyber(df: DataFrame, profile: str = "current") -> DataFrame:
    computed = {
        "grid_square": _grid(profile, "target_lat", "target_lon"),
        "threat_score": lookup("severity", P.LEVEL_SCORES, P.LOWEST_SCORE),
        "actor_category": ladder([(is_in("sophistication", *P.STATE_ACTORS), "STATE_SPONSORED")], "NON_STATE"),
    }
    return _project(df, _columns("cyber"), computed)


def enrich_embm(df: DataFrame, profile: str = "current") -> DataFrame:
    computed = {
        "grid_square": _grid(profile),
        "threat_score": lookup("threat_level", P.LEVEL_SCORES, P.LOWEST_SCORE),
    }
    return _project(df, _columns("embm"), computed)
