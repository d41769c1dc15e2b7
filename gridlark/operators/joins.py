"""Joins with latest state and with windowed aggregates; unified tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.conditions import ladder
from gridlark.functions.geo import feet_to_metres, grid_square, knots_to_kph
from gridlark.functions.text import join_text
from gridlark.operators.lookup import lookup_join
from gridlark.operators.windows import GRID_MINUTES
from gridlark.plans.profiles import CYBER_STATUS

AIR_PREFIX, SHIP_PREFIX, FACILITY_PREFIX = "AC-", "SHIP-", "FAC-"


def _gps_side(latest: DataFrame, columns: dict[str, str]) -> DataFrame:
    return latest.select("unit_id", *[F.col(c).alias(a) for c, a in columns.items()])


def _prefixed(latest: DataFrame, prefix: str) -> DataFrame:
    """Only the entities of one kind: the filter reaches the scan below the aggregate."""
    return latest.where(F.col("unit_id").startswith(prefix))


def _source(verified: Column, fallback: str) -> Column:
    return F.when(verified.isNotNull(), "GPS_VERIFIED").otherwise(fallback)


def aircraft_with_gps(aircraft: DataFrame, latest: DataFrame, profile: str = "setup") -> DataFrame:
    """Aircraft with the position their own transponder last reported."""
    key = F.concat(F.lit(AIR_PREFIX), "aircraft_id")
    base = [
        "aircraft_id", "tail_number", "aircraft_type", "role", "country", "timestamp",
        F.col("lat").alias("aircraft_lat"), F.col("lon").alias("aircraft_lon"),
        "altitude_ft", "heading_deg", "speed_kts", "status", "fuel_pct", "iff_mode",
    ]
    final = [
        F.coalesce("gps_lat", "lat").alias("final_lat"),
        F.coalesce("gps_lon", "lon").alias("final_lon"),
    ]
    if profile == "clean":
        gps = _gps_side(latest.withColumn("gps_unit_id", F.col("unit_id")), {
            "gps_unit_id": "gps_unit_id", "lat": "gps_lat", "lon": "gps_lon", "mission_status": "gps_status"})
        out = lookup_join(aircraft, _prefixed(gps, AIR_PREFIX), key, "unit_id")
        return out.select(*base, "gps_unit_id", "gps_lat", "gps_lon", "gps_status", *final)
    gps = _gps_side(latest, {
        "lat": "gps_lat", "lon": "gps_lon", "altitude_m": "gps_altitude_m", "heading_deg": "gps_heading",
        "speed_kph": "gps_speed_kph", "fuel_level_pct": "gps_fuel_pct",
        "mission_status": "gps_mission_status", "last_update": "gps_last_update"})
    out = lookup_join(aircraft, _prefixed(gps, AIR_PREFIX), key, "unit_id")
    return out.select(
        *base, F.col("_key").alias("gps_key"), "gps_lat", "gps_lon", "gps_altitude_m", "gps_heading",
        "gps_speed_kph", "gps_fuel_pct", "gps_mission_status", "gps_last_update", *final,
        _source(F.col("gps_lat"), "RADAR_ONLY").alias("position_source"),
    )


def naval_with_gps(naval: DataFrame, latest: DataFrame, profile: str = "setup") -> DataFrame:
    key = F.concat(F.lit(SHIP_PREFIX), "hull_number")
    moving = [
        "timestamp", F.col("lat").alias("vessel_lat"), F.col("lon").alias("vessel_lon"),
        "heading_deg", "speed_kts", "status", "iff_mode",
    ]
    final = [
        F.coalesce("gps_lat", "lat").alias("final_lat"),
        F.coalesce("gps_lon", "lon").alias("final_lon"),
    ]
    if profile == "clean":
        gps = _gps_side(latest.withColumn("gps_unit_id", F.col("unit_id")), {
            "gps_unit_id": "gps_unit_id", "lat": "gps_lat", "lon": "gps_lon", "mission_status": "gps_status"})
        out = lookup_join(naval, _prefixed(gps, SHIP_PREFIX), key, "unit_id")
        return out.select(
            "vessel_id", "hull_number", "vessel_type", "vessel_class", "country", *moving,
            "gps_unit_id", "gps_lat", "gps_lon", "gps_status", *final,
        )
    gps = _gps_side(latest, {
        "lat": "gps_lat", "lon": "gps_lon", "heading_deg": "gps_heading", "speed_kph": "gps_speed_kph",
        "mission_status": "gps_mission_status", "last_update": "gps_last_update"})
    out = lookup_join(naval, _prefixed(gps, SHIP_PREFIX), key, "unit_id")
    return out.select(
        "vessel_id", "hull_number", "vessel_type", "vessel_class", "displacement_tons", "country", "weapons",
        "aircraft_capacity", *moving, F.col("_key").alias("gps_key"), "gps_lat", "gps_lon", "gps_heading",
        "gps_speed_kph", "gps_mission_status", "gps_last_update", *final,
        _source(F.col("gps_lat"), "AIS_ONLY").alias("position_source"),
    )


def cyber_with_gps(cyber: DataFrame, latest: DataFrame, profile: str = "setup") -> DataFrame:
    final = [
        F.coalesce("facility_gps_lat", "target_lat").alias("final_lat"),
        F.coalesce("facility_gps_lon", "target_lon").alias("final_lon"),
    ]
    key = F.col("target_facility_id")
    if profile == "clean":
        gps = _gps_side(latest.withColumn("gps_unit_id", F.col("unit_id")), {
            "gps_unit_id": "gps_unit_id", "lat": "facility_gps_lat", "lon": "facility_gps_lon"})
        return lookup_join(cyber, gps, key, "unit_id").select(
            "incident_id", "timestamp", "threat_actor", "actor_country", "attack_type", "severity",
            "target_facility_id", "target_facility", "target_system", "target_region", "target_lat",
            "target_lon", "mitre_attack", "status", "gps_unit_id", "facility_gps_lat", "facility_gps_lon",
            *final,
        )
    gps = _gps_side(latest, {
        "lat": "facility_gps_lat", "lon": "facility_gps_lon", "unit_name": "facility_name_from_gps",
        "comms_status": "facility_comms_status", "last_update": "facility_last_update"})
    return lookup_join(cyber, gps, key, "unit_id").select(
        "incident_id", "timestamp", "threat_actor", "actor_country", "sophistication", "attack_type",
        "severity", "description", "target_facility_id", "target_facility", "target_system", "target_type",
        "target_region", "target_lat", "target_lon", "source_ip", "mitre_attack", "status",
        "facility_gps_lat", "facility_gps_lon", "facility_name_from_gps", "facility_comms_status",
        "facility_last_update", *final,
        _source(F.col("facility_gps_lat"), "STATIC_COORDS").alias("position_source"),
        ladder(*CYBER_STATUS).alias("threat_status"),
    )


# --- unified tracks ------------------------------------------------------------------------
TRACK_COLUMNS = (
    "track_id", "track_name", "track_type", "domain", "country", "iff_status", "lat", "lon", "heading_deg",
    "speed_kph", "altitude_m", "status", "timestamp", "grid_square",
)


def ground_tracks(gps: DataFrame) -> DataFrame:
    unit = F.col("unit_id")
    ours = ~(unit.startswith(AIR_PREFIX) | unit.startswith(SHIP_PREFIX) | unit.startswith(FACILITY_PREFIX))
    return gps.where(ours).select(
        unit.alias("track_id"),
        F.col("unit_name").alias("track_name"),
        F.col("unit_type").alias("track_type"),
        F.lit("GROUND").alias("domain"),
        F.lit("US").alias("country"),
        F.lit("FRIENDLY").alias("iff_status"),
        "lat", "lon", "heading_deg", "speed_kph", "altitude_m",
        F.col("mission_status").alias("status"),
        "timestamp",
        grid_square("lat", "lon", "band").alias("grid_square"),
    )


def _moving_tracks(joined, track_id, kind, number, track_type, domain, altitude, keep=()):
    return joined.select(
        *keep,
        F.col(track_id).alias("track_id"),
        join_text(F.col(kind), F.lit(" ("), F.col(number), F.lit(")")).alias("track_name"),
        F.col(track_type).alias("track_type"),
        F.lit(domain).alias("domain"),
        "country",
        F.col("iff_mode").alias("iff_status"),
        F.col("final_lat").alias("lat"),
        F.col("final_lon").alias("lon"),
        "heading_deg",
        knots_to_kph(F.col("speed_kts")).alias("speed_kph"),
        altitude.alias("altitude_m"),
        "status",
        "timestamp",
        grid_square("final_lat", "final_lon", "band").alias("grid_square"),
    )


def air_tracks(joined: DataFrame, keep=()) -> DataFrame:
    return _moving_tracks(
        joined, "aircraft_id", "aircraft_type", "tail_number", "role", "AIR",
        feet_to_metres(F.col("altitude_ft")), keep,
    )


def naval_tracks(joined: DataFrame, keep=()) -> DataFrame:
    return _moving_tracks(
        joined, "vessel_id", "vessel_type", "hull_number", "vessel_class", "NAVAL", F.lit(0.0), keep
    )


def unified_tracks(gps: DataFrame, aircraft: DataFrame, naval: DataFrame) -> DataFrame:
    """Ground, air and naval tracks in one schema."""
    return ground_tracks(gps).unionByName(air_tracks(aircraft)).unionByName(naval_tracks(naval))


# --- windowed correlation --------------------------------------------------------------------
ZONE_COLUMNS = (
    "unit_id", "unit_name", "unit_type", "grid_square", "lat", "lon", "mission_status", "readiness_score",
    "combat_effectiveness", "threat_count", "max_threat", "primary_threat", "timestamp",
)


#: Parts that a cell's units are dealt to in a stream; a cell's threats are repeated for each.
ZONE_SALTS = 8


def salted(units: DataFrame, threats: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: a unit has one, by its id and arrival, a cell's threats (one row a window) have all."""
    left = units.withColumn("salt", F.pmod(F.xxhash64("unit_id", "seq"), F.lit(salts)).cast("int"))
    return left, threats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def units_in_threat(units: DataFrame, threats: DataFrame, salts: int = ZONE_SALTS) -> DataFrame:
    """Unit reports in a grid cell that has active threats in the same window.

    Batch: joined on the window start and the cell, so AQE may split a hot cell.
    Streaming: joined on the window itself, which carries the watermark. Nothing can split a cell's state later, so its
    units are dealt to ``salts`` parts and its threats repeated for each: that many tasks share a hot cell.
    """
    if units.isStreaming:
        windowed = units.withColumn("window", F.window("ts", f"{GRID_MINUTES} minutes")).drop("ts")
        left, right = salted(windowed, threats, salts)
        return left.join(right, ["window", "grid_square", "salt"]).select("window", *ZONE_COLUMNS)
    size = GRID_MINUTES * 60_000
    start = F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(size))
    # projecting the start out of the struct makes it a new key: both sides are exchanged for the join
    right = threats.withColumn("window_start", F.unix_millis("window.start")).drop("window")
    left = units.withColumn("window_start", start)
    return left.join(right, ["window_start", "grid_square"]).select("window_start", *ZONE_COLUMNS)


def _filled(column: str, value=0) -> Column:
    return F.coalesce(F.col(column), F.lit(value))


def isr_gaps(force: DataFrame, isr: DataFrame) -> DataFrame:
    """Cells with units and how well imagery covers them in the same window."""
    images, effect = _filled("image_count"), _filled("avg_effectiveness", 0.0)
    status = (
        F.when(images == 0, "NO_COVERAGE")
        .when(effect < 30, "POOR_COVERAGE")
        .when(effect < 60, "LIMITED_COVERAGE")
        .otherwise("ADEQUATE_COVERAGE")
    )
    return force.join(isr, ["window", "grid_square"], "left").select(
        "window", "grid_square", "unit_count", "engaged_count", "avg_readiness",
        images.alias("recent_images"), effect.alias("isr_effectiveness"), status.alias("coverage_status"),
    )


# Weights of the grid risk score.
RISK_WEIGHTS = {"threat": 0.40, "readiness": 0.30, "coverage": 0.30}


def operational_picture(
    force: DataFrame, threat: DataFrame, isr: DataFrame, profile: str = "classic"
) -> DataFrame:
    """Force, threat and imagery per window and cell, with a status and a risk score.

    The three inputs are grouped by (window, cell); both left joins reuse that
    partitioning, so the plan has one exchange per input and none for the joins.
    """
    keys = ["window", "grid_square"]
    joined = force.join(threat, keys, "left").join(isr, keys, "left")
    critical, effect = _filled("critical_threats"), _filled("avg_effectiveness", 0.0)
    worst = _filled("max_threat_score")
    status = (
        F.when((critical > 0) & (F.col("engaged_count") > 0), "ACTIVE_COMBAT")
        .when(critical > 0, "HIGH_THREAT")
        .when(F.col("critical_count") > 0, "FORCE_CRITICAL")
        .when(F.col("avg_readiness") < 50, "DEGRADED")
        .otherwise("STABLE")
    )
    classic = profile == "classic"
    risk = (
        worst * RISK_WEIGHTS["threat"]
        + (F.lit(100.0) - F.col("avg_readiness")) * RISK_WEIGHTS["readiness"]
        + (F.lit(100.0) - effect) * RISK_WEIGHTS["coverage"]
    )
    return joined.select(
        *keys, "unit_count", "avg_readiness", "combat_ready_count", "critical_count", "engaged_count",
        "total_personnel", "avg_fuel", "avg_ammo",
        _filled("intercept_count").alias("threat_intercepts"),
        critical.alias("critical_threats"),
        *([_filled("high_threats").alias("high_threats")] if classic else []),
        _filled("air_defense_count").alias("air_defense_threats"),
        worst.alias("max_threat_score"),
        _filled("image_count").alias("isr_images"),
        effect.alias("isr_effectiveness"),
        *([_filled("satellites_covering").alias("satellite_count")] if classic else []),
        *([risk.cast("int").alias("grid_risk_score")] if classic else []),
        status.alias("grid_status"),
    )
