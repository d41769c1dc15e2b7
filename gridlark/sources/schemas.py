"""Declared schemas of the event streams, written as Spark DDL."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Stream names, topics, key columns, column names and types.
TOPICS = {
    "gps": "ground-force-gps",
    "aircraft": "military-aircraft",
    "naval": "naval-vessels",
    "cyber": "cyber-threats",
    "sigint": "sigint-feeds",
    "satellite": "satellite-imagery-metadata",
    "jsir": "spectrum-interference",
    "embm": "embm-tracks",
    "alerts": "all-alerts",
}

KEYS = {
    "gps": "unit_id",
    "aircraft": "aircraft_id",
    "naval": "vessel_id",
    "cyber": "incident_id",
    "sigint": "intercept_id",
    "satellite": "image_id",
    "jsir": "incident_id",
    "embm": "track_id",
    "alerts": "alert_id",
}

DDL = {
    "gps": """
        unit_id string, unit_name string, unit_type string, timestamp bigint, lat double, lon double,
        heading_deg double, speed_kph double, altitude_m double, fuel_level_pct double,
        ammo_level_pct double, personnel_count int, equipment_status string, mission_status string,
        fuel_consumption_rate double, comms_status string""",
    "aircraft": """
        aircraft_id string, tail_number string, aircraft_type string, role string, country string,
        weapons string, timestamp bigint, lat double, lon double, altitude_ft double,
        heading_deg double, speed_kts double, status string, fuel_pct double, iff_mode string""",
    "naval": """
        vessel_id string, hull_number string, vessel_type string, vessel_class string,
        displacement_tons int, country string, weapons string, aircraft_capacity int,
        timestamp bigint, lat double, lon double, heading_deg double, speed_kts double,
        status string, iff_mode string""",
    "cyber": """
        incident_id string, timestamp bigint, threat_actor string, actor_country string,
        sophistication string, attack_type string, severity string, target_facility_id string,
        target_facility string, target_system string, target_type string, target_region string,
        target_lat double, target_lon double, source_ip string, mitre_attack string, status string""",
    "sigint": """
        intercept_id string, timestamp bigint, signal_type string, frequency_mhz double,
        bandwidth_khz double, modulation string, bearing_deg double, signal_strength_dbm double,
        lat double, lon double, confidence_pct double, emitter_classification string,
        threat_level string, emission_pattern string, collector_id string""",
    "satellite": """
        image_id string, source_id string, timestamp bigint, sensor_type string,
        resolution_m double, cloud_cover_pct double, quality_score double, center_lat double,
        center_lon double, classification string""",
    "jsir": """
        incident_id string, timestamp bigint, event_type string, workflow_stage string,
        jammer_id string, jammer_location string, jammer_country string, jammer_lat double,
        jammer_lon double, jammer_terrain string, jammer_system string, jammer_type string,
        jammer_power_kw double, jammer_frequency_band string, target_satellite string,
        target_orbit string, target_frequency_ghz double, tdoa_ms double, fdoa_hz double,
        cep_km double, ellipse_major_km double, ellipse_minor_km double,
        ellipse_orientation double, strike_coords_lat double, strike_coords_lon double,
        mission_impact string, affected_unit_count int, comms_degradation_pct double""",
    "embm": """
        track_id string, timestamp bigint, source_incident string, track_type string,
        track_category string, emitter_function string, lat double, lon double,
        position_accuracy_m double, terrain string, emitter_system string,
        emitter_country string, emitter_type string, estimated_power_kw double,
        spectral_signature string, threat_level string, confidence double, targetable boolean,
        target_coord_lat double, target_coord_lon double, nearby_assets string,
        display_icon string, display_color string, display_priority string""",
    "alerts": """
        alert_id string, alert_type string, severity string, alert_message string,
        entity_id string, grid_square string, lat double, lon double, timestamp bigint""",
}

# Columns that other profiles declare on top of (or instead of) the ones above.
EXTRA_DDL = {
    ("aircraft", "setup"): "altitude_m double, speed_kph double, threat_level string",
    ("cyber", "setup"): (
        "description string, target_country string, destination_ip string, protocol string, port int"
    ),
    ("sigint", "classic"): "elevation_deg double",
    ("satellite", "classic"): (
        "acquisition_time string, sun_elevation_deg double, off_nadir_angle_deg double, "
        "processing_status string"
    ),
    ("jsir", "clean"): (
        "target_sat_type string, target_freq_ghz double, interference_type string, "
        "noise_floor_increase_db double, geolocation_method string, tdoa_milliseconds double, "
        "fdoa_hertz double, uncertainty_ellipse_major_km double, uncertainty_ellipse_minor_km double, "
        "geolocation_confidence_pct double, mission_impact_severity string, "
        "jsir_ticket_status string, recommended_action string"
    ),
}


def stream_schema(stream: str, profile: str = "current") -> StructType:
    """Schema of a raw stream; unknown JSON fields are dropped, missing ones read as NULL."""
    ddl = DDL[stream]
    extra = EXTRA_DDL.get((stream, profile))
    return StructType.fromDDL(f"{ddl}, {extra}" if extra else ddl)


def stream_columns(stream: str) -> list[str]:
    return [part.split()[0] for part in DDL[stream].split(",")]
