"""Common table expressions over the driver's tables, named ``v_*``."""

from __future__ import annotations

import re


def pick(index: str, *values: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[({index}) + 1]"


def d(x) -> str:
    """A DOUBLE literal (a bare 0.3 would be DECIMAL)."""
    return f"CAST({x} AS DOUBLE)"


def rnd(expr: str, n: int) -> str:
    """Row-level ROUND: half up on the decimal text of the double."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,20)), {n}) AS DOUBLE)"


def stat(expr: str, n: int) -> str:
    """ROUND of an aggregate, immune to summation order."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def whole(expr: str) -> str:
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,20)), 0) AS BIGINT)"


MS = "(epoch_us(ts) // 1000)"
LAT = "(CAST(43.5 AS DOUBLE) + CAST(event_id % 160 AS DOUBLE) / CAST(100 AS DOUBLE))"
LON = "(CAST(35.25 AS DOUBLE) + CAST(event_id % 137 AS DOUBLE) / CAST(100 AS DOUBLE))"
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
IFF = ("HOSTILE", "UNKNOWN", "FRIENDLY")


def band(lat="lat", lon="lon") -> str:
    return (
        f"('33T' || CASE WHEN {lon} < {d(35.75)} THEN 'W' WHEN {lon} < {d(36.25)} THEN 'X' ELSE 'Y' END"
        f" || CASE WHEN {lat} < {d(44.25)} THEN 'M' ELSE 'N' END)"
    )


def degree(lat="lat", lon="lon") -> str:
    return f"(CAST(CAST(trunc({lat}) AS INT) AS VARCHAR) || CAST(CAST(trunc({lon}) AS INT) AS VARCHAR))"


def five(lat="lat", lon="lon") -> str:
    return (
        f"('GRID-' || CAST(CAST(trunc({lat} / {d(5)}) AS INT) AS VARCHAR) || '-' ||"
        f" CAST(CAST(trunc({lon} / {d(5)}) AS INT) AS VARCHAR))"
    )


def score(col: str, medium: bool = True) -> str:
    mid = f" WHEN {col} = 'MEDIUM' THEN 50" if medium else ""
    return f"CASE WHEN {col} = 'CRITICAL' THEN 100 WHEN {col} = 'HIGH' THEN 75{mid} ELSE 25 END"


VIEWS: dict[str, str] = {}

VIEWS["v_gps"] = f"""
SELECT {pick('user_id % 5', 'AC-', 'SHIP-', 'FAC-', 'US-', 'UK-')} || user_id AS unit_id,
  'Unit ' || user_id AS unit_name, {pick('user_id % 4', 'ARMOR', 'INFANTRY', 'AVIATION', 'MARINES')} AS unit_type,
  {MS} AS timestamp, {LAT} AS lat, {LON} AS lon, CAST(event_id % 360 AS DOUBLE) AS heading_deg,
  value AS speed_kph, CAST(event_id % 3000 AS DOUBLE) AS altitude_m,
  CAST((event_id * 37) % 1000 AS DOUBLE) / {d(10)} AS fuel_level_pct,
  CAST((event_id * 53) % 1000 AS DOUBLE) / {d(10)} AS ammo_level_pct,
  CAST(event_id % 500 AS INT) AS personnel_count,
  {pick('(event_id // 7) % 4', 'FULLY_OPERATIONAL', 'DEGRADED', 'MAINTENANCE_REQUIRED', 'NON_OPERATIONAL')} AS equipment_status,
  {pick('(event_id // 13) % 4', 'ENGAGED', 'DEFENSIVE', 'PATROL', 'STANDBY')} AS mission_status,
  CAST((event_id // 3) % 8 AS DOUBLE) * {d(10)} AS fuel_consumption_rate,
  {pick('(event_id // 11) % 4', 'NOMINAL', 'DEGRADED', 'OFFLINE', 'JAMMING_DETECTED')} AS comms_status,
  event_id AS seq
FROM events"""

VIEWS["v_aircraft"] = f"""
SELECT CAST(user_id AS VARCHAR) AS aircraft_id, CAST(user_id AS VARCHAR) AS tail_number,
  {pick('(event_id // 4) % 3', 'TYPE-A', 'TYPE-B', 'TYPE-C')} AS aircraft_type,
  {pick('(event_id // 3) % 9', 'STEALTH', 'AIR_SUPERIORITY', 'STRIKE', 'BOMBER', 'STRATEGIC_BOMBER', 'MULTIROLE', 'INTERCEPTOR', 'ATTACK_HELO', 'TRANSPORT')} AS role,
  {pick('event_id % 4', 'AA', 'BB', 'CC', 'DD')} AS country, {pick('event_id % 2', 'FIT-1', 'FIT-2')} AS weapons,
  {MS} AS timestamp, {LAT} AS lat, {LON} AS lon, CAST(100 * (event_id % 400) AS DOUBLE) AS altitude_ft,
  CAST(100 * (event_id % 400) AS DOUBLE) * {d(0.3048)} AS altitude_m,
  CAST(event_id % 360 AS DOUBLE) AS heading_deg, CAST(event_id % 600 AS DOUBLE) AS speed_kts,
  CAST(event_id % 600 AS DOUBLE) * {d(1.852)} AS speed_kph,
  {pick('(event_id // 5) % 7', 'INTERCEPT', 'STRIKE', 'PATROL', 'ATTACK', 'RECON', 'ESCORT', 'TRANSIT')} AS status,
  CAST((event_id * 37) % 1000 AS DOUBLE) / {d(10)} AS fuel_pct,
  {pick('(event_id // 3) % 4', *LEVELS)} AS threat_level, {pick('(event_id // 2) % 3', *IFF)} AS iff_mode,
  event_id AS seq
FROM events WHERE event_type = 'click'"""

VIEWS["v_naval"] = f"""
SELECT CAST(user_id AS VARCHAR) AS vessel_id, CAST(user_id AS VARCHAR) AS hull_number,
  {pick('(event_id // 3) % 5', 'SUBMARINE', 'DESTROYER', 'CRUISER', 'CARRIER', 'TANKER')} AS vessel_type,
  {pick('(event_id // 7) % 3', 'CLASS-1', 'CLASS-2', 'CLASS-3')} AS vessel_class,
  CAST(100 * (event_id % 1000) AS INT) AS displacement_tons,
  {pick('event_id % 5', 'US', 'RU', 'CN', 'IR', 'AA')} AS country, {pick('event_id % 2', 'FIT-1', 'FIT-2')} AS weapons,
  CAST(event_id % 40 AS INT) AS aircraft_capacity, {MS} AS timestamp, {LAT} AS lat, {LON} AS lon,
  CAST(event_id % 360 AS DOUBLE) AS heading_deg, CAST(event_id % 40 AS DOUBLE) AS speed_kts,
  {pick('(event_id // 5) % 4', 'UNDERWAY', 'ANCHORED', 'PATROL', 'MOORED')} AS status,
  {pick('(event_id // 2) % 3', *IFF)} AS iff_mode, event_id AS seq
FROM events WHERE event_type = 'view'"""

VIEWS["v_cyber"] = f"""
SELECT 'CYBER-' || event_id AS incident_id, {MS} AS timestamp, 'ACTOR-' || (event_id % 9) AS threat_actor,
  {pick('event_id % 5', 'RU', 'CN', 'IR', 'KP', 'AA')} AS actor_country,
  {pick('(event_id // 5) % 3', 'NATION_STATE', 'APT', 'OTHER')} AS sophistication,
  {pick('(event_id // 2) % 4', 'PHISHING', 'RANSOMWARE', 'DDOS', 'INTRUSION')} AS attack_type,
  {pick('(event_id // 3) % 4', *LEVELS)} AS severity, 'Report ' || event_id AS description,
  'FAC-' || user_id AS target_facility_id, 'Site ' || user_id AS target_facility,
  {pick('event_id % 3', 'MAIL', 'VPN', 'HISTORIAN')} AS target_system, {pick('event_id % 2', 'IT', 'OT')} AS target_type,
  {pick('event_id % 3', 'NORTH', 'SOUTH', 'EAST')} AS target_region, 'AA' AS target_country,
  {LAT} AS target_lat, {LON} AS target_lon,
  '10.' || ((event_id // 65536) % 256) || '.' || ((event_id // 256) % 256) || '.' || (event_id % 256) AS source_ip,
  '192.0.2.' || (event_id % 256) AS destination_ip, {pick('event_id % 2', 'TCP', 'UDP')} AS protocol,
  CAST(event_id % 1024 AS INT) AS port, 'T' || (1000 + event_id % 500) AS mitre_attack,
  {pick('(event_id // 7) % 3', 'INVESTIGATING', 'DETECTED', 'BLOCKED')} AS status, event_id AS seq
FROM events WHERE event_type = 'error'"""

VIEWS["v_sigint"] = f"""
SELECT 'SIG-' || event_id AS intercept_id, {MS} AS timestamp,
  {pick('event_id % 6', 'RADAR', 'VOICE', 'DATA', 'BURST', 'IFF', 'JAMMER')} AS signal_type,
  {d(100)} + CAST(event_id % 9000 AS DOUBLE) / {d(10)} AS frequency_mhz,
  CAST(event_id % 250 AS DOUBLE) / {d(10)} AS bandwidth_khz, {pick('event_id % 3', 'AM', 'FM', 'PSK')} AS modulation,
  CAST(event_id % 3600 AS DOUBLE) / {d(10)} AS bearing_deg, CAST(event_id % 61 - 90 AS DOUBLE) AS signal_strength_dbm,
  {LAT} AS lat, {LON} AS lon, CAST(event_id % 90 AS DOUBLE) AS elevation_deg,
  CAST(event_id % 30 + 70 AS DOUBLE) AS confidence_pct,
  {pick('(event_id // 5) % 7', 'RU-RADAR-SA-10', 'CN-S-400', 'IR-SAM', 'RU-JAMMER', 'US-IFF', 'CN-TRANSPONDER', 'KP-OTHER')} AS emitter_classification,
  {pick('(event_id // 3) % 4', *LEVELS)} AS threat_level,
  {pick('(event_id // 2) % 5', 'SEARCH', 'TRACK', 'ACQUISITION', 'FIRE_CONTROL', 'CONTINUOUS')} AS emission_pattern,
  'COL-' || (event_id % 11) AS collector_id, event_id AS seq
FROM events WHERE event_type = 'signup'"""

VIEWS["v_satellite"] = f"""
SELECT 'SAT-' || event_id AS image_id, 'SRC-' || (event_id % 4) AS source_id, {MS} AS timestamp,
  CAST({MS} AS VARCHAR) AS acquisition_time, {pick('(event_id // 3) % 4', 'EO', 'IR', 'SAR', 'MSI')} AS sensor_type,
  {d(0.5)} + CAST((event_id * 11) % 80 AS DOUBLE) / {d(10)} AS resolution_m,
  CAST(event_id % 101 AS DOUBLE) AS cloud_cover_pct, CAST(event_id % 90 AS DOUBLE) AS sun_elevation_deg,
  CAST(event_id % 45 AS DOUBLE) AS off_nadir_angle_deg, {LAT} AS center_lat, {LON} AS center_lon,
  {pick('event_id % 2', 'OPEN', 'RESTRICTED')} AS classification,
  CAST((event_id * 7) % 101 AS DOUBLE) / {d(100)} AS quality_score,
  {pick('event_id % 2', 'RAW', 'PROCESSED')} AS processing_status, event_id AS seq
FROM events WHERE event_type = 'purchase'"""

_JLAT = f"({d(-10)} + CAST(o_orderkey % 400 AS DOUBLE) / {d(10)})"
_JLON = f"({d(-20)} + CAST(o_orderkey % 900 AS DOUBLE) / {d(10)})"
_CEP = f"(CAST((o_orderkey * 13) % 80 AS DOUBLE) / {d(10)})"
VIEWS["v_jsir"] = f"""
SELECT 'JSIR-' || o_orderkey AS incident_id,
  epoch_us(o_orderdate) // 1000 + (o_orderkey % 86400) * 1000 AS timestamp,
  'SATCOM_INTERFERENCE' AS event_type,
  {pick('o_orderkey % 4', 'DETECTION', 'CHARACTERIZATION', 'GEOLOCATION', 'MITIGATION')} AS workflow_stage,
  'JAM-' || (o_custkey % 7) AS jammer_id, 'Site ' || (o_custkey % 7) AS jammer_location,
  {pick('(o_orderkey // 2) % 4', 'AA', 'BB', 'CC', 'DD')} AS jammer_country,
  {_JLAT} AS jammer_lat, {_JLON} AS jammer_lon, {pick('o_orderkey % 3', 'HILL', 'COAST', 'PLAIN')} AS jammer_terrain,
  'SYS-' || ((o_orderkey // 3) % 5) AS jammer_system, {pick('o_orderkey % 2', 'FIXED', 'MOBILE')} AS jammer_type,
  CAST(o_orderkey % 50 AS DOUBLE) / {d(2)} AS jammer_power_kw,
  {pick('o_orderkey % 3', 'X', 'KU', 'KA')} AS jammer_frequency_band,
  'SATCOM-' || ((o_orderkey // 5) % 6) AS target_satellite, {pick('o_orderkey % 3', 'GEO', 'MEO', 'LEO')} AS target_orbit,
  {d(7)} + CAST(o_orderkey % 40 AS DOUBLE) / {d(10)} AS target_frequency_ghz,
  CAST(o_orderkey % 5000 AS DOUBLE) / {d(1000)} AS tdoa_ms, {d(-50)} + CAST(o_orderkey % 1000 AS DOUBLE) / {d(10)} AS fdoa_hz,
  {_CEP} AS cep_km, {_CEP} * {d(2)} AS ellipse_major_km, {_CEP} * {d(0.5)} AS ellipse_minor_km,
  CAST(o_orderkey % 180 AS DOUBLE) AS ellipse_orientation, {_JLAT} AS strike_coords_lat, {_JLON} AS strike_coords_lon,
  {pick('o_orderkey % 6', 'COMMS_DENIED', 'MISSION_ABORT', 'DEGRADED_COMMS', 'REDUCED_BANDWIDTH', 'MINIMAL_IMPACT', 'OTHER')} AS mission_impact,
  CAST(o_orderkey % 9 AS INT) AS affected_unit_count, CAST((o_orderkey * 17) % 101 AS DOUBLE) AS comms_degradation_pct,
  {pick('(o_orderkey // 3) % 4', 'BROADBAND_NOISE', 'SWEPT_CW', 'PULSED', 'SPOT')} AS interference_type,
  {pick('(o_orderkey // 7) % 3', 'SWEPT', 'MULTI_TONE', 'BARRAGE')} AS spectral_signature,
  CAST((o_orderkey * 19) % 100 AS DOUBLE) AS geolocation_confidence_pct,
  {pick('(o_orderkey // 2) % 4', *LEVELS)} AS mission_impact_severity,
  {pick('o_orderkey % 3', 'FREQUENCY_HOP', 'BEAM_REALLOCATION', 'INCREASE_EIRP')} AS recommended_action,
  o_orderkey AS seq
FROM orders"""

VIEWS["v_embm_derived"] = f"""
SELECT 'EMBM-' || jammer_id || '-' || incident_id AS track_id, timestamp, incident_id AS source_incident,
  'HOSTILE_EMITTER' AS track_type, 'EW_JAMMER' AS track_category, 'SATCOM_JAMMER' AS emitter_function,
  jammer_lat AS lat, jammer_lon AS lon, cep_km * {d(1000)} AS position_accuracy_m, jammer_terrain AS terrain,
  jammer_system AS emitter_system, jammer_country AS emitter_country, jammer_type AS emitter_type,
  jammer_power_kw AS estimated_power_kw, spectral_signature, mission_impact_severity AS threat_level,
  geolocation_confidence_pct AS confidence, true AS targetable, strike_coords_lat AS target_coord_lat,
  strike_coords_lon AS target_coord_lon, CAST(NULL AS VARCHAR) AS nearby_assets, 'JAMMER' AS display_icon,
  'RED' AS display_color,
  CASE WHEN mission_impact_severity IN ('HIGH', 'CRITICAL') THEN 'HIGH' ELSE 'MEDIUM' END AS display_priority, seq
FROM v_jsir"""
VIEWS["v_embm"] = f"""
SELECT * REPLACE (CAST((seq * 19) % 100 AS DOUBLE) / {d(100)} AS confidence, (seq % 3 <> 0) AS targetable)
FROM v_embm_derived"""

VIEWS["v_supply"] = f"""
SELECT 'DEPOT-' || (p_partkey % 6) AS depot_id, CAST(p_partkey AS VARCHAR) AS supply_class,
  CAST(floor((p_size * 10) * (CAST((p_partkey * 7) % 101 AS DOUBLE) / {d(100)})) AS INT) AS on_hand,
  CAST(p_size * 10 AS INT) AS max_capacity
FROM part"""
VIEWS["v_equipment"] = f"""
SELECT 'EQ-' || p_partkey AS equipment_id, 'UNIT-' || (p_partkey % 12) AS unit_id, p_type AS equipment_type,
  CAST(p_size + 9 AS INT) AS total,
  least(CAST(p_size + 9 AS INT), CAST(trunc(CAST((p_partkey * 7) % 101 AS DOUBLE) / {d(100)} * (p_size + 9)) AS INT)) AS fmc
FROM part"""

# --- enriched --------------------------------------------------------------------------
_GPS16 = """unit_id, unit_name, unit_type, timestamp, lat, lon, heading_deg, speed_kph, altitude_m,
  fuel_level_pct, ammo_level_pct, personnel_count, equipment_status, mission_status, fuel_consumption_rate, comms_status"""
VIEWS["v_gps_current"] = f"""
SELECT {_GPS16}, {degree()} AS grid_square,
  CASE WHEN fuel_consumption_rate > 0 THEN fuel_level_pct / fuel_consumption_rate ELSE {d(999)} END AS predicted_fuel_hours,
  fuel_level_pct * {d(0.3)} + ammo_level_pct * {d(0.3)} + {d(40)} AS readiness_score,
  CASE WHEN fuel_level_pct >= 50 AND ammo_level_pct >= 50 THEN 'COMBAT_READY'
       WHEN fuel_level_pct >= 25 AND ammo_level_pct >= 25 THEN 'DEGRADED' ELSE 'CRITICAL' END AS combat_effectiveness,
  seq
FROM v_gps"""
_READY = (
    f"fuel_level_pct * {d('0.30')} + ammo_level_pct * {d('0.30')}"
    f" + (CASE equipment_status WHEN 'FULLY_OPERATIONAL' THEN {d(100)} WHEN 'DEGRADED' THEN {d(60)}"
    f" WHEN 'MAINTENANCE_REQUIRED' THEN {d(30)} ELSE {d(10)} END) * {d(0.25)}"
    f" + (CASE comms_status WHEN 'NOMINAL' THEN {d(100)} WHEN 'DEGRADED' THEN {d(50)} ELSE {d(0)} END) * {d(0.15)}"
)
VIEWS["v_gps_classic"] = f"""
SELECT {_GPS16}, {band()} AS grid_square,
  CASE WHEN fuel_consumption_rate > 0
       THEN {rnd(f'fuel_level_pct / {d(100)} * {d(1000)} / fuel_consumption_rate', 1)} ELSE {d(999)} END AS fuel_hours_remaining,
  {rnd(_READY, 1)} AS readiness_score,
  CASE WHEN equipment_status = 'NON_OPERATIONAL' THEN 'NOT_COMBAT_READY'
       WHEN fuel_level_pct < 15 OR ammo_level_pct < 15 THEN 'CRITICAL'
       WHEN fuel_level_pct < 30 OR ammo_level_pct < 30 OR comms_status = 'OFFLINE' THEN 'DEGRADED'
       ELSE 'COMBAT_READY' END AS combat_effectiveness,
  seq
FROM v_gps"""
VIEWS["v_gps_clean"] = f"""
SELECT * EXCLUDE (altitude_m, fuel_consumption_rate, seq), {five()} AS grid_square,
  fuel_level_pct * {d(0.4)} + ammo_level_pct * {d(0.4)}
    + CASE WHEN equipment_status = 'FULLY_OPERATIONAL' THEN {d(20)} ELSE {d(5)} END AS readiness_score,
  CASE WHEN fuel_level_pct < 15 OR ammo_level_pct < 15 THEN 'CRITICAL'
       WHEN fuel_level_pct < 30 OR ammo_level_pct < 30 THEN 'DEGRADED' ELSE 'COMBAT_READY' END AS combat_effectiveness
FROM v_gps"""

VIEWS["v_aircraft_current"] = f"""
SELECT * EXCLUDE (altitude_m, speed_kph, threat_level), {degree()} AS grid_square,
  CASE iff_mode WHEN 'HOSTILE' THEN 'HOSTILE' WHEN 'UNKNOWN' THEN 'SUSPECT' ELSE 'FRIENDLY' END AS threat_classification
FROM v_aircraft"""
VIEWS["v_aircraft_setup"] = """
SELECT * EXCLUDE (weapons), country || '-' || aircraft_type || '-' || tail_number AS track_id,
  CASE WHEN role IN ('STEALTH', 'AIR_SUPERIORITY', 'STRIKE', 'BOMBER', 'STRATEGIC_BOMBER') THEN 'HIGH'
       WHEN role IN ('MULTIROLE', 'INTERCEPTOR', 'ATTACK_HELO') THEN 'MEDIUM' ELSE 'LOW' END AS computed_threat,
  CASE WHEN status IN ('INTERCEPT', 'STRIKE') THEN 'AGGRESSIVE'
       WHEN status IN ('PATROL', 'RECON', 'ESCORT') THEN 'MONITORING' ELSE 'NEUTRAL' END AS posture
FROM v_aircraft"""
VIEWS["v_aircraft_clean"] = """
SELECT * EXCLUDE (weapons, altitude_m, speed_kph, threat_level),
  CASE WHEN role IN ('STEALTH', 'AIR_SUPERIORITY', 'STRIKE', 'BOMBER') THEN 'HIGH' ELSE 'MEDIUM' END AS computed_threat
FROM v_aircraft"""

VIEWS["v_sigint_current"] = f"""
SELECT * EXCLUDE (elevation_deg, seq), {degree()} AS grid_square,
  (emitter_classification LIKE '%RADAR%' OR emitter_classification LIKE '%SAM%'
    OR emitter_classification LIKE '%S-300%' OR emitter_classification LIKE '%S-400%') AS is_air_defense,
  {score('threat_level')} AS threat_score,
  signal_strength_dbm * confidence_pct / {d(100)} AS signal_quality, seq
FROM v_sigint"""
VIEWS["v_sigint_classic"] = f"""
SELECT *, {band()} AS grid_square,
  (emitter_classification LIKE '%SA-%' OR emitter_classification LIKE '%RADAR%') AS is_air_defense,
  {score('threat_level')} AS threat_score,
  CASE WHEN signal_strength_dbm > -50 THEN 'STRONG' WHEN signal_strength_dbm > -70 THEN 'MODERATE' ELSE 'WEAK' END AS signal_quality
FROM v_sigint"""
VIEWS["v_sigint_clean"] = f"""
SELECT * EXCLUDE (bandwidth_khz, modulation, bearing_deg, elevation_deg), {five()} AS grid_square,
  (emitter_classification LIKE '%RADAR%') AS is_air_defense, {score('threat_level', False)} AS threat_score
FROM v_sigint"""

_SAT10 = """image_id, source_id, timestamp, sensor_type, resolution_m, cloud_cover_pct, quality_score,
  center_lat, center_lon, classification"""
_SEEN = f"quality_score * {d(100)} * ({d(1)} - cloud_cover_pct / {d(100)})"
_SAT_SCORE = rnd(
    f"{_SEEN} * (CASE WHEN resolution_m <= 1 THEN {d(1)} WHEN resolution_m <= 5 THEN {d(0.7)} ELSE {d(0.4)} END)", 1
)
VIEWS["v_satellite_current"] = f"""
SELECT {_SAT10}, {degree('center_lat', 'center_lon')} AS grid_square,
  {_SEEN} * ({d(1)} / nullif(resolution_m, 0) * {d(10)}) AS isr_effectiveness, seq
FROM v_satellite"""
VIEWS["v_satellite_classic"] = f"""
SELECT *, {band('center_lat', 'center_lon')} AS grid_square, {_SAT_SCORE} AS isr_effectiveness,
  CASE WHEN cloud_cover_pct > 70 THEN 'POOR' WHEN cloud_cover_pct > 40 THEN 'MODERATE'
       WHEN quality_score < {d(0.6)} THEN 'MODERATE' ELSE 'GOOD' END AS coverage_quality
FROM v_satellite"""
VIEWS["v_satellite_setup"] = f"""
SELECT {_SAT10}, {band('center_lat', 'center_lon')} AS grid_square, {_SAT_SCORE} AS isr_effectiveness,
  CASE WHEN cloud_cover_pct > 70 THEN 'POOR' WHEN cloud_cover_pct > 40 THEN 'MODERATE' ELSE 'GOOD' END AS coverage_quality,
  seq
FROM v_satellite"""
VIEWS["v_pass"] = f"""
SELECT *, CASE WHEN cloud_cover_pct < 20 AND quality_score > {d(0.7)} THEN 'OPTIMAL'
  WHEN cloud_cover_pct < 50 THEN 'USABLE' ELSE 'DEGRADED' END AS collection_quality
FROM v_satellite_current"""

VIEWS["v_jsir_enriched"] = f"""
SELECT * EXCLUDE (interference_type, spectral_signature, geolocation_confidence_pct, mission_impact_severity, recommended_action),
  {degree('jammer_lat', 'jammer_lon')} AS jammer_grid,
  CASE WHEN mission_impact IN ('COMMS_DENIED', 'MISSION_ABORT') THEN 'CRITICAL'
       WHEN mission_impact IN ('DEGRADED_COMMS', 'REDUCED_BANDWIDTH') THEN 'HIGH'
       WHEN mission_impact = 'MINIMAL_IMPACT' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN cep_km <= 1 THEN 'PRECISION_STRIKE_VIABLE' WHEN cep_km <= 3 THEN 'AREA_STRIKE_VIABLE'
       WHEN cep_km <= 5 THEN 'REQUIRES_REFINEMENT' ELSE 'GEOLOCATION_INSUFFICIENT' END AS strike_viability,
  CASE WHEN mission_impact IN ('COMMS_DENIED', 'MISSION_ABORT') AND cep_km <= 3 THEN 'KINETIC_STRIKE_RECOMMENDED'
       WHEN mission_impact IN ('COMMS_DENIED', 'MISSION_ABORT') THEN 'ADDITIONAL_GEOLOCATION_REQUIRED'
       WHEN mission_impact IN ('DEGRADED_COMMS', 'REDUCED_BANDWIDTH') THEN 'FREQUENCY_HOP_AND_MONITOR'
       ELSE 'CONTINUE_MONITORING' END AS recommended_response
FROM v_jsir"""
VIEWS["v_naval_current"] = f"""
SELECT * EXCLUDE (displacement_tons, aircraft_capacity), {degree()} AS grid_square,
  CASE iff_mode WHEN 'HOSTILE' THEN 'HOSTILE' WHEN 'UNKNOWN' THEN 'SUSPECT' ELSE 'FRIENDLY' END AS threat_classification,
  CASE WHEN vessel_type IN ('SUBMARINE', 'DESTROYER', 'CRUISER', 'CARRIER') THEN 'CAPITAL' ELSE 'SUPPORT' END AS vessel_category
FROM v_naval"""
VIEWS["v_cyber_current"] = f"""
SELECT * EXCLUDE (description, target_country, destination_ip, protocol, port),
  {degree('target_lat', 'target_lon')} AS grid_square, {score('severity')} AS threat_score,
  CASE WHEN sophistication IN ('NATION_STATE', 'APT') THEN 'STATE_SPONSORED' ELSE 'NON_STATE' END AS actor_category
FROM v_cyber"""
VIEWS["v_embm_current"] = f"""
SELECT *, {degree()} AS grid_square, {score('threat_level')} AS threat_score FROM v_embm"""


def resolve(sql: str) -> str:
    """Prefix a statement with the views it (transitively) uses."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in order)
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body.removeprefix('WITH ')}"
    return f"WITH {ctes}\n{body}"
