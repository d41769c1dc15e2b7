"""Five generations of the same rules. Everything that differs between them is data here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from gridlark.functions.conditions import (
    Cond,
    all_at_least,
    any_above,
    any_below,
    at_most,
    both,
    contains_any,
    either,
    is_in,
    is_true,
)

PROFILES = ("current", "classic", "setup", "clean", "deploy")

# --- scores -------------------------------------------------------------------------
# Weights, scores and thresholds of the readiness and threat formulas.
LEVEL_SCORES = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 50}
LEVEL_SCORES_NO_MEDIUM = {"CRITICAL": 100, "HIGH": 75}
LOWEST_SCORE = 25

EQUIPMENT_SCORES = {"FULLY_OPERATIONAL": 100.0, "DEGRADED": 60.0, "MAINTENANCE_REQUIRED": 30.0}
EQUIPMENT_FLOOR = 10.0
COMMS_SCORES = {"NOMINAL": 100.0, "DEGRADED": 50.0}
COMMS_FLOOR = 0.0


@dataclass(frozen=True)
class Readiness:
    """Weighted sum of fuel, ammunition, equipment and communications."""

    fuel: float
    ammo: float
    constant: float = 0.0
    equipment: float = 0.0
    comms: float = 0.0
    bonus: tuple[float, float] | None = None  # (fully operational, otherwise)
    places: int | None = None


READINESS_FULL = Readiness(fuel=0.30, ammo=0.30, equipment=0.25, comms=0.15, places=1)
READINESS = {
    "current": Readiness(fuel=0.3, ammo=0.3, constant=40.0),
    "classic": READINESS_FULL,
    "setup": READINESS_FULL,
    "deploy": READINESS_FULL,
    "clean": Readiness(fuel=0.4, ammo=0.4, bonus=(20.0, 5.0)),
}

# Endurance: level divided by rate ("level"), or hours from a 1000-unit tank ("tank").
ENDURANCE = {"current": "level", "classic": "tank", "setup": "tank", "deploy": "tank"}
ENDURANCE_COLUMN = {"level": "predicted_fuel_hours", "tank": "fuel_hours_remaining"}
ENDURANCE_UNKNOWN = 999.0
TANK_UNITS = 1000.0

_LOW_15 = any_below(fuel_level_pct=15, ammo_level_pct=15)
_LOW_30 = any_below(fuel_level_pct=30, ammo_level_pct=30)
_EFFECT_FULL = (
    [
        (is_in("equipment_status", "NON_OPERATIONAL"), "NOT_COMBAT_READY"),
        (_LOW_15, "CRITICAL"),
        (either(_LOW_30, is_in("comms_status", "OFFLINE")), "DEGRADED"),
    ],
    "COMBAT_READY",
)
EFFECTIVENESS = {
    "current": (
        [
            (all_at_least(fuel_level_pct=50, ammo_level_pct=50), "COMBAT_READY"),
            (all_at_least(fuel_level_pct=25, ammo_level_pct=25), "DEGRADED"),
        ],
        "CRITICAL",
    ),
    "classic": _EFFECT_FULL,
    "setup": _EFFECT_FULL,
    "deploy": _EFFECT_FULL,
    "clean": ([(_LOW_15, "CRITICAL"), (_LOW_30, "DEGRADED")], "COMBAT_READY"),
}

# --- grid ----------------------------------------------------------------------------
GRID_SCHEME = {
    "current": "degree",
    "classic": "band",
    "setup": "band",
    "deploy": "band",
    "clean": "five_degree",
}

# --- signals -------------------------------------------------------------------------
AIR_DEFENSE_MARKS = {
    "current": ("RADAR", "SAM", "S-300", "S-400"),
    "classic": ("SA-", "RADAR"),
    "setup": ("SA-", "RADAR"),
    "deploy": ("SA-", "RADAR"),
    "clean": ("RADAR",),
}
SIGNAL_LEVEL_SCORES = {
    p: LEVEL_SCORES_NO_MEDIUM if p == "clean" else LEVEL_SCORES for p in PROFILES
}
SIGNAL_STRENGTH_LABELS = (
    [
        (any_above(signal_strength_dbm=-50), "STRONG"),
        (any_above(signal_strength_dbm=-70), "MODERATE"),
    ],
    "WEAK",
)
EMITTER_COUNTRIES = (("RU-", "RUSSIA"), ("CN-", "CHINA"), ("IR-", "IRAN"))
EMITTER_COUNTRY_UNKNOWN = "UNKNOWN"
EMISSION_POSTURES = {"FIRE_CONTROL": "WEAPONS_LOCKED", "ACQUISITION": "TRACKING", "TRACK": "MONITORING"}
EMISSION_POSTURE_DEFAULT = "SEARCH"

# --- imagery -------------------------------------------------------------------------
RESOLUTION_FACTORS = ((1.0, 1.0), (5.0, 0.7), (None, 0.4))
_CLOUDY = [(any_above(cloud_cover_pct=70), "POOR"), (any_above(cloud_cover_pct=40), "MODERATE")]
COVERAGE_LABELS = {
    "classic": ([*_CLOUDY, (any_below(quality_score=0.6), "MODERATE")], "GOOD"),
    "setup": (_CLOUDY, "GOOD"),
    "deploy": (_CLOUDY, "GOOD"),
}

# --- aircraft, vessels, cyber, interference ------------------------------------------
IFF_CLASSES = {"HOSTILE": "HOSTILE", "UNKNOWN": "SUSPECT"}
IFF_CLASS_DEFAULT = "FRIENDLY"
ROLE_THREAT = {
    "setup": (
        [
            (is_in("role", "STEALTH", "AIR_SUPERIORITY", "STRIKE", "BOMBER", "STRATEGIC_BOMBER"), "HIGH"),
            (is_in("role", "MULTIROLE", "INTERCEPTOR", "ATTACK_HELO"), "MEDIUM"),
        ],
        "LOW",
    ),
    "clean": ([(is_in("role", "STEALTH", "AIR_SUPERIORITY", "STRIKE", "BOMBER"), "HIGH")], "MEDIUM"),
}
FLIGHT_POSTURE = (
    [
        (is_in("status", "INTERCEPT", "STRIKE"), "AGGRESSIVE"),
        (is_in("status", "PATROL", "RECON", "ESCORT"), "MONITORING"),
    ],
    "NEUTRAL",
)
CAPITAL_SHIPS = ("SUBMARINE", "DESTROYER", "CRUISER", "CARRIER")
STATE_ACTORS = ("NATION_STATE", "APT")

SEVERE_IMPACTS = ("COMMS_DENIED", "MISSION_ABORT")
MODERATE_IMPACTS = ("DEGRADED_COMMS", "REDUCED_BANDWIDTH")
IMPACT_SEVERITY = (
    [
        (is_in("mission_impact", *SEVERE_IMPACTS), "CRITICAL"),
        (is_in("mission_impact", *MODERATE_IMPACTS), "HIGH"),
        (is_in("mission_impact", "MINIMAL_IMPACT"), "MEDIUM"),
    ],
    "LOW",
)
# Largest circular error (km) for each label.
ACCURACY_LABELS = (
    (1.0, "PRECISION_STRIKE_VIABLE"),
    (3.0, "AREA_STRIKE_VIABLE"),
    (5.0, "REQUIRES_REFINEMENT"),
    (None, "GEOLOCATION_INSUFFICIENT"),
)
RESPONSE_LABELS = (
    [
        (both(is_in("mission_impact", *SEVERE_IMPACTS), at_most(cep_km=3)), "KINETIC_STRIKE_RECOMMENDED"),
        (is_in("mission_impact", *SEVERE_IMPACTS), "ADDITIONAL_GEOLOCATION_REQUIRED"),
        (is_in("mission_impact", *MODERATE_IMPACTS), "FREQUENCY_HOP_AND_MONITOR"),
    ],
    "CONTINUE_MONITORING",
)

CYBER_STATUS = (
    [
        (both(is_in("severity", "CRITICAL"), is_in("status", "INVESTIGATING")), "ACTIVE_BREACH"),
        (is_in("severity", "CRITICAL"), "CRITICAL_ALERT"),
        (is_in("severity", "HIGH"), "HIGH_PRIORITY"),
    ],
    "MONITORING",
)

# --- breakout streams ------------------------------------------------------------------
BREAKOUTS: dict[str, tuple[str, Cond]] = {
    "air_defense": ("sigint", both(is_true("is_air_defense"), is_in("threat_level", "CRITICAL", "HIGH"))),
    "hostile_comms": (
        "sigint",
        both(
            is_in("signal_type", "VOICE", "DATA", "BURST"),
            is_in("threat_level", "CRITICAL", "HIGH", "MEDIUM"),
        ),
    ),
    "jamming": (
        "sigint",
        either(contains_any("emitter_classification", "JAMM"), is_in("emission_pattern", "CONTINUOUS")),
    ),
    "iff": ("sigint", contains_any("emitter_classification", "IFF", "TRANSPONDER")),
    "strike_candidates": (
        "embm",
        both(is_true("targetable"), is_in("threat_level", "CRITICAL", "HIGH")),
    ),
    "active_jammers": (
        "embm",
        either(contains_any("emitter_function", "JAMM"), is_in("track_category", "JAMMER")),
    ),
    "collection_reqs": (
        "embm",
        either(any_below(confidence=0.6), any_above(position_accuracy_m=500)),
    ),
    "coverage_alerts": (
        "satellite",
        either(any_above(cloud_cover_pct=80), any_below(isr_effectiveness=50)),
    ),
}
PASS_QUALITY = (
    [
        (both(any_below(cloud_cover_pct=20), any_above(quality_score=0.7)), "OPTIMAL"),
        (any_below(cloud_cover_pct=50), "USABLE"),
    ],
    "DEGRADED",
)


# --- alerts ------------------------------------------------------------------------------
@dataclass(frozen=True)
class AlertRule:
    """A filter, a severity (ladder of tiers or a column) and a message template."""

    source: str
    alert_type: str
    keep: tuple[str, ...]
    when: Cond
    message: str
    entity: str
    prefix: str
    tiers: tuple[tuple[Cond, str], ...] = ()
    otherwise: str = "WARNING"
    severity_column: str | None = None
    id_has_time: bool = True
    grid: str = "grid_square"
    lat: str = "lat"
    lon: str = "lon"
    renames: dict[str, str] = field(default_factory=dict)


def _tiers(make: Callable[..., Cond], column: str, **levels: float):
    return tuple((make(**{column: level}), name) for name, level in levels.items())


_UNIT = ("unit_id", "unit_name", "unit_type", "grid_square")
_POINT = ("lat", "lon")
_HOURS_CUR, _HOURS = "predicted_fuel_hours", "fuel_hours_remaining"


def _fuel(when, tiers, message, hours):
    return AlertRule(
        "gps", "FUEL_CRITICAL", (*_UNIT, "fuel_level_pct", hours, "mission_status", *_POINT),
        when, message, "unit_id", "FUEL-", tiers,
    )


def _ammo(when, critical, high, message):
    return AlertRule(
        "gps", "AMMO_CRITICAL", (*_UNIT, "ammo_level_pct", "mission_status", *_POINT),
        when, message, "unit_id", "AMMO-",
        _tiers(any_below, "ammo_level_pct", CRITICAL=critical, HIGH=high),
    )


def _equipment(states, message, extra=()):
    return AlertRule(
        "gps", "EQUIPMENT_FAILURE", (*_UNIT, "equipment_status", "mission_status", *extra, *_POINT),
        is_in("equipment_status", *states), message, "unit_id", "EQUIP-",
        (
            (is_in("equipment_status", "NON_OPERATIONAL"), "CRITICAL"),
            (is_in("equipment_status", "MAINTENANCE_REQUIRED"), "HIGH"),
        ),
    )


def _comms(kind, states, message, degraded):
    return AlertRule(
        "gps", kind, (*_UNIT, "comms_status", "mission_status", *_POINT),
        is_in("comms_status", *states), message, "unit_id", "COMMS-",
        (
            (is_in("comms_status", "OFFLINE"), "CRITICAL"),
            (is_in("comms_status", "DEGRADED"), degraded),
        ),
    )


def _readiness(below, high, message):
    return AlertRule(
        "gps", "LOW_READINESS",
        (*_UNIT, "readiness_score", "combat_effectiveness", "fuel_level_pct", "ammo_level_pct",
         "equipment_status", *_POINT),
        any_below(readiness_score=below), message, "unit_id", "READY-",
        _tiers(any_below, "readiness_score", CRITICAL=30, HIGH=high),
    )


_RADAR_KEEP = (
    "intercept_id", "emitter_classification", "threat_level", "grid_square", "lat", "lon",
    "signal_strength_dbm", "signal_quality",
)


def _radar(message, keep=(*_RADAR_KEEP, "frequency_mhz", "collector_id")):
    return AlertRule(
        "sigint", "THREAT_RADAR", keep,
        both(
            is_true("is_air_defense"),
            any_above(signal_strength_dbm=-70),
            is_in("threat_level", "CRITICAL", "HIGH"),
        ),
        message, "intercept_id", "THREAT-", severity_column="threat_level", id_has_time=False,
    )


_JSIR_KEEP = (
    "incident_id", "jammer_location", "jammer_country", "jammer_system", "jammer_lat", "jammer_lon",
    "jammer_grid", "target_satellite", "mission_impact", "affected_unit_count", "cep_km",
    "strike_coords_lat", "strike_coords_lon", "severity", "strike_viability", "recommended_response",
)


def _jamming(message):
    return AlertRule(
        "jsir", "SATCOM_JAMMING", _JSIR_KEEP,
        is_in("mission_impact", *SEVERE_IMPACTS, *MODERATE_IMPACTS),
        message, "incident_id", "JSIR-", severity_column="severity", id_has_time=False,
        grid="jammer_grid", lat="jammer_lat", lon="jammer_lon",
    )


_FUEL_LOW = any_below(fuel_level_pct=20, fuel_hours_remaining=4)
_FUEL_TIERS = (
    (any_below(fuel_level_pct=10, fuel_hours_remaining=2), "CRITICAL"),
    (any_below(fuel_level_pct=15, fuel_hours_remaining=3), "HIGH"),
)
_ACTIVE = is_in("mission_status", "ENGAGED", "DEFENSIVE")
_DOWN = ("DEGRADED", "OFFLINE")
_BROKEN = ("NON_OPERATIONAL", "MAINTENANCE_REQUIRED")
_THREAT_TIERS = _tiers(all_at_least, "max_threat", CRITICAL=100, HIGH=75)
_ZONE_KEEP = (
    *_UNIT, "lat", "lon", "mission_status", "readiness_score", "combat_effectiveness",
    "threat_count", "max_threat", "primary_threat",
)


def _zone(message):
    return AlertRule(
        "threat_zone", "UNIT_UNDER_THREAT", _ZONE_KEEP, "true", message,
        "unit_id", "PROXIM-", _THREAT_TIERS,
    )


# Alert types, thresholds and message formats, per profile.
ALERTS: dict[str, dict[str, AlertRule]] = {
    "current": {
        "fuel": _fuel(
            any_below(predicted_fuel_hours=6),
            _tiers(any_below, _HOURS_CUR, CRITICAL=2, HIGH=4),
            "FUEL EMERGENCY: {unit_name} at {grid_square} has only {predicted_fuel_hours:r1} "
            "hours remaining. Level: {fuel_level_pct:whole}%",
            _HOURS_CUR,
        ),
        "ammo": _ammo(
            both(any_below(ammo_level_pct=30), is_in("mission_status", "ENGAGED")), 15, 25,
            "AMMO CRITICAL: {unit_name} at {grid_square} ammunition at {ammo_level_pct:whole}%. "
            "Immediate resupply required.",
        ),
        "equipment": _equipment(
            _BROKEN,
            "EQUIPMENT: {unit_name} at {grid_square} - {equipment_status} (Readiness: {readiness_score:trunc}%)",
        ),
        "comms": _comms(
            "COMMS_ALERT", _DOWN,
            "COMMS {comms_status}: {unit_name} at {grid_square} - Last pos: {lat}, {lon}", "WARNING",
        ),
        "low_readiness": _readiness(
            50, 40, "LOW READINESS: {unit_name} - {readiness_score:trunc}% ({combat_effectiveness})"
        ),
        "threat_radar": _radar(
            "THREAT: {emitter_classification} in {grid_square} - {signal_strength_dbm:whole} dBm"
        ),
        "hostile_aircraft": AlertRule(
            "aircraft", "HOSTILE_AIRCRAFT",
            ("aircraft_id", "tail_number", "aircraft_type", "country", "lat", "lon", "altitude_ft",
             "heading_deg", "speed_kts", "status", "weapons", "iff_mode"),
            both(is_in("iff_mode", "HOSTILE"), is_in("status", "INTERCEPT", "STRIKE", "PATROL", "ATTACK")),
            "HOSTILE AIRCRAFT: {aircraft_type} ({country}) {tail_number} - Status: {status} at "
            "{altitude_ft:trunc}ft, {speed_kts:trunc}kts",
            "aircraft_id", "HOSTILE-",
            ((is_in("status", "INTERCEPT", "STRIKE", "ATTACK"), "CRITICAL"),), "HIGH",
        ),
        "satcom": _jamming(
            "SATCOM JAMMING: {jammer_system} ({jammer_country}) targeting {target_satellite}. "
            "Impact: {mission_impact}. Affected: {affected_unit_count}. CEP: {cep_km}km"
        ),
        "hostile_naval": AlertRule(
            "naval", "HOSTILE_NAVAL",
            ("vessel_id", "hull_number", "vessel_type", "vessel_class", "country", "lat", "lon",
             "heading_deg", "speed_kts", "status", "weapons", "iff_mode", "grid_square"),
            is_in("iff_mode", "HOSTILE"),
            "HOSTILE NAVAL: {vessel_type} ({country}) {hull_number} - {status} at {speed_kts:trunc}kts",
            "vessel_id", "NAVAL-",
            ((is_in("vessel_category", "CAPITAL"), "CRITICAL"),), "HIGH",
        ),
        "cyber": AlertRule(
            "cyber", "CYBER_CRITICAL",
            ("incident_id", "threat_actor", "actor_country", "attack_type", "severity", "target_facility",
             "target_system", "target_lat", "target_lon", "grid_square", "source_ip", "mitre_attack",
             "status"),
            is_in("severity", "CRITICAL", "HIGH"),
            "CYBER: {attack_type} by {threat_actor} ({actor_country}) targeting {target_facility} - {severity}",
            "incident_id", "CYBER-", severity_column="severity", lat="target_lat", lon="target_lon",
            renames={"target_lat": "lat", "target_lon": "lon"},
        ),
    },
    "classic": {
        "fuel": _fuel(
            _FUEL_LOW, _FUEL_TIERS,
            "FUEL EMERGENCY: {unit_name} ({unit_type}) at {grid_square} has only {fuel_level_pct:r1}% fuel "
            "({fuel_hours_remaining:r1} hours remaining). Mission status: {mission_status}",
            _HOURS,
        ),
        "ammo": _ammo(
            any_below(ammo_level_pct=25), 10, 20,
            "AMMO CRITICAL: {unit_name} ({unit_type}) at {grid_square} has only {ammo_level_pct:r1}% "
            "ammunition. Mission status: {mission_status}",
        ),
        "equipment": _equipment(
            (*_BROKEN, "DEGRADED"),
            "EQUIPMENT ALERT: {unit_name} ({unit_type}) at {grid_square} - Status: {equipment_status}. "
            "Readiness: {readiness_score:r1}%",
            ("readiness_score",),
        ),
        "comms": _comms(
            "COMMS_DEGRADED", (*_DOWN, "JAMMING_DETECTED"),
            "COMMS ALERT: {unit_name} ({unit_type}) at {grid_square} - Communications {comms_status}. "
            "Mission: {mission_status}",
            "HIGH",
        ),
        "low_readiness": _readiness(
            60, 50,
            "READINESS ALERT: {unit_name} at {grid_square} - Score: {readiness_score:r1}% "
            "({combat_effectiveness}). Fuel: {fuel_level_pct:r0}%, Ammo: {ammo_level_pct:r0}%",
        ),
        "threat_radar": AlertRule(
            "sigint", "THREAT_RADAR",
            ("intercept_id", "signal_type", "frequency_mhz", "emitter_classification", "threat_level",
             "threat_score", "signal_strength_dbm", "signal_quality", "grid_square", "lat", "lon"),
            both(is_in("threat_level", "HIGH", "CRITICAL"), any_above(signal_strength_dbm=-80)),
            "THREAT DETECTED: {emitter_classification} ({signal_type}) at {grid_square}. Threat level: "
            "{threat_level}. Signal: {signal_quality} ({signal_strength_dbm:r1} dBm). "
            "Freq: {frequency_mhz:r2} MHz",
            "intercept_id", "THREAT-",
            (
                (is_in("threat_level", "CRITICAL"), "CRITICAL"),
                (both(is_in("threat_level", "HIGH"), is_in("signal_quality", "STRONG")), "CRITICAL"),
                (is_in("threat_level", "HIGH"), "HIGH"),
            ),
            id_has_time=False,
        ),
        "threat_zone": _zone(
            "THREAT PROXIMITY: {unit_name} operating in {grid_square} with {threat_count} active threat(s). "
            "Primary threat: {primary_threat}. Unit readiness: {readiness_score}% ({combat_effectiveness})"
        ),
        "satcom": _jamming(
            "SATCOM JAMMING: {jammer_system} ({jammer_country}) targeting {target_satellite}. "
            "Impact: {mission_impact}. Affected units: {affected_unit_count}. CEP: {cep_km}km. "
            "Response: {recommended_response}"
        ),
    },
    "setup": {
        "fuel": _fuel(
            _FUEL_LOW, _FUEL_TIERS,
            "FUEL EMERGENCY: {unit_name} at {grid_square} - {fuel_level_pct:whole}% "
            "({fuel_hours_remaining}h remaining)",
            _HOURS,
        ),
        "ammo": _ammo(
            both(any_below(ammo_level_pct=25), _ACTIVE), 10, 20,
            "AMMO CRITICAL: {unit_name} at {grid_square} - {ammo_level_pct:whole}% while {mission_status}",
        ),
        "equipment": _equipment(
            _BROKEN,
            "EQUIPMENT: {unit_name} at {grid_square} - {equipment_status} (Readiness: {readiness_score}%)",
            ("readiness_score",),
        ),
        "comms": _comms(
            "COMMS_ALERT", _DOWN,
            "COMMS {comms_status}: {unit_name} at {grid_square} - Last pos: {lat}, {lon}", "WARNING",
        ),
        "low_readiness": _readiness(
            50, 40, "LOW READINESS: {unit_name} - {readiness_score}% ({combat_effectiveness})"
        ),
        "threat_radar": _radar(
            "THREAT: {emitter_classification} in {grid_square} - {signal_quality} signal "
            "({signal_strength_dbm:whole} dBm)"
        ),
        "hostile_aircraft": AlertRule(
            "aircraft", "HOSTILE_AIRCRAFT",
            ("aircraft_id", "tail_number", "aircraft_type", "country", "role", "lat", "lon", "altitude_ft",
             "speed_kts", "status", "heading_deg"),
            both(is_in("iff_mode", "HOSTILE"), is_in("status", "INTERCEPT", "STRIKE", "PATROL", "RECON")),
            "HOSTILE: {country} {aircraft_type} ({tail_number}) {status} at FL{flight_level:whole} "
            "HDG {heading_deg:whole}° {speed_kts:whole}kts",
            "aircraft_id", "HOSTILE-",
            (
                (is_in("status", "INTERCEPT", "STRIKE"), "CRITICAL"),
                (is_in("role", "STEALTH", "BOMBER", "STRATEGIC_BOMBER"), "HIGH"),
            ),
            "MEDIUM",
        ),
        "threat_zone": _zone(
            "THREAT PROXIMITY: {unit_name} in {grid_square} with {threat_count} active threat(s). "
            "Primary: {primary_threat}"
        ),
    },
    "deploy": {
        "fuel": _fuel(
            _FUEL_LOW,
            (
                (any_below(fuel_level_pct=10, fuel_hours_remaining=2), "CRITICAL"),
                (any_below(fuel_level_pct=15), "HIGH"),
            ),
            "FUEL: {unit_name} at {grid_square} - {fuel_level_pct:whole}% ({fuel_hours_remaining}h)",
            _HOURS,
        ),
        "ammo": _ammo(
            both(any_below(ammo_level_pct=25), _ACTIVE), 10, 20,
            "AMMO: {unit_name} at {grid_square} - {ammo_level_pct:whole}% while {mission_status}",
        ),
        "comms": _comms(
            "COMMS_ALERT", _DOWN, "COMMS {comms_status}: {unit_name} at {grid_square}", "WARNING"
        ),
        "threat_radar": _radar(
            "THREAT: {emitter_classification} in {grid_square} ({signal_quality})", _RADAR_KEEP
        ),
        "threat_zone": _zone("PROXIMITY: {unit_name} in {grid_square} with {threat_count} threats"),
    },
    "clean": {
        "hostile_aircraft": AlertRule(
            "aircraft", "HOSTILE_AIRCRAFT",
            ("aircraft_id", "tail_number", "aircraft_type", "country", "role", "lat", "lon", "altitude_ft",
             "speed_kts", "status", "heading_deg"),
            is_in("iff_mode", "HOSTILE"),
            "HOSTILE: {country} {aircraft_type} {status}",
            "aircraft_id", "HOSTILE-",
            ((is_in("status", "INTERCEPT", "STRIKE"), "CRITICAL"),), "HIGH",
        ),
        "satcom": AlertRule(
            "jsir", "SATCOM_JAMMING",
            ("incident_id", "jammer_location", "jammer_country", "jammer_system", "jammer_lat", "jammer_lon",
             "target_satellite", "interference_type", "mission_impact", "cep_km",
             "geolocation_confidence_pct", "recommended_action", "strike_coords_lat", "strike_coords_lon"),
            is_in("mission_impact_severity", "HIGH", "CRITICAL"),
            "JSIR ALERT: {jammer_country} {jammer_system} jamming {target_satellite} - {mission_impact}",
            "incident_id", "JSIR-", severity_column="mission_impact_severity", id_has_time=False,
            grid="jammer_grid", lat="jammer_lat", lon="jammer_lon",
        ),
    },
}

# Which alerts are merged into the one alert stream, in merge order.
MERGED_ALERTS = {
    "current": (
        "fuel", "ammo", "equipment", "comms", "low_readiness", "threat_radar", "hostile_aircraft", "satcom",
    ),
    "classic": (
        "fuel", "ammo", "equipment", "comms", "low_readiness", "threat_radar", "threat_zone", "satcom",
    ),
}
