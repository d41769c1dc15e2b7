"""The raw streams as views over the supplied tables (formulas: FIXTURES.md, section 3).

Every view carries ``seq``, a unique arrival number that stands for the topic offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlark.functions.conditions import literal
from gridlark.functions.geo import FEET_TO_METRES, KNOTS_TO_KPH
from gridlark.operators.derive import derive_embm_track
from gridlark.sources.external import FEEDS, TIME

EQUIPMENT = ("FULLY_OPERATIONAL", "DEGRADED", "MAINTENANCE_REQUIRED", "NON_OPERATIONAL")
COMMS = ("NOMINAL", "DEGRADED", "OFFLINE", "JAMMING_DETECTED")
MISSIONS = ("ENGAGED", "DEFENSIVE", "PATROL", "STANDBY")
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
ROLES = (
    "STEALTH", "AIR_SUPERIORITY", "STRIKE", "BOMBER", "STRATEGIC_BOMBER",
    "MULTIROLE", "INTERCEPTOR", "ATTACK_HELO", "TRANSPORT",
)
FLIGHT_STATUS = ("INTERCEPT", "STRIKE", "PATROL", "ATTACK", "RECON", "ESCORT", "TRANSIT")
IFF = ("HOSTILE", "UNKNOWN", "FRIENDLY")
EMITTERS = (
    "RU-RADAR-SA-10", "CN-S-400", "IR-SAM", "RU-JAMMER", "US-IFF", "CN-TRANSPONDER", "KP-OTHER",
)
PATTERNS = ("SEARCH", "TRACK", "ACQUISITION", "FIRE_CONTROL", "CONTINUOUS")
SIGNALS = ("RADAR", "VOICE", "DATA", "BURST", "IFF", "JAMMER")
IMPACTS = (
    "COMMS_DENIED", "MISSION_ABORT", "DEGRADED_COMMS", "REDUCED_BANDWIDTH", "MINIMAL_IMPACT", "OTHER",
)
SITES = ("AA", "BB", "CC", "DD")


TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A supplied table with its declared schema: no job is spent on inferring it."""
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def _pick(index: str, values) -> str:
    return f"array({', '.join(literal(v) for v in values)})[cast({index} AS int)]"


def _tag(prefix: str, expr: str) -> str:
    return f"concat('{prefix}', cast({expr} AS string))"


def _dbl(expr: str) -> str:
    return f"cast({expr} AS double)"


def _view(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


# Zone-less times are read in the session zone, which is UTC.
MILLIS = "unix_millis(cast(ts AS timestamp))"
LAT = f"(43.5D + {_dbl('event_id % 160')} / 100D)"
LON = f"(35.25D + {_dbl('event_id % 137')} / 100D)"
FUEL = f"{_dbl('(event_id * 37) % 1000')} / 10D"
AMMO = f"{_dbl('(event_id * 53) % 1000')} / 10D"
FEET, KNOTS = _dbl("(event_id % 400) * 100"), _dbl("event_id % 600")
LEVEL = _pick("(event_id div 3) % 4", LEVELS)
ALLEGIANCE = _pick("(event_id div 2) % 3", IFF)

GPS = {
    "unit_id": f"concat({_pick('user_id % 5', ('AC-', 'SHIP-', 'FAC-', 'US-', 'UK-'))}, cast(user_id AS string))",
    "unit_name": _tag("Unit ", "user_id"),
    "unit_type": _pick("user_id % 4", ("ARMOR", "INFANTRY", "AVIATION", "MARINES")),
    "timestamp": MILLIS,
    "lat": LAT,
    "lon": LON,
    "heading_deg": _dbl("event_id % 360"),
    "speed_kph": "value",
    "altitude_m": _dbl("event_id % 3000"),
    "fuel_level_pct": FUEL,
    "ammo_level_pct": AMMO,
    "personnel_count": "cast(event_id % 500 AS int)",
    "equipment_status": _pick("(event_id div 7) % 4", EQUIPMENT),
    "mission_status": _pick("(event_id div 13) % 4", MISSIONS),
    "fuel_consumption_rate": f"{_dbl('(event_id div 3) % 8')} * 10D",
    "comms_status": _pick("(event_id div 11) % 4", COMMS),
    "seq": "event_id",
}
AIRCRAFT = {
    "aircraft_id": "cast(user_id AS string)",
    "tail_number": "cast(user_id AS string)",
    "aircraft_type": _pick("(event_id div 4) % 3", ("TYPE-A", "TYPE-B", "TYPE-C")),
    "role": _pick("(event_id div 3) % 9", ROLES),
    "country": _pick("event_id % 4", SITES),
    "weapons": _pick("event_id % 2", ("FIT-1", "FIT-2")),
    "timestamp": MILLIS,
    "lat": LAT,
    "lon": LON,
    "altitude_ft": FEET,
    "altitude_m": f"{FEET} * {literal(FEET_TO_METRES)}",
    "heading_deg": _dbl("event_id % 360"),
    "speed_kts": KNOTS,
    "speed_kph": f"{KNOTS} * {literal(KNOTS_TO_KPH)}",
    "status": _pick("(event_id div 5) % 7", FLIGHT_STATUS),
    "fuel_pct": FUEL,
    "threat_level": LEVEL,
    "iff_mode": ALLEGIANCE,
    "seq": "event_id",
}
NAVAL = {
    "vessel_id": "cast(user_id AS string)",
    "hull_number": "cast(user_id AS string)",
    "vessel_type": _pick("(event_id div 3) % 5", ("SUBMARINE", "DESTROYER", "CRUISER", "CARRIER", "TANKER")),
    "vessel_class": _pick("(event_id div 7) % 3", ("CLASS-1", "CLASS-2", "CLASS-3")),
    "displacement_tons": "cast((event_id % 1000) * 100 AS int)",
    "country": _pick("event_id % 5", ("US", "RU", "CN", "IR", "AA")),
    "weapons": _pick("event_id % 2", ("FIT-1", "FIT-2")),
    "aircraft_capacity": "cast(event_id % 40 AS int)",
    "timestamp": MILLIS,
    "lat": LAT,
    "lon": LON,
    "heading_deg": _dbl("event_id % 360"),
    "speed_kts": _dbl("event_id % 40"),
    "status": _pick("(event_id div 5) % 4", ("UNDERWAY", "ANCHORED", "PATROL", "MOORED")),
    "iff_mode": ALLEGIANCE,
    "seq": "event_id",
}
CYBER = {
    "incident_id": _tag("CYBER-", "event_id"),
    "timestamp": MILLIS,
    "threat_actor": _tag("ACTOR-", "event_id % 9"),
    "actor_country": _pick("event_id % 5", ("RU", "CN", "IR", "KP", "AA")),
    "sophistication": _pick("(event_id div 5) % 3", ("NATION_STATE", "APT", "OTHER")),
    "attack_type": _pick("(event_id div 2) % 4", ("PHISHING", "RANSOMWARE", "DDOS", "INTRUSION")),
    "severity": LEVEL,
    "description": _tag("Report ", "event_id"),
    "target_facility_id": _tag("FAC-", "user_id"),
    "target_facility": _tag("Site ", "user_id"),
    "target_system": _pick("event_id % 3", ("MAIL", "VPN", "HISTORIAN")),
    "target_type": _pick("event_id % 2", ("IT", "OT")),
    "target_region": _pick("event_id % 3", ("NORTH", "SOUTH", "EAST")),
    "target_country": "'AA'",
    "target_lat": LAT,
    "target_lon": LON,
    "source_ip": "concat_ws('.', '10', (event_id div 65536) % 256, (event_id div 256) % 256, event_id % 256)",
    "destination_ip": _tag("192.0.2.", "event_id % 256"),
    "protocol": _pick("event_id % 2", ("TCP", "UDP")),
    "port": "cast(event_id % 1024 AS int)",
    "mitre_attack": _tag("T", "event_id % 500 + 1000"),
    "status": _pick("(event_id div 7) % 3", ("INVESTIGATING", "DETECTED", "BLOCKED")),
    "seq": "event_id",
}
SIGINT = {
    "intercept_id": _tag("SIG-", "event_id"),
    "timestamp": MILLIS,
    "signal_type": _pick("event_id % 6", SIGNALS),
    "frequency_mhz": f"100D + {_dbl('event_id % 9000')} / 10D",
    "bandwidth_khz": f"{_dbl('event_id % 250')} / 10D",
    "modulation": _pick("event_id % 3", ("AM", "FM", "PSK")),
    "bearing_deg": f"{_dbl('event_id % 3600')} / 10D",
    "signal_strength_dbm": _dbl("event_id % 61 - 90"),
    "lat": LAT,
    "lon": LON,
    "elevation_deg": _dbl("event_id % 90"),
    "confidence_pct": _dbl("event_id % 30 + 70"),
    "emitter_classification": _pick("(event_id div 5) % 7", EMITTERS),
    "threat_level": LEVEL,
    "emission_pattern": _pick("(event_id div 2) % 5", PATTERNS),
    "collector_id": _tag("COL-", "event_id % 11"),
    "seq": "event_id",
}
SATELLITE = {
    "image_id": _tag("SAT-", "event_id"),
    "source_id": _tag("SRC-", "event_id % 4"),
    "timestamp": MILLIS,
    "acquisition_time": f"cast({MILLIS} AS string)",
    "sensor_type": _pick("(event_id div 3) % 4", ("EO", "IR", "SAR", "MSI")),
    "resolution_m": f"0.5D + {_dbl('(event_id * 11) % 80')} / 10D",
    "cloud_cover_pct": _dbl("event_id % 101"),
    "sun_elevation_deg": _dbl("event_id % 90"),
    "off_nadir_angle_deg": _dbl("event_id % 45"),
    "center_lat": LAT,
    "center_lon": LON,
    "classification": _pick("event_id % 2", ("OPEN", "RESTRICTED")),
    "quality_score": f"{_dbl('(event_id * 7) % 101')} / 100D",
    "processing_status": _pick("event_id % 2", ("RAW", "PROCESSED")),
    "seq": "event_id",
}
_JAM_LAT = f"(-10D + {_dbl('o_orderkey % 400')} / 10D)"
_JAM_LON = f"(-20D + {_dbl('o_orderkey % 900')} / 10D)"
_CEP = f"({_dbl('(o_orderkey * 13) % 80')} / 10D)"
JSIR = {
    "incident_id": _tag("JSIR-", "o_orderkey"),
    "timestamp": "unix_millis(cast(o_orderdate AS timestamp)) + (o_orderkey % 86400) * 1000",
    "event_type": "'SATCOM_INTERFERENCE'",
    "workflow_stage": _pick("o_orderkey % 4", ("DETECTION", "CHARACTERIZATION", "GEOLOCATION", "MITIGATION")),
    "jammer_id": _tag("JAM-", "o_custkey % 7"),
    "jammer_location": _tag("Site ", "o_custkey % 7"),
    "jammer_country": _pick("(o_orderkey div 2) % 4", SITES),
    "jammer_lat": _JAM_LAT,
    "jammer_lon": _JAM_LON,
    "jammer_terrain": _pick("o_orderkey % 3", ("HILL", "COAST", "PLAIN")),
    "jammer_system": _tag("SYS-", "(o_orderkey div 3) % 5"),
    "jammer_type": _pick("o_orderkey % 2", ("FIXED", "MOBILE")),
    "jammer_power_kw": f"{_dbl('o_orderkey % 50')} / 2D",
    "jammer_frequency_band": _pick("o_orderkey % 3", ("X", "KU", "KA")),
    "target_satellite": _tag("SATCOM-", "(o_orderkey div 5) % 6"),
    "target_orbit": _pick("o_orderkey % 3", ("GEO", "MEO", "LEO")),
    "target_frequency_ghz": f"7D + {_dbl('o_orderkey % 40')} / 10D",
    "tdoa_ms": f"{_dbl('o_orderkey % 5000')} / 1000D",
    "fdoa_hz": f"-50D + {_dbl('o_orderkey % 1000')} / 10D",
    "cep_km": _CEP,
    "ellipse_major_km": f"{_CEP} * 2D",
    "ellipse_minor_km": f"{_CEP} * 0.5D",
    "ellipse_orientation": _dbl("o_orderkey % 180"),
    "strike_coords_lat": _JAM_LAT,
    "strike_coords_lon": _JAM_LON,
    "mission_impact": _pick("o_orderkey % 6", IMPACTS),
    "affected_unit_count": "cast(o_orderkey % 9 AS int)",
    "comms_degradation_pct": _dbl("(o_orderkey * 17) % 101"),
    "interference_type": _pick("(o_orderkey div 3) % 4", ("BROADBAND_NOISE", "SWEPT_CW", "PULSED", "SPOT")),
    "spectral_signature": _pick("(o_orderkey div 7) % 3", ("SWEPT", "MULTI_TONE", "BARRAGE")),
    "geolocation_confidence_pct": _dbl("(o_orderkey * 19) % 100"),
    "mission_impact_severity": _pick("(o_orderkey div 2) % 4", LEVELS),
    "recommended_action": _pick("o_orderkey % 3", ("FREQUENCY_HOP", "BEAM_REALLOCATION", "INCREASE_EIRP")),
    "seq": "o_orderkey",
}


#: Which kinds of events a stream is made of; of all, where none is named.
KINDS = {"aircraft": ["click"], "naval": ["view"], "cyber": ["error"], "sigint": ["signup"], "satellite": ["purchase"]}


def _events(spark, sf_dir, event_type=None) -> DataFrame:
    df = load(spark, sf_dir, "events")
    return df if event_type is None else df.where(f"event_type = '{event_type}'")


def gps_view(events: DataFrame) -> DataFrame:
    return _view(events, GPS)


def aircraft_view(events: DataFrame) -> DataFrame:
    return _view(events, AIRCRAFT)


def naval_view(events: DataFrame) -> DataFrame:
    return _view(events, NAVAL)


def cyber_view(events: DataFrame) -> DataFrame:
    return _view(events, CYBER)


def sigint_view(events: DataFrame) -> DataFrame:
    return _view(events, SIGINT)


def satellite_view(events: DataFrame) -> DataFrame:
    return _view(events, SATELLITE)


def gps_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps_view(_events(spark, sf_dir))


def aircraft_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aircraft_view(_events(spark, sf_dir, KINDS["aircraft"][0]))


def naval_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naval_view(_events(spark, sf_dir, KINDS["naval"][0]))


def cyber_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cyber_view(_events(spark, sf_dir, KINDS["cyber"][0]))


def sigint_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigint_view(_events(spark, sf_dir, KINDS["sigint"][0]))


def satellite_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return satellite_view(_events(spark, sf_dir, KINDS["satellite"][0]))


def jsir_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(load(spark, sf_dir, "orders"), JSIR)


def embm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = derive_embm_track(jsir_raw(spark, sf_dir))
    replaced = {"confidence": f"{_dbl('(seq * 19) % 100')} / 100D", "targetable": "(seq % 3) != 0"}
    return _view(tracks, {c: replaced.get(c, c) for c in tracks.columns})


def supply_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(load(spark, sf_dir, "part"), {
        "depot_id": _tag("DEPOT-", "p_partkey % 6"),
        "supply_class": "cast(p_partkey AS string)",
        "on_hand": f"cast(floor(p_size * 10 * ({_dbl('(p_partkey * 7) % 101')} / 100D)) AS int)",
        "max_capacity": "cast(p_size * 10 AS int)",
    })


def equipment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = "cast(p_size + 9 AS int)"
    return _view(load(spark, sf_dir, "part"), {
        "equipment_id": _tag("EQ-", "p_partkey"),
        "unit_id": _tag("UNIT-", "p_partkey % 12"),
        "equipment_type": "p_type",
        "total": total,
        "fmc": f"least({total}, cast({_dbl('(p_partkey * 7) % 101')} / 100D * {total} AS int))",
    })


REQUESTED = (
    "block_ip", "isolate_system", "alert_team", "escalate", "contain", "investigate", "jam", "geolocate",
    "alert_ew", "task_collection", "classify", "share_intel", "kinetic_strike", "ew_attack", "refine_geo",
    "monitor", "unknown", "",
)


def action_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator requests, some without an id, an action, an operator or optional fields."""

    def sometimes(value: str, n: int) -> str:
        return f"CASE WHEN event_id % {n} != 0 THEN {value} END"

    return _view(_events(spark, sf_dir), {
        "entity_id": sometimes(_tag("REQ-", "user_id"), 10),
        "domain": _pick("event_id % 3", ("CYBER", "SIGINT", "EMBM")),
        "action": _pick(f"(event_id div 3) % {len(REQUESTED)}", REQUESTED),
        "operator": sometimes(_tag("OP-", "event_id % 5"), 4),
        "source_ip": sometimes(_tag("192.0.2.", "event_id % 256"), 5),
        "target_system": sometimes(_pick("event_id % 3", ("MAIL", "VPN", "HISTORIAN")), 6),
        "severity": sometimes(LEVEL, 7),
        "frequency_band": sometimes(_pick("event_id % 2", ("L-BAND", "S-BAND")), 8),
        "epoch_ms": MILLIS,
        "seq": "event_id",
    })


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with their networks, from the supplier table."""
    return _view(load(spark, sf_dir, "supplier"), {
        "facility_id": _tag("FAC-", "s_suppkey"),
        "name": "s_name",
        "type": _pick("s_suppkey % 3", ("AIR_BASE", "PORT", "DEPOT")),
        "region": _tag("REGION-", "s_suppkey % 5"),
        "country": _tag("N", "s_nationkey"),
        "lat": f"-20D + {_dbl('s_suppkey % 400')} / 10D",
        "lon": f"-60D + {_dbl('s_suppkey % 900')} / 10D",
        "networks": f"array('NET-A', {_tag('NET-', 's_suppkey % 4')})",
    })


def external_messages(spark: SparkSession, sf_dir: str, feed: str) -> DataFrame:
    """Every event as a message of an external feed. Some have a time that is none."""
    known = FEEDS[feed]
    whole = "date_format(ts, 'SSSSSS') = '000000'"
    iso = f"CASE WHEN {whole} THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") END"
    values = {
        "string": "concat('{name}-', cast(event_id % 97 AS string))", "double": "value", "int": "cast(event_id % 1000 AS int)",
        TIME: f"CASE WHEN event_id % 11 = 0 THEN 'not a time' ELSE {iso} END",
    }
    body = ", ".join(f"{values[kind].replace('{name}', name)} AS {name}" for name, kind in known.fields)
    return load(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", f"concat('{known.topic}/', cast(user_id AS string)) AS topic", f"to_json(struct({body})) AS value"
    )
