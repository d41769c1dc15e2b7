"""Both sides of every threshold, every category with a stranger, and NULL."""

import pytest
from pyspark.sql import functions as F

from gridlark.functions.geo import grid_square
from gridlark.functions.numbers import round_stat
from gridlark.functions.text import template
from gridlark.operators import alerts as A
from gridlark.operators import enrich as N
from gridlark.operators import state as S
from gridlark.plans.profiles import ALERTS


def values(df, column, key="seq"):
    return [r[column] for r in df.orderBy(key).collect()]


UNIT = {
    "unit_id": "U1", "unit_name": "Unit", "unit_type": "ARMOR", "timestamp": 1000, "lat": 44.0, "lon": 36.0,
    "fuel_level_pct": 80.0, "ammo_level_pct": 80.0, "equipment_status": "FULLY_OPERATIONAL",
    "comms_status": "NOMINAL", "mission_status": "PATROL", "fuel_consumption_rate": 10.0, "personnel_count": 5,
}


def units(make, column, cases, **base):
    return make("gps", [{**UNIT, **base, column: c} for c in cases])


def cell(spark, lat, lon, scheme):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    return df.select(grid_square("lat", "lon", scheme)).first()[0]


@pytest.mark.parametrize(
    "lat, lon, band, degree, five",
    [
        (44.24, 35.74, "33TWM", "4435", "GRID-8-7"),
        (44.25, 35.75, "33TXN", "4435", "GRID-8-7"),
        (44.26, 36.25, "33TYN", "4436", "GRID-8-7"),
        (-0.5, -12.9, "33TWM", "0-12", "GRID-0--2"),
        (1.0, 23.0, "33TWM", "123", "GRID-0-4"),
        (12.0, 3.0, "33TWM", "123", "GRID-2-0"),
    ],
)
def test_grid(spark, lat, lon, band, degree, five):
    assert [cell(spark, lat, lon, s) for s in ("band", "degree", "five_degree")] == [band, degree, five]


def test_grid_null(spark):
    assert cell(spark, None, 36.0, "degree") is None
    assert cell(spark, None, 36.0, "five_degree") is None
    assert cell(spark, None, None, "band") == "33TYN"


def test_effectiveness_classic(make):
    df = units(make, "fuel_level_pct", [14.9, 15.0, 15.1, 29.9, 30.0, None])
    assert values(N.enrich_gps(df, "classic"), "combat_effectiveness") == [
        "CRITICAL", "DEGRADED", "DEGRADED", "DEGRADED", "COMBAT_READY", "COMBAT_READY",
    ]
    df = units(make, "equipment_status", ["NON_OPERATIONAL", "STRANGER", None], fuel_level_pct=1.0)
    assert values(N.enrich_gps(df, "classic"), "combat_effectiveness") == ["NOT_COMBAT_READY", "CRITICAL", "CRITICAL"]
    df = units(make, "comms_status", ["OFFLINE", "DEGRADED", None])
    assert values(N.enrich_gps(df, "classic"), "combat_effectiveness") == ["DEGRADED", "COMBAT_READY", "COMBAT_READY"]


def test_effectiveness_current_and_clean(make):
    df = units(make, "ammo_level_pct", [50.0, 49.9, 25.0, 24.9, None])
    assert values(N.enrich_gps(df, "current"), "combat_effectiveness") == [
        "COMBAT_READY", "DEGRADED", "DEGRADED", "CRITICAL", "CRITICAL",
    ]
    df = units(make, "ammo_level_pct", [14.9, 15.0, 30.0])
    assert values(N.enrich_gps(df, "clean"), "combat_effectiveness") == ["CRITICAL", "DEGRADED", "COMBAT_READY"]


def test_readiness(make):
    df = units(
        make, "equipment_status", ["FULLY_OPERATIONAL", "DEGRADED", "MAINTENANCE_REQUIRED", "NON_OPERATIONAL", None]
    )
    assert values(N.enrich_gps(df, "classic"), "readiness_score") == [88.0, 78.0, 70.5, 65.5, 65.5]
    assert values(N.enrich_gps(df, "current"), "readiness_score") == [88.0] * 5
    assert values(N.enrich_gps(df, "clean"), "readiness_score") == [84.0, 69.0, 69.0, 69.0, 69.0]
    df = units(make, "comms_status", ["NOMINAL", "DEGRADED", "OFFLINE", None])
    assert values(N.enrich_gps(df, "classic"), "readiness_score") == [88.0, 80.5, 73.0, 73.0]


def test_endurance_with_no_consumption(make):
    df = units(make, "fuel_consumption_rate", [0.0, -1.0, None, 10.0])
    assert values(N.enrich_gps(df, "classic"), "fuel_hours_remaining") == [999.0, 999.0, 999.0, 80.0]
    assert values(N.enrich_gps(df, "current"), "predicted_fuel_hours") == [999.0, 999.0, 999.0, 8.0]


def fired(df, profile, name):
    return {r["seq"]: r["severity"] for r in A.alert(df, _with_seq(ALERTS[profile][name])).collect()}


def _with_seq(rule):
    from dataclasses import replace

    return replace(rule, keep=(*rule.keep, "seq"))


@pytest.mark.parametrize(
    "profile, expected",
    [
        ("classic", ["CRITICAL", "HIGH", "HIGH", "WARNING", "WARNING", None, None, None]),
        ("deploy", ["CRITICAL", "HIGH", "HIGH", "WARNING", "WARNING", None, None, None]),
    ],
)
def test_fuel_level_tiers(make, profile, expected):
    df = units(make, "fuel_level_pct", [9.9, 10.0, 14.9, 15.0, 19.9, 20.0, 20.1, None], fuel_consumption_rate=0.0)
    got = fired(N.enrich_gps(df, profile), profile, "fuel")
    assert [got.get(i) for i in range(8)] == expected


def test_fuel_hours_tiers(make):
    # hours = level * 10 / rate with a level of 50
    rates = [250.1, 250.0, 166.7, 166.6, 125.1, 125.0]
    df = units(make, "fuel_consumption_rate", rates, fuel_level_pct=50.0)
    hours = values(N.enrich_gps(df, "classic"), "fuel_hours_remaining")
    assert hours == [2.0, 2.0, 3.0, 3.0, 4.0, 4.0]
    df = units(make, "fuel_consumption_rate", [300.0, 250.0, 170.0, 160.0, 130.0, 120.0], fuel_level_pct=50.0)
    got = fired(N.enrich_gps(df, "classic"), "classic", "fuel")
    assert [got.get(i) for i in range(6)] == ["CRITICAL", "HIGH", "HIGH", "WARNING", "WARNING", None]
    got = fired(N.enrich_gps(df, "deploy"), "deploy", "fuel")
    assert [got.get(i) for i in range(6)] == ["CRITICAL", "WARNING", "WARNING", "WARNING", "WARNING", None]


def test_fuel_current(make):
    df = units(make, "fuel_level_pct", [19.9, 20.0, 39.9, 40.0, 59.9, 60.0])
    got = fired(N.enrich_gps(df, "current"), "current", "fuel")
    assert [got.get(i) for i in range(6)] == ["CRITICAL", "HIGH", "HIGH", "WARNING", "WARNING", None]


def test_ammo(make):
    df = units(make, "ammo_level_pct", [9.9, 10.0, 19.9, 20.0, 24.9, 25.0, None], mission_status="PATROL")
    got = fired(N.enrich_gps(df, "classic"), "classic", "ammo")
    assert [got.get(i) for i in range(7)] == ["CRITICAL", "HIGH", "HIGH", "WARNING", "WARNING", None, None]
    assert fired(N.enrich_gps(df, "setup"), "setup", "ammo") == {}
    assert fired(N.enrich_gps(df, "current"), "current", "ammo") == {}
    df = units(make, "mission_status", ["ENGAGED", "DEFENSIVE", "PATROL", None], ammo_level_pct=14.9)
    assert fired(N.enrich_gps(df, "setup"), "setup", "ammo") == {0: "HIGH", 1: "HIGH"}
    assert fired(N.enrich_gps(df, "current"), "current", "ammo") == {0: "CRITICAL"}


def test_equipment_and_comms(make):
    df = units(
        make, "equipment_status", ["NON_OPERATIONAL", "MAINTENANCE_REQUIRED", "DEGRADED", "FULLY_OPERATIONAL", None]
    )
    assert fired(N.enrich_gps(df, "classic"), "classic", "equipment") == {0: "CRITICAL", 1: "HIGH", 2: "WARNING"}
    assert fired(N.enrich_gps(df, "current"), "current", "equipment") == {0: "CRITICAL", 1: "HIGH"}
    df = units(make, "comms_status", ["OFFLINE", "DEGRADED", "JAMMING_DETECTED", "NOMINAL", None])
    assert fired(N.enrich_gps(df, "classic"), "classic", "comms") == {0: "CRITICAL", 1: "HIGH", 2: "WARNING"}
    assert fired(N.enrich_gps(df, "current"), "current", "comms") == {0: "CRITICAL", 1: "WARNING"}


def test_low_readiness_edges(spark):
    base = spark.createDataFrame(
        [(i, s) for i, s in enumerate([29.9, 30.0, 39.9, 40.0, 49.9, 50.0, 59.9, 60.0])], "seq bigint, readiness_score double"
    )
    df = base.select(
        "*", *[F.lit("x").alias(c) for c in ("unit_id", "unit_name", "unit_type", "grid_square", "combat_effectiveness",
                                             "equipment_status")],
        *[F.lit(1.0).alias(c) for c in ("fuel_level_pct", "ammo_level_pct", "lat", "lon")], F.lit(1).alias("timestamp"),
    )
    classic = fired(df, "classic", "low_readiness")
    assert [classic.get(i) for i in range(8)] == ["CRITICAL", "HIGH", "HIGH", "HIGH", "HIGH", "WARNING", "WARNING", None]
    current = fired(df, "current", "low_readiness")
    assert [current.get(i) for i in range(8)] == ["CRITICAL", "HIGH", "HIGH", "WARNING", "WARNING", None, None, None]


SIGNAL = {
    "intercept_id": "S", "timestamp": 1, "lat": 44.0, "lon": 36.0, "confidence_pct": 50.0, "signal_type": "RADAR",
    "signal_strength_dbm": -60.0, "emitter_classification": "XX-RADAR", "threat_level": "HIGH", "frequency_mhz": 1.0,
}


def signals(make, column, cases, profile="current", **base):
    return N.enrich_sigint(make("sigint", [{**SIGNAL, **base, column: c} for c in cases], profile), profile)


def test_signal_scores(make):
    levels = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "STRANGER", None]
    assert values(signals(make, "threat_level", levels), "threat_score") == [100, 75, 50, 25, 25, 25]
    assert values(signals(make, "threat_level", levels, "clean"), "threat_score") == [100, 75, 25, 25, 25, 25]


def test_air_defense(make):
    names = ["A-RADAR", "A-SAM", "A-S-300", "A-S-400", "A-SA-10", "radar", None]
    assert values(signals(make, "emitter_classification", names), "is_air_defense") == [
        True, True, True, True, False, False, False,
    ]
    assert values(signals(make, "emitter_classification", names, "classic"), "is_air_defense") == [
        True, False, False, False, True, False, False,
    ]
    assert values(signals(make, "emitter_classification", names, "clean"), "is_air_defense") == [
        True, False, False, False, False, False, False,
    ]


def test_signal_labels_and_quality(make):
    dbm = [-49.9, -50.0, -69.9, -70.0, None]
    assert values(signals(make, "signal_strength_dbm", dbm, "classic"), "signal_quality") == [
        "STRONG", "MODERATE", "MODERATE", "WEAK", "WEAK",
    ]
    assert values(signals(make, "signal_strength_dbm", [-60.0, None]), "signal_quality") == [-30.0, None]


def test_threat_radar_edges(make):
    dbm = [-69.9, -70.0, -79.9, -80.0]
    got = fired(signals(make, "signal_strength_dbm", dbm), "current", "threat_radar")
    assert got == {0: "HIGH"}
    got = fired(signals(make, "signal_strength_dbm", [-49.0, *dbm], "classic"), "classic", "threat_radar")
    assert got == {0: "CRITICAL", 1: "HIGH", 2: "HIGH", 3: "HIGH"}
    got = fired(signals(make, "threat_level", ["CRITICAL", "MEDIUM", None], "classic"), "classic", "threat_radar")
    assert got == {0: "CRITICAL"}


IMAGE = {
    "image_id": "I", "timestamp": 1, "center_lat": 44.0, "center_lon": 36.0, "resolution_m": 1.0,
    "cloud_cover_pct": 0.0, "quality_score": 0.9,
}


def images(make, column, cases, profile="current", **base):
    return N.enrich_satellite(make("satellite", [{**IMAGE, **base, column: c} for c in cases], profile), profile)


def test_imagery(make):
    got = values(images(make, "resolution_m", [1.0, 1.1, 5.0, 5.1, 0.0], "classic"), "isr_effectiveness")
    assert got == [90.0, 63.0, 63.0, 36.0, 90.0]
    assert values(images(make, "resolution_m", [0.0, 2.0]), "isr_effectiveness") == [None, 450.0]
    cloud = [70.0, 70.1, 40.0, 40.1]
    assert values(images(make, "cloud_cover_pct", cloud, "setup"), "coverage_quality") == [
        "MODERATE", "POOR", "GOOD", "MODERATE",
    ]
    quality = [0.59, 0.6]
    assert values(images(make, "quality_score", quality, "classic"), "coverage_quality") == ["MODERATE", "GOOD"]
    assert values(images(make, "quality_score", quality, "setup"), "coverage_quality") == ["GOOD", "GOOD"]


def test_pass_quality_and_coverage_alert(make):
    df = N.enrich_satellite_pass(images(make, "cloud_cover_pct", [19.9, 20.0, 49.9, 50.0, None], quality_score=0.71))
    assert values(df, "collection_quality") == ["OPTIMAL", "USABLE", "USABLE", "DEGRADED", "DEGRADED"]
    df = N.enrich_satellite_pass(images(make, "quality_score", [0.7, 0.71]))
    assert values(df, "collection_quality") == ["USABLE", "OPTIMAL"]
    df = images(make, "cloud_cover_pct", [80.0, 80.1], resolution_m=0.01)
    assert values(A.breakout(df, "coverage_alerts"), "seq") == [1]


def test_jsir(make):
    base = {"incident_id": "J", "timestamp": 1, "jammer_lat": 1.0, "jammer_lon": 2.0}
    impacts = ["COMMS_DENIED", "MISSION_ABORT", "DEGRADED_COMMS", "REDUCED_BANDWIDTH", "MINIMAL_IMPACT", "STRANGER", None]
    df = N.enrich_jsir(make("jsir", [{**base, "mission_impact": i, "cep_km": 3.1} for i in impacts]))
    assert values(df, "severity") == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "LOW"]
    assert values(df, "recommended_response")[:3] == [
        "ADDITIONAL_GEOLOCATION_REQUIRED", "ADDITIONAL_GEOLOCATION_REQUIRED", "FREQUENCY_HOP_AND_MONITOR",
    ]
    assert values(df, "recommended_response")[-1] == "CONTINUE_MONITORING"
    df = N.enrich_jsir(
        make("jsir", [{**base, "mission_impact": "COMMS_DENIED", "cep_km": c} for c in (1.0, 1.1, 3.0, 3.1, 5.0, 5.1, None)])
    )
    assert values(df, "strike_viability") == [
        "PRECISION_STRIKE_VIABLE", "AREA_STRIKE_VIABLE", "AREA_STRIKE_VIABLE", "REQUIRES_REFINEMENT",
        "REQUIRES_REFINEMENT", "GEOLOCATION_INSUFFICIENT", "GEOLOCATION_INSUFFICIENT",
    ]
    assert values(df, "recommended_response")[2] == "KINETIC_STRIKE_RECOMMENDED"
    assert values(df, "recommended_response")[-1] == "ADDITIONAL_GEOLOCATION_REQUIRED"


def test_aircraft(make):
    base = {"aircraft_id": "1", "tail_number": "1", "timestamp": 1, "lat": 1.0, "lon": 1.0}
    roles = ["STEALTH", "STRATEGIC_BOMBER", "MULTIROLE", "ATTACK_HELO", "STRANGER", None]
    rows = [{**base, "role": r} for r in roles]
    assert values(N.enrich_aircraft(make("aircraft", rows, "setup"), "setup"), "computed_threat") == [
        "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW",
    ]
    assert values(N.enrich_aircraft(make("aircraft", rows), "clean"), "computed_threat") == [
        "HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM",
    ]
    rows = [{**base, "status": s, "iff_mode": "HOSTILE", "role": "BOMBER"} for s in
            ("INTERCEPT", "STRIKE", "ATTACK", "PATROL", "RECON", "ESCORT", None)]
    current = fired(N.enrich_aircraft(make("aircraft", rows), "current"), "current", "hostile_aircraft")
    assert current == {0: "CRITICAL", 1: "CRITICAL", 2: "CRITICAL", 3: "HIGH"}
    setup = fired(N.enrich_aircraft(make("aircraft", rows, "setup"), "setup"), "setup", "hostile_aircraft")
    assert setup == {0: "CRITICAL", 1: "CRITICAL", 3: "HIGH", 4: "HIGH"}


def test_one_pass_equals_union(make):
    rows = [
        {**UNIT, "unit_id": f"U{i}", "fuel_level_pct": float(i), "ammo_level_pct": float(100 - i), "comms_status": c,
         "equipment_status": e}
        for i in range(0, 100, 7)
        for c in ("NOMINAL", "OFFLINE", None)
        for e in ("DEGRADED", "NON_OPERATIONAL")
    ]
    df = N.enrich_gps(make("gps", rows), "classic")
    rules = [r for r in ALERTS["classic"].values() if r.source == "gps"]
    one = A.alerts_one_pass(df, rules)
    union = A.alerts_by_union(df, rules)
    assert one.columns == list(A.ALERT_COLUMNS)
    assert sorted(map(str, one.collect())) == sorted(map(str, union.collect()))
    assert one.count() == sum(A.alert(df, r).count() for r in rules)


def test_message_skips_null_and_formats(spark):
    df = spark.createDataFrame([("a", None, 12.345, 1234567)], "x string, y string, z double, n int")
    text = df.select(template("{x}/{y}/{y|none}/{z:r1}/{z:whole}/{z:trunc}/{z:f2}/{n:grouped}")).first()[0]
    assert text == "a//none/12.3/12/12/12.35/1,234,567"


def test_round_stat_is_order_free(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (56.85,)], "x double")
    up = df.orderBy("x").agg(round_stat(F.avg("x"), 1)).first()[0]
    down = df.orderBy(F.desc("x")).agg(round_stat(F.avg("x"), 1)).first()[0]
    assert up == down


def test_rollup_of_nothing_is_zero(make):
    empty = S.latest_record(make("gps", [{**UNIT, "unit_id": "AC-1"}]), "unit_id")
    assert S.readiness_rollup(empty).first().asDict() == {
        "overall": 0.0, "fuel_avg": 0.0, "ammo_avg": 0.0, "comms_up_pct": 0.0, "equip_ok_pct": 0.0,
        "friendly_count": 0, "total_tracked": 1,
    }
    missing = S.latest_record(make("gps", [{"unit_id": "US-1", "timestamp": 1}]), "unit_id")
    assert S.readiness_rollup(missing).first()["fuel_avg"] == 50.0


def test_supply_grades(spark):
    df = spark.createDataFrame([(60, 100), (61, 100), (301, 1000), (30, 100), (604, 1000), (5, 0)], "on_hand int, max_capacity int")
    exact = [r["status"] for r in S.supply_status(df).collect()]
    rounded = [r["status"] for r in S.supply_status(df, rounded=True).collect()]
    assert exact == ["AMBER", "GREEN", "AMBER", "RED", "GREEN", "RED"]
    assert rounded == ["AMBER", "GREEN", "RED", "RED", "AMBER", "RED"]


def test_a_value_is_rounded_once(spark):
    df = spark.createDataFrame([(0.0499999999,), (0.25,), (-0.05,)], "x double")
    assert [r[0] for r in df.select(round_stat(F.col("x"), 1)).collect()] == [0.0, 0.3, -0.1]
