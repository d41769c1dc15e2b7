import pytest
from pyspark.sql import functions as F

from gridlark.operators import derive as D
from gridlark.operators import enrich as N
from gridlark.operators import joins as J
from gridlark.operators import state as S
from gridlark.operators import windows as W
from gridlark.sources import feeds

from conftest import DATA


def test_latest_ignores_null_per_column(make):
    rows = [
        {"unit_id": "A", "timestamp": 10, "unit_name": "old", "lat": 1.0},
        {"unit_id": "A", "timestamp": 20, "unit_name": None, "lat": 2.0},
        {"unit_id": "A", "timestamp": 20, "unit_name": None, "lat": 3.0},
        {"unit_id": "B", "timestamp": 5},
    ]
    got = {r["unit_id"]: r for r in S.gps_latest(make("gps", rows)).collect()}
    assert (got["A"]["unit_name"], got["A"]["lat"], got["A"]["last_update"]) == ("old", 3.0, 20)
    assert got["B"]["unit_name"] is None
    whole = {r["unit_id"]: r for r in S.latest_record(make("gps", rows), "unit_id").collect()}
    assert (whole["A"]["unit_name"], whole["A"]["lat"]) == (None, 3.0)


def test_gps_join_matches_by_message_key(make):
    gps = make("gps", [
        {"unit_id": "AC-1", "timestamp": 1, "lat": 9.0, "lon": 8.0},
        {"unit_id": "1", "timestamp": 2, "lat": 7.0, "lon": 7.0},
        {"unit_id": "SHIP-1", "timestamp": 2, "lat": 6.0, "lon": 6.0},
    ])
    planes = make("aircraft", [{"aircraft_id": i, "lat": 1.0, "lon": 1.0} for i in ("1", "2", None)])
    got = J.aircraft_with_gps(planes, S.gps_latest(gps)).orderBy(F.asc_nulls_last("aircraft_id")).collect()
    assert [(r["final_lat"], r["position_source"]) for r in got] == [
        (9.0, "GPS_VERIFIED"), (1.0, "RADAR_ONLY"), (1.0, "RADAR_ONLY"),
    ]
    assert got[2]["gps_key"] is None


def test_track_filters_and_units(make):
    gps = make("gps", [{"unit_id": u, "lat": 44.0, "lon": 36.0} for u in ("AC-1", "SHIP-1", "FAC-1", "US-1", "X")])
    assert {r["track_id"] for r in J.ground_tracks(gps).collect()} == {"US-1", "X"}


def _picture_inputs(make):
    minute = 60_000
    unit = {"unit_id": "U", "lat": 44.0, "lon": 35.0, "fuel_level_pct": 80.0, "ammo_level_pct": 80.0,
            "equipment_status": "FULLY_OPERATIONAL", "comms_status": "NOMINAL", "mission_status": "ENGAGED"}
    gps = make("gps", [{**unit, "timestamp": t} for t in (0, 5 * minute - 1, 5 * minute, 11 * minute)])
    signal = {"intercept_id": "S", "lat": 44.0, "lon": 35.0, "threat_level": "CRITICAL", "signal_strength_dbm": -40.0,
              "emitter_classification": "A-RADAR"}
    sig = make("sigint", [{**signal, "timestamp": 5 * minute}], "classic")
    return gps, sig


def test_windows_start_on_the_boundary(make):
    gps, _ = _picture_inputs(make)
    force = W.flatten_window(W.grid_force(N.enrich_gps(W.with_event_time(gps), "classic")))
    assert [(r["window_start"], r["unit_count"]) for r in force.orderBy("window_start").collect()] == [
        (0, 2), (300_000, 1), (600_000, 1),
    ]


def test_threat_join_never_crosses_windows(make):
    gps, sig = _picture_inputs(make)
    threats = W.active_threats(N.enrich_sigint(W.with_event_time(sig), "classic"))
    zone = J.units_in_threat(N.enrich_gps(W.with_event_time(gps), "classic"), threats)
    assert [r["timestamp"] for r in zone.collect()] == [300_000]


def test_picture_keeps_windows_without_threats(make):
    gps, sig = _picture_inputs(make)
    force = W.grid_force(N.enrich_gps(W.with_event_time(gps), "classic"))
    threat = W.grid_threat(N.enrich_sigint(W.with_event_time(sig), "classic"))
    isr = W.grid_isr(N.enrich_satellite(W.with_event_time(make("satellite", [], "classic")), "classic"))
    got = W.flatten_window(J.operational_picture(force, threat, isr)).orderBy("window_start").collect()
    assert [(r["grid_status"], r["threat_intercepts"], r["isr_images"]) for r in got] == [
        ("STABLE", 0, 0), ("ACTIVE_COMBAT", 1, 0), ("STABLE", 0, 0),
    ]


def test_merge_keeps_first_source(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "x", 4)], "id int, v string, timestamp int")
    b = spark.createDataFrame([(1, "y", 9), (2, "z", 9), (None, "n", 1)], "id int, v string, timestamp int")
    got = S.merge_first_wins([a, b], S.composite_key("id"))
    assert sorted((str(r["id"]), r["v"], r["timestamp"]) for r in got.collect()) == [
        ("1", "x", 4), ("2", "z", 9), ("None", "n", 1),
    ]


def test_fresh_is_strict_and_falls_back(make):
    rows = [{"aircraft_id": "a", "timestamp": 1000}, {"aircraft_id": "b", "timestamp": 2000}]
    df = make("aircraft", rows)
    assert {r["aircraft_id"] for r in S.state_fresh(df, "aircraft_id", 30, 31_000).collect()} == {"b"}
    assert S.state_fresh_or_recent(df, "aircraft_id", 30, 31_000, df, 50).count() == 1
    fallback = S.state_fresh_or_recent(df, "aircraft_id", 30, 99_000, df, 1).collect()
    assert [r["aircraft_id"] for r in fallback] == ["b"]


def test_log_limits_before_it_filters(spark):
    log = spark.createDataFrame(
        [(i, i, "CYBER" if i % 2 else "EMBM") for i in range(10)], "epoch_ms bigint, seq bigint, domain string"
    )
    got = S.log_last_n(log, 3, "cyber").collect()
    assert [(r["epoch_ms"], r["total"]) for r in got] == [(9, 10), (7, 10)]


def test_hull_type(spark):
    names = ["Ship (DDG)", "A (B) (LHD)", "Plain", "Odd (X) y", "Empty ()", "Open (FFH", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(D.derive_hull_type(F.col("n"))).collect()]
    expected = [n.split("(")[-1].rstrip(")") if n and "(" in n else "FFG" for n in names]
    assert got == expected


def test_synthetic_ids_only_where_the_column_is_absent(spark):
    df = spark.createDataFrame([("PHISHING", 5, "10.0.0.1")], "attack_type string, timestamp bigint, source_ip string")
    import hashlib

    expected = "CY-" + hashlib.md5(b"510.0.0.1").hexdigest()[:8]
    assert D.synth_ids(df).first()["incident_id"] == expected
    kept = df.withColumn("incident_id", F.lit(None).cast("string"))
    assert D.synth_ids(kept).first()["incident_id"] is None


@pytest.fixture
def tight(spark):
    """Settings under which small data is skewed and never broadcast."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_key_is_split(spark, tight):
    """Half of all incidents hit one facility: the join must split that partition and lose nothing."""
    events = spark.read.parquet(f"{DATA}/events.parquet").repartition(8)
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, 2).otherwise(F.col("user_id")).cast("bigint"))
    joined = J.cyber_with_gps(feeds.cyber_view(hot), S.gps_latest(feeds.gps_view(hot)))
    assert len(joined.collect()) == events.count()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_picture_has_one_exchange_per_input(spark, tight):
    from gridlark.plans.pictures import Domain

    plan = Domain(spark, DATA, "classic").operational_picture()._jdf.queryExecution().executedPlan().toString()
    # force, threat, and two steps of the distinct count of imagery
    assert plan.count("Exchange hashpartitioning") == 4


def test_alerts_scan_each_source_once(spark):
    from gridlark.plans.pictures import Domain

    plan = Domain(spark, DATA, "current").all_alerts()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4


def test_breakout_filter_reaches_the_scan(spark):
    from gridlark.operators import alerts as A
    from gridlark.plans.pictures import Domain

    plan = A.breakout(Domain(spark, DATA, "current").sigint, "air_defense")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,signup)" in plan
    assert "user_id" not in plan.split("ReadSchema:")[1].split("\n")[0]
