"""Zone maps, caches with fallback keys, and state that expires."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from gridlark.operators import state as S
from gridlark.plans import catalog
from gridlark.sources import sinks
from gridlark.sources.zones import ZoneMap, from_millis, to_millis
from gridlark.streaming import entities

EVENT = "event_id bigint, ts timestamp_ntz, event_type string"
START = datetime(2024, 1, 1)


def day(n, rows=20):
    return [(n * 100 + i, START + timedelta(days=n, minutes=i), "click" if i % 4 else "view") for i in range(rows)]


@pytest.fixture
def table(spark, tmp_path):
    """Ten files, one for each day; the last one has no views."""
    path = f"{tmp_path}/events.parquet"
    for n in range(10):
        rows = [r for r in day(n) if n < 9 or r[2] == "click"]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
    return path


def zone_map(spark, table, tmp_path):
    return ZoneMap(spark, table, f"{tmp_path}/zones", "ts", "event_type", EVENT).refresh()


def test_a_recent_read_opens_the_files_it_needs(spark, table, tmp_path):
    zones = zone_map(spark, table, tmp_path)
    newest = zones.newest()
    assert newest == START + timedelta(days=9, minutes=19) and zones.newest(["view"]) == START + timedelta(days=8, minutes=16)
    rows = zones.since(newest - timedelta(hours=24))
    assert len(rows.inputFiles()) == 2 and rows.count() == 16  # day 8's last minute and day 9
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and plan.count("FileScan") == 1
    views = zones.since(newest - timedelta(hours=30), ["view"])
    assert len(views.inputFiles()) == 1 and {r["event_type"] for r in views.collect()} <= {"view"}
    assert zones.since(newest + timedelta(days=1)).count() == 0


def test_only_new_files_are_scanned(spark, table, tmp_path):
    zones = zone_map(spark, table, tmp_path)
    before = len(spark.read.parquet(f"{tmp_path}/zones").inputFiles())
    assert zones.refresh() and len(spark.read.parquet(f"{tmp_path}/zones").inputFiles()) == before
    spark.createDataFrame(day(12), EVENT).coalesce(1).write.mode("append").parquet(table)
    assert zones.newest() == START + timedelta(days=9, minutes=19)
    assert zones.refresh().newest() == START + timedelta(days=12, minutes=19)
    assert spark.read.parquet(f"{tmp_path}/zones").groupBy("file").count().count() == 11
    spark.createDataFrame(day(1), EVENT).coalesce(1).write.mode("overwrite").parquet(table)
    assert zones.refresh().newest() == START + timedelta(days=1, minutes=19)


@pytest.mark.parametrize("hours", [1, 24, 24 * 3, 24 * 30])
def test_counts_come_from_the_map(spark, table, tmp_path, hours):
    zones = zone_map(spark, table, tmp_path)
    least = zones.newest() - timedelta(hours=hours)
    counted = zones.count_since(least)
    assert counted.first()["recent"] == spark.read.parquet(table).where(F.col("ts") >= F.lit(least).cast("timestamp_ntz")).count()
    assert len(counted.inputFiles()) <= 1  # at most the file that the limit cuts
    assert zones.count_since(least, ["view"]).first()["recent"] == spark.read.parquet(table).where((F.col("ts") >= F.lit(least).cast("timestamp_ntz")) & (F.col("event_type") == "view")).count()


def test_an_empty_table_has_no_zones(spark, tmp_path):
    spark.createDataFrame([], EVENT).write.parquet(f"{tmp_path}/events.parquet")
    zones = zone_map(spark, f"{tmp_path}/events.parquet", tmp_path)
    assert zones.newest() is None and zones.since(START).count() == 0 and zones.count_since(START).first()["recent"] == 0


def test_millis():
    assert to_millis(from_millis(1_700_000_000_123)) == 1_700_000_000_123
    assert to_millis(datetime(1969, 12, 31, 23, 59, 59, 999_500)) == -1


def test_registered_reads_scan_the_facts_once(spark):
    for name in ("state_fresh_gps", "state_fresh_cyber_day", "agg_recent_count"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 1 and "Subquery" not in plan
    gps = catalog.QUERIES["state_fresh_gps"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in gps


def test_records_without_an_id_have_other_keys(make):
    cyber = make("cyber", [{"incident_id": "C1", "timestamp": 5}, {"source_ip": "1.2.3.4", "timestamp": 6}, {"incident_id": "", "timestamp": 6}])
    assert [r[0] for r in cyber.orderBy("seq").select(S.cache_key("cyber")).collect()] == ["C1", "1.2.3.4_6", "unknown_6"]
    sigint = make("sigint", [{"intercept_id": None, "collector_id": "K", "frequency_mhz": 9.5, "timestamp": 1}, {"timestamp": 2}])
    assert [r[0] for r in sigint.orderBy("seq").select(S.cache_key("sigint")).collect()] == ["K_9.5", "unknown_"]
    gps = make("gps", [{"unit_id": None, "timestamp": 9}, {"unit_id": "", "timestamp": 9}, {"unit_id": "U", "timestamp": 9}])
    assert [r["unit_id"] for r in S.state_fresh(gps, S.cache_key("gps"), 60, 9).collect()] == ["U"]


def test_fresh_or_recent_decides_when_it_runs(spark, make):
    gps = make("gps", [{"unit_id": "U", "timestamp": 1000}, {"unit_id": "V", "timestamp": 70_000}])
    old = make("gps", [{"unit_id": f"F{i}", "timestamp": i} for i in range(9)])
    assert {r["unit_id"] for r in S.state_fresh_or_recent(gps, "unit_id", 60, 70_500, old, 3).collect()} == {"V"}
    assert {r["unit_id"] for r in S.state_fresh_or_recent(gps, "unit_id", 60, 990_000, old, 3).collect()} == {"F6", "F7", "F8"}


# --- streams -------------------------------------------------------------------------------------------------------------
REPORT = "unit_id string, timestamp long, seq long"


def test_an_entity_expires_and_comes_back(spark):
    """Four deliveries: unit A falls silent, expires while B goes on, and reports again."""
    minute, zero = 60_000, 1_700_000_000_000
    parts = [[("A", 0, 1), ("B", 0, 2), (None, 0, 3)], [("B", 5 * minute, 4), ("A", -1, 5)], [("B", 20 * minute, 6)], [("A", 21 * minute, 7)]]
    parts = [[(unit, zero + at, seq) for unit, at, seq in part] for part in parts]
    deliveries = [spark.createDataFrame(rows, REPORT) for rows in parts]

    def build(stream):
        timed = stream.withColumn("ts", F.timestamp_millis("timestamp")).withWatermark("ts", "1 minute")
        return entities.fresh_changes(timed, F.col("unit_id"), ["unit_id", "timestamp", "seq"], 600)

    path = entities.run_deliveries(spark, deliveries, build, entities.ENTITY, ("timestamp", "seq", entities.STATUS), 2)
    log = spark.read.parquet(path)
    seen = sorted((r["entity"], r["timestamp"] - zero, r["status"]) for r in log.collect())
    assert ("A", 0, "CURRENT") in seen and ("A", 0, "EXPIRED") in seen and ("A", 21 * minute, "CURRENT") in seen
    assert not any(r[1] == -1 or r[0] is None for r in seen)
    final = sinks.read_upserted(spark, path, entities.ENTITY, ("timestamp", "seq", entities.STATUS))
    assert {(r["entity"], r["status"]) for r in final.collect()} == {("A", "CURRENT"), ("B", "CURRENT")}


def test_changes_older_than_the_snapshot_are_dropped(spark):
    schema = "doc_id string, value string, change long"
    snapshot = spark.createDataFrame([("a", "s", 10), ("b", "s", 10)], schema)
    first = spark.createDataFrame([("a", "old", 9), ("a", "new", 11), ("c", "c1", 1), ("b", "same", 10)], schema)
    second = spark.createDataFrame([("a", "late", 10), ("c", "c2", 2), ("b", "b1", 30), ("b", "b0", 20)], schema)
    build = lambda stream: entities.changes_after_snapshot(stream, snapshot, "doc_id", "change")
    path = entities.run_deliveries(spark, [first, second], build, "doc_id", ("change",), 2)
    assert sorted((r["doc_id"], r["value"]) for r in spark.read.parquet(path).collect()) == [("a", "new"), ("b", "b1"), ("c", "c1"), ("c", "c2")]
