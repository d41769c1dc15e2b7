import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import DATA
from gridlark.sources import sinks, tables, topics
from gridlark.sources.schemas import KEYS, TOPICS, stream_columns, stream_schema


def test_unknown_fields_dropped_missing_fields_null(spark):
    body = json.dumps({"unit_id": "7", "lat": 1.5, "surprise": [1, 2]})
    df = spark.createDataFrame([("AC-7", body, TOPICS["gps"])], "key string, value string, topic string")
    row = topics.parse_messages(df, stream_schema("gps"), KEYS["gps"]).first()
    assert (row["unit_id"], row["lat"], row["lon"]) == ("AC-7", 1.5, None)
    assert topics.parse_messages(df, stream_schema("gps")).first()["unit_id"] == "7"


def test_every_stream_has_key_and_schema():
    for stream in TOPICS:
        assert KEYS[stream] in stream_columns(stream)
        assert stream_schema(stream).fieldNames() == stream_columns(stream)


def test_bad_records_are_set_aside(spark):
    schema = T.StructType.fromDDL("a int, b string")
    rows = [(0, '{"a": 1, "b": "x"}'), (1, '{"a": 1'), (2, "nonsense"), (3, None), (4, '{"a": "word"}'), (5, "{}")]
    df = spark.createDataFrame(rows, "n int, value string")
    good, bad = topics.quarantine(df, schema, keep=("n",))
    assert sorted(r["n"] for r in good.collect()) == [0, 5]
    assert sorted(r["n"] for r in bad.collect()) == [1, 2, 3, 4]


def test_feed_files_and_topic_parts(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text('{"mmsi": "1", "lat": 2.0, "extra": 1}\n{"mmsi": "2"}\n')
    df = topics.read_feed(spark, str(tmp_path / "feed"), T.StructType.fromDDL("mmsi string, lat double"))
    assert sorted((r["mmsi"], r["lat"]) for r in df.collect()) == [("1", 2.0), ("2", None)]
    named = spark.createDataFrame([("mda/ais/vessel/9",), ("mda",)], "topic string")
    got = topics.feed_topic_parts(named).collect()
    assert (got[0]["feed"], got[0]["feed_kind"], got[0]["feed_key"]) == ("mda", "ais", "vessel")
    assert got[1]["feed_kind"] is None


def test_route_by_topic(spark):
    rows = [("k", '{"lat": 1.0}', TOPICS["gps"]), ("k", '{"lat": 2.0}', TOPICS["naval"]), ("k", "{}", "other")]
    df = spark.createDataFrame(rows, "key string, value string, topic string")
    parts = topics.route(df, ["gps", "naval"])
    assert [r["lat"] for r in parts["gps"].collect()] == [1.0]
    assert [r["lat"] for r in parts["naval"].collect()] == [2.0]


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, v int, t bigint")


def test_upsert_replay_and_out_of_order(spark, tmp_path):
    path = str(tmp_path / "u")
    write = sinks.upsert_sink(path, "id", ("t",))
    write(batch(spark, [("a", 1, 1), ("a", 2, 2), ("b", 1, 5)]), 0)
    write(batch(spark, [("b", 0, 4), ("c", 3, 1)]), 1)
    write(batch(spark, [("b", 0, 4), ("c", 3, 1)]), 1)
    got = sorted(tuple(r) for r in sinks.read_upserted(spark, path, "id", ("t",)).collect())
    assert got == [("a", 2, 2), ("b", 1, 5), ("c", 3, 1)]
    target = str(tmp_path / "compact")
    assert sinks.compact_upserts(spark, path, target, "id", ("t",)) == 1
    assert sorted(tuple(r) for r in sinks.read_upserted(spark, target, "id", ("t",)).collect()) == got


def test_append_replay(spark, tmp_path):
    path = str(tmp_path / "a")
    write = sinks.append_sink(path, ("id",))
    for _ in range(2):
        write(batch(spark, [("a", 1, 1), ("a", 1, 1)]), 0)
    write(batch(spark, [("a", 1, 2)]), 1)
    assert sinks.read_appended(spark, path).count() == 2


def test_a_redelivered_record_is_read_once(spark, tmp_path):
    path = str(tmp_path / "a")
    write = sinks.append_sink(path, ("id",))
    write(batch(spark, [("a", 1, 1), ("b", 1, 1)]), 0)
    write(batch(spark, [("a", 9, 2), ("c", 1, 1)]), 1)
    got = sorted(tuple(r) for r in sinks.read_appended(spark, path, ("id",)).collect())
    assert got == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]


def test_a_half_written_batch_is_not_read(spark, tmp_path):
    path = tmp_path / "u"
    write = sinks.upsert_sink(str(path), "id", ("t",))
    write(batch(spark, [("a", 1, 1)]), 0)
    write(batch(spark, [("a", 2, 2)]), 1)
    (path / "batch_id=1" / "_SUCCESS").unlink()
    assert [tuple(r) for r in sinks.read_upserted(spark, str(path), "id", ("t",)).collect()] == [("a", 1, 1)]


def test_copy_skips_empty_and_copies_extras(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    spark.range(3).write.parquet(f"{source}/one")
    spark.range(0).write.parquet(f"{source}/none")
    spark.range(4).write.parquet(f"{source}/other")
    for _ in range(2):
        report = tables.copy_tables(spark, source, target, ["one", "none", "absent"])
        got = sorted(tuple(r) for r in report.collect())
        assert got == [("none", "listed", 0, "empty"), ("one", "listed", 3, "success"), ("other", "extra", 4, "success")]
    assert spark.read.parquet(f"{target}/other").count() == 4


def test_unique(spark):
    df = batch(spark, [("a", 1, 1), ("a", 1, 2)])
    assert tables.duplicates(df, ["id"]).first()["copies"] == 2
    with pytest.raises(ValueError):
        tables.assert_unique(df, ["id"])
    assert tables.assert_unique(df, ["id", "t"]).count() == 2


def test_batched_files(spark, tmp_path):
    path = str(tmp_path / "b")
    tables.replace_table(spark.range(250).coalesce(1), path, 100)
    sizes = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in sizes) == [50, 100, 100]


def test_shared_folder_comes_from_the_session(spark):
    from gridlark.plans.session import CHECKPOINT_DIR, scratch_path

    folder = spark.conf.get(CHECKPOINT_DIR)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(folder) and b.startswith(folder)


def test_freshness_reads_open_only_recent_days(spark, tmp_path):
    from gridlark.operators.state import state_fresh

    path = str(tmp_path / "days")
    day = 86_400_000
    rows = spark.createDataFrame([(f"e{i}", i, i * day // 2) for i in range(10)], "id string, seq int, timestamp bigint")
    sinks.append_sink(path, ("id",), day_of="timestamp")(rows, 0)
    stored = sinks.read_appended(spark, path)
    now = 9 * day // 2
    got = state_fresh(stored, "id", 86_400, now)
    assert sorted(r["id"] for r in got.collect()) == ["e8", "e9"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


class Reader:
    """Stands for a Kafka reader (the connector is not installed): keeps the options it is given."""

    def __init__(self, messages):
        self.messages, self.given = messages, {}

    def format(self, name):
        self.given["format"] = name
        return self

    def option(self, name, value):
        self.given[name] = value
        return self

    def options(self, **more):
        self.given.update(more)
        return self

    def load(self):
        return self.messages


def test_kafka_options_and_arrival_order(spark):
    from types import SimpleNamespace

    messages = spark.createDataFrame(
        [(bytearray(b"AC-1"), bytearray(b'{"unit_id": "1", "lat": 2.0}'), TOPICS["gps"], 0, 42)],
        "key binary, value binary, topic string, partition int, offset bigint",
    )
    stream, batch_reader = Reader(messages), Reader(messages)
    session = SimpleNamespace(readStream=stream, read=batch_reader)
    row = topics.read_topic(session, "gps", "host:1", starting="latest").first()
    assert (row["unit_id"], row["lat"], row["seq"]) == ("AC-1", 2.0, 42)
    assert stream.given["format"] == "kafka" and stream.given["startingOffsets"] == "latest"
    topics.read_messages(session, "host:1", ["a", "b"], streaming=False, options={"failOnDataLoss": "false"})
    assert batch_reader.given["subscribe"] == "a,b" and batch_reader.given["startingOffsets"] == "earliest"
    assert batch_reader.given["failOnDataLoss"] == "false"


def test_external_feeds_read_iso_times(spark):
    from gridlark.sources.external import FEEDS, parse_feed

    rows = [
        ("mda/port/abc", '{"event_id":"P1","port_lat":1.5,"timestamp":"2024-01-02T03:04:05.678901"}'),
        ("mda/port", '{"event_id":"P2","timestamp":"2024-01-02T03:04:05"}'),
        ("mda/port/x", '{"event_id":"P3","timestamp":"yesterday"}'),
        ("mda/portal/x", '{"event_id":"P4"}'), ("faa/adsb/1", '{"event_id":"P5"}'), ("mda/port/y", "no json"), ("mda/port/z", None),
    ]
    got = parse_feed(spark.createDataFrame(rows, "topic string, value string"), "port_event")
    found = {r["feed_key"]: (r["event_id"], r["port_lat"], r["timestamp"]) for r in got.collect()}
    assert found == {
        "abc": ("P1", 1.5, 1704164645678), None: ("P2", None, 1704164645000), "x": ("P3", None, None), "y": (None,) * 3, "z": (None,) * 3,
    }
    assert len({f.topic for f in FEEDS.values()}) == 6


def test_mixed_topics_are_scanned_and_parsed_once(spark):
    from gridlark.plans import catalog

    plan = catalog.QUERIES["src_multi_topic"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("from_json") == 0
    rows = [("ground-force-gps", '{"unit_id":"U","timestamp":7}'), ("naval-vessels", '{"vessel_id":"V","timestamp":"x"}'),
            ("cyber-threats", '{"incident_id":"C"}'), ("ground-force-gps", "{bad"), ("other", "{}"), ("ground-force-gps", None)]
    fields = {"id": {"gps": ("unit_id", "string"), "naval": ("vessel_id", "string")}, "at": {"gps": ("timestamp", "bigint"), "naval": ("timestamp", "bigint")}}
    got = topics.mixed_fields(spark.createDataFrame(rows, "topic string, value string"), fields)
    assert sorted(tuple(r) for r in got.collect()) == [("gps", "U", 7), ("naval", "V", None)]


def test_where_a_consumer_starts(spark):
    messages = spark.createDataFrame([("a", p, o) for p in (0, 1) for o in range(5)], "topic string, partition int, offset long")
    committed = spark.createDataFrame([("a", 0, 2), ("a", 0, 1), ("b", 0, 9)], "topic string, partition int, offset long")
    seen = lambda reset: sorted((r["partition"], r["offset"]) for r in topics.from_offsets(messages, committed, reset).collect())
    assert seen("latest") == [(0, 3), (0, 4)]
    assert seen("earliest") == [(0, 3), (0, 4)] + [(1, o) for o in range(5)]
    with pytest.raises(ValueError):
        topics.from_offsets(messages, committed, "newest")


def test_store_columns_are_dropped_and_repeated_actions_agree(spark):
    from gridlark.operators import derive as D

    row = spark.createDataFrame([("x", "y", 1)], "_id string, last_update string, A int")
    assert D.norm_columns(row).columns == ["a"]
    signals = spark.createDataFrame([("S", "HIGH")], "signal_type string, threat_level string")
    lists = spark.createDataFrame([("S", "HIGH", ["b"]), ("S", "HIGH", ["a", "z"])], "signal_type string, threat_level string, corrective_actions array<string>")
    assert D.lookup_corrective_actions(signals, lists, "none").first()["corrective_actions"] == ["a", "z"]


def test_latest_by_arrival(spark, make):
    from gridlark.operators import state as S

    gps = make("gps", [{"unit_id": "U", "timestamp": 9, "unit_name": "later"}, {"unit_id": "U", "timestamp": 5, "unit_name": "arrived last"}])
    assert S.gps_latest(gps).first()["unit_name"] == "later"
    assert S.gps_latest(gps, order=("seq",)).first()["unit_name"] == "arrived last"
