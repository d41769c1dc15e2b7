"""State of an entity is asked for once: every call goes to another process."""

from collections import Counter
from types import SimpleNamespace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.streaming import entities


class Handle:
    def __init__(self):
        self.calls, self.value = Counter(), None

    def getValueState(self, *_):
        return self

    def __getattr__(self, name):
        def call(value=None):
            self.calls[name] += 1
            if name == "update":
                self.value = value
            return {"get": self.value, "exists": self.value is not None}.get(name)

        return call


def test_documents_ask_once_a_batch():
    handle, processor = Handle(), entities.NewestDocument("change", T.LongType())
    processor.init(handle)
    processor.handleInitialState(("a",), {"change": 5}, None)
    assert handle.calls == {"update": 1}
    handle.calls.clear()
    assert list(processor.handleInputRows(("a",), iter([{"change": 4}, {"change": 9}, {"change": 7}]), None)) == [{"change": 9}]
    assert handle.calls == {"get": 1, "update": 1} and handle.value == (9,)
    assert list(processor.handleInputRows(("a",), iter([{"change": 9}]), None)) == []


def test_fresh_records_ask_once_a_batch():
    handle = Handle()
    processor = entities.FreshRecord(T.StructType().add("timestamp", "long").add("seq", "long"), 1000, ("timestamp", "seq"))
    processor.init(handle)
    rows = [{"timestamp": 10, "seq": 1}, {"timestamp": 30, "seq": 0}]
    assert [r["timestamp"] for r in processor.handleInputRows(("a",), iter(rows), None)] == [30]
    assert handle.calls == {"get": 1, "update": 1, "registerTimer": 1}
    handle.calls.clear()
    assert [r["status"] for r in processor.handleExpiredTimer(("a",), None, SimpleNamespace())] == [entities.EXPIRED]
    assert handle.calls == {"get": 1, "clear": 1}


def test_only_kept_columns_travel(spark, monkeypatch):
    stream = spark.readStream.format("rate").load().withColumnRenamed("timestamp", "ts").withWatermark("ts", "1 minute")
    stream = stream.selectExpr("ts", "value AS seq", "value AS timestamp", "'x' AS unit_id", "repeat('y', 100) AS message")
    seen, grouped = [], type(stream).groupBy
    monkeypatch.setattr(type(stream), "groupBy", lambda rows, *by: seen.append(rows.columns) or grouped(rows, *by))
    changes = entities.fresh_changes(stream, F.col("unit_id"), ["unit_id", "timestamp", "seq"], 60)
    assert changes.columns == ["entity", "status", "unit_id", "timestamp", "seq"]
    assert seen == [["entity", "unit_id", "timestamp", "seq", "ts"]]
