"""State kept for each entity of a stream: the fresh record with a time to live, and documents on top of a snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlark.plans.session import scratch_path
from gridlark.sources.sinks import upsert_sink, write_stream
from gridlark.streaming.jobs import stream_settings

ENTITY, STATUS = "entity", "status"
CURRENT, EXPIRED = "CURRENT", "EXPIRED"
#: What marks the column of event time in a stream's schema.
_WATERMARK = "spark.watermarkDelayMs"


class FreshRecord(StatefulProcessor):
    """The newest record of an entity, until the watermark has passed its time to live."""

    def __init__(self, schema: T.StructType, ttl_ms: int, order: tuple[str, ...]):
        self.schema, self.ttl_ms, self.order = schema, ttl_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.schema)

    def _rank(self, record) -> tuple:
        return tuple(record[c] for c in self.order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()  # None if there is none: every call asks another process
        before = None if known is None else dict(zip(self.schema.names, known))
        newest = before
        for row in rows:  # one row is held at a time, however many a batch has of the entity
            record = {c: row[c] for c in self.schema.names}
            if newest is None or self._rank(record) > self._rank(newest):
                newest = record
        if newest is not before:
            if before is not None:
                self.handle.deleteTimer(before["timestamp"] + self.ttl_ms)
            self.last.update(tuple(newest[c] for c in self.schema.names))
            self.handle.registerTimer(newest["timestamp"] + self.ttl_ms)
            yield Row(**{ENTITY: key[0], STATUS: CURRENT, **newest})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known is not None:
            record = dict(zip(self.schema.names, known))
            self.last.clear()
            yield Row(**{ENTITY: key[0], STATUS: EXPIRED, **record})

    def close(self) -> None:
        pass


def fresh_changes(stream: DataFrame, key: Column, columns: list[str], ttl_seconds: int, order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """Changes of the fresh state: a record that becomes an entity's newest is CURRENT; it is EXPIRED, and its state gone,
    once the watermark is past its time plus the time to live, unless a newer one has come.

    ``stream`` has event time with a watermark; records that are later than its delay don't count. Rows without a key have
    no entity. State is one record for each entity that is fresh. Only the columns that are kept, and event time, travel to
    Python.
    """
    kept = T.StructType([stream.schema[c] for c in columns])
    timed = [f.name for f in stream.schema if _WATERMARK in f.metadata]
    rows = stream.withColumn(ENTITY, key).where(F.col(ENTITY).isNotNull())
    rows = rows.select(*dict.fromkeys([ENTITY, *columns, *order, *timed]))
    output = T.StructType([T.StructField(ENTITY, T.StringType()), T.StructField(STATUS, T.StringType()), *kept.fields])
    processor = FreshRecord(kept, ttl_seconds * 1000, order)
    return rows.groupBy(ENTITY).transformWithState(processor, output, "Update", "EventTime")


class NewestDocument(StatefulProcessor):
    """The newest state of a document; what is known before the stream starts comes from a snapshot."""

    def __init__(self, order: str, kind: T.DataType):
        self.order, self.kind = order, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        # what the document says goes straight on; only its order number has to be kept
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("order", self.kind)]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.newest.update((initialState[self.order],))  # one row for each document

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, best = self.newest.get(), None  # no state is None
        known = None if state is None else state[0]
        for row in rows:
            if known is None or row[self.order] > known:
                known, best = row[self.order], row
        if best is not None:
            self.newest.update((known,))
            yield best

    def close(self) -> None:
        pass


def changes_after_snapshot(changes: DataFrame, snapshot: DataFrame, key: str, order: str) -> DataFrame:
    """The changes of a stream that are newer than everything known of their document, from the snapshot or the stream:
    at most one for each document and micro-batch. State is one order number for each document."""
    processor = NewestDocument(order, changes.schema[order].dataType)
    initial = snapshot.groupBy(key).agg(F.max(order).alias(order)).groupBy(key)
    return changes.groupBy(key).transformWithState(processor, changes.schema, "Update", "None", initialState=initial)


def run_deliveries(
    spark: SparkSession,
    deliveries: list[DataFrame],
    build: Callable[[DataFrame], DataFrame],
    key: str,
    order: tuple[str, ...],
    state_partitions: int | None = None,
) -> str:
    """Delivers tables one after the other into a folder that a stream reads, each as a micro-batch (or more) of the same
    query, and returns where the changes are stored as an upsert log."""
    root = scratch_path(spark, "deliveries")
    source, target, checkpoint = f"{root}/source", f"{root}/changes", f"{root}/checkpoint"
    writer, done = upsert_sink(target, key, order), None
    for delivery in deliveries:
        delivery.write.mode("append").parquet(source)
        with stream_settings(spark, state_partitions):
            done = write_stream(build(spark.readStream.schema(delivery.schema).parquet(source)), target, checkpoint, writer, "update")
            done.awaitTermination()
    return target
