"""Streams fed file by file give what the batch gives on closed windows."""

import time

import pytest
from pyspark.sql import functions as F

from gridlark.operators import windows as W
from gridlark.plans import catalog
from gridlark.plans.pictures import Domain
from gridlark.sources.sinks import append_sink, read_appended
from gridlark.streaming import jobs

from conftest import DATA


def deliver(df, path):
    """One more file in the folder; files are read in order of modification time."""
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in several files, in time order."""
    path = str(tmp_path_factory.mktemp("events") / "events.parquet")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    edges = [None, 8, 15, 22, None]
    for low, high in zip(edges, edges[1:]):
        part = events
        if low:
            part = part.where(F.dayofmonth("ts") >= low)
        if high:
            part = part.where(F.dayofmonth("ts") < high)
        deliver(part, path)
    return path


def streams(spark, folder, **options):
    return jobs.Streams(jobs.file_stream(spark, folder, files_per_trigger=1), **options)


def rows(df, columns):
    return sorted(str(r) for r in df.select(*columns).collect())


def test_closed_windows_equal_batch(spark, folder):
    stream = W.flatten_window(W.grid_force(streams(spark, folder).gps))
    got = spark.read.parquet(jobs.finish(stream, "force", state_partitions=2))
    batch = W.flatten_window(W.grid_force(Domain(spark, DATA, "classic").gps))
    last = Domain(spark, DATA).raw("gps").agg(F.max("timestamp")).first()[0]
    closed = batch.where(F.col("window_end") <= last - 600_000)
    assert rows(got, batch.columns) == rows(closed, batch.columns)


def test_updates_fold_to_the_batch_answer(spark, folder):
    stream = W.flatten_window(W.grid_threat(streams(spark, folder).sigint, "setup"))
    got = jobs.finish_changes(stream, "threat", ("window_start", "grid_square"), ("intercept_count",), 2)
    batch = W.flatten_window(W.grid_threat(Domain(spark, DATA, "setup").sigint, "setup"))
    assert rows(got, batch.columns) == rows(batch, batch.columns)


def test_latest_equals_batch(spark, folder):
    changes = jobs.gps_latest_changes(streams(spark, folder).gps_raw)
    got = jobs.finish_changes(changes, "latest", "unit_id", ("updates",), 2)
    batch = Domain(spark, DATA, "setup").gps_latest
    assert rows(got, batch.columns) == rows(batch, batch.columns)


def test_late_rows_beyond_the_delay_are_dropped(spark, tmp_path):
    path = str(tmp_path / "late")
    base = spark.read.parquet(f"{DATA}/events.parquet").limit(1)
    # a watermark holds from the batch after the one that follows the row that set it
    for event_id, minute in enumerate((1, 40, 41, 2, 59)):
        row = base.select(
            F.lit(event_id).cast("bigint").alias("event_id"),
            F.expr(f"timestamp_ntz'2024-01-01 10:{minute:02d}:00'").alias("ts"),
            "user_id", "event_type", "value", "props",
        )
        deliver(row, path)
    stream = W.flatten_window(W.windowed(streams(spark, path).gps, "force_composition", "unit_type", 5, "deploy"))
    got = spark.read.parquet(jobs.finish(stream, "late", state_partitions=1)).collect()
    counts = {r["window_start"] // 60_000 % 60: r["unit_count"] for r in got}
    assert counts == {0: 1, 40: 2}


def test_restart_continues_where_it_stopped(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for part in range(2):
        events.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        alerts = jobs.Streams(jobs.file_stream(spark, source), "classic").unit_alerts().drop("ts")
        query = jobs.write_stream(alerts, out, checkpoint, append_sink(out))
        query.awaitTermination()
    assert read_appended(spark, out).count() == jobs.A.alerts_one_pass(
        Domain(spark, DATA, "classic").gps, [r for r in jobs.ALERTS["classic"].values() if r.source == "gps"]
    ).count()


def test_chain_orders_jobs_and_rejects_circles(spark, tmp_path):
    order = jobs.Chain(spark, str(tmp_path), [
        jobs.Job("c", None, ("b",)), jobs.Job("b", None, ("a",)), jobs.Job("a", None),
    ]).jobs
    assert [j.name for j in order] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        jobs.Chain(spark, str(tmp_path), [jobs.Job("a", None, ("b",)), jobs.Job("b", None, ("a",))])


def test_parts_of_values_merge_to_the_batch_answer(spark):
    """Distinct counts without a set of values: the state is one row for each (window, key, value)."""
    sigint = W.with_event_time(Domain(spark, DATA, "setup").sigint)
    batch = W.flatten_window(W.grid_threat(sigint, "setup"))
    parts = W.windowed_parts(sigint, "grid_threat", "grid_square", W.GRID_MINUTES, "setup")
    assert "emitter_classification" in parts.columns and not [f for f in parts.schema.fields if f.dataType.typeName() == "array"]
    merged = W.merged_parts(W.flatten_window(parts), "grid_threat", "grid_square", "setup").select(*batch.columns)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, batch.collect()))
    assert batch.agg(F.max("unique_emitters")).first()[0] >= 1
    with pytest.raises(ValueError):
        W.windowed_parts(sigint, "grid_isr", "grid_square", 5, "classic")


def test_a_hot_cell_is_shared_by_several_tasks(spark):
    from gridlark.operators import joins as J

    units = spark.range(2000).select(F.col("id").alias("seq"), F.concat(F.lit("U"), F.col("id") % 3).alias("unit_id"), F.lit("C").alias("grid_square"))
    threats = spark.createDataFrame([("C", 5), ("D", 6)], "grid_square string, threats int")
    left, right = J.salted(units, threats, 8)
    placed = left.repartition(16, "grid_square", "salt").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(placed) > units.select("grid_square").distinct().count() and max(r["count"] for r in placed) < 1000
    joined = left.join(right, ["grid_square", "salt"]).drop("salt")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, units.join(threats, "grid_square").select(*joined.columns).collect()))


def test_alerts_delivered_twice_are_dealt_to_more_tasks(spark, monkeypatch):
    dealt = []

    def finish(df, name, mode="append", state_partitions=None):
        dealt.append(state_partitions)
        return f"{DATA}/part.parquet"

    monkeypatch.setattr(catalog.streaming, "finish", finish)
    catalog.QUERIES["stream_dedupe"](spark, DATA)
    assert dealt == [catalog.ALERT_PARTITIONS] and catalog.ALERT_PARTITIONS >= 4 * catalog.STATE_PARTITIONS
