"""Streaming queries built from the batch operators.

Only the sources, the watermark and the sinks differ: enrichment, alerts, windows and
joins are the functions of ``gridlark.operators``.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import alerts as A
from gridlark.operators import enrich as N
from gridlark.operators import joins as J
from gridlark.operators import windows as W
from gridlark.operators.state import GPS_LATEST, ORDER
from gridlark.plans.profiles import ALERTS
from gridlark.plans.session import scratch_path
from gridlark.sources import feeds
from gridlark.sources.sinks import Writer, read_upserted, upsert_sink, write_stream
from gridlark.sources.tables import is_folder

# How late a record may be. No delay is given with the rules; later rows are dropped.
DELAY = "10 minutes"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stream_settings(spark: SparkSession, state_partitions: int | None = None):
    """State on local disk instead of the heap, and a partition count that fits the job.

    Both are fixed by the first run of a checkpoint, so they are set before starting.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def file_stream(
    spark: SparkSession, path: str, schema: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """A folder of Parquet files (or one file of it) as a stream, with a declared schema or
    the one the files have."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if not is_folder(spark, path):  # a stream watches a folder: narrow it to the one file
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@dataclass
class Streams:
    """Raw streams over one stream of event rows, with event time and watermark."""

    events: DataFrame
    profile: str = "classic"
    delay: str = DELAY

    def _timed(self, view, event_type: str | None = None) -> DataFrame:
        rows = self.events
        if event_type:
            rows = rows.where(F.col("event_type") == event_type)
        return W.with_event_time(view(rows), delay=self.delay)

    @property
    def gps_raw(self) -> DataFrame:
        return self._timed(feeds.gps_view)

    @property
    def gps(self) -> DataFrame:
        return N.enrich_gps(self.gps_raw, self.profile)

    @property
    def sigint(self) -> DataFrame:
        return N.enrich_sigint(self._timed(feeds.sigint_view, "signup"), self.profile)

    @property
    def satellite(self) -> DataFrame:
        return N.enrich_satellite(self._timed(feeds.satellite_view, "purchase"), self.profile)

    @property
    def aircraft_raw(self) -> DataFrame:
        return self._timed(feeds.aircraft_view, "click")

    def unit_alerts(self) -> DataFrame:
        """All alerts about units, with the event time they carry the watermark by."""
        rules = [r for r in ALERTS[self.profile].values() if r.source == "gps"]
        return A.alerts_one_pass(self.gps, rules, keep=("ts",))

    def operational_picture(self) -> DataFrame:
        """Append mode: a window is reported once, when the watermark has passed it."""
        return J.operational_picture(
            W.grid_force(self.gps, "classic"),
            W.grid_threat(self.sigint, "classic"),
            W.grid_isr(self.satellite, "classic"),
            self.profile,
        )

    def units_in_threat(self) -> DataFrame:
        return J.units_in_threat(self.gps, W.active_threats(self.sigint, self.profile))


def gps_latest_changes(gps: DataFrame, profile: str = "setup") -> DataFrame:
    """Every change of a unit's latest values (update mode); one state row per unit."""
    columns = GPS_LATEST[profile]
    rank = F.struct(*ORDER)
    return gps.groupBy("unit_id").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns],
        F.max("timestamp").alias("last_update"),
        F.count(F.lit(1)).alias("updates"),
    )


def dedupe(df: DataFrame, id_column: str) -> DataFrame:
    """Drop repeats of an id that arrive within the watermark delay."""
    return df.dropDuplicatesWithinWatermark([id_column])


def finish(
    df: DataFrame,
    name: str,
    mode: str = "append",
    sink: Writer | None = None,
    path: str | None = None,
    state_partitions: int | None = None,
) -> str:
    """Run a stream over everything that is available and return where its output is."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with stream_settings(spark, state_partitions):
        query = write_stream(df, path, scratch_path(spark, f"{name}-checkpoint"), sink, mode)
        query.awaitTermination()
    return path


def finish_changes(
    df: DataFrame, name: str, key, order, state_partitions: int | None = None
) -> DataFrame:
    """Run an update-mode stream into an upsert log and read the resulting table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    finish(df, name, "update", upsert_sink(path, key, order), path, state_partitions)
    return read_upserted(spark, path, key, order)


@dataclass
class Job:
    """One persistent query: what it reads (by name), how it is built, how it is written."""

    name: str
    build: object  # Callable[[dict[str, DataFrame]], DataFrame]
    reads: tuple[str, ...] = ()
    mode: str = "append"


class Chain:
    """Persistent queries chained through the tables they write.

    Every job has its own checkpoint; jobs start after the ones they read from and stop
    in the opposite order.
    """

    def __init__(self, spark: SparkSession, root: str, jobs: list[Job]):
        self.spark, self.root = spark, root
        self.jobs = self._ordered(jobs)
        self.running: list = []

    @staticmethod
    def _ordered(jobs: list[Job]) -> list[Job]:
        known = {j.name for j in jobs}
        done, order = set(), []
        while len(order) < len(jobs):
            ready = [j for j in jobs if j.name not in done and all(r in done or r not in known for r in j.reads)]
            if not ready:
                raise ValueError("jobs read from each other in a circle")
            order += ready
            done |= {j.name for j in ready}
        return order

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _inputs(self, job: Job) -> dict[str, DataFrame]:
        return {r: file_stream(self.spark, self.table(r)) for r in job.reads}

    def run_available(self) -> None:
        """Process what is there, job after job."""
        with stream_settings(self.spark):
            for job in self.jobs:
                df = job.build(self._inputs(job))
                query = write_stream(df, self.table(job.name), f"{self.root}/_checkpoints/{job.name}", mode=job.mode)
                self.running.append(query)
                query.awaitTermination()

    def stop(self) -> None:
        for query in reversed(self.running):
            query.stop()
        self.running.clear()
