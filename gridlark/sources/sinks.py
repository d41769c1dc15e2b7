"""Stream sinks: last state per key, and idempotent append."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.state import latest_record

BATCH = "batch_id"
Writer = Callable[[DataFrame, int], None]


DAY = "day"


def write_batch(batch: DataFrame, path: str, batch_id: int, by: Sequence[str] = (), **options: str) -> None:
    """One folder per micro-batch, replaced as a whole when a batch is replayed. ``options`` are the writer's."""
    batch.write.mode("overwrite").options(**options).partitionBy(*by).parquet(f"{path}/{BATCH}={batch_id}")


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches whose writer has left its mark; one that is being written, or was given up, is not read."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCH}=*/_SUCCESS")
    marks = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return [mark.getPath().getParent().toString() for mark in marks or []]


def _committed(spark: SparkSession, path: str) -> DataFrame:
    folders = committed_batches(spark, path)
    if not folders:
        raise FileNotFoundError(f"no finished batch in {path}")
    return spark.read.option("basePath", path).parquet(*folders)


def upsert_sink(path: str, key: str | Sequence[str], order: Sequence[str]) -> Writer:
    """Replace-by-key as a change log: each batch keeps its last record per key.

    Writing a batch costs what the batch holds, not what the table holds, and a replayed
    batch replaces its own folder. ``read_upserted`` folds the batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(latest_record(batch, key, order), path, batch_id)

    return write


def read_upserted(spark: SparkSession, path: str, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: its last state over all batches."""
    stored = _committed(spark, path)
    return latest_record(stored, key, (*order, BATCH)).drop(BATCH)


def compact_upserts(spark: SparkSession, path: str, target: str, key, order: Sequence[str]) -> int:
    """Fold every finished batch into one at a new path; returns the batch it is current to.

    Readers switch to the new path when it is complete; the path being read is never overwritten.
    """
    stored = _committed(spark, path)
    newest = stored.agg(F.max(BATCH)).first()[0]
    folded = latest_record(stored, key, (*order, BATCH)).drop(BATCH)
    write_batch(folded, target, newest)
    return newest


def append_sink(path: str, id_columns: Sequence[str] = (), day_of: str | None = None) -> Writer:
    """Append records: ids are unique within a batch, a replay rewrites its folder.

    A record that is delivered again in a later batch is stored again; ``read_appended`` drops it by its id.

    ``day_of`` names an epoch-millisecond column: files are then laid out by day, and
    freshness reads over the table open only the days they need.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(list(id_columns)) if id_columns else batch
        if day_of:
            rows = rows.withColumn(DAY, F.to_date(F.timestamp_millis(day_of)))
        write_batch(rows, path, batch_id, (DAY,) if day_of else ())

    return write


def read_appended(spark: SparkSession, path: str, id_columns: Sequence[str] = ()) -> DataFrame:
    """The records of all finished batches; with ``id_columns``, each id once, as its first batch has it."""
    stored = _committed(spark, path)
    if not id_columns:
        return stored.drop(BATCH)
    rest = [c for c in stored.columns if c not in id_columns and c != BATCH]
    first = stored.groupBy(*id_columns).agg(F.min_by(F.struct(*rest), BATCH).alias("first"))
    return first.select(*id_columns, "first.*").select(*[c for c in stored.columns if c != BATCH])


def write_stream(df: DataFrame, path: str, checkpoint: str, sink: Writer | None = None, mode: str = "append",
                 available_now: bool = True):
    """Persist a derived stream under its own name.

    Without a sink: the exactly-once Parquet file sink. With one: ``foreachBatch``.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    if sink is None:
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(sink).start()
