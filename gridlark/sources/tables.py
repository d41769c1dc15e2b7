"""Stored tables: snapshot plus changes, replacement loads, copies with an audit, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.state import latest_record


def snapshot_plus_changes(
    snapshot: DataFrame, changes: DataFrame, key: str | Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Current documents: an initial copy overlaid with full-document changes."""
    return latest_record(snapshot.unionByName(changes, allowMissingColumns=True), key, order)


def replace_table(df: DataFrame, path: str, max_records_per_file: int | None = None) -> None:
    """Drop and reload. ``max_records_per_file`` bounds how much one file (insert batch) holds."""
    writer = df.write.mode("overwrite")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, location = _file_system(spark, path)
    return fs.getFileStatus(location).isDirectory()


def stamp(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of every file below a folder: changes when the stored tables do."""
    fs, location = _file_system(spark, path)
    files, out = fs.listFiles(location, True), []
    while files.hasNext():
        status = files.next()
        out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables (folders or .parquet files) below a folder."""
    fs, location = _file_system(spark, root)
    if not fs.exists(location):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(location)]
    return sorted(n.removesuffix(".parquet") for n in names if not n.startswith((".", "_")))


def _open(spark: SparkSession, root: str, name: str) -> DataFrame:
    fs, location = _file_system(spark, f"{root}/{name}.parquet")
    return spark.read.parquet(f"{root}/{name}.parquet" if fs.exists(location) else f"{root}/{name}")


def copy_tables(spark: SparkSession, source: str, target: str, listed: Sequence[str]) -> DataFrame:
    """Copy listed tables, then unlisted extras; skip empty ones; replace targets; report.

    The loop is over table names only; rows move from executor to executor.
    """
    present = list_tables(spark, source)
    plan = [(n, "listed") for n in listed if n in present] + [(n, "extra") for n in present if n not in listed]
    report = []
    for name, kind in plan:
        df = _open(spark, source, name)
        if df.isEmpty():
            report.append((name, kind, 0, "empty"))
            continue
        try:
            replace_table(df, f"{target}/{name}")
            # the footers of the files just written hold the count; no data is read again
            report.append((name, kind, spark.read.parquet(f"{target}/{name}").count(), "success"))
        except Exception as error:  # one failing table must not stop the others
            report.append((name, kind, 0, f"failed: {type(error).__name__}"))
    return spark.createDataFrame(report, "table_name string, kind string, rows bigint, status string")


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table and a total row."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy().agg(F.collect_list(F.struct("table_name", "rows")).alias("t"), F.sum("rows").alias("n")).select(
        F.explode(
            F.concat("t", F.array(F.struct(F.lit("TOTAL").alias("table_name"), F.col("n").alias("rows"))))
        ).alias("r")
    ).select("r.*")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def assert_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The DataFrame itself, or an error when a key is not unique."""
    if not duplicates(df, columns).isEmpty():
        raise ValueError(f"duplicate values of {', '.join(columns)}")
    return df
