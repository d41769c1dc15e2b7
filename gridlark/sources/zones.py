"""A zone map: the least and greatest time of every file of a table, so that a read of recent rows opens few files.

The map is a small stored table with a row for each file and group of rows (such as a kind of event). It grows with the
number of files; when files are added only those are scanned, and of them only the time and the group. The newest time
and the files that a read needs come from the map: no fact is read to find out what "recent" is.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.sources.tables import stamp

EPOCH = datetime(1970, 1, 1)


def to_millis(time: datetime) -> int:
    return (time - EPOCH) // timedelta(milliseconds=1)


def from_millis(millis: int) -> datetime:
    return EPOCH + timedelta(milliseconds=millis)


def _plain(path: str) -> str:
    """A path as a listing and as a scan name it."""
    return unquote(urlparse(path).path) if ":" in path.split("/")[0] else path


class ZoneMap:
    """The zones of a Parquet table at ``table``, stored at ``path``. ``time`` is a stored column without a zone; ``group``
    names a column whose values have zones of their own."""

    def __init__(self, spark: SparkSession, table: str, path: str, time: str, group: str | None = None, schema: str | None = None):
        self.spark, self.table, self.path, self.time, self.group, self.schema = spark, table, path, time, group, schema
        self.files: dict[str, tuple[str, int, int]] = {}

    def _read(self, files: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(*files)

    def refresh(self) -> ZoneMap:
        """Adds the zones of files that are new or have changed; those of files that are gone are not read any more."""
        now = {_plain(f): (f, n, t) for f, n, t in stamp(self.spark, self.table) if f.rsplit("/", 1)[-1][0] not in "._"}
        new = [f for name, (f, n, t) in now.items() if self.files.get(name, (f, None, None))[1:] != (n, t)]
        if new:
            group = F.col(self.group).cast("string") if self.group else F.lit(None).cast("string")
            rows = self._read(new).select(
                F.col("_metadata.file_path").alias("file"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("modified"),
                group.alias("group"), F.col(self.time).alias("time"),
            )
            zones = rows.groupBy("file", "modified", "group").agg(
                F.min("time").alias("least"), F.max("time").alias("greatest"), F.count("*").alias("rows"), F.count("time").alias("timed")
            )
            zones.write.mode("append").parquet(self.path)
        self.files = now
        return self

    def zones(self, groups: list[str] | None = None) -> list:
        """The zones of the present files: as many as files and groups, never rows of the table."""
        if not self.files:
            return []
        stored = self.spark.read.parquet(self.path)
        stored = stored.where(F.col("group").isin(*groups)) if groups else stored
        return [z for z in stored.collect() if self.files.get(_plain(z["file"]), (0, 0, None))[2] == z["modified"]]

    def newest(self, groups: list[str] | None = None) -> datetime | None:
        return max((z["greatest"] for z in self.zones(groups) if z["greatest"] is not None), default=None)

    def _mine(self, groups: list[str] | None) -> Column:
        return F.col(self.group).isin(*groups) if groups else F.lit(True)

    def since(self, least: datetime, groups: list[str] | None = None) -> DataFrame:
        """Rows of the groups from ``least`` on: one scan of the files that may have some, and of them only the row groups."""
        names = {_plain(z["file"]) for z in self.zones(groups) if z["greatest"] is not None and z["greatest"] >= least}
        files = sorted(self.files[name][0] for name in names) or [next(iter(self.files.values()))[0]]
        return self._read(files).where((F.col(self.time) >= F.lit(least).cast("timestamp_ntz")) & self._mine(groups))

    def count_since(self, least: datetime, groups: list[str] | None = None) -> DataFrame:
        """How many rows there are from ``least`` on, as ``recent``. Files that lie behind it as a whole are counted from
        the map; only those that it cuts are read."""
        zones = [z for z in self.zones(groups) if z["greatest"] is not None and z["greatest"] >= least]
        cut = sorted({self.files[_plain(z["file"])][0] for z in zones if z["least"] < least})
        whole = sum(z["timed"] for z in zones if z["least"] >= least and self.files[_plain(z["file"])][0] not in cut)
        if not cut:
            return self.spark.range(1).select(F.lit(whole).cast("long").alias("recent"))
        rows = self._read(cut).where((F.col(self.time) >= F.lit(least).cast("timestamp_ntz")) & self._mine(groups))
        return rows.agg((F.count("*") + whole).alias("recent"))
