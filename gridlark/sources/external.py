"""Feeds of other systems: JSON records on path-like topics, with ISO times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.sources.topics import feed_topic_parts

TIME = "time"


@dataclass(frozen=True)
class Feed:
    """``topic`` is the path that its messages begin with; ``fields`` are its record's, of which ``time`` ones are ISO text."""

    topic: str
    fields: tuple[tuple[str, str], ...]

    def names(self, kind: str) -> list[str]:
        return [name for name, own in self.fields if own == kind]

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"{name} {'string' if kind == TIME else kind}" for name, kind in self.fields))


def _feed(topic: str, fields: str) -> Feed:
    return Feed(topic, tuple((name, kind) for name, kind in (field.split() for field in fields.split(","))))


# Topics and record fields of the feeds.
FEEDS = {
    "ais_vessel": _feed(
        "mda/ais/vessel",
        "mmsi string, vessel_name string, vessel_type string, flag_country string, flag_name string, lat double, lon double, "
        "speed_knots double, heading_deg double, destination string, last_update time, source string",
    ),
    "port_event": _feed(
        "mda/port",
        "event_id string, port_name string, port_lat double, port_lon double, vessel_name string, vessel_type string, "
        "vessel_flag string, event_type string, timestamp time, source string",
    ),
    "vessel_alert": _feed(
        "mda/voi/alerts",
        "alert_id string, vessel_name string, vessel_flag string, lat double, lon double, reason string, severity string, "
        "timestamp time, source string",
    ),
    "change_report": _feed(
        "nga/geoint/change_detection",
        "report_id string, area_name string, lat double, lon double, change_type string, confidence_pct int, "
        "imagery_source string, resolution_m double, classification string, timestamp time, analyst string, source string",
    ),
    "restriction": _feed(
        "nga/geoint/restrictions",
        "restriction_id string, area_name string, restriction_type string, lat double, lon double, radius_km double, "
        "floor_ft int, ceiling_ft int, effective_from time, effective_until time, authority string, timestamp time, source string",
    ),
    "civil_aircraft": _feed(
        "faa/adsb",
        "hex_code string, callsign string, aircraft_type string, lat double, lon double, altitude_ft int, speed_knots double, "
        "heading_deg double, origin string, destination string, squawk string, last_update time, source string",
    ),
}


def iso_millis(text: Column) -> Column:
    """ISO time without a zone, with or without a fraction, as epoch milliseconds; NULL for anything else."""
    return F.unix_millis(F.try_to_timestamp(text))


def parse_feed(messages: DataFrame, feed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The records of one feed from (topic, value) messages: declared fields, times as epoch milliseconds, and the parts of
    the topic. Messages of other feeds are not parsed; a field that is missing or no time is NULL."""
    known = FEEDS[feed]
    mine = messages.where((F.col("topic") == known.topic) | F.col("topic").startswith(known.topic + "/"))
    parsed = mine.withColumn("_v", F.from_json("value", known.schema()))
    fields = [(iso_millis(F.col(f"_v.{n}")) if kind == TIME else F.col(f"_v.{n}")).alias(n) for n, kind in known.fields]
    return feed_topic_parts(parsed.select("topic", *fields, *keep))
