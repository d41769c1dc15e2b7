"""Latest state per entity, freshness-bounded reads, top-N reads, merges and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.numbers import ratio

# Seconds a cached record stays current, and rows per recent read.
FRESH_SECONDS = {"aircraft": 30, "naval": 30, "gps": 60, "sigint": 120, "cyber": 600}
RECENT_ROWS = {
    "alerts": 25, "cyber": 25, "breakout": 20, "embm": 20,
    "passes": 20, "jsir": 20, "fallback": 50,
}
FRIENDLY_PREFIXES = ("US-", "UK-")

GPS_LATEST = {
    "setup": (
        "unit_name", "unit_type", "lat", "lon", "heading_deg", "speed_kph", "altitude_m", "fuel_level_pct",
        "ammo_level_pct", "personnel_count", "equipment_status", "mission_status", "comms_status",
    ),
    "clean": (
        "unit_name", "unit_type", "lat", "lon", "heading_deg", "speed_kph", "altitude_m", "fuel_level_pct",
        "mission_status", "comms_status",
    ),
}
ORDER = ("timestamp", "seq")


def _order(columns: Sequence[str] = ORDER) -> Column:
    return F.struct(*columns)


def latest_record(df: DataFrame, key: str | Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """The whole last record per key. Partial aggregation runs before the exchange, so a
    hot key sends one row per map task however many rows it has."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), _order(order)).alias("r"))
    return folded.select(*keys, "r.*")


def latest_values(
    df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] = ORDER
) -> DataFrame:
    """Last non-NULL value of each column per key."""
    rank = _order(order)
    return df.groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    )


def gps_latest(gps: DataFrame, profile: str = "setup", order: Sequence[str] = ORDER) -> DataFrame:
    """Latest known position and status per unit: by event time, or with ``order`` ("seq",) by arrival alone."""
    columns = GPS_LATEST[profile]
    if profile != "setup":
        return latest_values(gps, "unit_id", columns, order)
    return latest_values(
        gps.withColumn("last_update", F.col("timestamp")), "unit_id", (*columns, "last_update"), order
    )


def top_recent(df: DataFrame, n: int, tie: str = "seq", time: str = "timestamp") -> DataFrame:
    """Newest ``n`` rows; each task keeps only its own top ``n``."""
    return df.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def latest_time(df: DataFrame, time: str = "timestamp") -> Column:
    """Largest event time of the table as a scalar subquery, for replayed (batch) reads."""
    return df.agg(F.max(time).alias("now")).scalar()


def cache_key(stream: str) -> Column:
    """What a record is cached by: its id, or what stands for it. A record without an id, of a stream that has nothing
    else to tell its entities by, is not cached: its key is NULL."""

    def given(column: str) -> Column:
        return F.nullif(F.col(column), F.lit(""))

    keys = {"gps": "unit_id", "aircraft": "aircraft_id", "naval": "vessel_id"}
    if stream in keys:
        return given(keys[stream])
    if stream == "cyber":
        other = F.concat_ws("_", F.coalesce("source_ip", F.lit("unknown")), F.coalesce(F.col("timestamp").cast("string"), F.lit("")))
        return F.coalesce(given("incident_id"), other)
    if stream == "sigint":
        frequency = F.coalesce(F.col("frequency_mhz").cast("string"), F.lit(""))
        return F.coalesce(given("intercept_id"), F.concat_ws("_", F.coalesce("collector_id", F.lit("unknown")), frequency))
    raise ValueError(f"no cache of {stream}")


def _fresh_rows(df: DataFrame, ttl_seconds: int, now_ms: Column | int) -> DataFrame:
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    ttl = F.lit(ttl_seconds * 1000)
    if "day" in df.columns:  # a table laid out by day: older days are not opened
        df = df.where(F.col("day") >= F.to_date(F.timestamp_millis((now - ttl).cast("bigint"))))
    return df.where(F.col("timestamp") > now - ttl)


def state_fresh(
    df: DataFrame, key: str | Column, ttl_seconds: int, now_ms: Column | int, order: Sequence[str] = ORDER
) -> DataFrame:
    """Latest record per entity that is younger than the time to live. ``key`` is a column or an expression such as
    ``cache_key``; rows whose key is NULL have no entity.

    A record older than the limit can never be an entity's fresh state, so it is dropped before the exchange. Where the
    time is computed from a stored column, read the rows through a zone map: it filters by what is stored.
    """
    entity = F.col(key) if isinstance(key, str) else key
    rows = _fresh_rows(df, ttl_seconds, now_ms).withColumn("_entity", entity).where("_entity IS NOT NULL")
    return latest_record(rows, "_entity", order).select(*df.columns)


def state_fresh_or_recent(
    df: DataFrame, key: str | Column, ttl_seconds: int, now_ms: Column | int, fallback: DataFrame, n: int
) -> DataFrame:
    """Fresh state, or the newest ``n`` rows of the fallback when nothing is fresh.

    The plan itself decides, when it runs: a subquery that stops at the first fresh row lets the fallback's rows through
    or none of them. No job runs while the plan is built.
    """
    shared = [c for c in fallback.columns if c in df.columns]
    some = _fresh_rows(df, ttl_seconds, now_ms).limit(1).agg(F.count(F.lit(1)).alias("some")).scalar()
    recent = top_recent(fallback.where(some == 0), n).select(*shared)
    return state_fresh(df, key, ttl_seconds, now_ms).select(*shared).unionByName(recent)


def merge_first_wins(parts: Sequence[DataFrame], key: Column, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Union of several sources in which the first source to hold a key wins.

    A fold instead of a ranking window: no group is ever sorted or held as a whole.
    """
    tagged = None
    for priority, part in enumerate(parts):
        one = part.withColumn("_p", F.lit(priority))
        tagged = one if tagged is None else tagged.unionByName(one)
    columns = [c for c in tagged.columns if c != "_p"]
    chosen = tagged.groupBy(key.alias("_k")).agg(
        F.min_by(F.struct(*columns), F.struct("_p", *[F.col(c) for c in order])).alias("r")
    )
    return chosen.select("r.*")


def composite_key(*columns: str) -> Column:
    return F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def union_dedupe_merge(
    history: DataFrame, cache: DataFrame, key_columns: Sequence[str]
) -> DataFrame:
    """All history rows, then cached rows whose composite key is not there yet. ``top_recent`` pages the result."""
    shared = [c for c in history.columns if c in cache.columns]
    return merge_first_wins(
        [history.select(*shared), cache.select(*shared)], composite_key(*key_columns), ("timestamp", "seq")
    )


def readiness_rollup(current: DataFrame) -> DataFrame:
    """One row: averages and shares over friendly units; an empty force gives zeros."""
    friendly = F.col("unit_id").startswith(FRIENDLY_PREFIXES[0]) | F.col("unit_id").startswith(
        FRIENDLY_PREFIXES[1]
    )
    mine = lambda c: F.when(friendly, c)
    total = F.count_if(friendly)
    divisor = F.greatest(total, F.lit(1))

    def mean(column: str) -> Column:
        # decimals: the sum is exact, so partition order cannot change the last bits
        value = F.coalesce(F.col(column), F.lit(50.0)).cast("decimal(18,6)")
        return F.coalesce(F.sum(mine(value)), F.lit(0)).cast("double") / divisor

    def share(cond: Column) -> Column:
        return F.count_if(friendly & cond) / divisor * 100

    folded = current.agg(
        mean("fuel_level_pct").alias("fuel"),
        mean("ammo_level_pct").alias("ammo"),
        share(F.col("comms_status") == "NOMINAL").alias("comms"),
        share(F.col("equipment_status") == "FULLY_OPERATIONAL").alias("equip"),
        total.alias("friendly_count"),
        F.count(F.lit(1)).alias("total_tracked"),
    )
    overall = F.col("fuel") * 0.3 + F.col("ammo") * 0.3 + F.col("comms") * 0.2 + F.col("equip") * 0.2
    rounded = lambda c: F.round(c.cast("decimal(28,10)"), 1).cast("double")
    return folded.select(
        rounded(overall).alias("overall"),
        rounded(F.col("fuel")).alias("fuel_avg"),
        rounded(F.col("ammo")).alias("ammo_avg"),
        rounded(F.col("comms")).alias("comms_up_pct"),
        rounded(F.col("equip")).alias("equip_ok_pct"),
        "friendly_count",
        "total_tracked",
    )


def count_by_type(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def recent_count(df: DataFrame, now_ms: Column | int, hours: int = 24, time: str = "timestamp") -> DataFrame:
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return df.where(F.col(time) >= now - F.lit(hours * 3_600_000)).agg(F.count(F.lit(1)).alias("recent"))


def log_last_n(log: DataFrame, n: int, domain: str | None, order: Sequence[str] = ("epoch_ms", "seq")) -> DataFrame:
    """Last ``n`` entries, then the domain filter (in that order), newest first, with the
    size of the whole log."""
    total = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    last = log.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    if domain:
        last = last.where(F.col("domain") == domain.upper())
    return last.withColumn("total", total)


# --- logistics ---------------------------------------------------------------------------
def equipment_rate(df: DataFrame) -> DataFrame:
    """Not-mission-capable count and operational rate per equipment row."""
    return df.withColumns(
        {
            "nmc": F.col("total") - F.col("fmc"),
            "or_rate": F.round(ratio(F.col("fmc"), F.col("total")), 2),
        }
    )


def supply_status(df: DataFrame, rounded: bool = False) -> DataFrame:
    """Fill rate, days of supply and colour; ``rounded`` grades the rounded rate
    (as updates do) instead of the exact one (as the first load does)."""
    fill = ratio(F.col("on_hand"), F.col("max_capacity"))
    rate = F.round(fill, 2)
    graded = rate if rounded else fill
    daily = F.greatest(F.lit(1.0), F.col("max_capacity").cast("double") / 30.0)
    return df.withColumns(
        {
            "fill_rate": rate,
            "days_of_supply": F.round(F.col("on_hand").cast("double") / daily, 1),
            "status": F.when(graded > 0.6, "GREEN").when(graded > 0.3, "AMBER").otherwise("RED"),
        }
    )
