"""Every query by name. Each takes (spark, data folder) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.operators import alerts as A
from gridlark.operators import audit as R
from gridlark.operators import blocks
from gridlark.operators import derive as D
from gridlark.operators import documents as C
from gridlark.operators import enrich as N
from gridlark.operators import index as I
from gridlark.operators import joins as J
from gridlark.operators import search as Q
from gridlark.operators import state as S
from gridlark.operators import windows as W
from gridlark.functions.text import template
from gridlark.functions.vectors import hash_embedding
from gridlark.plans.pictures import Domain
from gridlark.plans.profiles import ALERTS, BREAKOUTS
from gridlark.plans.session import prepare_vectors, scratch_path
from gridlark.sources import feeds, sinks, tables, topics
from gridlark.sources.external import FEEDS, parse_feed
from gridlark.streaming import entities
from gridlark.streaming import jobs as streaming
from gridlark.sources.zones import ZoneMap, from_millis, to_millis
from gridlark.sources.schemas import KEYS, TOPICS, stream_columns, stream_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def keep(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare_vectors(spark), sf_dir)

        QUERIES[name] = run
        return build

    return keep


def _public(df: DataFrame) -> DataFrame:
    """Without the helper columns that carry arrival order and event time."""
    return df.drop("seq", "ts")


def _register_all() -> None:
    # --- enrichment ----------------------------------------------------------------------
    enriched = {
        "gps": ("current", "classic", "setup", "clean", "deploy"),
        "aircraft": ("current", "setup", "clean"),
        "sigint": ("current", "classic", "setup", "clean", "deploy"),
        "satellite": ("current", "classic", "setup", "deploy"),
    }
    for stream, profiles in enriched.items():
        for profile in profiles:
            register(f"enrich_{stream}_{profile}")(
                lambda s, d, st=stream, p=profile: _public(getattr(Domain(s, d, p), st))
            )
    for stream in ("jsir", "naval", "cyber", "embm"):
        register(f"enrich_{stream}")(
            lambda s, d, st=stream: _public(getattr(Domain(s, d, "current"), st))
        )
    register("enrich_sigint_context")(
        lambda s, d: _public(N.enrich_sigint_context(Domain(s, d, "setup").sigint))
    )
    register("enrich_satellite_pass")(
        lambda s, d: _public(N.enrich_satellite_pass(Domain(s, d, "current").satellite))
    )

    # --- breakout filters ------------------------------------------------------------------
    for name, (source, _) in BREAKOUTS.items():
        register(f"sel_{name}")(
            lambda s, d, n=name, src=source: _public(A.breakout(getattr(Domain(s, d, "current"), src), n))
        )

    # --- alerts ----------------------------------------------------------------------------
    for profile, rules in ALERTS.items():
        for name in rules:
            register(f"alert_{name}_{profile}")(
                lambda s, d, p=profile, n=name: Domain(s, d, p).alert(n)
            )
    for profile in ("current", "classic"):
        register(f"union_alerts_{profile}")(lambda s, d, p=profile: Domain(s, d, p).all_alerts())
    register("part_by_alert_id")(
        lambda s, d: A.part_by_alert_id(Domain(s, d, "current").all_alerts())
    )

    # --- windows -----------------------------------------------------------------------------
    for name, source in (("grid_force", "gps"), ("grid_threat", "sigint"), ("grid_isr", "satellite"),
                         ("force_composition", "gps"), ("active_threats", "sigint")):
        for profile in ("classic", "setup", "deploy"):
            register(f"agg_{name}_{profile}")(
                lambda s, d, n=name, src=source, p=profile: W.flatten_window(
                    getattr(W, n)(getattr(Domain(s, d, p), src), p)
                )
            )
    register("agg_hostile_aircraft")(
        lambda s, d: W.flatten_window(W.hostile_aircraft(Domain(s, d, "setup").aircraft))
    )
    for key, build in (("jammers_country", W.jammers_by_country), ("satcom_status", W.satcom_status),
                       ("strike_targets", W.strike_targets)):
        register(f"agg_{key}")(
            lambda s, d, b=build: W.flatten_window(b(Domain(s, d, "current").jsir))
        )
    for profile in ("setup", "clean"):
        register(f"agg_gps_latest_{profile}")(lambda s, d, p=profile: Domain(s, d, p).gps_latest)

    # --- joins -------------------------------------------------------------------------------
    for profile in ("setup", "clean"):
        for stream in ("aircraft", "naval", "cyber"):
            register(f"join_{stream}_gps_{profile}")(
                lambda s, d, p=profile, st=stream: getattr(J, f"{st}_with_gps")(
                    Domain(s, d, p).raw(st), Domain(s, d, p).gps_latest, p
                )
            )
    for profile in ("classic", "setup", "deploy"):
        register(f"join_units_threat_{profile}")(lambda s, d, p=profile: Domain(s, d, p).threat_zone)
    register("join_isr_gaps")(lambda s, d: W.flatten_window(Domain(s, d, "classic").isr_gaps()))
    for profile in ("classic", "setup"):
        register(f"join_operational_picture_{profile}")(
            lambda s, d, p=profile: W.flatten_window(Domain(s, d, p).operational_picture())
        )
    register("track_unified")(lambda s, d: Domain(s, d, "setup").tracks())
    for stream in ("aircraft", "naval"):
        def tracks_clean(s, d, st=stream):
            """This generation also keeps the matched unit id."""
            dom = Domain(s, d, "clean")
            joined = getattr(J, f"{st}_with_gps")(dom.raw(st), dom.gps_latest, "clean")
            build = J.air_tracks if st == "aircraft" else J.naval_tracks
            return build(joined, keep=("gps_unit_id",)).drop("grid_square")

        register(f"track_{stream}_clean")(tracks_clean)

    # --- derived records -----------------------------------------------------------------------
    register("derive_embm_track")(lambda s, d: _public(D.derive_embm_track(Domain(s, d).raw("jsir"))))


_register_all()


@register("derive_gps_record")
def _gps_records(spark, sf_dir):
    """Aircraft and vessels as position reports."""
    dom = Domain(spark, sf_dir)
    air = D.derive_gps_record(
        dom.raw("aircraft"), F.concat(F.lit("AC-"), "aircraft_id"), F.lit("AIRCRAFT"),
        name=F.col("tail_number"), speed_knots=F.col("speed_kts"), altitude_ft=F.col("altitude_ft"),
        fuel=F.col("fuel_pct"), status=F.col("status"),
    )
    sea = D.derive_gps_record(
        dom.raw("naval"), F.concat(F.lit("SHIP-"), "hull_number"), F.lit("VESSEL"),
        speed_knots=F.col("speed_kts"), status=F.col("status"),
    )
    return air.unionByName(sea)


# --- derived records, lookups, normalisation --------------------------------------------------
def _satellite_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and the satellites they depend on: one unit per nation (a table of fixed size)."""
    key = F.col("n_nationkey")
    return feeds.load(spark, sf_dir, "nation").select(
        F.col("n_name").alias("callsign"),
        F.concat(F.lit("CLASS-"), (key % 3).cast("string")).alias("unit_class"),
        F.concat(F.lit("REGION-"), F.col("n_regionkey").cast("string")).alias("region"),
        F.array(
            F.concat(F.lit("SATCOM-"), (key % 4).cast("string")),
            F.concat(F.lit("SATCOM-"), (key % 3 + 2).cast("string")),
        ).alias("satcom_deps"),
    )


@register("derive_affected_units")
def _affected(spark, sf_dir):
    out = D.derive_affected_units(feeds.jsir_raw(spark, sf_dir), _satellite_users(spark, sf_dir))
    return out.withColumns(
        {c: F.concat_ws(",", c) for c in ("affected_units", "affected_unit_types")}
    )


@register("lookup_corrective_actions")
def _actions(spark, sf_dir):
    """Catalogue derived from the signals: pairs that were seen with a HIGH or CRITICAL level."""
    signals = feeds.sigint_raw(spark, sf_dir)
    pairs = signals.where(F.col("threat_level").isin("HIGH", "CRITICAL")).select("signal_type", "threat_level").distinct()
    catalogue = pairs.select(
        "*",
        F.array(
            F.concat(F.lit("Review "), F.lower("signal_type")), F.concat(F.lit("Report as "), F.lower("threat_level"))
        ).alias("corrective_actions"),
    )
    out = D.lookup_corrective_actions(signals, catalogue, "Monitor and report")
    return out.select(
        "intercept_id", "signal_type", "threat_level", F.concat_ws("; ", "corrective_actions").alias("corrective_actions")
    )


def _coalition(spark, sf_dir):
    """Vessel reports of partner nations, from the supplier table."""
    key = F.col("s_suppkey")
    hull = F.when(key % 3 == 0, F.concat("s_name", F.lit(" (DDG)"))).when(
        key % 3 == 1, F.concat("s_name", F.lit(" (A) (LHD)"))
    ).otherwise(F.col("s_name"))
    return feeds.load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("TRK-"), key.cast("string")).alias("track_id"),
        F.concat(F.lit("N"), (key % 7).cast("string")).alias("nation"),
        hull.alias("vessel_name"),
    )


@register("derive_hull_type")
def _hulls(spark, sf_dir):
    return _coalition(spark, sf_dir).withColumn("hull_type", D.derive_hull_type(F.col("vessel_name")))


@register("src_fanout_topic")
def _fanout(spark, sf_dir):
    return D.with_topic(_coalition(spark, sf_dir), "nation", "naval-tracks")


@register("norm_columns")
def _normalised(spark, sf_dir):
    upper = feeds.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("EVENT_ID"),
        F.col("event_type").alias("Event_Type"),
        F.col("ts").alias("TS"),
        F.col("user_id").cast("decimal(18,0)").alias("USER_ID"),
        F.col("value").cast("decimal(12,2)").alias("VALUE"),
        F.md5(F.col("event_id").cast("string")).alias("_id"),
        F.col("ts").alias("last_update"),
    )
    return D.norm_columns(upper)


@register("synth_ids")
def _synthetic(spark, sf_dir):
    cyber = D.synth_ids(feeds.cyber_raw(spark, sf_dir).select("attack_type", "timestamp", "source_ip"))
    sigint = D.synth_ids(feeds.sigint_raw(spark, sf_dir).select("signal_type", "timestamp", "frequency_mhz"))
    return cyber.select(F.col("incident_id").alias("id"), "timestamp", F.col("attack_type").alias("kind")).unionByName(
        sigint.select(F.col("intercept_id").alias("id"), "timestamp", F.col("signal_type").alias("kind"))
    )


@register("alert_voi")
def _vessels_of_interest(spark, sf_dir):
    return A.vessels_of_interest(
        feeds.naval_raw(spark, sf_dir).withColumnRenamed("country", "flag_country")
    ).select("vessel_id", "flag_country", "lat", "lon", "severity", "timestamp")


_STORED: dict[tuple, tuple] = {}


def _kept(spark, sf_dir, what: str, build: Callable):
    """What is stored once over the tables of a folder, and built on when their files have changed: ``build`` gets what
    it returned before, or None."""
    name, now = (spark.sparkContext.applicationId, sf_dir, what), tables.stamp(spark, sf_dir)
    seen, value = _STORED.get(name, (None, None))
    if seen != now:
        value = build(value)
        _STORED[name] = now, value
    return value


# --- current state and recent rows ---------------------------------------------------------------
DAY, HOUR_MS = 86_400, 3_600_000


def _zones(spark, sf_dir) -> ZoneMap:
    """The zone map of the event table, by kind of event."""
    table = f"{sf_dir}/events.parquet"
    return _kept(
        spark, sf_dir, "zones",
        lambda before: (before or ZoneMap(spark, table, scratch_path(spark, "zones"), "ts", "event_type", feeds.TABLES["events"])).refresh(),
    )


def _cached(spark, sf_dir, stream: str, seconds: int) -> DataFrame:
    """Fresh state of a stream: one scan of the files that the zone map picks, filtered by the stored time."""
    zones, kinds = _zones(spark, sf_dir), feeds.KINDS.get(stream)
    newest = zones.newest(kinds)
    view = getattr(feeds, f"{stream}_view")
    if newest is None:
        return view(feeds.load(spark, sf_dir, "events")).limit(0)
    now = to_millis(newest)
    raw = view(zones.since(from_millis(now - seconds * 1000), kinds))
    return S.state_fresh(raw, S.cache_key(stream), seconds, now)


def _fresh(stream: str, ttl: int | None = None) -> Query:
    return lambda s, d: _public(_cached(s, d, stream, S.FRESH_SECONDS[stream] if ttl is None else ttl))


for _stream in ("aircraft", "naval", "gps", "sigint", "cyber"):
    register(f"state_fresh_{_stream}")(_fresh(_stream))
    register(f"state_fresh_{_stream}_day")(_fresh(_stream, DAY))


@register("state_fresh_or_recent_fresh")
def _fresh_found(spark, sf_dir):
    raw = feeds.aircraft_raw(spark, sf_dir)
    dom = Domain(spark, sf_dir, "current")
    return _public(
        S.state_fresh_or_recent(raw, "aircraft_id", DAY, S.latest_time(raw), dom.aircraft, S.RECENT_ROWS["fallback"])
    )


@register("state_fresh_or_recent_fallback")
def _fresh_missing(spark, sf_dir):
    """The clock is a day past the last record, so the newest stored rows are returned."""
    raw = feeds.naval_raw(spark, sf_dir)
    dom = Domain(spark, sf_dir, "current")
    later = S.latest_time(raw) + F.lit(DAY * 1000)
    return _public(
        S.state_fresh_or_recent(
            raw, "vessel_id", S.FRESH_SECONDS["naval"], later, dom.naval, S.RECENT_ROWS["fallback"]
        )
    )


register("top_recent_alerts")(
    lambda s, d: S.top_recent(Domain(s, d, "current").all_alerts(), S.RECENT_ROWS["alerts"], tie="alert_id")
)
register("top_recent_cyber")(
    lambda s, d: _public(S.top_recent(Domain(s, d, "current").cyber, S.RECENT_ROWS["cyber"]))
)
for _name, (_source, _) in BREAKOUTS.items():
    register(f"top_recent_{_name}")(
        lambda s, d, n=_name, src=_source: _public(
            S.top_recent(A.breakout(getattr(Domain(s, d, "current"), src), n), S.RECENT_ROWS["breakout"])
        )
    )
register("top_recent_passes")(
    lambda s, d: _public(
        S.top_recent(N.enrich_satellite_pass(Domain(s, d, "current").satellite), S.RECENT_ROWS["passes"])
    )
)
register("top_recent_jsir")(
    lambda s, d: _public(S.top_recent(Domain(s, d, "current").jsir, S.RECENT_ROWS["jsir"]))
)


@register("union_dedupe_merge_cyber")
def _merge_cyber(spark, sf_dir):
    dom = Domain(spark, sf_dir, "current")
    cache = _cached(spark, sf_dir, "cyber", DAY)
    return _public(
        S.union_dedupe_merge(dom.cyber, cache, ("incident_id", "source_ip", "timestamp"))
    )


@register("union_dedupe_merge_sigint")
def _merge_sigint(spark, sf_dir):
    dom = Domain(spark, sf_dir, "current")
    cache = _cached(spark, sf_dir, "sigint", DAY)
    return _public(
        S.union_dedupe_merge(
            dom.sigint, cache, ("intercept_id", "frequency_mhz", "timestamp")
        )
    )


register("agg_readiness_rollup")(
    lambda s, d: S.readiness_rollup(S.latest_record(feeds.gps_raw(s, d), "unit_id"))
)
register("agg_count_by_type")(
    lambda s, d: S.count_by_type(
        feeds.load(s, d, "embeddings").select(F.col("label").cast("string").alias("source_type")), "source_type"
    )
)


@register("agg_recent_count")
def _recent(spark, sf_dir):
    zones = _zones(spark, sf_dir)
    newest = zones.newest()
    if newest is None:
        return S.recent_count(feeds.gps_raw(spark, sf_dir), 0)
    return zones.count_since(from_millis(to_millis(newest) - 24 * HOUR_MS))


register("agg_equipment_rate")(lambda s, d: S.equipment_rate(feeds.equipment_status(s, d)))
register("agg_supply_status")(lambda s, d: S.supply_status(feeds.supply_levels(s, d)))
register("agg_supply_status_update")(lambda s, d: S.supply_status(feeds.supply_levels(s, d), rounded=True))
def _peeked(shown: DataFrame, alerts: DataFrame) -> DataFrame:
    """Which rows a peek shows is open: how many they are, how many of them differ, and how many the table has."""
    known = alerts.select("alert_id").distinct().withColumn("known", F.lit(1))
    return shown.join(known, "alert_id", "left").agg(
        F.count("*").alias("shown"), F.count_distinct("alert_id").alias("different"), F.count("known").alias("known")
    )


@register("limit_peek")
def _limit_peek(spark, sf_dir):
    alerts = Domain(spark, sf_dir, "current").all_alerts()
    return _peeked(alerts.limit(5), alerts)




# --- operator responses ----------------------------------------------------------------------------
register("action_audit")(
    lambda s, d: R.action_audit(feeds.action_requests(s, d)).drop("seq")
)
register("action_audit_rejected")(
    lambda s, d: R.split_requests(feeds.action_requests(s, d))[1].select("seq", "domain", "error")
)
register("action_fanout")(
    lambda s, d: R.action_fanout(R.action_audit(feeds.action_requests(s, d))).select(
        "topic", "entity_id", "action", "epoch_ms"
    )
)
for _domain in (None, "cyber"):
    register(f"log_last_n_{_domain or 'all'}")(
        lambda s, d, dom=_domain: S.log_last_n(
            R.action_audit(feeds.action_requests(s, d)), 50, dom
        ).drop("seq")
    )


# --- sources -----------------------------------------------------------------------------------------
STREAMS = ("gps", "aircraft", "naval", "cyber", "sigint", "satellite", "jsir", "embm")


def _messages(spark, sf_dir, stream: str) -> DataFrame:
    raw = feeds.__dict__[f"{stream}_raw"](spark, sf_dir)
    columns = [*stream_columns(stream), "seq"]
    return topics.as_messages(raw.select(*columns), KEYS[stream], TOPICS[stream], keep=("seq",))


for _stream in STREAMS:
    register(f"src_topic_json_{_stream}")(
        lambda s, d, st=_stream: topics.parse_messages(_messages(s, d, st), stream_schema(st), KEYS[st])
    )


@register("src_event_time")
def _event_time(spark, sf_dir):
    timed = W.with_event_time(feeds.gps_raw(spark, sf_dir))
    return timed.select("seq", F.unix_millis("ts").alias("event_ms"), F.hour("ts").alias("event_hour"))


@register("src_key_column")
def _message_key(spark, sf_dir):
    """The key says AC-<tail>, the JSON field only <tail>; the key is what counts."""
    raw = feeds.aircraft_raw(spark, sf_dir)
    messages = raw.select(
        F.concat(F.lit("AC-"), "aircraft_id").alias("key"),
        F.to_json(F.struct(F.col("aircraft_id").alias("unit_id"), "lat", "lon", "timestamp")).alias("value"),
    )
    return topics.parse_messages(messages, stream_schema("gps"), "unit_id").select("unit_id", "lat", "lon", "timestamp")


MIXED = ("gps", "aircraft", "naval", "cyber", "sigint")


def _mixed_messages(spark, sf_dir) -> DataFrame:
    """Messages of five topics as one stored table, as a broker would keep them; ``offset`` counts within a topic."""

    def store(_):
        parts = [_messages(spark, sf_dir, name) for name in MIXED]
        path = scratch_path(spark, "messages")
        merged = reduce(DataFrame.unionByName, parts)
        merged.withColumns({"partition": (F.length("key") % 3).cast("int"), "offset": F.col("seq")}).write.parquet(path)
        return spark.read.parquet(path)

    return _kept(spark, sf_dir, "messages", store)


@register("src_multi_topic")
def _multi_topic(spark, sf_dir):
    """Five topics through one message table, with one scan and one parse, counted per entity of each."""
    fields = {
        "entity_id": {name: (KEYS[name], "string") for name in MIXED},
        "timestamp": {name: ("timestamp", "bigint") for name in MIXED},
    }
    typed = topics.mixed_fields(_mixed_messages(spark, sf_dir), fields)
    return typed.groupBy("stream", "entity_id").agg(
        F.max("timestamp").alias("last_update"), F.count(F.lit(1)).alias("records")
    )


for _reset in ("earliest", "latest"):
    @register(f"src_offset_reset_{_reset}")
    def _offset_reset(spark, sf_dir, reset=_reset):
        """A consumer that has read half of one topic and nothing of the others."""
        messages = _mixed_messages(spark, sf_dir)
        gps = messages.where(F.col("topic") == TOPICS["gps"])
        committed = gps.groupBy("topic", "partition").agg((F.max("offset") / 2).cast("bigint").alias("offset"))
        got = topics.from_offsets(messages, committed, reset)
        return got.groupBy("topic").agg(F.count("*").alias("messages"), F.min("offset").alias("first"), F.max("offset").alias("last"))


def _order_documents(spark, sf_dir) -> DataFrame:
    """One document per customer, replaced by each of the customer's orders."""
    return feeds.load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("change"),
    )


@register("src_snapshot_changes")
def _snapshot(spark, sf_dir):
    """Initial copy: the first document per customer; changes: every document, the newest wins."""
    orders = _order_documents(spark, sf_dir)
    first = orders.groupBy("doc_id").agg(F.min("change").alias("change"))
    snapshot = orders.join(first, ["doc_id", "change"], "left_semi")
    return tables.snapshot_plus_changes(snapshot, orders, "doc_id", ("change",))


@register("src_feed_json")
def _feed(spark, sf_dir):
    """The JSON payload of the event table read with a declared schema, with its topic path cut up."""
    rows = feeds.load(spark, sf_dir, "events").select(
        "event_id", F.col("props").alias("value"),
        F.concat(F.lit("mda/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("topic"),
    )
    parsed = topics.parse_messages(rows, T.StructType.fromDDL("k bigint, missing string"), keep=("event_id", "topic"))
    return topics.feed_topic_parts(parsed)


for _feed_name in FEEDS:
    register(f"src_feed_json_{_feed_name}")(
        lambda s, d, f=_feed_name: parse_feed(feeds.external_messages(s, d, f), f, ("seq",)).drop("feed", "feed_kind")
    )


def _damaged(spark, sf_dir):
    """GPS messages of which some are cut off, as a bad producer would send them."""
    messages = _messages(spark, sf_dir, "gps")
    cut = (F.col("seq") % 7) == 0
    return messages.withColumn("value", F.when(cut, F.substring("value", 1, 40)).otherwise(F.col("value")))


register("snk_error_tolerance_good")(
    lambda s, d: topics.quarantine(_damaged(s, d), stream_schema("gps"), keep=("seq",))[0].select(
        "seq", "unit_id", "timestamp", "fuel_level_pct"
    )
)
register("snk_error_tolerance_bad")(
    lambda s, d: topics.quarantine(_damaged(s, d), stream_schema("gps"), keep=("seq",))[1].select("seq")
)


# --- sinks and tables ------------------------------------------------------------------------------------
@register("snk_derived_topic")
def _derived(spark, sf_dir):
    """An enriched stream persisted under its own name, then read back."""
    path = scratch_path(spark, "sigint_enriched")
    Domain(spark, sf_dir, "current").sigint.write.parquet(path)
    return _public(spark.read.parquet(path))


@register("snk_upsert")
def _upsert(spark, sf_dir):
    """Two batches; the second replaces documents of the first."""
    path = scratch_path(spark, "military_aircraft")
    raw = feeds.aircraft_raw(spark, sf_dir)
    write = sinks.upsert_sink(path, "aircraft_id", S.ORDER)
    middle = raw.agg(F.percentile_approx("timestamp", 0.5)).scalar()
    write(raw.where(F.col("timestamp") <= middle), 0)
    write(raw.where(F.col("timestamp") > middle), 1)
    return _public(sinks.read_upserted(spark, path, "aircraft_id", S.ORDER))


@register("snk_append")
def _append(spark, sf_dir):
    """The same batch delivered twice is stored once."""
    path = scratch_path(spark, "operational_alerts")
    alerts = Domain(spark, sf_dir, "current").all_alerts()
    write = sinks.append_sink(path)
    write(alerts, 0)
    write(alerts, 0)
    return sinks.read_appended(spark, path)


@register("snk_replace_load")
def _replace(spark, sf_dir):
    path = scratch_path(spark, "kb_units")
    customers = feeds.load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    tables.replace_table(customers.limit(0), path)
    tables.replace_table(customers, path)
    return spark.read.parquet(path)


@register("snk_batched_insert")
def _batched(spark, sf_dir):
    """Files of a bounded number of rows; a writer's batches are its own affair."""
    path = scratch_path(spark, "vector_embeddings")
    tables.replace_table(feeds.load(spark, sf_dir, "embeddings").select("vec_id", "label"), path, 5_000_000)
    return spark.read.parquet(path)


@register("snk_copy_tables")
def _copy(spark, sf_dir):
    target = scratch_path(spark, "copy")
    return tables.copy_tables(spark, sf_dir, target, ("orders", "events", "absent", "documents"))


ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
register("snk_table_stats")(
    lambda s, d: tables.table_stats({name: feeds.load(s, d, name) for name in ALL_TABLES})
)
register("snk_unique_key")(
    lambda s, d: tables.duplicates(feeds.load(s, d, "lineitem"), ("l_orderkey", "l_linenumber"))
)


# --- documents ---------------------------------------------------------------------------------------
def _flat_documents(docs: DataFrame, id_column: str) -> DataFrame:
    """Nested documents with one column per field that the SQL check compares."""
    meta = F.col("rag_metadata")
    return docs.select(
        F.col(id_column).cast("string").alias("doc_id"),
        "rag_text",
        meta["doc_type"].alias("doc_type"),
        meta["domain"].alias("domain"),
        meta["classification"].alias("classification"),
        meta["source"].alias("source"),
        meta["confidence"].alias("confidence"),
        F.concat_ws("|", meta["keywords"]).alias("keywords"),
        F.col("location.type").alias("geo_type"),
        F.col("location.coordinates")[0].alias("geo_lon"),
        F.col("location.coordinates")[1].alias("geo_lat"),
    )


def _documents(spark, sf_dir, kind: str) -> DataFrame:
    rows = feeds.facilities(spark, sf_dir) if kind == "facility" else getattr(feeds, f"{kind}_raw")(spark, sf_dir)
    return C.build_documents(rows, kind)


for _kind, _spec in C.KINDS.items():
    register(f"doc_build_{_kind}")(
        lambda s, d, k=_kind, i=_spec.id_column: _flat_documents(_documents(s, d, k), i)
    )


def _indexed(spark, sf_dir, kind: str) -> DataFrame:
    """Documents as an index holds them, one per id: rows are folded before texts are built."""
    raw = getattr(feeds, f"{kind}_raw")(spark, sf_dir)
    return C.build_documents(S.latest_record(raw, C.KINDS[kind].id_column), kind)


for _kind in ("aircraft", "naval", "cyber"):
    @register(f"doc_upsert_{_kind}")
    def _index(spark, sf_dir, kind=_kind):
        """Documents indexed in two deliveries; the later one replaces by id."""
        path = scratch_path(spark, C.KINDS[kind].collection)
        write = C.index_writer(path, kind)
        docs = _documents(spark, sf_dir, kind)
        middle = docs.agg(F.percentile_approx("timestamp", 0.5)).scalar()
        write(docs.where(F.col("timestamp") > middle), 0)
        write(docs.where(F.col("timestamp") <= middle), 1)
        return _flat_documents(C.read_index(spark, path, kind), C.KINDS[kind].id_column)


for _name, _sep in (("lines", "\n"), ("paragraphs", "\n\n")):
    register(f"doc_chunk_{_name}")(
        lambda s, d, sep=_sep: C.chunk(
            feeds.load(s, d, "documents").select("doc_id", "text"), sep, "doc_id", "text"
        )
    )


@register("doc_embed_text")
def _embed_text(spark, sf_dir):
    docs = feeds.load(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.array("source", "lang").alias("tags"),
        F.struct("source", "n_chars").alias("origin"), "text",
    )
    return C.embedding_text(docs, ("lang", "tags", "origin", "absent", "text")).select("doc_id", "text_content")


@register("doc_embed_operational")
def _embed_operational(spark, sf_dir):
    dom = Domain(spark, sf_dir, "current")
    views = {n: dom.raw(n) for n in ("aircraft", "naval", "cyber", "sigint", "jsir")}
    return C.operational_embeddings({**views, "alerts": dom.all_alerts()})


def _fingerprint(df: DataFrame, *id_columns: str) -> DataFrame:
    """A vector that a Python worker has made as one comparable text, every byte value, digested where it was made."""
    return df.select(*id_columns, Q.fingerprint("embedding").alias("told_of")).select(*id_columns, "told_of.*")


def _fingerprint_of_expression(df: DataFrame, *id_columns: str) -> DataFrame:
    """The same of a vector that Spark's own expressions make: it stays there."""
    as_bytes = F.transform("embedding", lambda x: (x * 128 + 128).cast("int").cast("string"))
    return df.select(
        *id_columns, F.size("embedding").alias("dimensions"), F.md5(F.concat_ws(",", as_bytes)).alias("fingerprint")
    )


register("emb_hash")(
    lambda s, d: _fingerprint_of_expression(
        feeds.load(s, d, "benchmark").select("item_id", hash_embedding(F.col("text")).alias("embedding")), "item_id"
    )
)
register("emb_batch")(
    lambda s, d: _fingerprint(Q.embed(feeds.load(s, d, "documents").select("doc_id", "text"), "text", tasks=_tasks(s)), "doc_id")
)


@register("emb_rows_operational")
def _embedding_rows(spark, sf_dir):
    """Complete embedding rows: where the text is from, its vector, the model and its dimensions."""
    rows = I.embedding_rows(_embed_operational(spark, sf_dir), tasks=_tasks(spark))
    kept = ("embedding_id", "source_collection", "source_id", "source_type", "text_content", "embedding_model", "metadata")
    return _fingerprint(rows.select(*kept, F.col("dimensions").alias("told"), "embedding"), *kept, "told")


# --- knowledge tables ------------------------------------------------------------------------------------
def _kb_equipment(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return feeds.load(spark, sf_dir, "part").select(
        F.concat(F.lit("EQ-"), key.cast("string")).alias("equipment_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("equipment_type"),
        F.col("p_brand").alias("country_of_origin"),
        F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("specifications"),
        F.array(F.concat(F.lit("S-"), (key % 5).cast("string"))).alias("sensors"),
        F.array(F.concat(F.lit("W-"), (key % 3).cast("string"))).alias("weapons"),
        F.concat(F.lit("Catalogue item "), key.cast("string")).alias("description"),
        F.concat_ws(" ", F.col("p_name"), F.lit("of type"), F.col("p_type"), F.lit("made by"), F.col("p_brand")).alias(
            "rag_text"
        ),
    )


def _kb_actors(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    country = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    level = F.when(key % 3 == 0, "ADVANCED").otherwise("MODERATE")
    return feeds.load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ACT-"), key.cast("string")).alias("actor_id"),
        F.col("s_name").alias("name"),
        country.alias("country"),
        level.alias("sophistication"),
        F.concat_ws(" ", F.lit("Hostile actor"), F.col("s_name"), F.lit("active in"), country, F.lit("level"), level).alias(
            "rag_text"
        ),
    )


@register("kb_load")
def _load_kb(spark, sf_dir):
    """Nested rows written as JSON lines and read back with the declared schema."""
    path = scratch_path(spark, "kb_equipment")
    _kb_equipment(spark, sf_dir).write.json(path)
    rows = C.load_kb(spark, path, "equipment")
    return rows.select(
        "equipment_id", "name", F.col("specifications.size").alias("size"), F.col("specifications.price").alias("price"),
        F.col("sensors")[0].alias("sensor"), F.col("weapons")[0].alias("weapon"), "rag_text",
    )


register("kb_list_equipment")(
    lambda s, d: C.kb_list(_kb_equipment(s, d), "equipment_id").select("equipment_id", "name", "rag_text")
)
def _kb_geopolitical(spark, sf_dir) -> DataFrame:
    """Countries with a size rank from their customers."""
    sizes = feeds.load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("size")
    )
    return feeds.load(spark, sf_dir, "nation").join(sizes, "n_nationkey", "left").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("country_code"),
        F.col("n_name").alias("name"),
        F.coalesce("size", F.lit(0)).alias("size"),
    )


register("kb_list_geopolitical")(lambda s, d: C.kb_list(_kb_geopolitical(s, d), "country_code"))
register("kb_list_threat_actors")(lambda s, d: C.kb_list(_kb_actors(s, d), "actor_id"))


# --- search ------------------------------------------------------------------------------------------------
QUESTION = "hostile aircraft or critical cyber incident with small ring in status PATROL"


def _collections(spark, sf_dir) -> dict[str, Q.Collection]:
    """The searchable collections: the five of the default route, facilities and signals."""

    def table(df, id_column, merge_id, line):
        return Q.Collection(df, id_column, "rag_text", merge_id, (lambda: template(line)) if line else None)

    return {
        "rag_aircraft": table(
            _indexed(spark, sf_dir, "aircraft"), "aircraft_id", "aircraft_id",
            "{aircraft_type} ({tail_number}) - {country} - {status}",
        ),
        "rag_naval": table(
            _indexed(spark, sf_dir, "naval"), "vessel_id", "vessel_id",
            "{vessel_type} ({hull_number}) - {country} - {status}",
        ),
        "rag_cyber_incidents": table(
            _indexed(spark, sf_dir, "cyber"), "incident_id", "incident_id",
            "{attack_type} [{severity}] - {threat_actor} → {target_facility}",
        ),
        "kb_equipment": table(
            _kb_equipment(spark, sf_dir), "equipment_id", "equipment_id",
            "{name} ({equipment_type}) - {country_of_origin}",
        ),
        "kb_threat_actors": table(
            _kb_actors(spark, sf_dir), "actor_id", None, "{name} ({country}) - {sophistication}",
        ),
        "rag_facilities": table(_documents(spark, sf_dir, "facility"), "facility_id", "facility_id", None),
        "rag_sigint": table(_indexed(spark, sf_dir, "sigint"), "intercept_id", "intercept_id", None),
    }


def _tasks(spark) -> int:
    """For tables that one task reads: as many tasks as the cluster has cores to encode their texts."""
    return spark.sparkContext.defaultParallelism


def _delivered(spark, sf_dir, before: tuple | None) -> tuple[str, int, I.Published]:
    path, batch, _ = before or (scratch_path(spark, "search-index"), -1, None)
    I.deliver(spark, path, I.searchable(_collections(spark, sf_dir)), batch + 1, complete=True, tasks=_tasks(spark))
    return path, batch + 1, I.publish(spark, path, scratch_path(spark, "search-published"))


def _index_of(spark, sf_dir) -> I.Published:
    """The search index over the tables of a folder."""
    return _kept(spark, sf_dir, "index", lambda before: _delivered(spark, sf_dir, before))[2]


register("search_keyword")(
    lambda s, d: I.keyword(QUESTION, _index_of(s, d), Q.DEFAULT_ROUTE).select("collection", "hit_id", "text", "line", "score")
)


@register("search_keyword_texts")
def _keyword_texts(spark, sf_dir):
    """Whole documents, pages and conversation turns."""
    turns = feeds.load(spark, sf_dir, "conversations").withColumn(
        "turn_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    )
    texts = {
        "documents": Q.Collection(feeds.load(spark, sf_dir, "documents"), "doc_id", "text"),
        "pages": Q.Collection(feeds.load(spark, sf_dir, "pages"), "page_id", "html"),
        "conversations": Q.Collection(turns, "turn_id", "text"),
    }
    return Q.keyword_search("the then station, whether éaux or ERETH", texts).select("collection", "hit_id", "score")


register("search_vector")(
    lambda s, d: Q.shown(I.semantic(QUESTION, _index_of(s, d), Q.DEFAULT_ROUTE)).select("collection", "hit_id", "text", "score")
)


@register("search_vector_index")
def _vector_index(spark, sf_dir):
    """Filtered index search over stored blocks of one source type each; the score is the index's (1 + cosine) / 2."""
    rows = feeds.load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("source_id"), "embedding",
        F.concat(F.lit("TYPE-"), F.col("label").cast("string")).alias("source_type"),
    )
    stored = _kept(
        spark, sf_dir, "vectors",
        lambda _: blocks.pack(rows, "source_id", "embedding", scratch_path(spark, "vectors"), "source_type"),
    )
    query = feeds.load(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]
    hits = blocks.nearest(stored, query, Q.VECTOR_LIMIT, ["TYPE-3"])
    text = F.concat(F.lit("vector "), "id").alias("text")
    return Q.shown(hits.select(F.col("id").alias("hit_id"), text, Q.index_score(F.col("score")).alias("score")))


@register("search_many")
def _many(spark, sf_dir):
    """Every vector as a query against all vectors."""
    rows = feeds.load(spark, sf_dir, "embeddings")
    return Q.vector_search_batch(
        rows.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "doc_id"), 5
    )


@register("search_many_texts")
def _many_texts(spark, sf_dir):
    """Every benchmark text as a query against all whole documents."""
    queries = Q.embed(feeds.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text")
    docs = Q.embed(feeds.load(spark, sf_dir, "documents").select("doc_id", "text"), "text", tasks=_tasks(spark))
    return Q.vector_search_batch(queries, docs, 10)


register("search_hybrid")(lambda s, d: Q.results_page(I.ask(QUESTION, _index_of(s, d), collections=Q.DEFAULT_ROUTE)))
register("union_hybrid_results")(lambda s, d: I.ask(QUESTION, _index_of(s, d), collections=Q.DEFAULT_ROUTE).drop("text", "line"))
register("query_summary")(
    lambda s, d: Q.summarise(I.ask(QUESTION, _index_of(s, d), collections=Q.DEFAULT_ROUTE), QUESTION, Q.intent_of(QUESTION))
)
for _type in ("keyword", "semantic", "hybrid"):
    register(f"query_answer_{_type}")(lambda s, d, t=_type: I.answer(QUESTION, _index_of(s, d), t)[0])

#: A question for each domain that has a collection of its own.
DOMAIN_QUESTIONS = {
    "infrastructure": "which airfield or station base has the networks",
    "signals": "strong radar emission with critical threat level",
    "maritime": "friendly destroyer at sea",
    "cyber": "critical malware intrusion",
}
for _name, _asked in DOMAIN_QUESTIONS.items():
    register(f"query_answer_{_name}")(lambda s, d, q=_asked: I.answer(q, _index_of(s, d))[0])
register("query_answer_summary")(lambda s, d: I.answer(QUESTION, _index_of(s, d), "keyword")[1])


def _questions(spark, sf_dir) -> DataFrame:
    """Every conversation turn as a query, with words of one of several themes added."""
    themes = (
        "Hostile AIRCRAFT over Russia", "friendly ship from China", "critical malware", "which airfield",
        "high SIGNAL Iranian", "american fleet", "",
    )
    key = F.col("conv_id") + F.col("turn")
    theme = F.array(*[F.lit(t) for t in themes])[(key % len(themes)).cast("int")]
    return feeds.load(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.concat_ws(" ", F.col("text"), theme).alias("query"),
    )


@register("query_intent")
def _intents(spark, sf_dir):
    intent = _questions(spark, sf_dir).withColumn("i", Q.extract_intent(F.col("query")))
    return intent.select(
        "query_id", "i.domain", "i.action", "i.filters.country", "i.filters.iff_mode", "i.filters.severity"
    )


@register("query_route")
def _routes(spark, sf_dir):
    domain = Q.extract_intent(F.col("query"))["domain"]
    return _questions(spark, sf_dir).select(
        "query_id", F.concat_ws(",", Q.query_route(domain)).alias("collections")
    )


for _type in ("keyword", "semantic", "hybrid"):
    register(f"query_answer_many_{_type}")(
        lambda s, d, t=_type: Q.results_page(I.answer_many(_questions(s, d), _index_of(s, d), search_type=t))
    )

#: When the questions were asked at the latest; each conversation an hour before the next.
ASKED_MS = 1_700_000_000_000


def _logged(spark, sf_dir) -> DataFrame:
    """The log of all questions, each with the number of results that one plan finds for all of them."""
    asked = _questions(spark, sf_dir)
    answers = I.answer_many(asked, _index_of(spark, sf_dir))
    age = (F.split("query_id", "-")[0].cast("long") % 48) * HOUR_MS
    path = scratch_path(spark, "rag_query_history")
    sinks.append_sink(path)(I.log_answers(asked.withColumn("asked_ms", F.lit(ASKED_MS) - age), answers, "hybrid", F.col("asked_ms")), 0)
    return sinks.read_appended(spark, path)


register("query_log")(
    lambda s, d: _logged(s, d).select("query", "intent.domain", "search_type", "result_count", "timestamp")
)
register("query_log_recent")(lambda s, d: Q.recent_queries(_logged(s, d), ASKED_MS))


# --- streaming -----------------------------------------------------------------------------------------------
#: Partitions of streaming state. A checkpoint keeps its number for good: choose it for the data, not for the machine.
STATE_PARTITIONS = 8
#: The same for state that Python keeps for each entity: a call for each of them, so all cores should have a part.
ENTITY_PARTITIONS = 12
#: Of the alert stream: whole alerts, delivered twice, are dealt by id.
ALERT_PARTITIONS = 32


def _streams(spark, sf_dir, profile: str = "classic") -> streaming.Streams:
    return streaming.Streams(streaming.file_stream(spark, f"{sf_dir}/events.parquet", feeds.TABLES["events"]), profile)


def _finished(spark, df, name, mode="append", partitions: int | None = None) -> DataFrame:
    return spark.read.parquet(streaming.finish(df, name, mode, state_partitions=partitions or STATE_PARTITIONS))


@register("stream_tumbling")
def _stream_tumbling(spark, sf_dir):
    """Closed five-minute windows, each reported once."""
    agg = W.flatten_window(W.grid_force(_streams(spark, sf_dir).gps, "classic"))
    return _finished(spark, agg, "grid_force")


@register("stream_watermark")
def _stream_watermark(spark, sf_dir):
    """Windows are final once the watermark has passed them; still open ones are held back."""
    agg = W.flatten_window(W.force_composition(_streams(spark, sf_dir).gps, "deploy"))
    return _finished(spark, agg, "force_composition")


@register("stream_emit_changes")
def _stream_changes(spark, sf_dir):
    """Every change of a part of a window emitted: one part for each emitter, so that the number of emitters is counted
    without a set of them. The table of last changes, merged, equals the batch answer."""
    parts = W.flatten_window(W.windowed_parts(_streams(spark, sf_dir).sigint, "grid_threat", "grid_square", W.GRID_MINUTES, "setup"))
    kept = streaming.finish_changes(
        parts, "grid_threat", ("window_start", "grid_square", "emitter_classification"), ("intercept_count_0",), STATE_PARTITIONS
    )
    return W.merged_parts(kept, "grid_threat", "grid_square", "setup")


@register("stream_late_rows")
def _stream_late(spark, sf_dir):
    """Two deliveries; the second one has rows whose windows the watermark has closed, which are dropped."""
    events = feeds.load(spark, sf_dir, "events")
    late = F.col("event_id") % 5 == 0

    def closed(stream):
        return W.flatten_window(W.force_composition(streaming.Streams(stream).gps, "deploy"))

    last = events.agg(F.max("event_id")).first()[0] or 0
    early = F.col("event_id") <= last * 8 // 10
    path = entities.run_deliveries(
        spark, [events.where(early & ~late), events.where(~early | late)], closed, ("window_start", "unit_type"), ("unit_count",), STATE_PARTITIONS
    )
    return sinks.read_upserted(spark, path, ("window_start", "unit_type"), ("unit_count",)).select("window_start", "unit_type", "unit_count")


@register("stream_stateful_latest")
def _stream_latest(spark, sf_dir):
    changes = streaming.gps_latest_changes(_streams(spark, sf_dir).gps_raw)
    table = streaming.finish_changes(changes, "gps_latest", "unit_id", ("updates",), STATE_PARTITIONS)
    return table.drop("updates")


@register("stream_dedupe")
def _stream_dedupe(spark, sf_dir):
    """The alert stream delivered twice; repeats are dropped within the watermark."""
    twice = _streams(spark, sf_dir).unit_alerts().unionByName(_streams(spark, sf_dir).unit_alerts())
    once = streaming.dedupe(twice, "alert_id")
    return _finished(spark, once.drop("ts"), "alerts", partitions=ALERT_PARTITIONS)


def _slices(df: DataFrame, column: str, n: int) -> list[DataFrame]:
    """The rows in ``n`` parts along a column, as they would arrive."""
    at = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)])).first()[0]
    place = sum((F.col(column) > F.lit(edge)).cast("int") for edge in at)
    return [df.where(place == i) for i in range(n)]


@register("stream_state_fresh")
def _stream_fresh(spark, sf_dir):
    """Units whose last report is younger than two hours as the stream ends, and those that have expired."""
    events = feeds.load(spark, sf_dir, "events")

    def changes(stream):
        timed = streaming.Streams(stream).gps_raw
        return entities.fresh_changes(timed, S.cache_key("gps"), ["unit_id", "lat", "lon", "timestamp", "seq"], 2 * 3600)

    path = entities.run_deliveries(
        spark, _slices(events, "event_id", 4), changes, entities.ENTITY, ("timestamp", "seq", entities.STATUS), ENTITY_PARTITIONS
    )
    table = sinks.read_upserted(spark, path, entities.ENTITY, ("timestamp", "seq", entities.STATUS))
    return table.select("entity", "status", "unit_id", "lat", "lon", "timestamp")


@register("stream_snapshot_changes")
def _stream_snapshot(spark, sf_dir):
    """Documents as of a snapshot, then a stream of changes, some of them older than the snapshot."""
    orders = _order_documents(spark, sf_dir)
    last = orders.agg(F.max("change")).first()[0] or 0
    early, middle = last * 4 // 10, last * 6 // 10
    snapshot = S.latest_record(orders.where(F.col("change") <= middle), "doc_id", ("change",))
    path = entities.run_deliveries(
        spark, _slices(orders.where(F.col("change") > early), "change", 2),
        lambda stream: entities.changes_after_snapshot(stream, snapshot, "doc_id", "change"), "doc_id", ("change",), ENTITY_PARTITIONS,
    )
    newer = sinks.read_upserted(spark, path, "doc_id", ("change",)).withColumn("from_stream", F.lit(True))
    return tables.snapshot_plus_changes(snapshot.withColumn("from_stream", F.lit(False)), newer, "doc_id", ("change",))


@register("stream_persistent")
def _stream_chain(spark, sf_dir):
    """Raw to enriched to breakout, each step a persistent query over the table before it."""
    root = scratch_path(spark, "chain")
    streams = _streams(spark, sf_dir, "current")
    chain = streaming.Chain(spark, root, [
        streaming.Job("sigint_air_defense", lambda t: A.breakout(t["sigint_enriched"], "air_defense"), ("sigint_enriched",)),
        streaming.Job("sigint_enriched", lambda t: streams.sigint.drop("ts")),
    ])
    chain.run_available()
    chain.stop()
    return _public(spark.read.parquet(chain.table("sigint_air_defense")))


@register("stream_join_gps")
def _stream_join(spark, sf_dir):
    """Aircraft stream against the latest-position table as it stands when the batch runs."""
    latest = Domain(spark, sf_dir, "setup").gps_latest
    joined = J.aircraft_with_gps(_streams(spark, sf_dir).aircraft_raw, latest, "setup")
    return _finished(spark, joined, "aircraft_with_gps")


@register("stream_operational_picture")
def _stream_picture(spark, sf_dir):
    picture = W.flatten_window(_streams(spark, sf_dir).operational_picture())
    return _finished(spark, picture, "operational_picture")


@register("stream_units_threat")
def _stream_zone(spark, sf_dir):
    zone = W.flatten_window(_streams(spark, sf_dir).units_in_threat())
    return _finished(spark, zone, "units_in_threat").drop("window_end")


@register("stream_peek")
def _stream_peek(spark, sf_dir):
    """The first rows of a running stream."""
    shown = _finished(spark, _streams(spark, sf_dir).unit_alerts().drop("ts").limit(5), "peek")
    gps = Domain(spark, sf_dir, "classic").gps
    return _peeked(shown, A.alerts_one_pass(gps, [r for r in ALERTS["classic"].values() if r.source == "gps"]))
