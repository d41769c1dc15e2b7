"""Records derived from other records: tracks, positions, lookups, normalised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.conditions import is_in, ladder
from gridlark.functions.geo import feet_to_metres, knots_to_kph
from gridlark.operators.lookup import lookup_join

# What a derived emitter track is labelled with.
EMITTER_LABELS = {
    "track_type": "HOSTILE_EMITTER",
    "track_category": "EW_JAMMER",
    "emitter_function": "SATCOM_JAMMER",
    "display_icon": "JAMMER",
    "display_color": "RED",
}

# What a position report assumes when the entity does not say.
POSITION_DEFAULTS = {
    "fuel": 80.0,
    "ammo": 85.0,
    "personnel": 0,
    "equipment": "FULLY_OPERATIONAL",
    "mission": "STANDBY",
    "rate": 2.5,
    "comms": "NOMINAL",
}


def derive_embm_track(jsir: DataFrame) -> DataFrame:
    """One emitter track per interference incident."""
    label = {name: F.lit(value).alias(name) for name, value in EMITTER_LABELS.items()}
    priority = ladder([(is_in("mission_impact_severity", "HIGH", "CRITICAL"), "HIGH")], "MEDIUM")
    carried = [c for c in ("seq", "ts") if c in jsir.columns]
    return jsir.select(
        F.concat(F.lit("EMBM-"), "jammer_id", F.lit("-"), "incident_id").alias("track_id"),
        "timestamp",
        F.col("incident_id").alias("source_incident"),
        label["track_type"],
        label["track_category"],
        label["emitter_function"],
        F.col("jammer_lat").alias("lat"),
        F.col("jammer_lon").alias("lon"),
        (F.col("cep_km") * 1000.0).alias("position_accuracy_m"),
        F.col("jammer_terrain").alias("terrain"),
        F.col("jammer_system").alias("emitter_system"),
        F.col("jammer_country").alias("emitter_country"),
        F.col("jammer_type").alias("emitter_type"),
        F.col("jammer_power_kw").alias("estimated_power_kw"),
        "spectral_signature",
        F.col("mission_impact_severity").alias("threat_level"),
        F.col("geolocation_confidence_pct").alias("confidence"),
        F.lit(True).alias("targetable"),
        F.col("strike_coords_lat").alias("target_coord_lat"),
        F.col("strike_coords_lon").alias("target_coord_lon"),
        F.lit(None).cast("string").alias("nearby_assets"),
        label["display_icon"],
        label["display_color"],
        priority.alias("display_priority"),
        *carried,
    )


def derive_gps_record(
    df: DataFrame,
    entity_id: Column,
    entity_type: Column,
    name: Column | None = None,
    speed_knots: Column | None = None,
    altitude_ft: Column | None = None,
    fuel: Column | None = None,
    ammo: Column | None = None,
    personnel: Column | None = None,
    status: Column | None = None,
) -> DataFrame:
    """Turn any moving entity into a position report; absent values get defaults."""

    def given(col, default):
        return F.lit(default) if col is None else F.coalesce(col, F.lit(default))

    still = F.lit(0.0)
    fixed = POSITION_DEFAULTS
    return df.select(
        entity_id.alias("unit_id"),
        (entity_id if name is None else F.coalesce(name, entity_id)).alias("unit_name"),
        entity_type.alias("unit_type"),
        "timestamp",
        F.round("lat", 6).alias("lat"),
        F.round("lon", 6).alias("lon"),
        F.round("heading_deg", 1).alias("heading_deg"),
        F.round(knots_to_kph(still if speed_knots is None else speed_knots), 1).alias("speed_kph"),
        F.round(feet_to_metres(still if altitude_ft is None else altitude_ft), 1).alias("altitude_m"),
        given(fuel, fixed["fuel"]).alias("fuel_level_pct"),
        given(ammo, fixed["ammo"]).alias("ammo_level_pct"),
        given(personnel, fixed["personnel"]).cast("int").alias("personnel_count"),
        F.lit(fixed["equipment"]).alias("equipment_status"),
        given(status, fixed["mission"]).alias("mission_status"),
        F.lit(fixed["rate"]).alias("fuel_consumption_rate"),
        F.lit(fixed["comms"]).alias("comms_status"),
    )


def derive_affected_units(incidents: DataFrame, units: DataFrame) -> DataFrame:
    """Units that depend on the satellite an incident targets.

    The dependency arrays are exploded into an equi-join key and the unit registry (a
    dimension, far smaller than the incidents) is folded per satellite first: incidents
    are joined once and never multiplied by the number of units.
    """
    by_satellite = (
        units.select("callsign", "unit_class", "region", F.explode(F.array_distinct("satcom_deps")).alias("satellite"))
        .groupBy("satellite")
        .agg(F.sort_array(F.collect_set(F.struct("callsign", "unit_class", "region"))).alias("units"))
    )
    joined = lookup_join(incidents, by_satellite, F.col("target_satellite"), "satellite")
    none = F.array().cast("array<string>")
    return joined.select(
        "incident_id",
        "target_satellite",
        F.coalesce(F.col("units.callsign"), none).alias("affected_units"),
        F.coalesce(F.col("units.unit_class"), none).alias("affected_unit_types"),
        F.col("units")[0]["region"].alias("affected_region"),
    )


def lookup_corrective_actions(df: DataFrame, catalogue: DataFrame, default: str) -> DataFrame:
    """Attach the action list for (signal_type, threat_level); unknown pairs get the default. Of several lists for a pair
    the least counts, so repeated catalogue rows change nothing."""
    pair = lambda: F.concat_ws("/", "signal_type", "threat_level")
    table = catalogue.groupBy(pair().alias("pair")).agg(F.min("corrective_actions").alias("corrective_actions"))
    joined = lookup_join(df, table, pair(), "pair").drop("_key")
    return joined.withColumn(
        "corrective_actions", F.coalesce("corrective_actions", F.array(F.lit(default)))
    )


def derive_hull_type(name: Column, default: str = "FFG") -> Column:
    """Text inside the last parentheses of a vessel name."""
    inside = F.regexp_extract(name, r"\(([^(]*?)\)*$", 1)
    return F.when(F.contains(name, F.lit("(")), inside).otherwise(F.lit(default))


def with_topic(df: DataFrame, nation: str, kind: str) -> DataFrame:
    """Name of the per-nation topic a record is routed to."""
    return df.withColumn("topic", F.concat(F.lit("coalition-"), F.lower(nation), F.lit(f"-{kind}")))


# Columns that a store adds to every record.
STORE_COLUMNS = ("_id", "last_update")


def norm_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, ISO text for times, integers for whole decimals; the store's own columns are dropped."""
    out = []
    for field in df.schema.fields:
        if field.name in STORE_COLUMNS:
            continue
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole_second = F.date_format(col, "SSSSSS") == "000000"
            col = F.when(whole_second, F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
                F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            )
        elif isinstance(field.dataType, T.DecimalType):
            col = col.cast("bigint") if field.dataType.scale == 0 else col.cast("double")
        out.append(col.alias(field.name.lower()))
    return df.select(out)


# Id column -> (marker column, prefix, hashed columns).
SYNTHETIC_IDS = {
    "incident_id": ("attack_type", "CY-", ("timestamp", "source_ip")),
    "intercept_id": ("signal_type", "SIG-", ("timestamp", "frequency_mhz")),
}


def synth_ids(df: DataFrame) -> DataFrame:
    """Give rows an id derived from their content when the id column is absent."""
    for id_col, (marker, prefix, parts) in SYNTHETIC_IDS.items():
        if id_col in df.columns or marker not in df.columns:
            continue
        text = F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
        df = df.withColumn(id_col, F.concat(F.lit(prefix), F.substring(F.md5(text), 1, 8)))
    return df
