"""Search documents: built from entity rows, chunked, turned into embedding text, loaded and listed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.conditions import is_in, ladder
from gridlark.functions.geo import geo_point
from gridlark.functions.text import padded_index, template
from gridlark.operators.state import ORDER, top_recent
from gridlark.sources.sinks import read_upserted, upsert_sink

# Country names, document labels and text formats.
COUNTRIES = {"US": "United States", "RU": "Russia", "CN": "China", "IR": "Iran"}
ACTOR_COUNTRIES = {"RU": "Russia", "CN": "China", "IR": "Iran", "KP": "North Korea"}
LINE = "\n    "
BLANKS = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class DocumentKind:
    collection: str
    id_column: str
    doc_type: str
    domain: str
    classification: str
    source: str
    confidence: float | None
    keywords: tuple[str, ...]
    lines: tuple[str, ...]
    lat: str = "lat"
    lon: str = "lon"


KINDS = {
    "aircraft": DocumentKind(
        "rag_aircraft", "aircraft_id", "aircraft", "AIR", "UNCLASSIFIED", "real-time-tracking", 0.95,
        ("aircraft_type", "role", "country", "iff_status"),
        (
            "{aircraft_type|Unknown} ({tail_number|N/A}) is a {iff_status} {role|unknown role} aircraft ",
            "operated by {country_name}. ",
            "Currently at altitude {altitude_ft|0:grouped} feet, heading {heading_deg:f0} degrees ",
            "at {speed_kts:f0} knots. Position: {lat:f4}°N, {lon:f4}°E.",
            "Mission status: {status|Unknown}. Fuel: {fuel_pct:f0}%.",
            "Weapons: {weapons|Unknown}.",
        ),
    ),
    "naval": DocumentKind(
        "rag_naval", "vessel_id", "naval_vessel", "MARITIME", "UNCLASSIFIED", "real-time-tracking", 0.92,
        ("vessel_type", "vessel_class", "country", "iff_status"),
        (
            "{vessel_type|Unknown} ({hull_number|N/A}) is a {iff_status} {vessel_class|unknown class} vessel",
            "operated by the {country_name} Navy.",
            "Displacement: {displacement_tons|0:grouped} tons. Currently heading {heading_deg:f0} degrees",
            "at {speed_kts:f0} knots. Position: {lat:f4}°N, {lon:f4}°E.",
            "Status: {status|Unknown}. Weapons: {weapons|Unknown}.",
            "{capacity_note}",
        ),
    ),
    "cyber": DocumentKind(
        "rag_cyber_incidents", "incident_id", "cyber_incident", "CYBER", "SECRET", "cyber-defense-center", 0.88,
        ("attack_type", "threat_actor", "target_facility", "severity"),
        (
            "CYBER INCIDENT {incident_id}: {attack_type|Unknown} attack detected.",
            "Threat actor: {threat_actor|Unknown} ({country_name} state-sponsored).",
            "Sophistication level: {sophistication|Unknown}.",
            "Target: {target_facility|Unknown} - {target_system|Unknown} ({target_type} in {target_region}).",
            "Severity: {severity|Unknown}. Status: {status|Unknown}.",
            "Source IP: {source_ip|Unknown}. Destination: {destination_ip|Unknown}:{port}.",
            "MITRE ATT&CK: {mitre_attack|Unknown}.",
            "Target coordinates: {target_lat:f4}°N, {target_lon:f4}°E.",
        ),
        "target_lat", "target_lon",
    ),
    "facility": DocumentKind(
        "rag_facilities", "facility_id", "facility", "INFRASTRUCTURE", "UNCLASSIFIED", "facility-registry", 1.0,
        ("name", "type", "region"),
        (
            "US Military Facility: {name|Unknown} ({facility_id}).",
            "Type: {type|Unknown}. Region: {region|Unknown}.",
            "Location: {lat:f4}°N, {lon:f4}°E in {country|Unknown}.",
            "Networks: {network_list}.",
            "This facility supports US military operations in the {region} theater.",
        ),
    ),
    "sigint": DocumentKind(
        "rag_sigint", "intercept_id", "sigint", "SIGINT", "TOP_SECRET", "sigint-collection", None,
        ("signal_type", "emitter_classification", "threat_level"),
        (
            "SIGINT Intercept {intercept_id}: {signal_type|Unknown} signal detected.",
            "Frequency: {frequency_mhz:f2} MHz, Bandwidth: {bandwidth_khz:f1} kHz.",
            "Modulation: {modulation|Unknown}. Signal strength: {signal_strength_dbm:f1} dBm.",
            "Bearing: {bearing_deg:f1}°. Position: {lat:f4}°N, {lon:f4}°E.",
            "Emitter classification: {emitter_classification|Unknown}.",
            "Threat level: {threat_level|Unknown}. Emission pattern: {emission_pattern|Unknown}.",
            "Collected by: {collector_id|Unknown}. Confidence: {confidence_pct:f0}%.",
        ),
    ),
}


def _name_of(column: str, names: dict[str, str], rest: Column) -> Column:
    out = None
    for code, name in names.items():
        cond = F.col(column) == code
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(rest)


def _inputs(kind: str) -> dict[str, Column]:
    """Columns the texts use that the rows do not have."""
    if kind in ("aircraft", "naval"):
        inputs = {
            "iff_status": ladder([(is_in("iff_mode", "FRIENDLY"), "friendly")], "hostile"),
            "country_name": _name_of("country", COUNTRIES, F.coalesce("country", F.lit("Unknown"))),
        }
        if kind == "naval":
            capacity = F.col("aircraft_capacity")
            inputs["capacity_note"] = F.when(
                capacity != 0, F.concat(F.lit("Aircraft capacity: "), capacity.cast("string"), F.lit(" aircraft."))
            )
        return inputs
    if kind == "cyber":
        return {"country_name": _name_of("actor_country", ACTOR_COUNTRIES, F.lit("Unknown"))}
    if kind == "facility":
        return {"network_list": F.concat_ws(", ", "networks")}
    return {"emitter_country": F.split("emitter_classification", "-")[0]}


# Fields that become one nested struct instead of staying flat.
POSITION = {
    "aircraft": ("lat", "lon", "altitude_ft", "heading_deg", "speed_kts"),
    "naval": ("lat", "lon", "heading_deg", "speed_kts"),
}
HELPERS = ("iff_status", "country_name", "capacity_note", "network_list")


def build_documents(df: DataFrame, kind: str) -> DataFrame:
    """Entity rows as nested search documents."""
    spec = KINDS[kind]
    rows = df.withColumns(_inputs(kind))
    confidence = F.lit(spec.confidence) if spec.confidence is not None else F.coalesce(
        "confidence_pct", F.lit(0.0)
    ) / 100.0
    metadata = F.struct(
        F.lit(spec.doc_type).alias("doc_type"),
        F.lit(spec.domain).alias("domain"),
        F.lit(spec.classification).alias("classification"),
        F.lit(spec.source).alias("source"),
        confidence.alias("confidence"),
        F.array(*[F.col(k) for k in spec.keywords]).alias("keywords"),
    )
    nested = POSITION.get(kind, ())
    flat = [c for c in rows.columns if c not in (*nested, *HELPERS, "ts")]
    extra = []
    if nested:
        extra.append(F.struct(*nested).alias("position"))
        extra.append(ladder([(is_in("iff_mode", "FRIENDLY"), "FRIENDLY")], "HOSTILE").alias("threat_level"))
        flat = [c for c in flat if c != "threat_level"]
    return rows.select(
        *flat,
        *extra,
        geo_point(spec.lat, spec.lon).alias("location"),
        F.rtrim(template(LINE.join(spec.lines)), F.lit(BLANKS)).alias("rag_text"),
        metadata.alias("rag_metadata"),
    )


def index_writer(path: str, kind: str):
    """Sink that indexes documents of a kind: the last one per id wins."""
    return upsert_sink(path, KINDS[kind].id_column, ORDER)


def read_index(spark, path: str, kind: str) -> DataFrame:
    return read_upserted(spark, path, KINDS[kind].id_column, ORDER)


# --- chunks ----------------------------------------------------------------------------------
def chunk(
    df: DataFrame,
    separator: str = "\n\n",
    id_column: str = "document_id",
    text_column: str = "content",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Paragraphs of a document: trimmed, empty ones dropped, numbered from zero."""
    literal = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in separator)
    pieces = F.filter(
        F.transform(F.split(text_column, literal), lambda p: F.btrim(p, F.lit(BLANKS))), lambda p: p != ""
    )
    rows = df.select(id_column, *keep, F.posexplode(pieces).alias("chunk_index", "content"))
    words = F.filter(F.split("content", r"[ \t\n\r\x0b\x0c]+"), lambda w: w != "")
    return rows.select(
        F.concat(F.col(id_column).cast("string"), F.lit("-"), padded_index(F.col("chunk_index"))).alias("chunk_id"),
        id_column,
        *keep,
        "chunk_index",
        "content",
        F.size(words).alias("word_count"),
        F.length("content").alias("char_count"),
    )


# --- embedding text -----------------------------------------------------------------------------
def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.ArrayType):
        return F.concat_ws(" ", F.transform(col, lambda x: x.cast("string")))
    if isinstance(kind, T.StructType):
        return F.concat_ws(" ", *[F.col(f"{name}.{f.name}").cast("string") for f in kind.fields])
    return col.cast("string")


def embedding_text(df: DataFrame, fields: Sequence[str], preview: int = 500) -> DataFrame:
    """Chosen fields as one whole text, ``text_content``: arrays and structs are joined, missing fields and blank
    results skipped. ``text_preview`` is its beginning, for listings."""
    present = [f for f in fields if f in df.columns]
    text = F.concat_ws(" ", *[_as_text(df, f) for f in present])
    rows = df.withColumn("text_content", text).where(F.btrim("text_content", F.lit(BLANKS)) != "")
    return rows.withColumn("text_preview", F.substring("text_content", 1, preview))


# From which columns the rows of each operational table are embedded.
@dataclass(frozen=True)
class OperationalText:
    source_type: str
    collection: str
    id_prefix: str
    id_column: str
    pattern: str
    metadata: tuple[str, ...]
    newest_first: bool = True


OPERATIONAL = {
    "aircraft": OperationalText(
        "AIRCRAFT", "military_aircraft", "emb-aircraft-", "aircraft_id",
        "{aircraft_type} {country} {role} {status} {weapons}", ("country", "aircraft_type", "iff_mode"), False,
    ),
    "naval": OperationalText(
        "NAVAL", "naval_vessels", "emb-naval-", "vessel_id",
        "{vessel_type} {vessel_class} {country} {status} {weapons}", ("country", "vessel_class"), False,
    ),
    "cyber": OperationalText(
        "CYBER_THREAT", "cyber_threats", "emb-cyber-", "incident_id",
        "{attack_type} {severity} {threat_actor} {description} {target_system} targeting {target_location}",
        ("severity", "attack_type", "threat_actor"),
    ),
    "sigint": OperationalText(
        "SIGINT", "sigint_intercepts", "emb-sigint-", "intercept_id",
        "{signal_type} {category} threat level {threat_level} {description} {emitter_classification}",
        ("signal_type", "threat_level", "category"),
    ),
    "jsir": OperationalText(
        "JSIR", "jsir_incidents", "emb-jsir-", "incident_id",
        "SATCOM jamming {jammer_system} {jammer_country} targeting {target_satellite} mission impact {mission_impact}",
        ("jammer_country", "mission_impact", "target_satellite"),
    ),
    "alerts": OperationalText(
        "ALERT", "operational_alerts", "emb-alert-", "alert_id",
        "{alert_type} {severity} {alert_message}", ("alert_type", "severity"),
    ),
}


def operational_embeddings(tables: dict[str, DataFrame], n: int | None = None) -> DataFrame:
    """The rows of each operational table as text with metadata. With ``n``, only so many of each: the newest where
    the table is time-ordered, others by id."""
    out = None
    for name, df in tables.items():
        spec = OPERATIONAL[name]
        needed = {p.split("}")[0] for p in spec.pattern.split("{")[1:]} | set(spec.metadata)
        rows = df.withColumns({c: F.lit(None).cast("string") for c in needed if c not in df.columns})
        if n is None:
            pass
        elif spec.newest_first:
            rows = top_recent(rows, n, tie=spec.id_column)
        else:
            rows = rows.orderBy(spec.id_column, *[F.col(c).desc() for c in ("timestamp", "seq") if c in df.columns]).limit(n)
        text = template(spec.pattern)
        part = rows.select(
            F.concat(F.lit(spec.id_prefix), F.coalesce(F.col(spec.id_column).cast("string"), F.lit("unknown"))).alias(
                "embedding_id"
            ),
            F.lit(spec.collection).alias("source_collection"),
            F.col(spec.id_column).alias("source_id"),
            F.lit(spec.source_type).alias("source_type"),
            text.alias("text_content"),
            F.to_json(F.struct(*spec.metadata)).alias("metadata"),
        ).where(F.btrim("text_content", F.lit(BLANKS)) != "")
        out = part if out is None else out.unionByName(part)
    return out


# --- knowledge base --------------------------------------------------------------------------------
def kb_list(df: DataFrame, id_column: str, after: str | None = None, n: int | None = None) -> DataFrame:
    """A knowledge table without its vectors: all rows, or the page of ``n`` whose ids follow ``after``."""
    rows = df.drop("embedding")
    if after is not None:
        rows = rows.where(F.col(id_column) > after)
    return rows if n is None else rows.orderBy(id_column).limit(n)


KB_DDL = {
    "equipment": """
        equipment_id string, name string, equipment_type string, country_of_origin string,
        specifications struct<size: int, price: double>, sensors array<string>, weapons array<string>,
        description string, rag_text string""",
    "threat_actors": """
        actor_id string, name string, names array<string>, country string, sophistication string,
        ttps struct<initial_access: array<string>, persistence: array<string>>, rag_text string""",
    "facilities": """
        facility_id string, name string, type string, country string, region string,
        coordinates struct<lat: double, lon: double>, networks array<string>""",
    "geopolitical": """
        country_code string, name string, classification string, military_strength_rank int,
        key_capabilities array<string>, threat_assessment string""",
    "documents": """
        document_id string, title string, source string, classification string, date_published string,
        content string, keywords array<string>""",
}


def load_kb(spark, path: str, kind: str) -> DataFrame:
    """Nested knowledge rows from JSON lines, with a declared schema."""
    return spark.read.schema(T.StructType.fromDDL(KB_DDL[kind])).json(path)
