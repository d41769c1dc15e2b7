"""Operator-response records. Record keeping only: nothing is carried out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults and the detail fields recorded for each action of each domain.
DEFAULT_OPERATOR = "COP_OPERATOR"
STATUS = "EXECUTED"
COMMON_TOPIC = "cop-actions"
MISSING = "id and action required"
REQUEST_DEFAULTS = {
    "source_ip": "UNKNOWN",
    "target_system": "UNKNOWN",
    "severity": "HIGH",
    "frequency_band": "X-BAND",
}
DETAILS: dict[tuple[str, str], dict[str, str]] = {
    ("CYBER", "block_ip"): {"blocked_ip": "{source_ip}", "firewall_rule": "BLOCK-{id}",
                            "message": "Address {source_ip} blocked"},
    ("CYBER", "isolate_system"): {"isolated_system": "{target_system}", "message": "{target_system} isolated"},
    ("CYBER", "alert_team"): {"priority": "{severity}", "message": "Teams notified"},
    ("CYBER", "escalate"): {"ticket_id": "ESC-{id}", "message": "Incident escalated"},
    ("CYBER", "contain"): {"message": "Containment recorded"},
    ("CYBER", "investigate"): {"investigation_id": "INV-{id}", "message": "Investigation opened"},
    ("SIGINT", "jam"): {"freq_band": "{frequency_band}", "message": "Request on {frequency_band} recorded"},
    ("SIGINT", "geolocate"): {"message": "Geolocation requested"},
    ("SIGINT", "alert_ew"): {"message": "Coordinators notified"},
    ("SIGINT", "task_collection"): {"duration_min": "30", "message": "Collection requested"},
    ("SIGINT", "classify"): {"message": "Classification requested"},
    ("SIGINT", "share_intel"): {"message": "Report shared"},
    ("EMBM", "kinetic_strike"): {"message": "Request recorded"},
    ("EMBM", "ew_attack"): {"message": "Request recorded"},
    ("EMBM", "refine_geo"): {"message": "Refinement requested"},
    ("EMBM", "monitor"): {"message": "Monitoring established"},
}


def detail_templates(domain: Column, action: Column) -> Column:
    """The detail templates of a (domain, action) as a literal map: no join, whatever number of requests one pair has."""
    known = [
        entry
        for (d, a), fields in DETAILS.items()
        for entry in (
            F.lit(f"{d}/{a}"),
            F.array(*[F.struct(F.lit(k).alias("field"), F.lit(t).alias("template")) for k, t in fields.items()]),
        )
    ]
    return F.try_element_at(F.create_map(*known), F.concat_ws("/", domain, action))


def _present(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with an id and an action, and the rejected rest with a reason."""
    complete = _present("entity_id") & _present("action")
    return requests.where(complete), requests.where(~complete).withColumn("error", F.lit(MISSING))


def _fill(template: Column) -> Column:
    out = F.replace(template, F.lit("{id}"), F.col("entity_id"))
    for name, default in REQUEST_DEFAULTS.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit(default)))
    return out


def action_audit(requests: DataFrame) -> DataFrame:
    """One audit record per complete request; an unknown action has empty details."""
    complete, _ = split_requests(requests)
    fields = F.coalesce(
        detail_templates(F.col("domain"), F.col("action")), F.array().cast("array<struct<field: string, template: string>>")
    )
    details = F.map_from_entries(F.transform(fields, lambda f: F.struct(f["field"], _fill(f["template"]))))
    return complete.select(
        "entity_id",
        "action",
        F.coalesce("operator", F.lit(DEFAULT_OPERATOR)).alias("operator"),
        F.date_format(F.timestamp_millis("epoch_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"),
        "epoch_ms",
        F.lit(STATUS).alias("status"),
        "domain",
        F.to_json(details).alias("details"),
        *[c for c in ("seq",) if c in requests.columns],
    )


def action_fanout(records: DataFrame) -> DataFrame:
    """Each record once per topic it is published to."""
    own = F.concat(F.lit("cop-"), F.lower("domain"), F.lit("-actions"))
    return records.withColumn("topic", F.explode(F.array(own, F.lit(COMMON_TOPIC))))
