"""Event record layout and stored-table layouts.

An in-flight event is one wide row: the common columns plus the union of all record
fields, every one nullable. A field the event's type does not have is NULL.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The event types and the fields of each, as the event source names them.
EVENT_FIELDS: dict[int, list[str]] = {
    1: [
        "process_guid", "process_id", "image", "command_line", "current_directory", "user",
        "parent_process_id", "parent_image", "parent_command_line", "integrity_level", "hashes",
    ],
    3: [
        "process_guid", "process_id", "image", "user", "protocol", "initiated", "source_ip",
        "source_port", "destination_ip", "destination_hostname", "destination_port",
    ],
    7: [
        "process_guid", "process_id", "image", "image_loaded", "signed", "signature",
        "signature_status", "hashes",
    ],
    8: [
        "source_process_id", "source_image", "target_process_id", "target_image",
        "new_thread_id", "start_address", "start_module", "start_function",
    ],
    10: [
        "source_process_id", "source_image", "target_process_id", "target_image",
        "granted_access", "call_trace",
    ],
    22: ["process_id", "image", "query_name", "query_status", "query_results"],
}

INT_FIELDS = {
    "process_id", "parent_process_id", "source_process_id", "target_process_id",
    "new_thread_id", "source_port", "destination_port",
}
BOOL_FIELDS = {"initiated", "signed"}

# A row without these is dropped; a missing text here becomes '' (all others stay NULL).
REQUIRED_FIELDS = {
    eid: [f for f in fields if f in {"process_id", "source_process_id", "target_process_id"}]
    for eid, fields in EVENT_FIELDS.items()
}
BLANK_FIELDS = {"process_guid", "image", "source_image", "target_image", "query_name"}

EVENT_TYPE_IDS = list(EVENT_FIELDS)
SOURCE_IMAGE_TYPES = [8, 10]  # these name their process source_image / source_process_id

RECORD_FIELDS: list[str] = list(dict.fromkeys(f for fs in EVENT_FIELDS.values() for f in fs))
COMMON_FIELDS = ["id", "event_type_id", "event_time", "computer"]


def field_type(name: str) -> T.DataType:
    if name in INT_FIELDS:
        return T.LongType()
    return T.BooleanType() if name in BOOL_FIELDS else T.StringType()


def xml_name(field: str) -> str:
    """``destination_ip`` -> ``DestinationIp``, the name the field has in event XML."""
    return "".join(part.capitalize() for part in field.split("_"))


def wide_schema(id_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", id_type or T.LongType()),
            T.StructField("event_type_id", T.IntegerType()),
            T.StructField("event_time", T.TimestampType()),
            T.StructField("computer", T.StringType()),
        ]
        + [T.StructField(f, field_type(f)) for f in RECORD_FIELDS]
    )


# Levels, states and model names the stored tables accept.
SEVERITIES = ["Low", "Medium", "High", "Critical"]  # ascending rank
STATUSES = ["open", "acknowledged", "resolved"]
MODEL_TYPES = ["isolation_forest", "random_forest"]

# Kill-chain tactics in display order.
TACTICS: list[tuple[str, str]] = [
    ("TA0001", "Initial Access"),
    ("TA0002", "Execution"),
    ("TA0003", "Persistence"),
    ("TA0004", "Privilege Escalation"),
    ("TA0005", "Defense Evasion"),
    ("TA0006", "Credential Access"),
    ("TA0007", "Discovery"),
    ("TA0008", "Lateral Movement"),
    ("TA0009", "Collection"),
    ("TA0011", "Command and Control"),
    ("TA0010", "Exfiltration"),
    ("TA0040", "Impact"),
]

EVENT_COLUMNS = ["id", "event_type_id", "timestamp", "pid", "image", "raw_json", "ingested_at"]
HIT_COLUMNS = [
    "id", "event_fk", "rule_id", "rule_name", "severity", "mitre_technique", "mitre_tactic",
    "matched_fields", "timestamp", "event_time",
]
ALERT_COLUMNS = [
    "id", "rule_hit_fk", "event_fk", "rule_id", "rule_name", "severity", "mitre_technique",
    "mitre_tactic", "process_image", "process_pid", "command_line", "parent_image", "status",
    "suspected_families", "timestamp",
]
SCORE_COLUMNS = ["event_fk", "model_type", "score", "timestamp", "mode"]
