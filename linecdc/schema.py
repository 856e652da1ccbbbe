"""Event schema, event types, column vocabularies and the change-table DDL
(B7, C6, C10)."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that the change-event contract requires.
INSERT = "INSERT"
UPDATE = "UPDATE"
DELETE = "DELETE"
EVENT_TYPES = (INSERT, UPDATE, DELETE)

EVENT_COLUMNS = (
    "event_id",
    "file_name",
    "old_value",
    "new_value",
    "event_type",
    "line_number",
    "event_timestamp",
)

# Wire schema of one change event (JSON value of a log record).
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), True),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("old_value", T.StringType(), True),
    T.StructField("new_value", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("line_number", T.IntegerType(), True),
    T.StructField("event_timestamp", T.StringType(), True),
])

# Columns that must be present for a record to be valid.
REQUIRED_COLUMNS = ("event_id", "file_name", "event_type", "event_timestamp")

# Second vocabulary used by one DDL variant (C10): old name -> new name.
ALT_VOCABULARY = {
    "file_name": "file_path",
    "event_type": "operation",
    "event_timestamp": "detected_at",
    "loaded_at": "ingested_at",
}

def change_table_ddl(name: str, location: str | None = None) -> str:
    """CREATE TABLE for the change table (Parquet). Key, NOT NULL and CHECK are
    not enforced by Parquet; the sink and the validity predicate enforce them."""
    loc = f" LOCATION '{location}'" if location else ""
    return (
        f"CREATE TABLE IF NOT EXISTS {name} ("
        "event_id STRING, file_name STRING, old_value STRING, new_value STRING, "
        "event_type STRING, line_number INT, event_timestamp TIMESTAMP, "
        "loaded_at TIMESTAMP DEFAULT current_timestamp(), run_id STRING, batch_id BIGINT"
        f") USING parquet PARTITIONED BY (run_id, batch_id){loc}"
    )
