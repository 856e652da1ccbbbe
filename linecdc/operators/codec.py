"""Encode / decode / validate change events on the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linecdc.functions.text import built, parse_timestamp, select_built, uuid_form
from linecdc.schema import EVENT_COLUMNS, EVENT_SCHEMA, EVENT_TYPES, REQUIRED_COLUMNS

CORRUPT = "_corrupt"
_DECODE_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType(), True)])
LOG_COLUMNS = ("topic", "partition", "offset", "timestamp")
# A dead letter keeps what it needs to be sent again.
PAYLOAD = ("key", "value")


def encode_value(df: DataFrame) -> Column:
    """The 7 event fields as JSON text; nulls are written, not dropped."""
    return F.to_json(F.struct(*[F.col(c) for c in EVENT_COLUMNS]), {"ignoreNullFields": "false"})


def publish_frame(events: DataFrame) -> DataFrame:
    """B1: one log record per event, key = event_id, value = JSON (bytes), the
    shape ``df.write.format('kafka')`` takes."""
    return events.select(F.encode(F.col("event_id"), "UTF-8").alias("key"),
                         F.encode(encode_value(events), "UTF-8").alias("value"))


def decode(records: DataFrame, keep: tuple[str, ...] = (*PAYLOAD, *LOG_COLUMNS)) -> DataFrame:
    """C1-C3, lenient: bytes -> text -> struct with the fixed schema; unknown
    fields ignored, missing ones null. Malformed text keeps the raw text in
    ``_corrupt``. Log coordinates are kept for first-wins ordering."""
    keep = tuple(c for c in keep if c in records.columns)
    return select_built(select_built(records, _parsed, keep), _decoded, keep)


def _parsed(keep: tuple[str, ...]) -> list:
    raw = F.col("value")
    text = raw.cast("string")
    parsed = F.from_json(text, _DECODE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return [*keep, text.alias("raw_value"),
            F.when(raw.isNull(), F.lit(None)).otherwise(F.is_valid_utf8(raw)).alias("utf8_ok"),
            parsed.alias("data")]


def _decoded(keep: tuple[str, ...]) -> list:
    # A malformed record decodes to an all-null row, never a partial one.
    return [*keep, "raw_value", "utf8_ok",
            *[F.when(F.col(f"data.{CORRUPT}").isNull(), F.col(f"data.{c}")).alias(c) for c in EVENT_COLUMNS],
            F.col(f"data.{CORRUPT}").alias(CORRUPT)]


def _reason() -> Column:
    """First failing rule, in a fixed order."""
    r = F.when(F.col("raw_value").isNull(), F.lit("null_value"))
    r = r.when(~F.col("utf8_ok"), F.lit("bad_utf8"))
    r = r.when(F.col(CORRUPT).isNotNull(), F.lit("malformed_json"))
    for c in REQUIRED_COLUMNS:
        r = r.when(F.col(c).isNull(), F.lit(f"missing_{c}"))
    r = r.when(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), F.lit("bad_event_type"))
    r = r.when(parse_timestamp(F.col("event_timestamp")).isNull(), F.lit("bad_timestamp"))
    return r


def validate(decoded: DataFrame) -> DataFrame:
    """Adds ``reason`` (null when the record is valid)."""
    return decoded.withColumn("reason", built(_reason))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C8 on rows that ``validate`` has tagged: (valid events, dead letters)."""
    there = validated.columns
    keep, payload = (tuple(c for c in names if c in there) for names in (LOG_COLUMNS, PAYLOAD))
    valid = validated.where("reason is null")
    return select_built(valid, _names, (*EVENT_COLUMNS, *keep)), select_built(
        validated.where("reason is not null"), _names, (*payload, "reason", *keep))


def _names(names: tuple[str, ...]) -> tuple[str, ...]:
    return names


def route(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every input row lands in exactly one side: (valid events, dead letters)."""
    return split(validate(decoded))


ALLOWED_KEYS = EVENT_COLUMNS


def decode_strict(records: DataFrame) -> DataFrame:
    """Unknown key or missing file_name / event_type rejects the record;
    a missing event_id or event_timestamp is generated (deterministically from
    the log position and the record time). Adds ``status`` and ``reason``."""
    d = decode(records)
    text = F.col("raw_value")
    keys = F.json_object_keys(text)
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ALLOWED_KEYS]))) > 0
    reason = (F.when(text.isNull(), F.lit("null_value"))
              .when(F.col(CORRUPT).isNotNull() | keys.isNull(), F.lit("malformed_json"))
              .when(unknown, F.lit("unknown_key"))
              .when(F.col("file_name").isNull(), F.lit("missing_file_name"))
              .when(F.col("event_type").isNull(), F.lit("missing_event_type")))
    gen_id = uuid_form(F.md5(F.concat_ws("\u0001", F.col("topic"), F.col("partition").cast("string"),
                                         F.col("offset").cast("string"))))
    return d.select(
        *[c for c in LOG_COLUMNS if c in d.columns],
        F.coalesce(F.col("event_id"), gen_id).alias("event_id"),
        "file_name", "old_value", "new_value", "event_type", "line_number",
        F.coalesce(F.col("event_timestamp"),
                   F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")).alias("event_timestamp"),
        F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("rejected")).alias("status"),
        reason.alias("reason"),
    )


def to_table_rows(valid: DataFrame) -> DataFrame:
    """Event columns as stored: event_timestamp becomes a TIMESTAMP."""
    return valid.withColumn("event_timestamp", built(_stored_time))


def _stored_time() -> Column:
    return parse_timestamp(F.col("event_timestamp"))
