"""Scalar column expressions (J1-J11). All JVM-side built-ins; no Python UDF."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the line terminators of Python's str.splitlines, as a Java regex.
SPLITLINES_REGEX = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"

# Fixed value: ISO-8601 text with microseconds and a numeric offset.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def splitlines(text: Column) -> Column:
    """ARRAY<STRING> of lines with str.splitlines semantics (J1): every
    terminator ends a line, one trailing terminator adds no line, the empty
    text has no lines. A null text gives an empty array (missing file)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPLITLINES_REGEX, -1)
    n = F.size(parts)
    # Drop exactly one trailing "" (the text ended with a terminator, or was empty).
    return F.when(F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, n - 1)).otherwise(parts)


def join_lines(lines: Column) -> Column:
    """List of lines back to text (export only; never the state format)."""
    return F.array_join(lines, "\n")


def line_hash(line: Column) -> Column:
    """64-bit hash used as a join key; equality is always re-checked on the text."""
    return F.xxhash64(line)


def uuid_form(hex32: Column) -> Column:
    """32 hex digits in 8-4-4-4-12 form."""
    return F.concat_ws(
        "-",
        F.substring(hex32, 1, 8),
        F.substring(hex32, 9, 4),
        F.substring(hex32, 13, 4),
        F.substring(hex32, 17, 4),
        F.substring(hex32, 21, 12),
    )


def event_id(file_name: Column, version: Column, event_type: Column, line_number: Column) -> Column:
    """Deterministic event id. (event_type, line_number) is unique inside
    one version, so a replay of the same version yields the same ids."""
    return uuid_form(F.md5(F.concat_ws(
        "\u0001", file_name, version.cast("string"), event_type, line_number.cast("string"))))


def iso_timestamp(ts: Column) -> Column:
    """Timestamp as ISO-8601 text in the session time zone (UTC)."""
    return F.date_format(ts, ISO_FORMAT)


def parse_timestamp(text: Column) -> Column:
    """ISO text to TIMESTAMP; null when it does not parse."""
    return F.try_to_timestamp(text)


def base_name(path: Column) -> Column:
    """Last path component."""
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, '' when none."""
    return F.lower(F.regexp_extract(base_name(path), "(\\.[^.]+)$", 1))


@lru_cache(maxsize=256)
def _built(gateway, make, args: tuple):
    return make(*args)


def built(make, *args):
    """``make(*args)``, made once a driver. Each call of the column API is a round trip to the
    JVM; a stream that builds hundreds of them for every batch waits for little else."""
    return _built(SparkContext._gateway, make, args)


@lru_cache(maxsize=256)
def _sequence(gateway, make, args: tuple) -> list:
    return []


def select_built(df: DataFrame, make, *args) -> DataFrame:
    """``df.select(*make(*args))``, the columns sent to the JVM once a driver."""
    kept = _sequence(SparkContext._gateway, make, args)
    if not kept:
        kept.append(df._jcols(*make(*args)))
    return type(df)(df._jdf.select(kept[0]), df.sparkSession)
