"""Keys, labels, line breaks and JSON payloads, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import trimmed

UNKNOWN = "UNKNOWN"
_BREAKS = "[\r\n\u000b\u000c\u0085\u2028\u2029]+"


def business_key(c: Column) -> Column:
    """Trimmed upper case; leading zeros stay."""
    return F.upper(F.trim(c.cast("string")))


def null_to_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(UNKNOWN))


def flatten_linebreaks(c: Column) -> Column:
    """Every run of line breaks of any kind as one blank."""
    return F.regexp_replace(c, _BREAKS, " ")


def has_linebreak(c: Column) -> Column:
    return c.rlike(_BREAKS)


def split_account_code(c: Column) -> Column:
    """struct(code, name) of name[code]; without brackets the code is empty and the name the trimmed text."""
    g = "^\\s*(.+?)\\s*\\[([^\\[\\]]+)\\]\\s*$"
    code = F.trim(F.regexp_extract(c, g, 2))
    return F.struct(code.alias("code"), F.when(c.rlike(g), F.regexp_extract(c, g, 1)).otherwise(trimmed(c)).alias("name"))


def bucket_label(major: Column, medium: Column, level: str = "major") -> Column:
    """major, or major_medium where there is a medium category."""
    if level == "major":
        return major
    return F.when(F.coalesce(medium, F.lit("")) == "", major).otherwise(F.concat_ws("_", major, medium))


def json_payload(*cols: str) -> Column:
    """The columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*cols))


def json_field(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path)
