"""Dates and period months from text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import trimmed

#: (grammar, Java format) in the order of the attempts.
_DATES = (
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    ("^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$", "d.M.yyyy"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
)


def parse_date_unambiguous(c: Column) -> Column:
    """The date of a whole cell, or null; day and month that could be swapped (both up to 12) stay text."""
    t = trimmed(c)
    part = lambda k: F.regexp_extract(t, "^([0-9]{1,2})[/-]([0-9]{1,2})[/-][0-9]{4}$", k).try_cast("int")
    unclear = t.rlike("^[0-9]{1,2}([/-])[0-9]{1,2}\\1[0-9]{4}$") & (part(1) <= 12) & (part(2) <= 12)
    tries = [F.when(t.rlike(g), F.try_to_timestamp(t, F.lit(f)).cast("date")) for g, f in _DATES]
    return F.when(~F.coalesce(unclear, F.lit(False)), F.coalesce(*tries))


def normalize_period(c: Column) -> Column:
    """YYYY-MM from YYYY[-./_]M, YYYYMM, YYYYMMDD and Korean year and month; null if the month isn't 1 to 12."""
    t = trimmed(c)
    forms = (("^([0-9]{4})[-./_]([0-9]{1,2})$", False), ("^([0-9]{4})([0-9]{2})$", False), ("^([0-9]{4})([0-9]{2})[0-9]{2}$", False), ("([0-9]{4}|[0-9]{2})[년./\\s]+([0-9]{1,2})월?", True))
    out = []
    for g, short in forms:
        y, m = F.regexp_extract(t, g, 1), F.regexp_extract(t, g, 2)
        if short:
            y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
        ok = t.rlike(g) & m.try_cast("int").between(1, 12)
        out.append(F.when(ok, F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))))
    return F.when(c.cast("string").rlike("^[0-9]{4}-(0[1-9]|1[0-2])\\z"), c.cast("string")).otherwise(F.coalesce(*out))  # most are as they should be


def period_parts(period: Column) -> Column:
    """struct(date_sk, year, quarter, month) of a YYYY-MM period."""
    y, m = F.substring(period, 1, 4).cast("int"), F.substring(period, 6, 2).cast("int")
    quarter = F.concat(F.substring(period, 1, 4), F.lit("-Q"), (F.floor((m - 1) / 3) + 1).cast("string"))
    return F.struct((y * 100 + m).alias("date_sk"), y.alias("year"), quarter.alias("quarter"), m.alias("month"))


def period_from_name(name: Column) -> Column:
    """The period in a file name (2024-01 or 202401), or null."""
    y, m = (F.regexp_extract(name, "(?:^|[^0-9])((?:19|20)[0-9]{2})[-_.]?(0[1-9]|1[0-2])(?:[^0-9]|$)", k) for k in (1, 2))
    return F.when(y != "", F.concat(y, F.lit("-"), m))


def expand_period_spec(spec: str | list[str] | None) -> list[str] | None:
    """Months of ALL or *, years, quarters, months and comma lists; None means all."""
    import re

    items = spec if isinstance(spec, list | tuple) else str(spec if spec is not None else "ALL").split(",")
    out: list[str] = []
    for item in (str(x).strip().upper() for x in items):
        if item in ("", "ALL", "*"):
            return None
        if m := re.fullmatch(r"([0-9]{4})", item):
            year, months = int(m[1]), range(1, 13)
        elif m := re.fullmatch(r"([0-9]{4})-?Q([1-4])", item):
            year, months = int(m[1]), range(3 * int(m[2]) - 2, 3 * int(m[2]) + 1)
        elif m := re.fullmatch(r"([0-9]{4})[-/]?([0-9]{2})", item):
            year, months = int(m[1]), [int(m[2])]
        else:
            raise ValueError(f"not a period: {item!r}")
        if not 1900 <= year <= 2100 or any(not 1 <= k <= 12 for k in months):
            raise ValueError(f"period out of range: {item!r}")
        out += [f"{year}-{k:02d}" for k in months]
    return sorted(set(out))
