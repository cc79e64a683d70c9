"""Number text in English and Polish notation, as Column functions. Digits are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank, no-break and narrow no-break space.
SPACES = " \u00a0\u202f"
_EXP = "([eE][+-]?[0-9]+)?"
#: Grammar of a whole number cell by mode.
STRICT = {
    "English": rf"^[+-]?(([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.][0-9]*)?|[.][0-9]+){_EXP}$",
    "Polish": rf"^[+-]?(([0-9]+|[0-9]{{1,3}}([.][0-9]{{3}})+|[0-9]{{1,3}}( [0-9]{{3}})+)(,[0-9]+)?|,[0-9]+){_EXP}$",
}


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(c.cast("string"), F.lit(" \t\n\x0b\f\r\u00a0\u202f"))


def _plain_spaces(c: Column) -> Column:
    return F.translate(c, "\u00a0\u202f", "  ")


def _check_mode(mode: str, known) -> None:
    if mode not in known:
        raise ValueError(f"unknown number mode {mode!r}; known: {sorted(known)}")


def is_missing_number(c: Column) -> Column:
    """Null, blank and a lone dash are missing, not invalid."""
    t = trimmed(c)
    return c.isNull() | t.isin("", "-")


def parse_number_strict(c: Column, mode: str = "English") -> Column:
    """struct(value double, state): state is ok, missing or invalid; value is null unless ok."""
    _check_mode(mode, STRICT)
    t = trimmed(c)
    if mode == "Polish":
        t = _plain_spaces(t)
        clean, grouping = F.translate(t, ",. ", "."), "[. ]"
    else:
        clean, grouping = F.translate(t, ",", ""), ","
    fits = t.rlike(STRICT[mode]) & ~(t.rlike("[eE]") & t.rlike(grouping))
    value = F.when(fits, clean.try_cast("double"))
    value = F.when(F.abs(value) < F.lit(float("inf")), value)
    state = F.when(is_missing_number(c), "missing").when(value.isNull(), "invalid").otherwise("ok")
    return F.struct(F.when(~is_missing_number(c), value).alias("value"), state.alias("state"))


_KEEP = {
    "English": r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)?([.][0-9]+)?$",
    "Polish": r"^[+-]?([0-9]+|[0-9]{1,3}([.][0-9]{3})+|[0-9]{1,3}( [0-9]{3})+)?(,[0-9]+)?$",
}


def parse_number_preserving(c: Column, mode: str = "English") -> Column:
    """struct(value decimal(38,18), scale, text): value is null where the text isn't a number, or has a leading zero."""
    _check_mode(mode, _KEEP)
    t = F.translate(_plain_spaces(trimmed(c)), "\u2212", "-")
    point, drop = ("[.]", ",") if mode == "English" else (",", ". ")
    body = F.regexp_replace(t, "^[+-]", "")
    whole = F.translate(F.regexp_extract(body, "^[^" + ("." if mode == "English" else ",") + "]*", 0), drop, "")
    fits = t.rlike(_KEEP[mode]) & t.rlike("[0-9]") & ~((F.length(whole) > 1) & whole.startswith("0"))
    frac = F.regexp_extract(body, point + "([0-9]+)$", 1)
    sign = F.when(t.startswith("-"), "-").otherwise("")
    value = F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac))).try_cast("decimal(38,18)")
    return F.struct(F.when(fits, value).alias("value"), F.when(fits, F.length(frac)).alias("scale"), c.cast("string").alias("text"))


_EU = {"1 234,56", "1.234,56", "polish", "eu", "european"}
_US = {"1,234.56", "us", "standard", "en"}


def parse_number_auto(c: Column, fmt: str = "auto") -> Column:
    """decimal(38,6), or null; "auto" takes a comma as decimal after grouped digits or before 1, 2 or over 3 digits."""
    t = F.trim(c.cast("string"))
    eu = F.translate(t, f",.{SPACES}", ".")
    us = F.translate(t, ",", "")
    fmt = fmt.lower()
    if fmt in _EU:
        body = eu
    elif fmt in _US:
        body = us
    else:
        looks = t.rlike(rf"^[+-]?[0-9]{{1,3}}([{SPACES}.][0-9]{{3}})+(,[0-9]+)$") | t.rlike("^[+-]?[0-9]+,([0-9]{1,2}|[0-9]{4,})$")
        body = F.when(looks, eu).otherwise(us)
    return body.try_cast("decimal(38,6)")


def number_syntax_ok(c: Column, fmt: str) -> Column:
    """True for missing cells and for those of the strict grammar of one format (us, else eu)."""
    t = F.trim(c.cast("string"))
    if fmt.lower() in _US:
        good = t.rlike("^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?$")
    else:
        good = t.rlike(rf"^[+-]?([0-9]+|[0-9]{{1,3}}([{SPACES}][0-9]{{3}})+|[0-9]{{1,3}}([.][0-9]{{3}})+)(,[0-9]+)?$")
    return c.isNull() | t.isin("", "-") | (good & parse_number_auto(c, fmt).isNotNull())


def decimal_lossless(c: Column, precision: int, scale: int) -> Column:
    """True where number text (exponents allowed) is held exactly by decimal(precision, scale); blank is null, so fine."""
    t = trimmed(c)
    wide = t.try_cast("decimal(38,18)")
    exact = (wide if scale <= 18 else t).try_cast(f"decimal({precision},{scale})")  # the text is read once
    digits = F.length(F.regexp_extract(F.regexp_replace(t, "0+$", ""), "[.]([0-9]+)$", 1))
    # Only text of over 19 characters can have more digits after its point than `wide` holds.
    short = F.length(t) <= 19
    fits = exact.isNotNull() & wide.isNotNull() & (exact.cast("decimal(38,18)") == wide) & (short | t.rlike("[eE]") | (digits <= scale))
    return c.isNull() | (t == "") | F.coalesce(fits, F.lit(False))


def significant_digits(value: Column) -> Column:
    """Digits of a decimal without leading and trailing zeros; at least 1."""
    digits = F.regexp_replace(F.regexp_replace(F.translate(value.cast("string"), "-.", ""), "^0+", ""), "0+$", "")
    return F.greatest(F.length(digits), F.lit(1))


def plain_decimal_text(value: Column) -> Column:
    """Fixed-point text without trailing zeros; 0 for zero."""
    t = F.regexp_replace(fixed_text(value), "([.][0-9]*?)0+$", "$1")
    t = F.regexp_replace(t, "[.]$", "")
    return F.when(t.rlike("^-?0$"), "0").otherwise(t)



def fixed_text(value: Column) -> Column:
    """A decimal with 18 digits after the point, never with an exponent."""
    return F.translate(F.format_number(value.cast("decimal(38,18)"), 18), ",", "")
