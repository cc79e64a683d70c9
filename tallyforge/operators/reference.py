"""Account-rule and exchange-rate tables, checked as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .star import STATEMENT_LINES

#: The fields of an account rule's file.
RULE_FIELDS = ("account_code", "account_name", "statement_line", "waterfall_step", "cost_category", "sign_multiplier", "is_subtotal")
#: What a rule's step and category may be.
WATERFALL_STEPS = ("GROSS_MARGIN", "CONTRIBUTION_MARGIN", "OPERATING_PROFIT", "NON_ADDITIVE")
COST_CATEGORIES = ("REVENUE", "DEDUCTION", "COGS", "LOGISTICS", "PROMOTION", "WARRANTY", "FIXED_COST", "SUBTOTAL")
#: The period of rates for all months that have none of their own.
DEFAULT = "DEFAULT"


def expand_rate_periods(rates: DataFrame) -> DataFrame:
    """Rates of years and quarters as one row per month; months stay."""
    year, quarter = F.substring("period", 1, 4), F.regexp_extract("period", "^[0-9]{4}-?Q([1-4])$", 1)
    first = F.when(quarter != "", quarter.try_cast("int") * 3 - 2).otherwise(F.lit(1))
    last = F.when(quarter != "", quarter.try_cast("int") * 3).otherwise(F.lit(12))
    months = F.transform(F.sequence(first, last), lambda m: F.concat(year, F.lit("-"), F.lpad(m.cast("string"), 2, "0")))
    whole = F.col("period").rlike("^[0-9]{4}(-?Q[1-4])?$")
    return rates.withColumn("period", F.explode(F.when(whole, months).otherwise(F.array("period"))))


def rate_faults(rates: DataFrame, reporting: str) -> DataFrame:
    """(kind, key, message): rates that aren't finite and positive, a reporting rate other than 1, repeated pairs."""
    key = F.concat_ws(" ", "period", "currency")
    r = F.col("rate")
    checks = F.array(
        F.when(r.isNull() | ~(r > 0) | F.isnan(r.cast("double")), F.lit("rate is not positive")),
        F.when((F.col("currency") == reporting) & (r != 1), F.lit("reporting currency is not 1")),
    )
    bad = rates.select(F.lit("rate").alias("kind"), key.alias("key"), F.explode(F.array_compact(checks)).alias("message"))
    twice = rates.groupBy("period", "currency").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("rate").alias("kind"), key.alias("key"), F.lit("rate is given twice").alias("message"))
    return bad.unionByName(twice)


def account_rule_faults(rules: DataFrame) -> DataFrame:
    """(kind, key, message): unknown statement lines, signs other than 1 and -1, repeated or blank codes."""
    code = F.upper(F.trim(F.coalesce("account_code", F.lit(""))))
    lines = F.col("statement_line").isin([*STATEMENT_LINES, "SUBTOTAL_IGNORED"])
    checks = F.array(
        F.when(code == "", F.lit("code is blank")),
        F.when(~F.coalesce(lines, F.lit(False)), F.lit("unknown statement line")),
        F.when(~F.coalesce(F.col("sign_multiplier").isin(1, -1), F.lit(False)), F.lit("sign is not 1 or -1")),
    )
    bad = rules.select(F.lit("account").alias("kind"), code.alias("key"), F.explode(F.array_compact(checks)).alias("message"))
    twice = rules.groupBy(code.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("account").alias("kind"), "key", F.lit("code is given twice").alias("message"))
    return bad.unionByName(twice)


def period_months(token: Column) -> Column:
    """The months (YYYY-MM) of a year, a quarter (2024-Q1, 2024Q1) or a month (2024-01, 2024/01, 202401), [DEFAULT] for itself, else null."""
    t = F.upper(F.trim(token))
    year, rest = F.substring(t, 1, 4), F.substring(t, 5, 9)
    part = F.regexp_extract(rest, "^-?Q([1-4])$", 1).try_cast("int")
    month = F.regexp_extract(rest, "^[-/]?([0-9]{2})$", 1).try_cast("int")
    first = F.when(rest == "", 1).when(part.isNotNull(), part * 3 - 2).when(month.between(1, 12), month)
    last = F.when(rest == "", 12).when(part.isNotNull(), part * 3).when(month.between(1, 12), month)
    ok = t.rlike("^[0-9]{4}") & year.try_cast("int").between(1900, 2100) & first.isNotNull()
    return F.when(t == DEFAULT, F.array(F.lit(DEFAULT))).when(ok, F.transform(F.sequence(first, last), lambda m: F.concat(year, F.lit("-"), F.lpad(m.cast("string"), 2, "0"))))


def _rate(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("decimal(18,8)")


def rate_entry_faults(entries: DataFrame, reporting: str) -> DataFrame:
    """(kind, key, message) of a file's entries (token, currency, rate_text): incomplete ones, unknown periods, rates
    that are no numbers, not positive, or not 1 for the reporting currency."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    full = ~(blank("token") | blank("currency") | blank("rate_text"))
    r = _rate(F.col("rate_text"))
    checks = F.array(
        F.when(~full, F.lit("entry is incomplete")), F.when(full & period_months(F.col("token")).isNull(), F.lit("period can't be read")),
        F.when(full & r.isNull(), F.lit("rate is not a number")), F.when(full & (r <= 0), F.lit("rate is not positive")),
        F.when(full & (F.upper(F.trim("currency")) == reporting) & (r > 0) & (r != 1), F.lit("reporting currency is not 1")),
    )
    return entries.select(F.lit("rate").alias("kind"), F.concat_ws(" ", F.trim("token"), F.upper(F.trim("currency"))).alias("key"), F.explode(F.array_compact(checks)).alias("message"))


def resolved_rates(entries: DataFrame, specific: bool = False) -> DataFrame:
    """(period, currency, rate): one row a month of entries (i, j, token, currency, rate_text) without faults. The last
    entry counts; if `specific`, that of the shortest time, and the last of those."""
    months = entries.select(period_months(F.col("token")).alias("months"), F.upper(F.trim("currency")).alias("currency"), _rate(F.col("rate_text")).alias("rate"), "i", "j")
    rank = F.struct(*([(-F.size("months")).alias("n")] if specific else []), "i", "j")
    return months.select(F.explode("months").alias("period"), "currency", "rate", rank.alias("rank")).groupBy("period", "currency").agg(F.max_by("rate", "rank").alias("rate"))


def rates_for(wanted: DataFrame, rates: DataFrame, reporting: str, fallback: bool = False) -> DataFrame:
    """(period, currency, rate, basis) of each distinct wanted pair: its month's own rate, else with `fallback` that of
    DEFAULT, else 1 for the reporting currency; null where there is none. The basis is month, default or reporting."""
    own = rates.where(F.col("period") != DEFAULT).select("period", "currency", F.col("rate").alias("__own"))
    rest = rates.where((F.col("period") == DEFAULT) & F.lit(fallback)).select("currency", F.col("rate").alias("__rest"))
    out = wanted.select("period", "currency").distinct().join(own, ["period", "currency"], "left").join(rest, "currency", "left")
    one = F.when(F.col("currency") == reporting, F.lit(1).cast("decimal(18,8)"))
    basis = F.when(F.col("__own").isNotNull(), "month").when(F.col("__rest").isNotNull(), "default").when(one.isNotNull(), "reporting")
    return out.select("period", "currency", F.coalesce("__own", "__rest", one).alias("rate"), basis.alias("basis"))


def typed_rules(entries: DataFrame) -> DataFrame:
    """A file's rules with trimmed text, the sign as an int (null unless it is a whole number) and the subtotal as a boolean
    (null unless it is true, 1, yes, y, t or false, 0, no, n, f or blank)."""
    sign, flag = F.trim("sign_multiplier"), F.lower(F.trim("is_subtotal"))
    return entries.select(
        *[F.trim(c).alias(c) for c in RULE_FIELDS[:2]], *[F.upper(F.trim(c)).alias(c) for c in RULE_FIELDS[2:5]],
        F.when(sign.rlike("^[+-]?[0-9]{1,9}$"), sign.try_cast("int")).alias("sign_multiplier"),
        F.when(flag.isin("true", "1", "yes", "y", "t"), True).when(flag.isin("false", "0", "no", "n", "f", ""), False).alias("is_subtotal"),
    )


def rule_entry_faults(entries: DataFrame) -> DataFrame:
    """(kind, key, message) of a file's rules: those of account_rule_faults, lacking fields, blank names, unknown steps
    and categories, and subtotals that are neither true nor false."""
    raw = entries.select(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in RULE_FIELDS[1:]])).alias("lost"), *RULE_FIELDS)
    rules = typed_rules(raw.withColumn("account_code", F.coalesce("account_code", F.lit(""))))
    lacking = raw.where(F.size("lost") > 0).select(F.lit("account").alias("kind"), F.upper(F.trim(F.coalesce("account_code", F.lit("")))).alias("key"), F.concat(F.lit("lacks "), F.array_join("lost", ", ")).alias("message"))
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(True))  # noqa: E731  (lacking fields are told once)
    checks = F.array(
        F.when(F.col("account_name") == "", F.lit("name is blank")), F.when(~known("waterfall_step", WATERFALL_STEPS), F.lit("unknown waterfall step")),
        F.when(~known("cost_category", COST_CATEGORIES), F.lit("unknown cost category")),
    )
    more = rules.select(F.lit("account").alias("kind"), F.upper("account_code").alias("key"), F.explode(F.array_compact(checks)).alias("message"))
    flags = raw.where("is_subtotal IS NOT NULL").select("account_code", *RULE_FIELDS[1:])
    odd = typed_rules(flags).where("is_subtotal IS NULL").select(F.lit("account").alias("kind"), F.upper(F.coalesce("account_code", F.lit(""))).alias("key"), F.lit("subtotal is neither true nor false").alias("message"))
    return account_rule_faults(rules).unionByName(lacking).unionByName(more).unionByName(odd)
