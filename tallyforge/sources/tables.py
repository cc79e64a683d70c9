"""Exchange rates and account rules from the files that users keep them in: nested JSON, or CSV with a header.

Such a file has an entry for each month and currency, or for each account column, so it is read as one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.reference import RULE_FIELDS, rate_entry_faults, resolved_rates, rule_entry_faults, typed_rules


def _kind(path: str, kind: str | None) -> str:
    found = kind or path.rsplit(".", 1)[-1].lower()
    if found not in ("csv", "json"):
        raise ValueError(f"neither CSV nor JSON: {path}")
    return found


def _json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("doc")).where(F.trim("doc") != "")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their place; a name in the header stands without the blanks around it."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.strip() for c in df.columns]).withColumn("__i", F.monotonically_increasing_id())


def scan_rates(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(i, j, token, currency, rate_text), one row an entry: {period: {currency: rate}} in JSON, or the columns period,
    currency_code (or currency) and fx_rate (or rate) in CSV. Entries come as they are; i and j are their place."""
    if _kind(path, kind) == "json":
        outer = _json(spark, path).select(F.posexplode_outer(F.from_json("doc", "map<string, map<string, string>>")).alias("i", "token", "of"))
        return outer.select(F.col("i").cast("long").alias("i"), "token", F.posexplode_outer("of").alias("j", "currency", "rate_text")).select("i", F.col("j").cast("long").alias("j"), "token", "currency", "rate_text")
    df = _csv(spark, path)
    have = {c.lower(): c for c in df.columns}
    use = [next((have[n] for n in names if n in have), None) for names in (("period",), ("currency_code", "currency"), ("fx_rate", "rate"))]
    if None in use:
        raise ValueError(f"a file of rates has the columns period, currency_code and fx_rate; found {df.columns[:-1]}")
    out = df.select(F.col("__i").alias("i"), F.lit(0).cast("long").alias("j"), *[F.col(f"`{c}`").alias(n) for c, n in zip(use, ("token", "currency", "rate_text"), strict=True)])
    return out.where(F.trim(F.concat_ws("", "token", "currency", "rate_text")) != "")


def _raise_on(faults: DataFrame, path: str) -> None:
    if some := faults.orderBy("key", "message").limit(5).collect():
        raise ValueError(f"{path}: " + "; ".join(f"{r['key']}: {r['message']}" for r in some))


def load_rates(spark: SparkSession, path: str, reporting: str, kind: str | None = None, specific: bool = False) -> DataFrame:
    """(period, currency, rate) of each month, and of DEFAULT where the file has it; any fault raises.

    Years and quarters stand for their months. Where several entries give a month's rate the last one in the file
    counts; if `specific`, the one of the shortest time, and the last of those.
    """
    entries = scan_rates(spark, path, kind)
    _raise_on(rate_entry_faults(entries, reporting), path)
    out = resolved_rates(entries, specific)
    if out.isEmpty():
        raise ValueError(f"no rates in {path}")
    return out


def scan_account_rules(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The fields of each rule as text, in the order of the file: {"rules": [rule, ...]}, [rule, ...] or {code: rule} in JSON, or CSV."""
    if _kind(path, kind) == "csv":
        df = _csv(spark, path)
        if lost := [c for c in RULE_FIELDS if c not in df.columns]:
            raise ValueError(f"a file of account rules lacks the columns {lost}")
        return df.orderBy("__i").select(*RULE_FIELDS)
    rule = f"struct<{', '.join(f'{c}: string' for c in RULE_FIELDS)}>"
    doc = F.trim("doc")
    inner = F.trim(F.get_json_object(doc, "$.rules"))

    def coded(e: Column) -> Column:
        own = e["value"]
        return F.struct(F.coalesce(own["account_code"], e["key"]).alias("account_code"), *[own[c].alias(c) for c in RULE_FIELDS[1:]])

    rules = F.when(doc.startswith("["), F.from_json(doc, f"array<{rule}>")).when(inner.startswith("["), F.from_json(inner, f"array<{rule}>")).otherwise(F.transform(F.map_entries(F.from_json(doc, f"map<string, {rule}>")), coded))
    return _json(spark, path).select(F.inline_outer(rules))


def load_account_rules(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The rules, typed; any fault raises, as does a file without rules."""
    entries = scan_account_rules(spark, path, kind)
    _raise_on(rule_entry_faults(entries), path)
    out = typed_rules(entries)
    if out.isEmpty():
        raise ValueError(f"no rules in {path}")
    return out


def save_account_rules(rules: DataFrame, path: str) -> None:
    """{"rules": [...]} in the order of the codes, in one file of the folder; the same rules give the same bytes."""
    every = F.array_sort(F.collect_list(F.struct(*RULE_FIELDS)))
    rules.agg(F.to_json(F.struct(every.alias("rules"))).alias("value")).write.mode("overwrite").text(path)
