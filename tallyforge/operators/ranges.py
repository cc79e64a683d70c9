"""Date-range rules: validation, daily expansion and overlap counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def expand_date_ranges(rules: DataFrame, start: str = "start_date", end: str = "end_date", day: str = "applied_date") -> DataFrame:
    """One row per day of each inclusive range; overlapping rules stay separate, reversed ranges give no rows."""
    good = rules.where(F.col(end) >= F.col(start))
    return good.withColumn(day, F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day")))).drop(start, end)


def estimate_daily_rows(rules: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    return rules.agg(F.coalesce(F.sum(F.datediff(end, start) + 1), F.lit(0)).cast("long").alias("days"))


def daily_preview(rules: DataFrame, n: int = 20, order: Sequence[str] = ("applied_date",)) -> DataFrame:
    """The first daily rows in the given order."""
    return expand_date_ranges(rules).orderBy(*order).limit(n)


def interval_overlap_count(rules: DataFrame, key: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """(key, pairs): pairs of a key's ranges that intersect, without forming them.

    Starts and ends are events in time, starts first on a day; each end closes the ranges that began up to it and
    haven't been counted before: with s starts and e ends so far, it adds s - e - 1 pairs. Days are summed per key
    before the running sums, so a key's window holds its distinct days.
    """
    events = rules.select(F.col(key), F.explode(F.array(F.struct(F.col(start).alias("day"), F.lit(1).alias("opens"), F.lit(0).alias("closes")), F.struct(F.col(end).alias("day"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))).alias("e")).select(key, "e.*")
    days = events.groupBy(key, "day").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    w = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = days.withColumns({"s": F.sum("opens").over(w), "e": F.sum("closes").over(w) - F.col("closes")})
    # the c ends of a day, one after another: sum of s - (e + i) - 1 for i below c
    pairs = F.col("closes") * (F.col("s") - F.col("e") - 1) - F.expr("(closes * (closes - 1)) div 2")
    return run.groupBy(key).agg(F.sum(pairs).alias("pairs"))


def promotion_rule_validation(master: DataFrame, rules: DataFrame) -> DataFrame:
    """(sheet, key, column, message): one row per fault of the promotion master and the support rules (all text columns)."""
    from tallyforge.functions.dates import parse_date_unambiguous

    def blank(c):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""

    def faults(df, sheet, key, checks):
        made = F.array(*[F.when(bad, F.struct(F.lit(c).alias("column"), F.lit(m).alias("message"))) for c, m, bad in checks])
        return df.select(F.lit(sheet).alias("sheet"), F.col(key).alias("key"), F.explode(F.array_compact(made)).alias("f")).select("sheet", "key", "f.*")

    def marked(df, key):
        """df with whether its key occurs twice; blank keys aren't counted, so that they don't meet in one task."""
        many = df.where(~blank(key)).groupBy(F.col(key).alias("__many")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__many")
        return df.join(many, F.col(key) == F.col("__many"), "left").withColumn("__twice", F.col("__many").isNotNull()).drop("__many")

    m, r = marked(master, "promotion_id"), marked(rules, "support_rule_id")
    known = master.select(F.col("promotion_id").alias("__id")).distinct()
    r = r.join(known, F.col("promotion_id") == F.col("__id"), "left")
    start, end = parse_date_unambiguous(F.col("start_date")), parse_date_unambiguous(F.col("end_date"))
    amount = F.trim("support_per_unit").try_cast("decimal(38,6)")
    return faults(m, "master", "promotion_id", [("promotion_id", "required", blank("promotion_id")), ("promotion_id", "duplicate", F.col("__twice")), ("promotion_name", "required", blank("promotion_name"))]).unionByName(
        faults(
            r, "rules", "support_rule_id",
            [
                ("support_rule_id", "required", blank("support_rule_id")), ("support_rule_id", "duplicate", F.col("__twice")), ("promotion_id", "required", blank("promotion_id")),
                ("promotion_id", "not in master", ~blank("promotion_id") & F.col("__id").isNull()), ("model_code", "required", blank("model_code")), ("start_date", "not a date", start.isNull()), ("end_date", "not a date", end.isNull()),
                ("end_date", "before start", F.coalesce(end < start, F.lit(False))), ("support_per_unit", "not an amount", amount.isNull()), ("support_per_unit", "negative", F.coalesce(amount < 0, F.lit(False))), ("currency", "required", blank("currency")),
            ],
        )
    )


def normalize_promotions(master: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily rows, issues and (days, overlapping pairs); the daily rows are those of rules without issues."""
    from tallyforge.functions.dates import parse_date_unambiguous

    issues = promotion_rule_validation(master, rules)
    bad = issues.where("sheet = 'rules'").select(F.col("key").alias("__k")).distinct()
    good = rules.join(bad, F.col("support_rule_id").eqNullSafe(F.col("__k")), "left_anti").withColumns({"start_date": parse_date_unambiguous(F.col("start_date")), "end_date": parse_date_unambiguous(F.col("end_date"))})
    counts = estimate_daily_rows(good).crossJoin(interval_overlap_count(good, "model_code").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")))
    return expand_date_ranges(good), issues, counts
