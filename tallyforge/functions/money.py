"""Ratios, column groups and currency conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column, multiplier: float = 1.0) -> Column:
    """num / den * multiplier; 0.0 where the denominator is 0, NaN or missing. An overflow stays infinite for the caller's check."""
    ok = den.isNotNull() & (den != 0) & ~F.isnan(den.cast("double")) & num.isNotNull()
    return F.when(ok, num.cast("double") / den.cast("double") * F.lit(float(multiplier))).otherwise(F.lit(0.0))


def column_group_sum(cols: list[Column]) -> Column:
    """Row-wise sum; a missing value counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])


def fx_convert(df: DataFrame, rates: DataFrame, amounts: list[str], reporting: str, digits: int = 6, fallback: Column | None = None) -> DataFrame:
    """Each amount times the rate of its (period, currency), as <amount>_reporting; the reporting currency's rate is 1.

    rates(period, currency, rate) is joined on the left; Spark broadcasts it while it is under its threshold. A pair
    without a rate takes the fallback if one is given, else raises when the amount is used.
    """
    r = rates.select(F.col("period").alias("__p"), F.col("currency").alias("__c"), F.col("rate").cast("decimal(18,8)").alias("__r"))
    out = df.join(r, (F.col("period") == F.col("__p")) & (F.col("currency") == F.col("__c")), "left")
    missing = F.raise_error(F.concat(F.lit("no exchange rate for "), F.coalesce("period", F.lit("?")), F.lit(" "), F.coalesce("currency", F.lit("?")))).cast("decimal(18,8)")
    rate = F.when(F.col("currency") == reporting, F.lit(1).cast("decimal(18,8)")).otherwise(F.coalesce(F.col("__r"), missing if fallback is None else fallback.cast("decimal(18,8)")))
    for a in amounts:
        out = out.withColumn(f"{a}_reporting", F.round(F.col(a).cast("decimal(18,6)") * rate, digits).cast("decimal(38,6)"))
    return out.drop("__p", "__c", "__r")
