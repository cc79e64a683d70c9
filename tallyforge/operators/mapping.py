"""Ordered first-match classification and its statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Rule, rule_column


def _first(rules: Sequence[Rule], columns: Mapping[str, str]) -> Column:
    """Place of the first rule that matches, null if none does."""
    places = reversed(list(enumerate(rules)))
    return reduce(lambda rest, r: F.when(rule_column(r[1], columns), F.lit(r[0])).otherwise(rest), places, F.lit(None).cast("int"))


def first_match_classify(df: DataFrame, rules: Sequence[Rule], target: str, default: str = "Unmapped", unmapped_only: bool = False) -> DataFrame:
    """df with rule_id (null if none matches) and the target: the first matching rule's value, or the default."""
    if not rules:
        raise ValueError("no rules")
    live = [r for r in rules if r.enabled and r.conditions]
    (place,) = [n for n in ("__place", "___place") if n not in df.columns][:1]
    # The conditions are evaluated once, to a place in the list of rules; ids and values are looked up by it.
    text = lambda x: F.array(*[F.lit(v) for v in x]) if live else F.lit(None).cast("array<string>")
    found = df.withColumn(place, _first(live, dict(df.dtypes)))
    value = F.coalesce(F.get(text([r.target for r in live]), F.col(place)), F.lit(default))
    out = found.withColumn("rule_id", F.get(text([r.rule_id for r in live]), F.col(place))).withColumn(target, value).drop(place)
    return out.where(F.col("rule_id").isNull()) if unmapped_only else out


def rule_match_stats(classified: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, matched, share) of every rule, and of a null rule for the rows that none matches; share in percent."""
    listed = classified.sparkSession.createDataFrame([(r.rule_id,) for r in rules], "rule_id string").unionByName(classified.sparkSession.createDataFrame([(None,)], "rule_id string"))
    counts = classified.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    both = listed.alias("l").join(counts.alias("c"), F.col("l.rule_id").eqNullSafe(F.col("c.rule_id")), "left").select(F.col("l.rule_id").alias("rule_id"), F.coalesce("n", F.lit(0)).alias("matched"))
    total = classified.agg(F.count(F.lit(1)).alias("total"))
    return both.crossJoin(F.broadcast(total)).select("rule_id", "matched", F.when(F.col("total") > 0, F.col("matched") * F.lit(100.0) / F.col("total")).otherwise(F.lit(0.0)).alias("share"))


def unmapped_top_values(unmapped: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """(column, value, n): the k most frequent values of each column among the unmapped rows, exactly; ties by value."""
    from pyspark.sql.window import Window

    cells = unmapped.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("k", rank).where(F.col("k") <= k).select("column", "value", "n")


def classify_dataset(df: DataFrame, rules: Sequence[Rule], target: str, default: str, columns: Sequence[str], k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classified rows, the match statistics and the top unmapped values, of one lazy plan."""
    out = first_match_classify(df, rules, target, default)
    return out, rule_match_stats(out, rules), unmapped_top_values(out.where(F.col("rule_id").isNull()), columns, k)
