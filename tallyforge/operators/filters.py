"""Filter conditions, mapping-rule predicates and period and entity filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.dates import expand_period_spec, normalize_period
from tallyforge.functions.numbers import trimmed


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any = None
    case_sensitive: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: str
    target: str
    conditions: Sequence[Condition] = field(default_factory=tuple)
    combine: str = "AND"
    enabled: bool = True
    name: str = ""


class MissingColumnError(ValueError):
    """A spec names a column that the data lacks."""


def require(df: DataFrame, names: Sequence[str]) -> None:
    if lost := [n for n in names if n not in df.columns]:
        raise MissingColumnError(f"missing columns: {lost}")


def filter_column(cond: Condition) -> Column | None:
    """Comparison of the trimmed text; null for an operator that isn't known, which filters nothing."""
    text = F.trim(F.coalesce(F.col(cond.column).cast("string"), F.lit("")))
    values = [str(v).strip() for v in cond.value] if isinstance(cond.value, list | tuple | set) else [str(cond.value).strip()]
    return {"==": lambda: text == values[0], "!=": lambda: text != values[0], "in": lambda: text.isin(values), "not in": lambda: ~text.isin(values), "contains": lambda: text.contains(values[0])}.get(cond.operator, lambda: None)()


def filter_spec(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Rows for which all conditions hold."""
    require(df, [c.column for c in conditions])
    parts = [p for c in conditions if (p := filter_column(c)) is not None]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


#: Types that are compared with numbers as they are; others as text that may be a number.
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def condition_column(cond: Condition, type_: str = "string") -> Column:
    """One of the 15 rule operators; never null. A missing value matches only is_null, != , not_contains and not_in."""
    raw = F.col(cond.column).cast("string")
    op, value = cond.operator, cond.value
    fold = (lambda c: c) if cond.case_sensitive else F.lower
    low = (lambda v: str(v)) if cond.case_sensitive else (lambda v: str(v).lower())
    no = lambda c: F.coalesce(c, F.lit(False))
    if op == "is_null":
        return raw.isNull() | (trimmed(raw) == "")
    if op == "is_not_null":
        return raw.isNotNull() & (trimmed(raw) != "")
    if op in ("==", "!="):
        hit = no(fold(raw) == low(value))
        return hit if op == "==" else ~hit
    if op in ("contains", "not_contains"):
        hit = no(fold(raw).contains(low(value)))
        return hit if op == "contains" else ~hit
    if op == "startswith":
        return no(fold(raw).startswith(low(value)))
    if op == "endswith":
        return no(fold(raw).endswith(low(value)))
    if op in ("in", "not_in"):
        items = [str(v) for v in value] if isinstance(value, list | tuple | set) else [v.strip() for v in str(value).split(",") if v.strip()]
        hit = no(fold(raw).isin([low(v) for v in items])) if items else F.lit(False)
        return hit if op == "in" else ~hit
    if op in (">", ">=", "<", "<="):
        try:
            limit = F.lit(float(value))
        except (TypeError, ValueError):
            raise ValueError(f"not a number to compare with: {value!r}") from None
        num = F.col(cond.column).cast("double") if type_.startswith(_NUMBERS) else trimmed(raw).try_cast("double")
        return no({">": num > limit, ">=": num >= limit, "<": num < limit, "<=": num <= limit}[op])
    if op == "regex":
        return no(raw.rlike(str(value) if cond.case_sensitive else f"(?i){value}"))
    raise ValueError(f"unknown rule operator: {op!r}")


def rule_column(rule: Rule, columns: Sequence[str] | Mapping[str, str]) -> Column:
    """AND or OR of the conditions over a table's columns, or its columns and their types; a disabled or empty rule never matches."""
    if not rule.enabled or not rule.conditions:
        return F.lit(False)
    if lost := [c.column for c in rule.conditions if c.column not in columns]:
        raise MissingColumnError(f"missing columns: {lost}")
    types = columns if isinstance(columns, Mapping) else {}
    parts = [condition_column(c, types.get(c.column, "string")) for c in rule.conditions]
    return reduce((lambda a, b: a & b) if rule.combine == "AND" else (lambda a, b: a | b), parts)


def period_spec_filter(df: DataFrame, column: str, spec: str | None) -> DataFrame:
    """Rows of the months of a period spec; a list of literals, so that partitions are pruned."""
    months = expand_period_spec(spec)
    return df if months is None else df.where(F.col(column).isin(months))


def isolate_entity(df: DataFrame, entity: str, currencies: Sequence[str], periods: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Rows of one entity and the allowed periods, with the counts of one pass; raises on a strange currency or period among them."""
    mine = F.upper(F.trim(F.col("entity"))) == entity.upper()
    months = expand_period_spec(periods)
    norm = normalize_period(F.col("period"))
    inside = F.lit(True) if months is None else norm.isin(months)
    kept = mine & inside
    strange = ~F.upper(F.trim(F.col("currency"))).isin([c.upper() for c in currencies])
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~mine).alias("other_entity"), F.count_if(mine & ~inside).alias("other_period"),
        F.count_if(kept).alias("kept"), F.count_if(kept & strange).alias("bad_currency"), F.count_if(mine & norm.isNull()).alias("bad_period"),
    ).first().asDict()
    if counts["bad_period"]:
        raise ValueError(f"{counts['bad_period']} rows of {entity} have no readable period")
    if counts["bad_currency"]:
        raise ValueError(f"{counts['bad_currency']} rows of {entity} have a currency that is not allowed")
    return df.where(kept).withColumn("period", norm), counts
