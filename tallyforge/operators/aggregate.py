"""The filtered group-by summary: one spec compiled to one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import column_group_sum, safe_ratio
from tallyforge.functions.numbers import is_missing_number, parse_number_strict

from .filters import Condition, filter_spec, require

FUNCTIONS = ("sum", "mean", "count", "min", "max")


@dataclass(frozen=True)
class ColumnGroup:
    name: str
    sources: Sequence[str]
    output: bool = True


@dataclass(frozen=True)
class Ratio:
    name: str
    numerator: str
    denominator: str
    multiplier: float = 1.0
    output: bool = True


@dataclass(frozen=True)
class AggregationSpec:
    keys: Sequence[str]
    measures: Sequence[str] = ()
    functions: Mapping[str, str] = field(default_factory=dict)
    groups: Sequence[ColumnGroup] = ()
    ratios: Sequence[Ratio] = ()
    filters: Sequence[Condition] = ()
    constants: Mapping[str, str] = field(default_factory=dict)
    month: str | None = None
    annual: str | None = None
    number_mode: str = "English"
    order: Sequence[str] = ()
    strict: bool = True
    number_type: str = "double"


def source_measures(spec: AggregationSpec) -> list[str]:
    made = {g.name for g in spec.groups} | {r.name for r in spec.ratios}
    wanted = [*spec.measures, *(s for g in spec.groups for s in g.sources), *(x for r in spec.ratios for x in (r.numerator, r.denominator))]
    return list(dict.fromkeys(w for w in wanted if w not in made))


def required_columns(spec: AggregationSpec) -> list[str]:
    """Keys, measures, filter columns, month and sources, less what the spec itself makes."""
    keys = [k for k in spec.keys if k not in spec.constants and k != spec.annual]
    wanted = [*keys, *source_measures(spec), *(c.column for c in spec.filters), *([spec.month] if spec.month else [])]
    return list(dict.fromkeys(wanted))


def _parsed(df: DataFrame, column: str, mode: str) -> Column:
    if dict(df.dtypes)[column] == "string":
        return parse_number_strict(F.col(column), mode)
    value = F.col(column)
    return F.struct(value.alias("value"), F.when(value.isNull(), "missing").otherwise("ok").alias("state"))


def ratio_order(ratios: Sequence[Ratio]) -> list[Ratio]:
    """Ratios after those that they use; raises on a cycle."""
    left, out = {r.name: r for r in ratios}, []
    while left:
        free = [r for r in left.values() if r.numerator not in left and r.denominator not in left]
        if not free:
            raise ValueError(f"ratios use one another: {sorted(left)}")
        for r in free:
            out.append(left.pop(r.name))
    return out


def prepared(df: DataFrame, spec: AggregationSpec) -> DataFrame:
    """Filtered rows with the group keys as text and each source measure as <name>__v and <name>__s."""
    require(df, required_columns(spec))
    clash = set(spec.constants) & ({*df.columns} | ({spec.annual} if spec.annual else set()))
    if clash:
        raise ValueError(f"constant columns clash: {sorted(clash)}")
    out = filter_spec(df, spec.filters)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = [text(k).alias(k) for k in group_keys(spec) if k in df.columns and k != spec.annual]
    if spec.annual:
        cols.append(F.substring(F.trim(text(spec.month)), 1, 4).alias(spec.annual))
    for m in source_measures(spec):
        p = _parsed(df, m, spec.number_mode)
        cols += [p["value"].cast(spec.number_type).alias(f"{m}__v"), p["state"].alias(f"{m}__s")]
    return out.select(*cols)


def group_keys(spec: AggregationSpec) -> list[str]:
    """Keys of the grain: an annual column stands in the month's place, or first; constants aren't part of it."""
    keys = [k for k in spec.keys if k not in spec.constants]
    if not spec.annual:
        return keys
    if spec.month in keys:
        return [spec.annual if k == spec.month else k for k in keys]
    return keys if spec.annual in keys else [spec.annual, *keys]


def aggregate_spec(df: DataFrame, spec: AggregationSpec) -> DataFrame:
    """Filter, group, fold, add group columns and ratios, stamp constants, choose columns and order by the keys.

    A column may have its own function and feed groups as a plain sum; both are aggregates of one shuffle. With
    strict, an invalid number raises when its group is computed.
    """
    rows, keys = prepared(df, spec), group_keys(spec)
    zero = F.lit(0).cast(spec.number_type)
    aggs = []
    for m in source_measures(spec):
        v, s = F.col(f"{m}__v"), F.col(f"{m}__s")
        if spec.strict:
            v = F.when(s == "invalid", F.raise_error(F.lit(f"column {m} holds text that is no {spec.number_mode} number")).cast(spec.number_type)).otherwise(v)
        aggs.append(F.coalesce(F.sum(v), zero).alias(f"{m}__sum"))
        fn = spec.functions.get(m, "sum")
        if m in spec.measures and fn in FUNCTIONS and fn != "sum":
            made = {"mean": lambda v=v: F.coalesce(F.avg(v), zero), "count": lambda v=v: F.count(v), "min": lambda v=v: F.coalesce(F.min(v), zero), "max": lambda v=v: F.coalesce(F.max(v), zero)}[fn]()
            aggs.append(made.alias(f"{m}__own"))
    out = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
    own = lambda m: F.col(f"{m}__own" if f"{m}__own" in out.columns else f"{m}__sum")
    cols = {m: own(m) for m in source_measures(spec)}
    for g in spec.groups:
        out = out.withColumn(g.name, column_group_sum([F.col(f"{s}__sum") for s in g.sources]))
        cols[g.name] = F.col(g.name)
    for r in ratio_order(spec.ratios):
        out = out.withColumn(r.name, safe_ratio(cols[r.numerator], cols[r.denominator], r.multiplier))
        cols[r.name] = F.col(r.name)
    shown = output_columns(spec)
    stamped = {k: F.lit(v) for k, v in spec.constants.items()}
    order = [*(k for k in spec.keys if k in spec.constants or k in keys), *(k for k in keys if k not in spec.keys)]
    if spec.annual and spec.annual not in spec.keys:
        order = [spec.annual, *(k for k in order if k != spec.annual)] if spec.month not in spec.keys else [spec.annual if k == spec.month else k for k in [*spec.keys]]
    order += [k for k in spec.constants if k not in order]
    return out.select(*[(stamped[k] if k in stamped else F.col(k)).alias(k) for k in order], *[cols[c].alias(c) for c in shown]).orderBy(*keys)


def output_columns(spec: AggregationSpec) -> list[str]:
    """Value columns: those of the explicit order first, then measures, groups and ratios that are shown."""
    every = [*spec.measures, *(g.name for g in spec.groups if g.output), *(r.name for r in spec.ratios if r.output)]
    return [*(c for c in spec.order if c in every), *(c for c in every if c not in spec.order)]


def number_counts(df: DataFrame, columns: Sequence[str], mode: str = "English") -> DataFrame:
    """(column, missing, invalid, examples) in one pass: the first and the last of a column's invalid texts."""
    state = lambda c: parse_number_strict(F.col(c), mode)["state"]
    aggs = []
    for c in columns:
        bad = F.when(state(c) == "invalid", F.substring(F.col(c), 1, 40))
        aggs += [F.count_if(is_missing_number(F.col(c))).alias(f"{c}__m"), F.count_if(state(c) == "invalid").alias(f"{c}__i"), F.array_join(F.array_distinct(F.array(F.min(bad), F.max(bad))), "|").alias(f"{c}__e")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__m").alias("missing"), F.col(f"{c}__i").alias("invalid"), F.col(f"{c}__e").alias("examples")) for c in columns])
    return one.select(F.inline(rows))


def group_cardinality(df: DataFrame, keys: Sequence[str], conditions: Sequence[Condition] = (), cap: int = 2_000_000) -> DataFrame:
    """One row (groups, exact): distinct keys after the filters, counted up to the cap; reads keys and filter columns only.
    Each task counts the keys that it was dealt, and the counts are added up."""
    each = filter_spec(df, conditions).select(*keys).distinct().groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(F.least(total, F.lit(cap)).alias("groups"), (total <= cap).alias("exact"))


def period_sketches(df: DataFrame, keys: Sequence[str], period: str, bits: int = 14) -> DataFrame:
    """(period, sketch): a HyperLogLog sketch of each period's distinct keys, of 2 ** bits registers (standard error 0.9 % at 14).

    Sketches are kept with the data and merged, so that a cardinality over new periods doesn't read the old ones.
    """
    key = F.xxhash64(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in keys])
    return df.groupBy(F.col(period).alias("period")).agg(F.hll_sketch_agg(key, F.lit(bits)).alias("sketch"))


def merge_sketches(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old periods' sketches with those of the periods that were loaded anew."""
    return old.join(new.select("period"), "period", "left_anti").unionByName(new)


def sketched_cardinality(sketches: DataFrame) -> DataFrame:
    """One row (groups): the estimated number of distinct keys of all periods together."""
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("long").alias("groups"))


def preview(df: DataFrame, spec: AggregationSpec, rows: int = 2000, shown: int = 15, order: Sequence[str] = ()) -> DataFrame:
    """The summary of the first rows only, in the given order or, as fast as may be, in any."""
    return aggregate_spec((df.orderBy(*order) if order else df).limit(rows), spec).limit(shown)


def spec_to_json(spec: AggregationSpec) -> str:
    """A spec as text, to be stored and read by spec_from_json."""
    return json.dumps(asdict(spec), ensure_ascii=False, sort_keys=True)


def spec_from_json(text: str) -> AggregationSpec:
    """The spec of a text; an unknown entry raises, a missing one has its default."""
    raw = json.loads(text)
    if strange := set(raw) - {f.name for f in fields(AggregationSpec)}:
        raise ValueError(f"unknown entries of a stored spec: {sorted(strange)}")
    made = {"groups": ColumnGroup, "ratios": Ratio, "filters": Condition}
    return AggregationSpec(**{k: [made[k](**x) for x in v] if k in made else v for k, v in raw.items()})
