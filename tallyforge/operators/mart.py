"""Generic single-fact mart: declared model, scope loads, dimension merge, audit, reconciliation, exports and recipes."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import decimal_lossless, trimmed
from tallyforge.functions.text import bucket_label

from .periods import content_fingerprint


@dataclass(frozen=True)
class Dimension:
    name: str
    keys: Sequence[str]
    attributes: Sequence[str] = ()
    authority: str | None = None


@dataclass(frozen=True)
class Measure:
    column: str
    precision: int = 18
    scale: int = 2
    kind: str = "value"

    @property
    def type(self) -> str:
        return f"decimal({self.precision},{self.scale})"


@dataclass(frozen=True)
class MartModel:
    period: str
    row_key: Sequence[str]
    measures: Sequence[Measure]
    dimensions: Sequence[Dimension] = ()
    partitions: Sequence[str] = ()
    excluded: Sequence[str] = ()
    duplicates: str = "reject"

    def __post_init__(self):
        names = [m.column for m in self.measures]
        others = [self.period, *self.partitions, *self.row_key, *(c for d in self.dimensions for c in (*d.keys, *d.attributes))]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError("a measure is declared twice")
        if clash := {n.lower() for n in names} & {o.lower() for o in others} | {n.lower() for n in [*names, *others]} & {e.lower() for e in self.excluded}:
            raise ValueError(f"columns with several roles: {sorted(clash)}")
        if len({o.lower() for o in others}) < len(set(others)):
            raise ValueError("columns that differ by case only")
        for m in self.measures:
            if not 0 <= m.scale <= m.precision <= 38:
                raise ValueError(f"bad precision of {m.column}")

    @property
    def scope(self) -> list[str]:
        return [self.period, *self.partitions]


def _forms_differ(column: str) -> Column:
    n = F.length(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.when(F.min(n) < F.max(n), 1).otherwise(0)


def scope_row_validation(df: DataFrame, model: MartModel, scopes: DataFrame | None = None) -> DataFrame:
    """One row of fault counts: blank scope and row keys, inexact measures, odd periods, dimensions with authorities of
    unlike lengths, repeated row keys, rows outside the scopes."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    any_ = lambda parts: reduce(lambda a, b: a | b, parts, F.lit(False))
    counts = df.agg(F.count_if(any_([blank(c) for c in model.scope])).alias("blank_scope"), F.count_if(any_([blank(c) for c in model.row_key])).alias("blank_key"), F.count_if(any_([~decimal_lossless(F.col(m.column), m.precision, m.scale) for m in model.measures])).alias("inexact"),
        F.count_if(~blank(model.period) & period_form(F.col(model.period)).isNull()).alias("odd_periods"), sum((_forms_differ(d.authority) for d in model.dimensions if d.authority), F.lit(0)).cast("long").alias("mixed_authorities"))
    repeats = df.groupBy(*model.scope, *model.row_key).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    outside = df.join(scopes, model.scope, "left_anti").agg(F.count(F.lit(1)).alias("outside")) if scopes is not None else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("outside"))
    return counts.crossJoin(repeats).crossJoin(outside)


def model_text(model: MartModel) -> str:
    """The model as text, to compare it with the one a mart was made for."""
    return json.dumps(asdict(model), sort_keys=True, ensure_ascii=False)


def period_form(c: Column) -> Column:
    """Length of a valid period: 6 (YYYYMM), 7 (YYYY-MM) or 10 (a date); null for any other text."""
    t = c.cast("string")
    day = F.when(t.rlike("^[0-9]{6}$"), F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-01"))).when(t.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t)
    return F.when(day.try_cast("date").isNotNull(), F.length(t))


def exact_measure(m: Measure) -> Column:
    """A measure's text as its declared decimal; null where it is blank or inexact."""
    value = trimmed(F.col(m.column)).try_cast("decimal(38,18)" if m.scale <= 18 else m.type)
    return value.try_cast(m.type)


def typed_stage(df: DataFrame, model: MartModel) -> DataFrame:
    """Measures as their declared decimals; an inexact one raises when it is read."""
    bad = lambda m: F.raise_error(F.lit(f"{m.column} isn't exact as {m.type}")).cast(m.type)
    return df.withColumns({m.column: F.when(decimal_lossless(F.col(m.column), m.precision, m.scale), exact_measure(m)).otherwise(bad(m)) for m in model.measures})


def collapse_duplicate_grain(df: DataFrame, keys: Sequence[str], measures: Sequence[str], seq: str) -> DataFrame:
    """One row per key: measures summed (all blank stays blank), other columns of the first row in input order."""
    rest = [c for c in df.columns if c not in {*keys, *measures, seq}]
    aggs = [F.sum(m).alias(m) for m in measures]
    if rest:
        aggs.append(F.min_by(F.struct(*rest), F.col(seq)).alias("__r"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest], *measures)


def sum_null_propagating(c: str) -> Column:
    """Null if any input is null."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def scope_controls(df: DataFrame, scope: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*scope).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(m), F.lit(0)).alias(f"sum_{m}") for m in measures])


def reconcile_scopes(stored: DataFrame, df: DataFrame, scope: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(scope..., matches): stored controls against the controls of the data now; missing on either side is no match."""
    now = scope_controls(df, scope, measures)
    names = ["rows", *[f"sum_{m}" for m in measures]]
    a = stored.select(*scope, *[F.col(n).alias(f"a_{n}") for n in names])
    b = now.select(*scope, *[F.col(n).alias(f"b_{n}") for n in names])
    ok = reduce(lambda x, y: x & y, [F.coalesce(F.col(f"a_{n}") == F.col(f"b_{n}"), F.lit(False)) for n in names])
    return a.join(b, list(scope), "full_outer").select(*scope, ok.alias("matches"))


def discover_scopes(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    return df.select(*scope).distinct()


def replace_scope(current: DataFrame, incoming: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The fact after a load of whole scopes: those of the incoming rows are replaced, all others stay."""
    return current.join(discover_scopes(incoming, scope), list(scope), "left_anti").unionByName(incoming, allowMissingColumns=True)


def load_all_scopes(incoming: DataFrame, path: str, scope: Sequence[str]) -> None:
    """All scopes of the rows in one dynamic overwrite of their partitions. A scope's rows are gathered before, into one
    file for a few million of them, so that there aren't as many files as tasks and scopes."""
    gathered(incoming, scope).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def gathered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows dealt by their partition columns; Spark splits those of large partitions over several tasks."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def archive_replaced_rows(current: DataFrame, incoming: DataFrame, scope: Sequence[str], revision: int) -> DataFrame:
    """Rows that a load is about to replace, with the revision that replaces them."""
    return current.join(discover_scopes(incoming, scope), list(scope), "left_semi").withColumn("replaced_by", F.lit(revision).cast("long"))


def archive_verified(archive: DataFrame, current: DataFrame, incoming: DataFrame, scope: Sequence[str]) -> bool:
    """The archive holds exactly the rows that go: their number and multiset hash are equal."""
    gone = current.join(discover_scopes(incoming, scope), list(scope), "left_semi")
    return content_fingerprint(archive.drop("replaced_by")).first() == content_fingerprint(gone.select(*[c for c in archive.columns if c != "replaced_by"])).first()


def star_rejoin(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """fact with each dimension's attributes, by its surrogate key; Spark broadcasts what is under its threshold."""
    return reduce(lambda f, d: f.join(d[1], d[0], "inner"), dims.items(), fact)


def member_keys(stage: DataFrame, dim: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """stage with each row's member number from a dimension (sk, keys...); null key parts match null ones."""
    d = dim.select(F.col("sk").alias(out), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return stage.join(d, on).drop(*[f"__k{i}" for i in range(len(keys))])


def natural_key_join(stage: DataFrame, registry: DataFrame, dimension: str, keys: Sequence[str], out: str) -> DataFrame:
    """stage with the surrogate key of (dimension, natural key); the key's parts stay real columns of the registry."""
    reg = registry.where(F.col("dimension") == dimension).select(*[F.col(f"k{i}").alias(f"__k{i}") for i in range(len(keys))], F.col("sk").alias(out))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return stage.join(reg, on).drop(*[f"__k{i}" for i in range(len(keys))])


def select_mart(star: DataFrame, columns: Sequence[str] = (), group_by: Sequence[str] = (), measures: Sequence[str] = (), filters: Mapping[str, object] | None = None, period: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Chosen columns of the rows that pass, or measures summed by group_by (null where an input is null)."""
    if first and last and len(first) != len(last):
        raise ValueError("period bounds of unlike granularity")
    out = star
    for c, v in (filters or {}).items():
        out = out.where(F.col(c).eqNullSafe(F.lit(v)))
    if period and first:
        out = out.where(F.col(period) >= first)
    if period and last:
        out = out.where(F.col(period) <= last)
    if group_by:
        return out.groupBy(*group_by).agg(*[sum_null_propagating(m).alias(m) for m in measures])
    return out.select(*columns) if columns else out


def paged_sample(df: DataFrame, order: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000, offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


@dataclass(frozen=True)
class Recipe:
    mode: str = "wide_raw"
    group_by: Sequence[str] = field(default_factory=tuple)
    level: str = "major"
    exclude_zero: bool = True
    apply_sign: bool = False
    unmapped: str = "fail"
    bucket: str = "other"


def unmapped_measures(measures: Sequence[str] | DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_column) of measures without an entry, and of amount entries without a major category."""
    names = measures if isinstance(measures, DataFrame) else mapping.sparkSession.createDataFrame([(m,) for m in measures], "source_column string")
    good = mapping.where((F.col("measure_type") != "amount") | (F.trim(F.coalesce("major_category", F.lit(""))) != "")).select("source_column")
    return names.join(good, "source_column", "left_anti")


def resolved_mapping(measures: Sequence[str], mapping: DataFrame, recipe: Recipe) -> DataFrame:
    """Amount entries of the measures; those without a mapping raise, or go to the bucket with a sort order from 9000 on."""
    lost = unmapped_measures(measures, mapping)
    used = mapping.join(lost, "source_column", "left_anti").where("measure_type = 'amount'").where(F.col("source_column").isin(list(measures)))
    if recipe.unmapped == "fail":
        if some := lost.limit(5).collect():
            raise ValueError(f"measures without a mapping: {[r[0] for r in some]}")
        return used
    extra = lost.select("source_column", F.lit("amount").alias("measure_type"), F.lit("").alias("account_code"), F.col("source_column").alias("display_name"), F.lit(recipe.bucket).alias("major_category"), F.lit("").alias("medium_category"), F.lit("").alias("minor_category"), F.lit(1).alias("sign"), F.lit(9000).alias("sort_order"))
    return used.unionByName(extra, allowMissingColumns=True)


def long_detail_recipe(star: DataFrame, measures: Sequence[str], mapping: DataFrame, recipe: Recipe) -> DataFrame:
    """Grouped measures as account rows with code, name and categories; zero and null amounts go if asked.

    The measures are summed before they are unpivoted, so that the wide rows aren't multiplied by the accounts.
    """
    m = resolved_mapping(measures, mapping, recipe)
    sums = star.groupBy(*recipe.group_by).agg(*[F.sum(F.col(f"`{c}`").cast("decimal(38,6)")).alias(c) for c in measures])
    rows = sums.unpivot(list(recipe.group_by), list(measures), "source_column", "amount").join(m, "source_column")
    if recipe.apply_sign:
        rows = rows.withColumn("amount", (F.col("amount") * F.col("sign")).cast("decimal(38,6)"))
    if recipe.exclude_zero:
        rows = rows.where("amount IS NOT NULL AND amount <> 0")
    return rows.select(*recipe.group_by, "account_code", "display_name", "major_category", "medium_category", "minor_category", "amount")


def wide_rollup_recipe(star: DataFrame, measures: Sequence[str], mapping: DataFrame, recipe: Recipe, extra: Sequence[str] = ()) -> DataFrame:
    """Measures summed into one column per major (or major_medium) category, by group; one aggregate over one scan."""
    entries = resolved_mapping(measures, mapping, recipe).withColumn("__b", bucket_label(F.col("major_category"), F.col("medium_category"), recipe.level)).orderBy("sort_order", "source_column").collect()  # one entry per measure of the model
    buckets: dict[str, list] = {}
    for e in entries:
        buckets.setdefault(e["__b"], []).append(e)
    aggs, used = [], {*(g.lower() for g in recipe.group_by), *(x.lower() for x in extra)}
    for label, parts in buckets.items():
        name, k = label, 2
        while name.lower() in used:
            name, k = f"{label}_{k}", k + 1
        used.add(name.lower())
        terms = [F.coalesce(F.sum(F.col(f"`{e['source_column']}`").cast("decimal(38,6)")), F.lit(0)) * F.lit(e["sign"] if recipe.apply_sign else 1) for e in parts]
        aggs.append(reduce(lambda a, b: a + b, terms).cast("decimal(38,6)").alias(name))
    return star.groupBy(*recipe.group_by).agg(*aggs, *[F.sum(x).alias(x) for x in extra])


def run_recipe(star: DataFrame, measures: Sequence[str], mapping: DataFrame, recipe: Recipe, columns: Sequence[str] = ()) -> DataFrame:
    if recipe.mode == "long_detail":
        return long_detail_recipe(star, measures, mapping, recipe)
    if recipe.mode == "wide_rollup":
        return wide_rollup_recipe(star, measures, mapping, recipe)
    if recipe.mode == "wide_raw":
        return select_mart(star, columns, recipe.group_by, measures)
    raise ValueError(f"unknown recipe mode: {recipe.mode!r}")


def recipe_reconcile(star: DataFrame, measures: Sequence[str], mapping: DataFrame, recipe: Recipe) -> DataFrame:
    """(major_category, source_total, exported_total, matches), in exact decimals."""
    m = resolved_mapping(measures, mapping, recipe)
    source = star.agg(*[F.sum(F.col(f"`{c}`").cast("decimal(38,6)")).alias(c) for c in measures]).unpivot([], list(measures), "source_column", "amount").join(m, "source_column")
    sign = F.col("sign") if recipe.apply_sign else F.lit(1)
    source = source.groupBy("major_category").agg(F.coalesce(F.sum(F.col("amount") * sign), F.lit(0)).cast("decimal(38,6)").alias("source_total"))
    out = long_detail_recipe(star, measures, mapping, recipe).groupBy("major_category").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,6)").alias("exported_total"))
    return source.join(out, "major_category", "full_outer").select("major_category", "source_total", F.coalesce("exported_total", F.lit(0).cast("decimal(38,6)")).alias("exported_total")).withColumn("matches", F.col("source_total") == F.col("exported_total"))


def recipe_left_out(measures: Sequence[str] | DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_column, reason) of the measures that a recipe's totals don't hold: subtotal, non_monetary or unmapped.

    A measure without an entry, or with an amount entry that has no major category, is unmapped.
    """
    names = measures if isinstance(measures, DataFrame) else mapping.sparkSession.createDataFrame([(m,) for m in measures], "source_column string")
    entry = mapping.select("source_column", F.col("measure_type").alias("__t"), (F.trim(F.coalesce("major_category", F.lit(""))) != "").alias("__m"))
    kind = F.when(F.col("__t") == "amount", F.when(~F.col("__m"), "unmapped")).when(F.col("__t").isin("subtotal", "non_monetary"), F.col("__t")).otherwise("unmapped")
    return names.select("source_column").distinct().join(entry, "source_column", "left").select("source_column", kind.alias("reason")).where("reason IS NOT NULL")


def long_cost_export(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """(keys..., measure, value) of cost measures; another kind is refused."""
    if bad := [m.column for m in measures if m.kind != "cost"]:
        raise ValueError(f"not cost measures: {bad}")
    return df.select(*keys, *[F.col(m.column).cast("decimal(38,6)").alias(m.column) for m in measures]).unpivot(list(keys), [m.column for m in measures], "measure", "value")
