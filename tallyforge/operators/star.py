"""Star schema: key registries, dimensions, facts, currency, drill-across and their checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.dates import expand_period_spec, period_parts
from tallyforge.functions.money import fx_convert
from tallyforge.functions.text import UNKNOWN, business_key, null_to_unknown
from tallyforge.session import written

UNKNOWN_KEY = -1
STATEMENT_LINES = ("GROSS_REVENUE", "SALES_DEDUCTION", "COGS", "LOGISTICS_COST", "PROMOTION_COST", "WARRANTY_COST", "FIXED_SGNA")


# keys and dimensions

def new_keys(keys: DataFrame, registry: DataFrame, key: str = "nk", exact: bool = False) -> DataFrame:
    """Distinct keys that the registry lacks, normalised unless they are to be taken as they are."""
    wanted = keys.select((F.col(key) if exact else business_key(F.col(key))).alias(key)).where(F.col(key) != "").distinct()
    return wanted.join(registry.select(key), key, "left_anti")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row", start: int = 1, partitions: int | None = None) -> DataFrame:
    """df with gapless numbers from `start` on in the given order; ties are numbered in any order.

    The rows are dealt by ranges and sorted within; the counts of the ranges (one number each) give each range's first
    number, so that no task holds all rows. They are written in between, so that numbers and counts see the same ranges,
    also when a task runs again.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("__p", before.alias("__b"))  # one row for each of the n ranges
    return placed.join(F.broadcast(firsts), "__p").select((F.lit(start) + F.col("__b") + F.col("__i")).cast("long").alias(name), *df.columns)


def assign_surrogate_keys(registry: DataFrame, keys: DataFrame, key: str = "nk", sk: str = "sk", partitions: int | None = None, exact: bool = False) -> DataFrame:
    """The registry with new keys appended: its highest number and on, in key order; old numbers never change."""
    top = registry.agg(F.max(sk)).first()[0]
    numbered = number_rows(new_keys(keys, registry, key, exact), [key], sk, max(top if top is not None else 0, 0) + 1, partitions)
    return registry.select(F.col(sk).cast("long").alias(sk), key).unionByName(numbered)


def append_unknown_member(dim: DataFrame, sk: str, texts: Sequence[str]) -> DataFrame:
    """dim and one row with the key -1 and UNKNOWN in the text columns; other columns are null there."""
    one = dim.sparkSession.range(1).select(*[(F.lit(UNKNOWN_KEY) if c == sk else F.lit(UNKNOWN) if c in texts else F.lit(None)).cast(t).alias(c) for c, t in dim.dtypes])
    return dim.unionByName(one)


def scan_master_records(df: DataFrame, key: str, optional: Sequence[str]) -> DataFrame:
    """Master rows with a normalised key; optional columns that are missing or blank are UNKNOWN."""
    return df.select(business_key(F.col(key)).alias(key), *[(null_to_unknown(F.col(c)) if c in df.columns else F.lit(UNKNOWN)).alias(c) for c in optional])


def upsert_master(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose normalised key isn't among the new ones, and the new rows."""
    norm = lambda d: d.withColumn(key, business_key(F.col(key)))
    return norm(old).join(norm(new).select(key).distinct(), key, "left_anti").unionByName(norm(new), allowMissingColumns=True)


def dedup_keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key in input order."""
    return first_by_input_order(df, [key], seq).select(*df.columns)


def first_by_input_order(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Per key, all other columns as of its first row; min_by over a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("__r")).select(*keys, "__r.*")


def latest_authority_row(df: DataFrame, key: str, authority: str) -> DataFrame:
    """The row of each key with the highest authority."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(authority)).alias("__r")).select(key, "__r.*")


def build_dimension(master: DataFrame, key: str, attributes: Sequence[str], registry: DataFrame, sk: str = "sk") -> DataFrame:
    """Dimension rows (sk, key, attributes) with the UNKNOWN member; registry (sk, nk) holds at least the master's keys."""
    rows = scan_master_records(master, key, attributes)
    return append_unknown_member(rows.join(registry.select(F.col("nk").alias(key), sk), key).select(sk, key, *attributes), sk, [key, *attributes])


def discovered_dimension(staged: DataFrame, key: str, name: str, registry: DataFrame, sk: str = "sk") -> DataFrame:
    """A dimension found in the facts: the greatest name of each code."""
    found = staged.where(F.trim(key) != "").groupBy(business_key(F.col(key)).alias(key)).agg(F.max(null_to_unknown(F.col(name))).alias(name))
    return build_dimension(found, key, [name], registry, sk)


def expand_calendar(periods: DataFrame, spec: str | None = None, registered: DataFrame | None = None) -> DataFrame:
    """Date dimension of all months from the first to the last of the periods (YYYY-MM), of those of a period spec, and
    of those registered before."""
    months = expand_period_spec(spec) if spec else None
    every = periods.select("period")
    if months:
        every = every.unionByName(periods.sparkSession.createDataFrame([(m,) for m in months], "period string"))
    if registered is not None:
        every = every.unionByName(registered.select("period"))
    ends = every.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a IS NOT NULL")
    day = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    months = ends.select(F.explode(F.sequence(day("a"), day("b"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("period"))
    return months.select(period_parts(F.col("period")).alias("p"), "period").select("p.date_sk", "period", "p.year", "p.quarter", "p.month")


def dimension_uniqueness(dim: DataFrame, sk: str, nk: str) -> DataFrame:
    return dim.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(sk).alias("keys"), F.count_distinct(business_key(F.col(nk))).alias("codes")).withColumn("ok", (F.col("rows") == F.col("keys")) & (F.col("rows") == F.col("codes")))


def master_key_check(master: DataFrame, key: str) -> DataFrame:
    """(key, n): blank keys and keys that are equal without regard to case; none if the master is fine."""
    return master.groupBy(F.coalesce(business_key(F.col(key)), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR key = ''")


def conflicting_attributes(df: DataFrame, key: str, authority: str, attributes: Sequence[str]) -> DataFrame:
    """Keys with unlike attributes under one authority."""
    return df.groupBy(key, authority).agg(F.count_distinct(F.to_json(F.struct(*attributes))).alias("versions")).where("versions > 1")


def merge_dimension_type1(dim: DataFrame, stage: DataFrame, key: str, attributes: Sequence[str], authority: str, sk: str = "sk") -> tuple[DataFrame, DataFrame]:
    """(dimension, audit): new attributes where the staged authority is strictly higher than the old one; keys are exact
    and keep their number. Of several staged rows of one authority the one with the greatest attributes counts.

    The audit has the old version of each changed member.
    """
    rank = F.struct(F.col(authority), F.to_json(F.struct(*attributes)))
    latest = stage.groupBy(key).agg(F.max_by(F.struct(authority, *attributes), rank).alias("__r")).select(key, "__r.*")
    numbers = assign_surrogate_keys(dim.select(F.col(sk), F.col(key).alias("nk")), latest.select(F.col(key).alias("nk")), sk=sk, exact=True).withColumnRenamed("nk", key)
    o, n = dim.alias("o"), latest.alias("n")
    both = numbers.join(o.drop(sk), key, "left").alias("o").join(n, key, "left")
    newer = F.col(f"n.{authority}").isNotNull() & (F.col(f"o.{authority}").isNull() | (F.col(f"n.{authority}") > F.col(f"o.{authority}")))
    out = both.select(F.col(sk), F.col(key), *[F.when(newer, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in (authority, *attributes)])
    changed = newer & F.col(f"o.{authority}").isNotNull() & (F.to_json(F.struct(*[F.col(f"n.{a}") for a in attributes])) != F.to_json(F.struct(*[F.col(f"o.{a}") for a in attributes])))
    audit = both.where(changed).select(F.col(sk), F.col(key), *[F.col(f"o.{c}").alias(c) for c in (authority, *attributes)])
    return out, audit


# lookups

def lookup_surrogate_left(fact: DataFrame, dim: DataFrame, code: str, nk: str, sk: str, out: str, exact: bool = False) -> DataFrame:
    """fact with the member's key, -1 where its code (normalised, unless it is to be taken as it is) isn't in dim; the code is kept."""
    d = dim.where(F.col(sk) != UNKNOWN_KEY).select(F.col(nk).alias("__nk"), F.col(sk).alias("__sk"))
    return fact.join(d, (F.col(code) if exact else business_key(F.col(code))) == F.col("__nk"), "left").withColumn(out, F.coalesce(F.col("__sk"), F.lit(UNKNOWN_KEY)).cast("long")).drop("__nk", "__sk")


def fk_missing(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(column, code, n) of fact codes that their dimension lacks, null codes too; the most frequent first.

    The codes of all columns are counted in one pass over the fact, so that only distinct ones meet the keys; both are
    compared as text.
    """
    text = lambda c: F.col(c).cast("string").alias("code")
    cells = fact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c)) for c in dims])).alias("cell")).select("cell.*")
    counts = cells.groupBy("column", "code").agg(F.count(F.lit(1)).alias("n"))
    keys = reduce(DataFrame.unionByName, (dim.select(F.lit(c).alias("column"), text(key)) for c, (dim, key) in dims.items()))
    return counts.join(keys, ["column", "code"], "left_anti").select("column", "code", "n").orderBy("column", F.desc("n"), "code")


def fk_anti_join_failfast(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str]], errors: str | None = None) -> None:
    """Raise with the first missing codes, after writing them all where a path is given."""
    lost = fk_missing(fact, dims)
    some = lost.limit(5).collect()
    if some:
        if errors:
            lost.write.mode("overwrite").parquet(errors)
        raise ValueError("foreign keys without a member: " + ", ".join(f"{r['column']}={r['code']} ({r['n']} rows)" for r in some))


# facts

def unpivot_accounts(wide: DataFrame, ids: Sequence[str], accounts: Sequence[str], subtotals: Sequence[str] = ()) -> DataFrame:
    """(ids..., account_code, amount): one scan for all accounts; subtotal columns are left out, zeros stay."""
    used = [a for a in accounts if a not in set(subtotals)]
    return wide.unpivot(list(ids), used, "account_code", "amount")


def long_amounts(long: DataFrame, rules: DataFrame, rates: DataFrame, reporting: str) -> DataFrame:
    """Long rows with the account's line and sign: raw, signed (both rounded to 6) and reporting amounts."""
    r = rules.select(F.col("account_code").alias("__a"), "statement_line", F.col("sign_multiplier").alias("__s"))
    out = long.join(r, F.col("account_code") == F.col("__a"), "left").drop("__a")
    out = out.withColumn("amount", F.round(F.col("amount").cast("decimal(18,6)"), 6)).withColumn("signed", (F.col("amount") * F.coalesce("__s", F.lit(0))).cast("decimal(18,6)")).drop("__s")
    return fx_convert(out, rates, ["signed"], reporting)


def waterfall_columns(value: Column, suffix: str = "") -> list[Column]:
    """The seven statement lines and the five results of a signed amount, as aggregates."""
    line = {s: F.coalesce(F.sum(F.when(F.col("statement_line") == s, value)), F.lit(0)).cast("decimal(38,6)") for s in STATEMENT_LINES}
    net = line["GROSS_REVENUE"] + line["SALES_DEDUCTION"]
    gross = net + line["COGS"]
    variable = line["LOGISTICS_COST"] + line["PROMOTION_COST"] + line["WARRANTY_COST"]
    margin = gross + variable
    made = {**{k.lower(): v for k, v in line.items()}, "net_revenue": net, "gross_margin": gross, "variable_cost": variable, "contribution_margin": margin, "operating_profit": margin + line["FIXED_SGNA"]}
    return [v.cast("decimal(38,6)").alias(f"{k}{suffix}") for k, v in made.items()]


def waterfall_rollup(long: DataFrame, grain: Sequence[str], value: str = "signed_reporting", local: str | None = None) -> DataFrame:
    """The statement lines and results of each grain; with the `local` amounts' column also theirs, as <name>_local.

    Subtotals are in no line, as they would count their accounts twice.
    """
    lines = waterfall_columns(F.col(value)) + (waterfall_columns(F.col(local), "_local") if local else [])
    return long.where(F.coalesce("statement_line", F.lit("")) != "SUBTOTAL_IGNORED").groupBy(*grain).agg(*lines)


def _line_total(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(38,6)")


def _entries(rules: DataFrame) -> dict[str, tuple[str, int]]:
    """account -> (statement line, sign); one rule per account column of the wide table, so a small table by nature."""
    return {r["account_code"]: (r["statement_line"], r["sign_multiplier"]) for r in rules.select("account_code", "statement_line", "sign_multiplier").collect()}


def wide_lines(wide: DataFrame, accounts: Sequence[str], rules: DataFrame, rates: DataFrame, reporting: str, local: bool = False) -> DataFrame:
    """Wide rows with one column per statement line: the reporting amounts of its accounts, each rounded to 6, added up;
    if `local`, also <line>_local in the row's own currency.

    Equals long_amounts and a sum by line, without a row for each account: the rules are resolved on the driver, and
    the rate is joined once a row. Accounts without a rule, and subtotals, are in no line.
    """
    by: dict[str, list[tuple[str, int]]] = {}
    for a, (line, sign) in _entries(rules).items():
        if a in accounts:
            by.setdefault(line, []).append((a, sign))
    signed = {a: f"__signed_{a}" for parts in by.values() for a, _ in parts}
    out = wide.withColumns({signed[a]: (F.round(F.col(a).cast("decimal(18,6)"), 6) * F.lit(sign)).cast("decimal(18,6)") for parts in by.values() for a, sign in parts})
    out = fx_convert(out, rates, list(signed.values()), reporting)
    total = lambda parts, ending="": reduce(lambda x, y: x + y, [_line_total(F.col(f"{signed[a]}{ending}")) for a, _ in parts] or [F.lit(0)]).cast("decimal(38,6)")
    lines = {s.lower(): total(by.get(s, ()), "_reporting") for s in STATEMENT_LINES}
    if local:
        lines |= {f"{s.lower()}_local": total(by.get(s, ())) for s in STATEMENT_LINES}
    out = out.withColumns(lines)
    return out.drop(*signed.values(), *[f"{x}_reporting" for x in signed.values()])


def signed_total(accounts: Sequence[str], rules: DataFrame) -> Column:
    """A wide row's signed amounts of all accounts in a statement line, each rounded to 6, added up."""
    used = [(a, sign) for a, (line, sign) in _entries(rules).items() if a in accounts and line in STATEMENT_LINES]
    return sum((_line_total(F.round(F.col(a).cast("decimal(18,6)"), 6) * F.lit(sign)) for a, sign in used), F.lit(0).cast("decimal(38,6)")).cast("decimal(38,6)")


def with_results(df: DataFrame, suffix: str = "") -> DataFrame:
    """df with the five results of its seven statement line columns (all of the same suffix)."""
    out = df
    for name, parts in (
        ("net_revenue", ("gross_revenue", "sales_deduction")), ("gross_margin", ("net_revenue", "cogs")), ("variable_cost", ("logistics_cost", "promotion_cost", "warranty_cost")),
        ("contribution_margin", ("gross_margin", "variable_cost")), ("operating_profit", ("contribution_margin", "fixed_sgna")),
    ):
        out = out.withColumn(f"{name}{suffix}", sum((F.col(f"{p}{suffix}") for p in parts[1:]), F.col(f"{parts[0]}{suffix}")).cast("decimal(38,6)"))
    return out


def wide_waterfall(wide: DataFrame, accounts: Sequence[str], rules: DataFrame, rates: DataFrame, reporting: str, grain: Sequence[str]) -> DataFrame:
    """waterfall_rollup straight from the wide table."""
    lines = [s.lower() for s in STATEMENT_LINES]
    return with_results(wide_lines(wide, accounts, rules, rates, reporting).groupBy(*grain).agg(*[_line_total(F.sum(c)).alias(c) for c in lines]))


def unmapped_wide_accounts(wide: DataFrame, accounts: Sequence[str], rules: DataFrame, allow: bool = False) -> dict[str, object]:
    """account -> sum of absolute amounts of the accounts without a rule that have money in them; raises on any unless allowed."""
    lost = [a for a in accounts if a not in _entries(rules)]
    if not lost:
        return {}
    money = wide.agg(*[F.sum(F.abs(a)).alias(a) for a in lost]).first().asDict()
    found = {a: v for a, v in money.items() if v}
    if found and not allow:
        raise ValueError(f"accounts without a rule: {', '.join(found)}")
    return found


#: Names under which the columns of an inventory table may come, the first that is there counts.
INVENTORY_ALIASES = {
    "warehouse_code": ("warehouse_code", "warehouse"),
    "currency": ("currency_code", "currency"),
    "entity": ("entity_code", "entity"),
    "qty": ("ending_qty", "inventory_qty", "qty", "stock_qty"),
    "value": ("ending_inventory_val_local", "ending_inventory_val", "inventory_val_local", "inventory_val", "ending_val", "value"),
    "dio": ("dio_days", "dio"),
    "cost": ("warehouse_logistics_cost_local", "warehouse_logistics_cost", "logistics_cost_local", "logistics_cost", "wh_logistics_cost", "cost"),
}


def inventory_source(df: DataFrame) -> DataFrame:
    """An inventory table under the names that inventory_fact reads, found among their aliases; the warehouse's code is its name where it has none."""
    have = {c.lower(): c for c in df.columns}
    names, lost = {}, []
    for name, aliases in INVENTORY_ALIASES.items():
        found = next((have[a] for a in aliases if a in have), None)
        if found is None:
            lost.append(name)
        names[name] = found
    if lost:
        raise ValueError(f"inventory columns not found: {lost}")
    out = df.withColumnsRenamed({old: new for new, old in names.items() if old != new})
    return out if "warehouse_name" in out.columns else out.withColumn("warehouse_name", F.col("warehouse_code"))


def inventory_premart(df: DataFrame, grain: Sequence[str], value: str, sums: Sequence[str], warehouse: str, dio: str = "dio") -> DataFrame:
    """Sums, days of stock weighted by value (a plain mean where the weights aren't positive), and warehouses of a grain."""
    w, d = F.col(value), F.col(dio).cast("decimal(12,6)")
    weight = F.sum(w)
    mean = F.when(weight > 0, F.sum(w.cast("decimal(24,6)") * d).cast("double") / weight.cast("double")).otherwise(F.sum(d).cast("double") / F.count(d))
    return df.groupBy(*grain).agg(weight.alias(value), *[F.sum(s).alias(s) for s in sums], mean.alias("dio"), F.count_distinct(warehouse).alias("warehouses"))


def price_premart(df: DataFrame, grain: Sequence[str], prices: Sequence[str], channel: str) -> DataFrame:
    """Mean, least and greatest unit prices, and channels of a grain."""
    parts = [x for p in prices for x in ((F.sum(p).cast("double") / F.count(p)).alias(p), F.min(p).alias(f"min_{p}"), F.max(p).alias(f"max_{p}"))]
    return df.groupBy(*grain).agg(*parts, F.count_distinct(channel).alias("channels"))


def _dealt(df: DataFrame, grain: Sequence[str], partitions: int | None) -> DataFrame:
    """The rows dealt by a grain that is nearly a key, so that sums are made for a task's share of it only; as they are without a number.

    Sums made before the rows are dealt would save nothing there, and each task would hold one for nearly every row it reads.
    """
    return df.repartition(partitions, *grain) if partitions else df


def inventory_fact(df: DataFrame, grain: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Sums of quantity, value and cost; days of stock weighted by value, a plain mean where the weights aren't positive."""
    w, d = F.col("value").cast("decimal(18,6)"), F.col("dio").cast("decimal(12,6)")
    weight = F.sum(w)
    return _dealt(df, grain, partitions).groupBy(*grain).agg(
        F.sum(F.col("qty").cast("decimal(18,6)")).alias("qty"), weight.alias("value"), F.sum(F.col("cost").cast("decimal(18,6)")).alias("cost"),
        F.when(weight > 0, F.sum(w * d).cast("double") / weight.cast("double")).otherwise(F.sum(d).cast("double") / F.count(d)).alias("dio"),
    )


def price_fact(df: DataFrame, grain: Sequence[str], prices: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Mean unit prices, never sums."""
    return _dealt(df, grain, partitions).groupBy(*grain).agg(*[(F.sum(F.col(p).cast("decimal(18,6)")).cast("double") / F.count(p)).alias(p) for p in prices])


def grain_join(amounts: DataFrame, quantities: DataFrame, grain: Sequence[str], measures: Sequence[str], quantity: str = "qty") -> DataFrame:
    """Amounts summed on a grain with the quantity summed on the same; each side is aggregated before the join."""
    a = amounts.groupBy(*grain).agg(*[F.sum(m).alias(m) for m in measures])
    q = quantities.groupBy(*grain).agg(F.sum(quantity).alias(quantity))
    return a.join(q, list(grain), "left").withColumn(quantity, F.coalesce(quantity, F.lit(0)))


def customer(sk: str, code: str) -> Column:
    """A member's number as text, or the raw code of an unmapped one."""
    return F.when(F.col(sk) == UNKNOWN_KEY, F.concat(F.lit("?"), F.col(code))).otherwise(F.col(sk).cast("string"))


def product_premart(pnl: DataFrame, grain: Sequence[str], sums: Sequence[str], customer_sk: str, customer_code: str) -> DataFrame:
    """Sums and distinct customers of a grain; unmapped customers count by their raw code."""
    who = customer(customer_sk, customer_code)
    return pnl.groupBy(*grain).agg(*[F.sum(s).alias(s) for s in sums], F.count_distinct(who).alias("customers"))


def drill_across(facts: Mapping[str, DataFrame], grain: Sequence[str], zero: Sequence[str] = ()) -> DataFrame:
    """Facts that are unique on the grain, side by side; the measures in `zero` are 0 where a fact has no row."""
    out = None
    for f in facts.values():
        out = f if out is None else out.join(f, list(grain), "full_outer")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


@dataclass(frozen=True)
class PremartPart:
    """What a premart has of one fact: sums, means of prices with their least and greatest, days of stock weighted by a summed value, and how many distinct members."""

    rows: DataFrame
    count: str
    member: Column
    sums: Sequence[str] = ()
    prices: Sequence[str] = ()
    weight: str | None = None
    dio: str = "dio"


def _premart_sums(p: PremartPart, c: Callable[[str], str] = lambda name: name) -> tuple[dict[str, Column], list[Column]]:
    """The columns that a premart reads, and its aggregates, which know them as c(name)."""
    kept = {m: F.col(m) for m in (*p.sums, *p.prices)} | ({p.dio: F.col(p.dio).cast("decimal(12,6)")} if p.weight else {})
    aggs = [F.sum(c(m)).alias(m) for m in p.sums]
    if p.weight:
        weight, days = F.sum(c(p.weight)), F.col(c(p.dio))
        aggs.append(F.when(weight > 0, F.sum(F.col(c(p.weight)).cast("decimal(24,6)") * days).cast("double") / weight.cast("double")).otherwise(F.sum(days).cast("double") / F.count(days)).alias(p.dio))
    for m in p.prices:
        aggs += [(F.sum(c(m)).cast("double") / F.count(c(m))).alias(m), F.min(c(m)).alias(f"min_{m}"), F.max(c(m)).alias(f"max_{m}")]
    return kept, aggs


def _premart(p: PremartPart, rows: DataFrame, grain: Sequence[str]) -> DataFrame:
    kept, aggs = _premart_sums(p)
    narrow = rows.select(*grain, p.member.cast("string").alias("__who"), *[v.alias(n) for n, v in kept.items()])
    before = F.lag("__who").over(Window.partitionBy(*grain).orderBy("__who"))
    new = F.col("__who").isNotNull() & ~before.eqNullSafe(F.col("__who"))
    return narrow.withColumn("__new", new).groupBy(*grain).agg(*aggs, F.count_if("__new").alias(p.count))


def dealt_premarts(parts: Sequence[PremartPart], grain: Sequence[str]) -> DataFrame:
    """What premarts gives, for facts that are dealt alike by a column of the grain (session.written_dealt, as_dealt): no row
    is dealt anew, and a row meets the sums of its own fact only. Each grain comes with the first fact that has it, which
    the later ones are joined to. Rows are sorted by the grain, whose first column should tell most of them apart."""
    out = []
    for i, p in enumerate(parts):
        rows = reduce(lambda r, q: r.join(q.rows.select(*grain), list(grain), "left_anti"), parts[:i], p.rows)
        out.append(reduce(lambda m, q: m.join(_premart(q, q.rows, grain), list(grain), "left"), parts[i + 1 :], _premart(p, rows, grain)))
    columns = [c for c in out[0].columns if c not in grain]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out).select(*grain, *columns)


def premarts(parts: Sequence[PremartPart], grain: Sequence[str]) -> DataFrame:
    """The premarts of several facts side by side, as drill_across of product_premart, inventory_premart and price_premart
    gives them, but with one shuffle: the narrow rows of all facts are dealt by the grain once and sorted by member, so
    that a member is counted where it differs from the row before, and no set of members is held. The grain has no nulls."""
    narrow, aggs = [], []
    for i, p in enumerate(parts):
        mine, c = F.col("__part") == i, lambda n, i=i: f"{n}__{i}"
        kept, sums = _premart_sums(p, c)
        narrow.append(p.rows.select(*grain, F.lit(i).alias("__part"), p.member.cast("string").alias("__who"), *[v.alias(c(n)) for n, v in kept.items()]))
        aggs += sums
        aggs.append(F.when(F.count_if(mine) > 0, F.count_if(mine & F.col("__new") & F.col("__who").isNotNull())).alias(p.count))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), narrow)
    member = F.struct("__part", "__who")
    before = F.lag(member).over(Window.partitionBy(*grain).orderBy("__part", "__who"))
    return union.repartition(*grain).withColumn("__new", ~before.eqNullSafe(member)).groupBy(*grain).agg(*aggs)


# checks

def reconcile(left: DataFrame, right: DataFrame, value_left: str, value_right: str, tolerance: float = 1e-4) -> DataFrame:
    """(left_total, right_total, ok) of two decimal columns."""
    a = left.agg(F.coalesce(F.sum(F.col(value_left)), F.lit(0)).cast("decimal(38,6)").alias("left_total"))
    b = right.agg(F.coalesce(F.sum(F.col(value_right)), F.lit(0)).cast("decimal(38,6)").alias("right_total"))
    return a.crossJoin(b).withColumn("ok", F.abs(F.col("left_total") - F.col("right_total")) <= tolerance)


def signed_waterfall_reconcile(long: DataFrame, grain: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """(left_total, right_total, left_local, right_local, ok): the signed amounts of all accounts with a rule against the
    operating profits of their waterfall, in the reporting and the local currency, each side in one pass."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,6)")
    a = long.agg(total("signed_reporting").alias("left_total"), total("signed").alias("left_local"))
    b = waterfall_rollup(long, grain, local="signed").agg(total("operating_profit").alias("right_total"), total("operating_profit_local").alias("right_local"))
    same = lambda x, y: F.abs(F.col(x) - F.col(y)) <= tolerance
    return a.crossJoin(b).select("left_total", "right_total", "left_local", "right_local", (same("left_total", "right_total") & same("left_local", "right_local")).alias("ok"))


def fanout_check(mart: DataFrame, fact: DataFrame, grain: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """(grain_unique, max_diff_<metric>..., ok): the mart against the fact aggregated anew."""
    twice = mart.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeats"))
    again = fact.groupBy(*grain).agg(*[F.sum(m).alias(f"f_{m}") for m in metrics])
    one = mart.groupBy(*grain).agg(*[F.sum(m).alias(f"m_{m}") for m in metrics])
    diff = one.join(again, list(grain), "full_outer").agg(*[F.max(F.abs(F.coalesce(f"m_{m}", F.lit(0)) - F.coalesce(f"f_{m}", F.lit(0)))).alias(f"max_diff_{m}") for m in metrics])
    ok = F.col("grain_unique")
    for m in metrics:
        ok = ok & (F.coalesce(f"max_diff_{m}", F.lit(0)) <= tolerance)
    return twice.select((F.col("repeats") == 0).alias("grain_unique")).crossJoin(diff).withColumn("ok", ok)


def same_by_grain(mart: DataFrame, facts: Sequence[tuple[DataFrame, Sequence[str]]], grain: Sequence[str], dealt: bool = False) -> bool:
    """Whether the mart is unique on the grain and has exactly the facts' sums in every grain; what fanout_check finds where
    this is true needn't be looked for.

    Without dealing rows by the grain: each metric is summed with a signed 60-bit hash of its row's grain as its weight, and
    such sums are equal on both sides if they are so grain by grain (and else by a chance of 1 in 2^60). Uniqueness is counted by
    64-bit hashes, or by the grain itself where the mart is dealt by a column of it. Metrics that a hundred trillion can't bound, or with over six decimals, sums that
    38 digits can't hold, and chance repeats of a hash give False.
    """
    weight = F.shiftright(F.xxhash64(*grain), 4).cast("decimal(18,0)")

    def weighed(df: DataFrame, metrics: Sequence[str]) -> list:
        kept = [(m, F.col(m).try_cast("decimal(20,6)")) for m in metrics]
        lost = reduce(lambda a, b: a | b, (F.col(m).isNotNull() & (v.isNull() | (v != F.col(m))) for m, v in kept))
        sums = [F.when(F.count(v) > 0, F.try_sum(v * F.col("__w"))).otherwise(0).alias(m) for m, v in kept]
        row = df.withColumn("__w", weight).agg(F.count_if(lost).alias("lost"), *sums).first()
        return [None] if row["lost"] or None in row else [*row][1:]

    if any((left := weighed(mart, metrics)) == [None] or left != weighed(fact, metrics) for fact, metrics in facts):
        return False
    key = grain if dealt else [F.xxhash64(*grain).alias("h")]
    return mart.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def price_check(mart: DataFrame, fact: DataFrame, grain: Sequence[str], prices: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """(grain_unique, max_diff_<price>..., strays, ok): the mart's mean prices against those of the fact, grain by grain.

    Strays are grains that have a price on one side only; means are never compared by their sums.
    """
    twice = mart.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeats"))
    again = fact.groupBy(*grain).agg(*[(F.sum(p).cast("double") / F.count(p)).alias(f"f_{p}") for p in prices])
    both = mart.select(*grain, *[F.col(p).cast("double").alias(f"m_{p}") for p in prices]).join(again, list(grain), "full_outer")
    stray = F.lit(False)
    for p in prices:
        stray = stray | (F.col(f"m_{p}").isNull() != F.col(f"f_{p}").isNull())
    diff = both.agg(F.count_if(stray).alias("strays"), *[F.coalesce(F.max(F.abs(F.col(f"m_{p}") - F.col(f"f_{p}"))), F.lit(0.0)).alias(f"max_diff_{p}") for p in prices])
    ok = F.col("grain_unique") & (F.col("strays") == 0)
    for p in prices:
        ok = ok & (F.col(f"max_diff_{p}") <= tolerance)
    return twice.select((F.col("repeats") == 0).alias("grain_unique")).crossJoin(diff).withColumn("ok", ok)


def unmapped_code_report(branches: Mapping[str, tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """(kind, period, code, currency, rows, impact): per branch its rows with the key -1 in a column, by raw code; the last item is the impact aggregate."""
    out = None
    for kind, (df, sk, code, impact) in branches.items():
        part = df.where(F.col(sk) == UNKNOWN_KEY).groupBy("period", business_key(F.col(code)).alias("code"), "currency").agg(F.count(F.lit(1)).alias("rows"), impact.cast("decimal(38,6)").alias("impact")).select(F.lit(kind).alias("kind"), "period", "code", "currency", "rows", "impact")
        out = part if out is None else out.unionByName(part)
    return out


def revenue_or_profit(revenue: str, profit: str) -> Column:
    """The sum of net revenue, or where that is 0 of the absolute operating profit, as an aggregate."""
    net = F.coalesce(F.sum(revenue), F.lit(0))
    return F.when(net != 0, net).otherwise(F.coalesce(F.sum(F.abs(F.col(profit))), F.lit(0)))


@dataclass(frozen=True)
class UnmappedBranch:
    """Where unmapped codes may be: rows with the key -1 in `sk`, and what they weigh in both currencies, as aggregates named by `basis`."""

    rows: DataFrame
    sk: str
    code: str
    local: Column
    reporting: Column
    basis: str


AUDIT = ("kind", "period", "code", "currency", "rows", "impact_local", "impact_reporting", "basis")


def unmapped_code_audit(branches: Mapping[str, UnmappedBranch], accounts: DataFrame | None = None) -> DataFrame:
    """(kind, period, code, currency, rows, impact_local, impact_reporting, basis) of the branches, by raw code (blank:
    UNKNOWN), and of the accounts that unmapped_account_amounts gives. Prices weigh by their mean, never by a sum."""
    parts = []
    for kind, b in branches.items():
        code = F.coalesce(F.nullif(business_key(F.col(b.code)), F.lit("")), F.lit("UNKNOWN"))
        six = lambda c: F.round(F.coalesce(c, F.lit(0)), 6).cast("decimal(38,6)")
        found = b.rows.where(F.col(b.sk) == UNKNOWN_KEY).groupBy("period", code.alias("code"), "currency")
        parts.append(found.agg(F.count(F.lit(1)).alias("rows"), six(b.local).alias("impact_local"), six(b.reporting).alias("impact_reporting")).select(F.lit(kind).alias("kind"), *AUDIT[1:-1], F.lit(b.basis).alias("basis")))
    if accounts is not None:
        parts.append(accounts.select(F.lit("pnl_account").alias("kind"), *AUDIT[1:-1], F.lit("raw account amount").alias("basis")))
    return reduce(DataFrame.unionByName, parts)


def unmapped_account_amounts(wide: DataFrame, accounts: Sequence[str], rules: DataFrame, rates: DataFrame, reporting: str) -> DataFrame | None:
    """(period, code, currency, rows, impact_local, impact_reporting) of the accounts without a rule, zeros included: raw
    amounts without a sign. All of them are summed in one pass and only the sums are turned into rows; None without any."""
    known = _entries(rules)
    lost = [a for a in accounts if a not in known]
    if not lost:
        return None
    raw = fx_convert(wide.withColumns({a: F.round(F.col(a).cast("decimal(18,6)"), 6) for a in lost}), rates, lost, reporting)
    sums = raw.groupBy("period", "currency").agg(F.count(F.lit(1)).alias("rows"), *[_line_total(F.sum(c)).alias(c) for a in lost for c in (a, f"{a}_reporting")])
    each = F.array(*[F.struct(F.lit(a).alias("code"), F.col(a).alias("impact_local"), F.col(f"{a}_reporting").alias("impact_reporting")) for a in lost])
    return sums.select("period", "currency", "rows", F.inline(each)).select("period", "code", "currency", "rows", "impact_local", "impact_reporting")


def unmapped_account_guard(long: DataFrame, allow: bool = False) -> DataFrame:
    """(account_code, rows, impact) of accounts without a rule and with money in them; raises on any unless allowed."""
    lost = long.where(F.col("statement_line").isNull()).groupBy("account_code").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.abs("amount")).alias("impact")).where("impact > 0")
    if not allow and (some := lost.limit(3).collect()):
        raise ValueError("accounts without a rule: " + ", ".join(r["account_code"] for r in some))
    return lost


#: How a measure may be summed: over all dimensions, over all but time, as a mean with weights, or not at all.
ADDITIVITY = ("ADDITIVE", "SEMI_ADDITIVE", "WEIGHTED", "NON_ADDITIVE")
_CLASS, _WEIGHT = "additivity", "weight"


def with_additivity(df: DataFrame, classes: Mapping[str, str | tuple[str, str]]) -> DataFrame:
    """df whose columns carry their class as metadata, which Parquet keeps."""
    made = {}
    for c, how in classes.items():
        name, weight = how if isinstance(how, tuple) else (how, None)
        if name not in ADDITIVITY or (name == "WEIGHTED") != (weight is not None):
            raise ValueError(f"unknown additivity of {c}: {how!r}")
        made[c] = {**df.schema[c].metadata, _CLASS: name, **({_WEIGHT: weight} if weight else {})}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=made[c]) if c in made else F.col(f"`{c}`") for c in df.columns])


def additivity_of(df: DataFrame) -> dict[str, str | tuple[str, str]]:
    """column -> class, of the columns that carry one."""
    found = {f.name: f.metadata for f in df.schema.fields if _CLASS in f.metadata}
    return {c: (m[_CLASS], m[_WEIGHT]) if _WEIGHT in m else m[_CLASS] for c, m in found.items()}


def additivity_safe_rollup(mart: DataFrame, keys: Sequence[str], period: str, classes: Mapping[str, str | tuple[str, str]] | None = None) -> DataFrame:
    """Roll a mart up over its periods. ADDITIVE sums; SEMI_ADDITIVE takes the latest period's sum; ("WEIGHTED", w) is
    recomputed as the w-weighted mean; NON_ADDITIVE is refused. The classes are those that the columns carry, unless given."""
    classes = additivity_of(mart) if classes is None else classes
    if not classes:
        raise ValueError("no additivity is known of any column")
    bad = [m for m, c in classes.items() if c == "NON_ADDITIVE"]
    if bad:
        raise ValueError(f"can't be rolled up over time: {bad}")
    per = mart.groupBy(*keys, period).agg(*[F.sum(m).alias(m) for m, c in classes.items() if not isinstance(c, tuple)], *[x for m, c in classes.items() if isinstance(c, tuple) for x in (F.sum(F.col(m) * F.col(c[1])).alias(f"{m}__n"), F.sum(c[1]).alias(f"{m}__w"))])
    aggs = []
    for m, c in classes.items():
        if isinstance(c, tuple):
            w = F.sum(f"{m}__w")
            aggs.append(F.when(w != 0, F.sum(f"{m}__n").cast("double") / w.cast("double")).alias(m))
        else:
            aggs.append((F.sum(m) if c == "ADDITIVE" else F.max_by(m, period)).alias(m))
    return per.groupBy(*keys).agg(*aggs)


def strict_base_lines(fact: DataFrame, lines: Mapping[str, Sequence[str]], rate: Column) -> DataFrame:
    """The strict row-wise variant: base lines are sums of account columns with fixed signs (costs and deductions
    negative), rounded to 2; reporting lines are converted from them, and totals are added up anew from either."""
    sign = {"GROSS_REVENUE": 1}
    out = fact
    for line in STATEMENT_LINES:
        total = None
        for a in lines.get(line, ()):
            total = F.col(a).cast("decimal(18,2)") if total is None else total + F.col(a).cast("decimal(18,2)")
        total = F.lit(0) if total is None else total
        local = F.round(total * sign.get(line, -1), 2).cast("decimal(20,2)")
        out = out.withColumn(f"{line.lower()}_local", local).withColumn(f"{line.lower()}_reporting", F.round(local * rate, 2).cast("decimal(20,2)"))
    for s in ("local", "reporting"):
        c = lambda x, s=s: F.col(f"{x}_{s}")
        out = out.withColumn(f"net_revenue_{s}", c("gross_revenue") + c("sales_deduction"))
        out = out.withColumn(f"gross_margin_{s}", c("net_revenue") + c("cogs"))
        out = out.withColumn(f"variable_cost_{s}", c("logistics_cost") + c("promotion_cost") + c("warranty_cost"))
        out = out.withColumn(f"contribution_margin_{s}", c("gross_margin") + c("variable_cost"))
        out = out.withColumn(f"operating_profit_{s}", c("contribution_margin") + c("fixed_sgna"))
    return out
