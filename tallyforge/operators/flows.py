"""The composite pipelines: both stars, the mart load and the period publisher, each from staged tables to checked output."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal as D
from functools import reduce
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.dates import normalize_period, period_from_name
from tallyforge.functions.money import fx_convert
from tallyforge.functions.text import business_key
from tallyforge.session import as_dealt, scratch_folder, written
from tallyforge.sources import landing, sinks
from tallyforge.sources.files import create_once, names, read_text
from tallyforge.sources.revisions import Part, Revision, Revisions, replaced

from . import filters, mart, periods, star

GRAIN = ["period", "entity", "product_sk", "product_code"]


@dataclass(frozen=True)
class StarResult:
    """The serving mart, its dimensions and facts, and one small table per check."""

    mart: DataFrame
    dims: Mapping[str, DataFrame]
    facts: Mapping[str, DataFrame]
    checks: Mapping[str, DataFrame]
    left_out: Mapping[str, Mapping[str, int]] = field(default_factory=dict)


def _registry(keys: DataFrame, key: str) -> DataFrame:
    empty = keys.sparkSession.createDataFrame([], "sk long, nk string")
    return star.assign_surrogate_keys(empty, keys.select(F.col(key).alias("nk")))


#: So many rows of a fact go to a bucket, at most where codes are spread evenly.
BUCKET_ROWS = 500_000


def _coded(fact: DataFrame, dim: DataFrame, code: str, sk: str, buckets: int | None = None) -> DataFrame:
    """fact with the member's key, -1 for an unmapped code, and the code normalised; dealt by the code into buckets where a number is given."""
    plain = fact.withColumn(code, business_key(F.col(code)))
    plain = plain.repartition(buckets, code) if buckets else plain
    return star.lookup_surrogate_left(plain, dim, code, code, "sk", sk, exact=True).withColumn(code, F.coalesce(F.nullif(F.col(code), F.lit("")), F.lit("UNKNOWN")))


def build_dimensions(customers: DataFrame, products: DataFrame, inventory: DataFrame, prices: DataFrame, rules: DataFrame, months: DataFrame) -> dict[str, DataFrame]:
    """The six dimensions: customers and products from their masters, warehouses and channels as found in the facts,
    accounts from their rules, and the months from the first to the last. All but accounts and months have UNKNOWN."""
    stock = star.inventory_source(inventory)
    offers = prices.withColumn("channel_name", F.col("channel_code"))
    return {
        "customer": star.build_dimension(customers, "customer_code", [c for c in customers.columns if c != "customer_code"], _registry(customers, "customer_code")),
        "product": star.build_dimension(products, "product_code", [c for c in products.columns if c != "product_code"], _registry(products, "product_code")),
        "warehouse": star.discovered_dimension(stock, "warehouse_code", "warehouse_name", _registry(stock, "warehouse_code")),
        "channel": star.discovered_dimension(offers, "channel_code", "channel_name", _registry(offers, "channel_code")),
        "account": rules.join(_registry(rules, "account_code").select(F.col("nk").alias("account_code"), F.col("sk").alias("account_sk")), "account_code"),
        "date": star.expand_calendar(months),
    }


def _unmapped_branches(facts: Mapping[str, DataFrame], price: str) -> dict[str, star.UnmappedBranch]:
    """Each code of a star's facts, with what its unmapped rows weigh: revenue or else profit, stock value, mean price."""
    pnl, stock, offers = star.with_results(facts["pnl"]), facts["inventory"], facts["price"]
    sales = (star.revenue_or_profit("net_revenue_local", "operating_profit_local"), star.revenue_or_profit("net_revenue", "operating_profit"), "net revenue or absolute operating profit")
    value = (F.sum("stock_value_local"), F.sum("stock_value"), "stock value")
    mean = (F.avg(f"{price}_local"), F.avg(price), "mean price")
    made = (("pnl", pnl, "customer", sales), ("pnl", pnl, "product", sales), ("inventory", stock, "product", value), ("inventory", stock, "warehouse", value), ("price", offers, "product", mean), ("price", offers, "channel", mean))
    return {f"{name}_{dim}": star.UnmappedBranch(df, f"{dim}_sk", f"{dim}_code", *weight) for name, df, dim, weight in made}


def tolerant_star(
    wide: DataFrame, inventory: DataFrame, prices: DataFrame, customers: DataFrame, products: DataFrame, rules: DataFrame, rates: DataFrame, *,
    entity: str, currencies: Sequence[str], reporting: str, accounts: Sequence[str], periods: str | None = None, allow_unmapped: bool = False, target: str | None = None,
) -> StarResult:
    """One entity's P&L, inventory and prices as a star, and the mart of all three on (period, entity, product).

    Rows of other entities and periods are left out and counted; a strange currency or period raises, as do money in
    accounts without a rule (unless allowed), a missing rate, repeated members, a fact that differs from the wide rows
    it was made of, and a mart that differs from its facts. Unmapped codes get the key -1 and keep their code; what they
    and the accounts without a rule weigh in both currencies is the check "unmapped". Facts are aggregated to the grain before they are joined. The
    facts and the mart are written once, in buckets of the product code, and read by the checks without a shuffle; with a
    target they are written there, and all tables are published as one bundle after the checks. All rows of a product go
    through one task.
    """
    spark = wide.sparkSession
    store = Revisions(spark, target or scratch_folder(spark))
    staged, left_out, parts = {}, {}, {}
    for name, df in (("pnl", wide), ("inventory", star.inventory_source(inventory)), ("price", prices)):
        mine, left_out[name] = filters.isolate_entity(df, entity, currencies, periods)
        staged[name] = mine.withColumns({c: F.upper(F.trim(c)) for c in ("entity", "currency")})
    buckets = max(spark.sparkContext.defaultParallelism, *(-(-n["kept"] // BUCKET_ROWS) for n in left_out.values()))
    rates = written(rates)
    dims = {}

    def keep(name: str, df: DataFrame) -> None:
        parts[f"dim_{name}"] = store.write(f"dim_{name}", df)
        dims[name] = store.read_part(f"dim_{name}", parts[f"dim_{name}"])

    def dealt(name: str, df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        with as_dealt(spark, buckets):
            parts[name], rows = store.write_dealt(name, df, "product_code", buckets, order)
        return rows

    for name, d in build_dimensions(customers, products, staged["inventory"], staged["price"], rules, staged["pnl"]).items():
        if name != "date":  # its months are read from the facts
            keep(name, d)
    star.unmapped_wide_accounts(staged["pnl"], accounts, rules, allow_unmapped)
    # codes first: raw rows are narrower in the shuffles than those with lines and both currencies
    pnl = _coded(_coded(staged["pnl"], dims["customer"], "customer_code", "customer_sk"), dims["product"], "product_code", "product_sk", buckets)
    pnl = star.with_results(star.wide_lines(pnl, accounts, rules, rates, reporting, local=True), "_local")
    inv = _coded(_coded(staged["inventory"], dims["warehouse"], "warehouse_code", "warehouse_sk"), dims["product"], "product_code", "product_sk", buckets)
    inv = fx_convert(inv, rates, ["value", "cost"], reporting)
    offer = [c for c in prices.columns if c.endswith("_price")]
    price = _coded(_coded(staged["price"], dims["channel"], "channel_code", "channel_sk"), dims["product"], "product_code", "product_sk", buckets)
    price = fx_convert(price, rates, offer, reporting)
    lines, keys = [x.lower() for x in star.STATEMENT_LINES], ["product_code", "product_sk", "period", "entity"]
    facts = {
        "pnl": dealt("fact_pnl", pnl.select("period", "entity", "customer_sk", "customer_code", "product_sk", "product_code", "currency", "qty", *lines, "net_revenue_local", "operating_profit_local"), [*keys, "customer_code"]),
        "inventory": dealt("fact_inventory", inv.select("period", "entity", "warehouse_sk", "warehouse_code", "product_sk", "product_code", "currency", F.col("qty").cast("decimal(18,6)").alias("stock_qty"), F.col("value").cast("decimal(38,6)").alias("stock_value_local"), F.col("value_reporting").alias("stock_value"), F.col("cost_reporting").alias("stock_cost"), "dio"), [*keys, "warehouse_code"]),
        "price": dealt("fact_price", price.select("period", "entity", "channel_sk", "channel_code", "product_sk", "product_code", "currency", *[x for p in offer for x in (F.col(p).cast("decimal(38,6)").alias(f"{p}_local"), F.col(f"{p}_reporting").alias(p))]), [*keys, "channel_code"]),
    }
    keep("date", star.expand_calendar(reduce(DataFrame.unionByName, (f.select("period") for f in facts.values()))))
    stock = ["stock_value", "stock_qty", "stock_cost"]
    premarts = [
        star.PremartPart(facts["pnl"], "customers", star.customer("customer_sk", "customer_code"), [*lines, "qty"]),
        star.PremartPart(facts["inventory"], "warehouses", F.col("warehouse_code"), stock, weight="stock_value"),
        star.PremartPart(facts["price"], "channels", F.col("channel_code"), prices=offer),
    ]
    made = star.dealt_premarts(premarts, keys)
    full = star.with_results(made)
    results = [c for c in full.columns if c not in made.columns]
    zero = [*lines, "qty", "customers", *results, *stock, "warehouses"]
    mart_rows = full.select(*GRAIN, *zero[:-1], "dio", "warehouses", *[x for p in offer for x in (p, f"min_{p}", f"max_{p}")], "channels").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    out = dealt("mart", mart_rows)  # sorted as it is
    checks = {
        "fanout": star.fanout_check(out, facts["pnl"], GRAIN, [*lines, "qty"]),
        "stock": star.fanout_check(out, facts["inventory"], GRAIN, ["stock_qty", "stock_value", "stock_cost"]),
        "price": star.price_check(out, facts["price"], GRAIN, offer),
        "profit": star.reconcile(star.with_results(facts["pnl"]), out, "operating_profit", "operating_profit"),
        "members": star.dimension_uniqueness(dims["product"].where("sk <> -1"), "sk", "product_code").unionByName(star.dimension_uniqueness(dims["customer"].where("sk <> -1"), "sk", "customer_code")),
        "wide_long": star.reconcile(staged["pnl"].select(star.signed_total(accounts, rules).alias("signed")), facts["pnl"], "signed", "operating_profit_local"),
        "unmapped": star.unmapped_code_audit(_unmapped_branches(facts, offer[0]), star.unmapped_account_amounts(staged["pnl"], accounts, rules, rates, reporting)),
    }
    with as_dealt(spark, buckets):
        same = star.same_by_grain(out, [(facts["pnl"], [*lines, "qty"]), (facts["inventory"], stock)], GRAIN, dealt=True)  # else the checks say where
        for name in ("members", "wide_long", *(() if same else ("fanout", "stock")), "price", "profit"):
            if not checks[name].where("NOT ok").isEmpty():
                raise ValueError(f"the mart's check failed: {name}")
    if target:
        sinks.export_bundle({"unmapped": checks["unmapped"]}, target, parts)
    return StarResult(out, dims, facts, checks, left_out)


def strict_star(
    wide: DataFrame, dims: Mapping[str, tuple[DataFrame, str]], rates: DataFrame, lines: Mapping[str, Sequence[str]], errors: str | None = None, *,
    entity: str | None = None, currencies: Sequence[str] = (), periods: str | None = None, target: str | None = None,
) -> DataFrame:
    """The strict star's one big table. dims: code column -> (dimension with sk, its key column).

    With an entity, only its rows of the allowed periods count, and a strange currency or period raises. Codes without a
    member raise before anything is joined (all of them are written to `errors`), as do periods and currencies without
    a rate; then the fact is joined with each dimension on the inside and with its rate, and the statement lines are
    worked out row by row. With a target the table is published there as its next version.
    """
    mine = filters.isolate_entity(wide, entity, currencies, periods)[0] if entity else wide
    coded = mine.withColumns({c: business_key(F.col(c)) for c in dims})
    star.fk_anti_join_failfast(coded, dims, errors)
    known = rates.where("rate IS NOT NULL").select("period", "currency")
    if lost := coded.select("period", "currency").distinct().join(known, ["period", "currency"], "left_anti").orderBy("period", "currency").limit(5).collect():
        raise ValueError("no exchange rate: " + ", ".join(f"{r['period']} {r['currency']}" for r in lost))
    out = coded
    for c, (dim, key) in dims.items():
        out = out.join(dim.withColumnsRenamed({"sk": f"{c}_sk", key: c}), c, "inner")
    out = star.strict_base_lines(out.join(rates, ["period", "currency"]), lines, F.col("rate"))
    if not target:
        return out
    store = Revisions(wide.sparkSession, target)
    sinks.export_bundle({"table": out}, target)
    return store.read("table", store.current())


@dataclass(frozen=True)
class MartLoad:
    """A mart at a revision: the keyed fact, its dimensions, and the fact with their attributes."""

    store: Revisions
    at: Revision
    changed: bool
    model: mart.MartModel

    @property
    def revision(self) -> int:
        return self.at.number

    @property
    def keyed(self) -> DataFrame:
        return self.store.read("fact", self.at)

    @property
    def dims(self) -> dict[str, DataFrame]:
        return {d.name: self.store.read(f"dim_{d.name}", self.at) for d in self.model.dimensions}

    @property
    def fact(self) -> DataFrame:
        return mart_star(self.store, self.at, self.model)

    @property
    def controls(self) -> DataFrame:
        """(scope..., rows, sum_<measure>...) of every scope, as they were when it was loaded."""
        sums = [f"sum_{m.column}" for m in self.model.measures]
        rows = [(*json.loads(k), c["rows"], *(D(c["sums"][n]) for n in sums)) for k, c in self.at.details["scopes"].items()]
        schema = ", ".join([*(f"`{c}` string" for c in self.model.scope), "rows long", *(f"`{n}` decimal(38,{m.scale})" for n, m in zip(sums, self.model.measures, strict=True))])
        return self.store.spark.createDataFrame(rows, schema)


def mart_star(store: Revisions, at: Revision, model: mart.MartModel, only: Sequence[str] | None = None) -> DataFrame:
    """The fact at a revision, or some of its scopes, with the keys and attributes of its dimensions as of that revision."""
    out = store.read("fact", at, only)
    dims = {}
    for d in model.dimensions:
        wanted = [c for c in dict.fromkeys([*d.keys, *d.attributes]) if c not in out.columns and not any(c in x.columns for x in dims.values())]
        dims[f"{d.name}_sk"] = store.read(f"dim_{d.name}", at).select(F.col("sk").alias(f"{d.name}_sk"), *wanted)
    return mart.star_rejoin(out, dims)


def load_mart(df: DataFrame, model: mart.MartModel, target: str, seq: str | None = None, source: str | None = None) -> MartLoad:
    """Load whole scopes into the mart in the folder `target`, as one new revision of its fact, dimensions and controls.

    The rows are validated while they are staged. A scope whose content equals what it was loaded from is left alone,
    and a load of such scopes only makes no revision. Members are merged by authority (see merge_members) and the fact
    keeps their numbers. What was written is counted again and held against the stage; only then the revision is
    created. A load that is refused, dies or finds a newer revision leaves the mart as it was. Replaced rows stay in the
    earlier revision (see archived_rows). Another model, another period form, and for a `source` column another set of
    files for a scope that came from several, are refused. Scopes are held on the driver, some hundred bytes each.
    """
    spark, scope, measures = df.sparkSession, model.scope, [m.column for m in model.measures]
    store = Revisions(spark, target)
    base = store.current()
    known: dict[str, dict] = base.details.get("scopes", {})
    if base.number and base.details["model"] != mart.model_text(model):
        raise ValueError("the mart has another model; load it into a new folder")
    stage = staged_rows(df, model, seq, {base.details.get("period_form")} - {None})
    files = {}
    if source:
        files = {_scope_key(r, scope): sorted(r["files"]) for r in stage.groupBy(*scope).agg(F.collect_set(source).alias("files")).collect()}
        stage = stage.drop(source)
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(f"sum_{m}") for m in measures]
    prints = stage.groupBy(*scope).agg(F.count(F.lit(1)).alias("rows"), *sums, *periods.fingerprint_sums([c for c in stage.columns if c not in scope]))
    staged = {_scope_key(r, scope): _control(r, measures) | {"h1": str(r["h1"]), "h2": str(r["h2"])} for r in prints.collect()}  # one row a scope
    if not staged:
        raise ValueError("no rows to load")
    for key, mine in files.items():
        theirs = known.get(key, {}).get("files", [])
        if key in known and max(len(mine), len(theirs)) > 1 and mine != theirs:
            raise ValueError(f"the files of scope {key} were {theirs}, now {mine}")
        staged[key]["files"] = mine
    fresh = [k for k, v in staged.items() if {n: v[n] for n in ("rows", "h1", "h2")} != {n: known.get(k, {}).get(n) for n in ("rows", "h1", "h2")}]
    if not fresh:
        return MartLoad(store, base, False, model)
    if len(fresh) < len(staged):
        few = spark.createDataFrame([tuple(json.loads(k)) for k in fresh], ", ".join(f"`{c}` string" for c in scope))
        near = stage.where(F.col(model.period).isin(sorted({json.loads(k)[0] for k in fresh})))  # a plain filter passes most rows over before they meet the scopes
        stage = written(near.join(F.broadcast(few), scope, "left_semi"))  # read several times from now on
    parts, keyed = {}, stage
    for d in model.dimensions:
        old = store.read(f"dim_{d.name}", base) if base.number else None
        merged, audit = merge_members(stage, old, d, model.duplicates != "sum")
        parts[f"dim_{d.name}"] = store.write(f"dim_{d.name}", merged)
        parts[f"audit_{d.name}"] = store.write(f"audit_{d.name}", audit)
        keyed = mart.member_keys(keyed, store.read_part(f"dim_{d.name}", parts[f"dim_{d.name}"]), d.keys, f"{d.name}_sk")
    spare = {c for d in model.dimensions for c in (*d.keys, *d.attributes)} - {*scope, *model.row_key, *measures}
    part = store.write("fact", keyed.drop(*spare), scope)
    again = {_scope_key(r, scope): _control(r, measures) for r in mart.scope_controls(store.read_part("fact", part), scope, measures).collect()}
    if again != {k: {n: staged[k][n] for n in ("rows", "sums")} for k in fresh}:
        raise RuntimeError("the written scopes differ from their source; the mart is as it was")
    parts["fact"] = replaced(base.parts.get("fact"), part)
    details = {
        "model": mart.model_text(model), "period_form": len(json.loads(fresh[0])[0]), "scopes": {**known, **{k: staged[k] for k in fresh}},
        "loaded": {"scopes": len(fresh), "rows": sum(staged[k]["rows"] for k in fresh)},
    }
    return MartLoad(store, store.commit(base, parts, details), True, model)


def _scope_key(row, scope: Sequence[str]) -> str:
    return json.dumps([str(row[c]) for c in scope], ensure_ascii=False)


def _control(row, measures: Sequence[str]) -> dict:
    return {"rows": row["rows"], "sums": {f"sum_{m}": str(row[f"sum_{m}"].normalize()) for m in measures}}


def staged_rows(df: DataFrame, model: mart.MartModel, seq: str | None, forms: set[int]) -> DataFrame:
    """The rows with typed measures, written; blank scopes and keys, inexact measures and odd periods are counted on the way
    and raise, as do repeated row keys where they aren't summed."""
    blank = lambda cs: reduce(lambda a, b: a | b, (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in cs), F.lit(False))
    form = mart.period_form(F.col(model.period))
    made = {m.column: F.struct(mart.decimal_lossless(F.col(m.column), m.precision, m.scale).alias("exact"), mart.exact_measure(m).alias("value")) for m in model.measures}
    typed = df.withColumns({**made, **{c: F.col(c).cast("string") for c in model.scope}, "__form": form})
    inexact = reduce(lambda a, b: a | b, (~F.col(f"{c}.exact") for c in made), F.lit(False))
    seen = Observation()
    counted = typed.observe(
        seen, F.count_if(blank(model.scope)).alias("blank_scope"), F.count_if(blank(model.row_key)).alias("blank_key"), F.count_if(inexact).alias("inexact"),
        F.count_if(~blank([model.period]) & F.col("__form").isNull()).alias("odd_periods"), F.min("__form").alias("shortest"), F.max("__form").alias("longest"),
    )
    stage = counted.withColumns({c: F.col(f"{c}.value") for c in made}).drop("__form")
    measures = [m.column for m in model.measures]
    if model.duplicates == "sum":
        stage = mart.collapse_duplicate_grain(stage, [*model.scope, *model.row_key], measures, seq)
    stage = written(stage.drop(seq) if seq in stage.columns else stage)
    got = seen.get
    faults = {k: got[k] for k in ("blank_scope", "blank_key", "inexact", "odd_periods") if got[k]}
    if model.duplicates != "sum" and (n := stage.groupBy(*model.scope, *model.row_key).count().where("count > 1").count()):
        faults["repeated_keys"] = n
    if faults:
        raise ValueError(f"rows that can't be loaded: {faults}")
    if len(forms | {got["shortest"], got["longest"]} - {None}) > 1:
        raise ValueError("periods of unlike forms")
    return stage


def merge_members(stage: DataFrame, old: DataFrame | None, d: mart.Dimension, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(dimension, replaced versions) after a load's members: new ones get numbers, attributes of strictly higher authority win.

    Authorities are texts of one length, in the dimension too; a dimension without an authority column has one authority.
    If strict, unlike attributes of a member under one authority raise, staged ones and against the dimension's; else
    the greatest ones are taken.
    """
    nk = F.to_json(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in d.keys]))
    authority = F.coalesce(F.col(d.authority).cast("string"), F.lit("")) if d.authority else F.lit("")
    attributes = list(dict.fromkeys([*d.keys, *d.attributes]))
    members = written(stage.select(authority.alias("authority"), *attributes).distinct().select(nk.alias("nk"), "authority", *attributes))
    if old is None:
        old = members.limit(0).select(F.lit(0).cast("long").alias("sk"), "*")
    if d.authority:
        sizes = lambda t: t.select(F.length("authority").alias("n")).distinct()
        if len(found := sizes(members).unionByName(sizes(old)).distinct().limit(2).collect()) > 1:
            raise ValueError(f"{d.name}: authorities of unlike forms ({', '.join(str(r[0]) for r in found)} characters)")
    if strict:
        both = members.unionByName(old.select("nk", "authority", *attributes))
        if some := star.conflicting_attributes(both, "nk", "authority", attributes).limit(3).collect():
            raise ValueError(f"{d.name}: unlike attributes under one authority: {[r['nk'] for r in some]}")
    return star.merge_dimension_type1(old, members, "nk", attributes, "authority")


def mart_history(store: Revisions) -> DataFrame:
    """(revision, scopes, rows) of each load."""
    entries = [store.revision(n) for n in store.numbers()]
    return store.spark.createDataFrame([(e.number, e.details["loaded"]["scopes"], e.details["loaded"]["rows"]) for e in entries], "revision long, scopes long, rows long")


def archived_rows(store: Revisions, number: int, model: mart.MartModel) -> DataFrame:
    """The rows that a revision replaced, with their members' attributes as they were, and replaced_by.

    Their counts and sums are held against the controls of the time, and raise where they differ.
    """
    before, after = store.revision(number - 1) if number > 1 else Revision(0), store.revision(number)
    if "fact" not in before.parts:
        return mart_star(store, after, model, ()).withColumn("replaced_by", F.lit(number).cast("long"))
    now = after.parts["fact"].folders
    gone = [k for k, v in before.parts["fact"].folders.items() if now.get(k) != v]
    rows = mart_star(store, before, model, gone)
    measures = [m.column for m in model.measures]
    found = {_scope_key(r, model.scope): _control(r, measures) for r in mart.scope_controls(rows, model.scope, measures).collect()}
    if wrong := [k for k, v in found.items() if v != {n: before.details["scopes"][k][n] for n in ("rows", "sums")}] or len(found) != len(gone):
        raise RuntimeError(f"archived scopes differ from their controls: {wrong}")
    return rows.withColumn("replaced_by", F.lit(number).cast("long"))


def mart_matches(store: Revisions, at: Revision, model: mart.MartModel) -> bool:
    """Whether the fact of a revision still has the counts and sums that its scopes were loaded with."""
    measures = [m.column for m in model.measures]
    found = {_scope_key(r, model.scope): _control(r, measures) for r in mart.scope_controls(store.read("fact", at), model.scope, measures).collect()}
    return found == {k: {n: v[n] for n in ("rows", "sums")} for k, v in at.details["scopes"].items()}


def export_mart(load: MartLoad, folder: str, name: str, df: DataFrame | None = None) -> dict:
    """A candidate for publication: the mart's star, or a table made of it, with the revision and model it comes from."""
    meta = {"revision": load.revision, "model_sha256": sha256(mart.model_text(load.model).encode()).hexdigest()}
    return sinks.export_candidate(load.fact if df is None else df, folder, name, meta)


def approve_export(load: MartLoad, folder: str, name: str, reviewer: str) -> dict:
    """Approve a candidate once: of the mart's current revision, with the mart reconciled and the candidate unchanged."""
    if not reviewer.strip():
        raise ValueError("an approval needs a reviewer")
    store, manifest = load.store, sinks.read_candidate(load.store.spark, folder, name)
    now = store.current()
    if not mart_matches(store, now, load.model):
        raise ValueError("the mart differs from its controls")
    _check_candidate(now, manifest)
    approval = {"reviewer": reviewer, "revision": now.number, "manifest_sha256": manifest["sha256"]}
    if not create_once(store.spark, f"{folder}/candidate={name}/approval.json", json.dumps(approval, ensure_ascii=False, sort_keys=True)):
        raise FileExistsError(f"{name} is approved already")
    return approval


def _check_candidate(now: Revision, manifest: Mapping) -> None:
    if manifest["revision"] != now.number:
        raise PermissionError(f"the candidate is of revision {manifest['revision']}, the mart has {now.number}")
    if manifest["model_sha256"] != sha256(now.details["model"].encode()).hexdigest():
        raise PermissionError("the mart's model has changed")


def publish_export(load: MartLoad, folder: str, name: str, destination: str, seen: int = 0) -> Revision:
    """Publish an approved candidate as the destination's next version, if that still has the version `seen` (0: none)
    with the content it was published with, and the approval is for this candidate and the mart's current revision."""
    spark, now = load.store.spark, load.store.current()
    manifest = sinks.read_candidate(spark, folder, name)
    path = f"{folder}/candidate={name}"
    if "approval.json" not in names(spark, path):
        raise PermissionError(f"{name} isn't approved")
    approval = json.loads(read_text(spark, f"{path}/approval.json"))
    if approval["manifest_sha256"] != manifest["sha256"]:
        raise PermissionError("the approval is for another candidate")
    _check_candidate(now, manifest)
    if approval["revision"] != now.number:
        raise PermissionError("the approval is stale")
    return sinks.publish_next(spark, destination, spark.read.parquet(manifest["path"]), seen, {"candidate": name, "reviewer": approval["reviewer"], "mart_revision": now.number})


_FILES = "file string, hash string, period string"


@dataclass(frozen=True)
class PeriodLoad:
    """An inspected load, written but in no revision yet: the dataset as it would be, and what was found in it.

    rows, files and metrics are the store's tables as they would be; incoming has the folders of the new rows.
    """

    store: Revisions
    base: Revision
    parts: Mapping[str, Part]
    incoming: Part
    snapshot: DataFrame
    targets: Sequence[str]
    files: DataFrame
    totals: Sequence[str]

    @property
    def after(self) -> DataFrame:
        return self.store.read_part("rows", self.parts["rows"])


def loaded_files(store: Revisions, at: Revision | None = None) -> DataFrame:
    """(file, hash, period) of the loads that make up a store's rows."""
    at = at or store.current()
    return store.read("files", at) if "files" in at.parts else store.spark.createDataFrame([], _FILES)


def inspect_load(rows: DataFrame, store: Revisions, keys: Sequence[str], totals: Sequence[str], headers: DataFrame | None = None, required: Sequence[str] = (), baseline: Sequence[str] | None = None, period: str = "period") -> PeriodLoad:
    """From the rows of a folder's files (file, hash, period, ...) to an inspected dataset, ready for approval.

    Periods of any form are normalised first; a file without one takes the period of its name, and text that is no
    period stays, so that the inspection finds it. headers (file, header) has each file's own columns: a file that lacks
    a required one raises (another order doesn't matter, rows are matched by name), as do several new files of one
    period. The periods of changed files, now and before, are closed over files that share a period; a period that lost
    one of its several files raises. All rows of the files in these periods replace what the periods held, also where
    that leaves none. Only the new rows are inspected and written; the others keep their folders and metrics.
    """
    spark, base = store.spark, store.current()
    if (required or baseline) and headers is None:
        raise ValueError("required columns can be checked only against the files' headers")
    history = loaded_files(store, base)
    raw, norm = F.col(period).cast("string"), normalize_period(F.col(period))
    nameless = rows.groupBy("file").agg(F.max(norm).alias("__p")).where("__p IS NULL").select("file", period_from_name(F.col("file")).alias("__name"))
    staged = written(rows.join(nameless, "file", "left").withColumn(period, F.coalesce(norm, F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", F.col("__name")), raw)).drop("__name"))
    pairs = staged.select("file", "hash", normalize_period(F.col(period)).alias("period")).distinct()
    listed = written(pairs.join(headers.select("file", "header"), "file", "full_outer") if headers is not None else pairs.withColumn("header", F.array().cast("array<string>")))
    state = written(landing.scan_incoming_folder(listed, history, baseline=baseline, required=required if headers is not None else ()))
    if not (odd := state.where("header_state IN ('empty', 'missing_columns') OR status = 'conflict'")).isEmpty():
        raise ValueError(f"files that can't be loaded: {[tuple(r) for r in odd.select('file', 'period', 'header_state', 'status').limit(5).collect()]}")
    changed = state.where("status <> 'unchanged'").select("file").distinct()
    now = state.where("period IS NOT NULL").select("file", "period").distinct()
    before = history.select("file", "period").distinct()
    targets = periods.target_period_closure(now, before, changed)
    if not (gone := periods.half_period_guard(now, before, targets)).isEmpty():
        raise ValueError(f"periods that lost a file: {[tuple(r) for r in gone.limit(5).collect()]}")
    wanted = sorted(r[0] for r in targets.collect())  # periods are months: few, whatever the data
    used = now.join(targets, "period", "left_semi").select("file").unionByName(changed).distinct()
    incoming = store.write("rows", staged.join(F.broadcast(used), "file", "left_semi").drop("file", "hash"), [period])
    fresh = store.read_part("rows", incoming)
    if incoming.folders and not (found := periods.inspect_dataset(fresh, period, keys, totals).first())["is_valid"]:
        raise ValueError(f"the dataset isn't valid: {found.asDict()}")
    part = replaced(base.parts.get("rows"), incoming, [f"{period}={t}" for t in wanted])
    if not part.folders:
        raise ValueError("the dataset isn't valid: it has no rows")
    files = state.join(F.broadcast(used), "file", "left_semi").where("period IS NOT NULL").select("file", "hash", "period").distinct()
    kept = history.join(targets, "period", "left_anti").select("file", "hash", "period")
    parts = {"rows": part, "files": store.write("files", kept.unionByName(files)), "metrics": store.write("metrics", _metrics(store, base, fresh, period, totals, targets))}
    return PeriodLoad(store, base, parts, incoming, written(periods.snapshot_of_metrics(store.read_part("metrics", parts["metrics"]), totals)), wanted, files, tuple(totals))


def _metrics(store: Revisions, base: Revision, fresh: DataFrame, period: str, totals: Sequence[str], targets: DataFrame) -> DataFrame:
    """Metrics of each period after a load: those of the new rows, and the old ones of the periods that stay."""
    new = periods.load_metrics(fresh, period, totals)
    if "metrics" not in base.parts:
        return new
    old = store.read("metrics", base)
    if set(old.columns) != set(new.columns):
        raise ValueError("the totals differ from those that the store keeps")
    return periods.replace_rows(old, new, "period", targets)


def inspect_folder(spark: SparkSession, path: str, store: Revisions, keys: Sequence[str], totals: Sequence[str], period: str = "period", pattern: str = "*.csv", delimiter: str = ",", encoding: str = "utf-8", baseline: Sequence[str] | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), every: bool = False) -> PeriodLoad:
    """inspect_load of a folder's files, chosen by the keywords of their names: hashes, headers and rows are read from them."""
    files = landing.chosen(landing.profile_landing_files(spark, path, pattern), include, exclude, every).collect()  # one row a file
    if not files:
        raise ValueError("no files to load")
    if empty := [f["path"] for f in files if not f["size"]]:
        raise ValueError(f"empty files: {empty[:5]}")
    paths = [f["path"] for f in files]
    hashes = spark.createDataFrame([(f["path"], f["sha256"]) for f in files], "file string, hash string")
    headers = written(landing.file_headers(spark, paths, delimiter, encoding).select("file", landing.clean_header(F.col("names")).alias("header")))
    rows = landing.scan_delimited_text(spark, paths, delimiter, encoding, multiline=True, file="file")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in (period, *keys, *totals) if c not in rows.columns})
    rows = rows.join(F.broadcast(hashes), "file")
    return inspect_load(rows, store, keys, totals, headers, [period, *keys, *totals], baseline, period)


def publish_load(load: PeriodLoad, approved: DataFrame) -> Revision:
    """Make an inspected load the store's next revision, if its rows still are what was approved and the store hasn't changed.

    The new rows are read again; those of other periods are in folders that never change. Rows, files and metrics become
    current together; a refused or a stale load leaves the store as it was.
    """
    store, totals = load.store, load.totals
    fresh = store.read_part("rows", load.incoming)
    period = next(iter(load.parts["rows"].folders)).partition("=")[0]
    targets = store.spark.createDataFrame([(t,) for t in load.targets], "period string")
    now = periods.snapshot_of_metrics(_metrics(store, load.base, fresh, period, totals, targets), totals)
    if not periods.approval_gate(now, approved, totals).first()["approved"]:
        raise PermissionError("the snapshot isn't approved")
    done = now.first()
    return store.commit(load.base, load.parts, {"rows": done["rows"], "first_period": done["first_period"], "last_period": done["last_period"], "targets": list(load.targets)})


def inspection_snapshot(df: DataFrame, totals: Sequence[str], period: str = "period") -> DataFrame:
    """One row, written: summary metrics and the content's fingerprint."""
    return written(periods.snapshot_of_metrics(periods.load_metrics(df, period, totals), totals))
