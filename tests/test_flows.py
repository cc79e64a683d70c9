"""The composite pipelines on small tables: what they refuse, what they leave alone, and what they keep."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import aggregate, flows, mapping, mart, periods, ranges, star
from tallyforge.operators.filters import Condition, Rule
from tallyforge.session import scratch_folder
from tallyforge.sources.revisions import Revisions, StaleRevision


@pytest.fixture
def staged(spark):
    wide = spark.createDataFrame(
        [("2026-01", "pl", "c1", "p1", "PLN", 2, D("100"), D("10"), D("1")), ("2026-01", "PL", "c9", "P1 ", "EUR", 1, D("50"), D("0"), D("2")), ("2026-02", "PL", "c1", "new", "PLN", 3, D("7"), D("1"), D("3")), ("2026-01", "DE", "c1", "p1", "XXX", 9, D("9"), D("9"), D("9"))],
        "period string, entity string, customer_code string, product_code string, currency string, qty int, REV decimal(18,6), DED decimal(18,6), TOTAL decimal(18,6)",
    )
    inv = spark.createDataFrame([("2026-01", "PL", "w1", "p1", "PLN", 5, D("30"), D("10"), D("2")), ("2026-01", "PL", "w2", "p1", "PLN", 5, D("10"), D("30"), D("2"))], "period string, entity_code string, warehouse string, product_code string, currency_code string, ending_qty int, inventory_val decimal(18,6), dio decimal(12,6), logistics_cost decimal(18,6)")
    prices = spark.createDataFrame([("2026-01", "PL", "web", "p1", "PLN", D("10")), ("2026-01", "PL", "shop", "p1", "PLN", D("20"))], "period string, entity string, channel_code string, product_code string, currency string, our_price decimal(18,6)")
    customers = spark.createDataFrame([("c1", "One")], "customer_code string, customer_name string")
    products = spark.createDataFrame([("p1", "Pen")], "product_code string, product_name string")
    rules = spark.createDataFrame([("REV", "GROSS_REVENUE", 1), ("DED", "SALES_DEDUCTION", -1), ("TOTAL", "SUBTOTAL_IGNORED", 1)], "account_code string, statement_line string, sign_multiplier int")
    rates = spark.createDataFrame([("2026-01", "EUR", D("4.5"))], "period string, currency string, rate decimal(18,8)")
    return [wide, inv, prices, customers, products, rules, rates]


ARGS = {"entity": "PL", "currencies": ["PLN", "EUR"], "reporting": "PLN", "accounts": ["REV", "DED", "TOTAL"]}


def test_tolerant_star(spark, staged):
    target = scratch_folder(spark)
    got = flows.tolerant_star(*staged, **ARGS, target=target)
    rows = {(r["period"], r["product_code"]): r for r in got.mart.collect()}
    assert set(rows) == {("2026-01", "P1"), ("2026-02", "NEW")}
    one, new = rows["2026-01", "P1"], rows["2026-02", "NEW"]
    assert (one["gross_revenue"], one["net_revenue"], one["operating_profit"], one["customers"]) == (D(325), D(315), D(315), 2)
    assert (one["stock_value"], one["dio"], one["warehouses"], one["our_price"], one["channels"]) == (D(40), 15.0, 2, 15.0, 2)
    assert new["product_sk"] == -1 and new["net_revenue"] == D(6) and new["stock_value"] == 0 and new["our_price"] is None
    assert got.left_out["pnl"]["other_entity"] == 1
    assert {(r["kind"], r["code"]) for r in got.checks["unmapped"].collect()} == {("pnl_customer", "C9"), ("pnl_product", "NEW")}
    assert set(got.dims) == {"customer", "product", "warehouse", "channel", "account", "date"}
    assert all(r["ok"] for r in got.checks["fanout"].collect() + got.checks["profit"].collect() + got.checks["stock"].collect())


def test_a_star_is_published_from_where_its_checks_have_read_it(spark, staged):
    target = scratch_folder(spark)
    got = flows.tolerant_star(*staged, **ARGS, target=target)
    tables = {**{f"fact_{k}": v for k, v in got.facts.items()}, **{f"dim_{k}": v for k, v in got.dims.items()}, "mart": got.mart}
    store = Revisions(spark, target)
    assert set(store.current().parts) == {*tables, "unmapped"}
    for name, df in tables.items():
        published = store.read(name, store.current())
        assert sorted(published.inputFiles()) == sorted(df.inputFiles()) and sorted(map(repr, published.collect())) == sorted(map(repr, df.select(*published.columns).collect()))


def test_unmapped_audit_of_a_star(spark, staged):
    wide, inv, prices, customers, products, rules, rates = staged
    free = wide.withColumn("REV", F.when(F.col("product_code") == "new", D("1")).otherwise(F.col("REV")))  # DED is 1 too: no net revenue
    costs = spark.createDataFrame([("TOTAL", "COGS", -1)], rules.schema)
    inv = inv.unionByName(inv.limit(1).withColumns({"product_code": F.lit("gone"), "warehouse": F.lit(" ")}))
    prices = prices.unionByName(prices.withColumn("product_code", F.lit("gone")))
    got = flows.tolerant_star(free.withColumn("MISC", F.lit(0).cast("decimal(18,6)") + F.col("qty")), inv, prices, customers, products, rules.where("account_code <> 'TOTAL'").unionAll(costs), rates, **{**ARGS, "accounts": [*ARGS["accounts"], "MISC"]}, allow_unmapped=True)
    found = {(r["kind"], r["period"], r["code"], r["currency"]): (r["rows"], r["impact_local"], r["impact_reporting"]) for r in got.checks["unmapped"].collect()}
    assert found == {
        ("pnl_customer", "2026-01", "C9", "EUR"): (1, D(50), D(225)),
        ("pnl_product", "2026-02", "NEW", "PLN"): (1, D(3), D(3)),  # revenue 1 - 1 = 0, profit -3
        ("pnl_account", "2026-01", "MISC", "PLN"): (1, D(2), D(2)), ("pnl_account", "2026-01", "MISC", "EUR"): (1, D(1), D("4.5")), ("pnl_account", "2026-02", "MISC", "PLN"): (1, D(3), D(3)),
        ("inventory_product", "2026-01", "GONE", "PLN"): (1, D(30), D(30)), ("inventory_warehouse", "2026-01", "UNKNOWN", "PLN"): (1, D(30), D(30)),
        ("price_product", "2026-01", "GONE", "PLN"): (2, D(15), D(15)),
    }


def test_a_fact_that_differs_from_its_wide_rows_is_refused(staged):
    wide, inv, prices, customers, products, rules, rates = staged
    with pytest.raises(ValueError, match="wide_long"):  # a rate given twice doubles the rows that use it
        flows.tolerant_star(wide, inv, prices, customers, products, rules, rates.unionAll(rates), **ARGS)


def test_tolerant_star_refuses(staged):
    wide, inv, prices, customers, products, rules, rates = staged
    with pytest.raises(ValueError, match="accounts without a rule: DED"):
        flows.tolerant_star(wide, inv, prices, customers, products, rules.where("account_code <> 'DED'"), rates, **ARGS)
    with pytest.raises(ValueError, match="currency"):
        flows.tolerant_star(wide, inv, prices, customers, products, rules, rates, **{**ARGS, "currencies": ["PLN"]})
    with pytest.raises(ValueError, match="members"):
        flows.tolerant_star(wide, inv, prices, customers, products.unionAll(products), rules, rates, **ARGS)
    with pytest.raises(Exception, match="no exchange rate"):
        flows.tolerant_star(wide, inv, prices, customers, products, rules, rates.limit(0), **ARGS)
    with pytest.raises(ValueError, match="inventory columns not found: .'dio'"):
        flows.tolerant_star(wide, inv.drop("dio"), prices, customers, products, rules, rates, **ARGS)


def test_strict_star_fails_before_it_joins(spark, staged):
    wide, rates = staged[0].where("entity <> 'DE'"), staged[6]
    dim = spark.createDataFrame([(1, "P1")], "sk long, nk string")
    errors = scratch_folder(spark)
    with pytest.raises(ValueError, match="product_code=NEW"):
        flows.strict_star(wide, {"product_code": (dim, "nk")}, rates, {"GROSS_REVENUE": ["REV"]}, errors)
    assert [tuple(r) for r in spark.read.parquet(errors).collect()] == [("product_code", "NEW", 1)]
    out = flows.strict_star(wide.where("product_code <> 'new' AND currency = 'EUR'"), {"product_code": (dim, "nk")}, rates, {"GROSS_REVENUE": ["REV"]}).collect()
    assert [(r["product_code_sk"], r["gross_revenue_reporting"]) for r in out] == [(1, D("225.00"))]


def test_strict_star_isolates_an_entity_and_needs_rates(spark, staged):
    wide, rates = staged[0], staged[6].unionByName(spark.createDataFrame([("2026-01", "PLN", D(1))], staged[6].schema))
    dims = {"product_code": (spark.createDataFrame([(1, "P1"), (2, "NEW")], "sk long, nk string"), "nk")}
    args = (dims, rates, {"GROSS_REVENUE": ["REV"]})
    with pytest.raises(ValueError, match="no exchange rate: 2026-01 XXX, 2026-02 PLN"):
        flows.strict_star(wide, *args)
    with pytest.raises(ValueError, match="currency"):
        flows.strict_star(wide, *args, entity="PL", currencies=["PLN"])
    out = flows.strict_star(wide, *args, entity="PL", currencies=["PLN", "EUR"], periods="2026-01", target=scratch_folder(spark))
    assert sorted((r["currency"], r["product_code_sk"], r["gross_revenue_reporting"]) for r in out.collect()) == [("EUR", 1, D("225.00")), ("PLN", 1, D("100.00"))]


def test_additivity_is_carried_by_the_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", "2026-01", 1.0, 5.0, 2.0), ("a", "2026-02", 2.0, 7.0, 4.0)], "k string, period string, sales double, stock double, rate double")
    classed = star.with_additivity(df, {"sales": "ADDITIVE", "stock": "SEMI_ADDITIVE", "rate": ("WEIGHTED", "sales")})
    path = str(tmp_path / "mart")
    classed.write.parquet(path)
    again = spark.read.parquet(path)
    assert star.additivity_of(again) == {"sales": "ADDITIVE", "stock": "SEMI_ADDITIVE", "rate": ("WEIGHTED", "sales")}
    assert [tuple(r) for r in star.additivity_safe_rollup(again, ["k"], "period").collect()] == [("a", 3.0, 7.0, 10 / 3)]
    with pytest.raises(ValueError, match="over time: .'stock'"):
        star.additivity_safe_rollup(star.with_additivity(again, {"stock": "NON_ADDITIVE"}), ["k"], "period")
    with pytest.raises(ValueError, match="no additivity"):
        star.additivity_safe_rollup(df, ["k"], "period")
    with pytest.raises(ValueError, match="unknown additivity"):
        star.with_additivity(df, {"sales": "MAYBE"})


def test_cardinality_sketches_of_periods_merge(spark):
    df = spark.range(30_000).select((F.col("id") % 7000).alias("k"), (F.col("id") % 3).cast("string").alias("period"))
    kept = aggregate.period_sketches(df.where("period <> '2'"), ["k"], "period")
    both = aggregate.merge_sketches(kept, aggregate.period_sketches(df.where("period = '2'"), ["k"], "period"))
    assert both.count() == 3
    assert abs(aggregate.sketched_cardinality(both).first()[0] - 7000) < 210
    assert aggregate.sketched_cardinality(both.limit(0)).first()[0] == 0


def test_price_and_stock_checks_see_a_changed_mart(spark):
    fact = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 5.0)], "g string, p double")
    mart_ = spark.createDataFrame([("a", 15.0), ("b", 5.0), ("c", None)], "g string, p double")
    ok = lambda m: star.price_check(m, fact, ["g"], ["p"]).first()
    assert ok(mart_)["ok"]
    assert not ok(mart_.where("g <> 'b'"))["ok"] and ok(mart_.where("g <> 'b'"))["strays"] == 1
    assert ok(mart_.withColumn("p", F.col("p") + 1))["max_diff_p"] == 1.0
    assert not ok(mart_.unionAll(mart_.where("g = 'a'")))["grain_unique"]


MODEL = mart.MartModel("period", ["invoice"], [mart.Measure("amount", 10, 2)], [mart.Dimension("customer", ["customer"], ["name"], "period")], ["entity"])


def invoices(spark, *rows):
    return spark.createDataFrame(rows, "period string, entity string, invoice string, customer string, name string, amount string")


FIRST = [("2026-01", "A", "1", "k", "Old", "10.00"), ("2026-01", "B", "2", "k", "Old", ""), ("2026-02", "A", "3", "m", "Em", "5.5")]
SECOND = [FIRST[0], ("2026-02", "A", "3", "k", "New", "20.00"), ("2026-02", "A", "4", "n", "En", "1")]


def facts(load):
    return sorted((r["period"], r["entity"], r["invoice"], r["customer"], r["name"], r["amount"]) for r in load.fact.collect())


@pytest.fixture(scope="module")
def loaded(spark):
    target = scratch_folder(spark)
    flows.load_mart(invoices(spark, *FIRST), MODEL, target)
    return target, flows.load_mart(invoices(spark, *SECOND), MODEL, target)


def test_mart_loads(spark, loaded):
    target, c = loaded
    assert (c.revision, c.changed) == (2, True)
    assert facts(c) == [("2026-01", "A", "1", "k", "New", D("10.00")), ("2026-01", "B", "2", "k", "New", None), ("2026-02", "A", "3", "k", "New", D("20.00")), ("2026-02", "A", "4", "n", "En", D("1.00"))]
    assert sorted(c.keyed.columns) == ["amount", "customer_sk", "entity", "invoice", "period"]
    assert {r["customer"]: (r["sk"], r["name"]) for r in c.dims["customer"].collect()} == {"k": (1, "New"), "m": (2, "Em"), "n": (3, "En")}
    assert {(r["period"], r["entity"]): (r["rows"], r["sum_amount"]) for r in c.controls.collect()} == {("2026-01", "A"): (1, D(10)), ("2026-01", "B"): (1, D(0)), ("2026-02", "A"): (2, D(21))}
    gone = flows.archived_rows(c.store, 2, MODEL).collect()
    assert [(r["invoice"], r["customer"], r["name"], r["amount"], r["replaced_by"]) for r in gone] == [("3", "m", "Em", D("5.50"), 2)]
    assert [(r["customer"], r["name"]) for r in c.store.read("audit_customer", c.at).collect()] == [("k", "Old")]
    assert flows.archived_rows(c.store, 1, MODEL).count() == 0
    assert [tuple(r) for r in flows.mart_history(c.store).orderBy("revision").collect()] == [(1, 3, 3), (2, 1, 2)]
    same = flows.load_mart(invoices(spark, *SECOND[::-1]), MODEL, target)
    assert (same.revision, same.changed) == (2, False)


@pytest.mark.parametrize(("rows", "words"), [
    ([("2026-03", "A", "9", "k", "N", "1.234")], "'inexact': 1"), ([("2026-03", "A", "9", "k", "N", "1")] * 2, "repeated_keys"), ([("2026-03", " ", None, "k", "N", "1")], "'blank_scope': 1, 'blank_key': 1"),
    ([("2026-13", "A", "9", "k", "N", "1")], "odd_periods"), ([("202603", "A", "9", "k", "N", "1")], "unlike forms"), ([("2026-03", "A", "9", "k", "N", "1"), ("2026-03", "A", "8", "k", "M", "1")], "unlike attributes under one authority"),
    ([("2026-02", "B", "9", "k", "Else", "1")], "unlike attributes under one authority"),
])
def test_mart_loads_are_refused(spark, loaded, rows, words):
    target, now = loaded
    with pytest.raises(ValueError, match=words):
        flows.load_mart(invoices(spark, *rows), MODEL, target)
    assert Revisions(spark, target).current() == now.at


def test_other_models_authorities_and_files_are_refused(spark, loaded):
    target, now = loaded
    other = mart.MartModel("period", ["invoice"], [mart.Measure("amount", 12, 2)], MODEL.dimensions, ["entity"])
    with pytest.raises(ValueError, match="another model"):
        flows.load_mart(invoices(spark, *FIRST), other, target)
    ranked = mart.MartModel("period", ["invoice"], [mart.Measure("amount", 10, 2)], [mart.Dimension("customer", ["customer"], [], "name")], ["entity"])
    with pytest.raises(ValueError, match="authorities of unlike forms"):
        flows.load_mart(invoices(spark, *FIRST), ranked, scratch_folder(spark))
    plain = mart.MartModel("period", ["invoice"], [mart.Measure("amount", 10, 2)], [], ["entity"])
    files = lambda *names: invoices(spark, *[("2026-01", "A", str(k), "k", n, "1") for k, n in enumerate(names)]).withColumnRenamed("name", "file")
    folder = scratch_folder(spark)
    assert flows.load_mart(files("a", "b"), plain, folder, source="file").changed
    with pytest.raises(ValueError, match="the files of scope"):
        flows.load_mart(files("a", "a", "a"), plain, folder, source="file")
    assert flows.load_mart(files("b", "a", "a"), plain, folder, source="file").revision == 2


def test_a_load_that_dies_leaves_the_mart_as_it_was(spark, loaded, monkeypatch):
    target, now = loaded
    before = facts(now)
    third = [("2026-01", "A", "1", "k", "Newer", "11.00"), ("2026-03", "A", "5", "z", "Zed", "3.00")]
    steps = 0
    real = Revisions.write

    def dies(after):
        def write(self, name, df, by=()):
            nonlocal steps
            part = real(self, name, df, by)
            steps += 1
            if steps == after:
                raise KeyboardInterrupt(name)
            return part

        return write

    for after in (1, 2, 3):  # after the dimension, its audit and the fact
        steps = 0
        monkeypatch.setattr(Revisions, "write", dies(after))
        with pytest.raises(KeyboardInterrupt):
            flows.load_mart(invoices(spark, *third).withColumn("period", F.regexp_replace("period", "2026-01", "2026-05")), MODEL, target)
        monkeypatch.setattr(Revisions, "write", real)
        store = Revisions(spark, target)
        assert store.current() == now.at and facts(flows.MartLoad(store, store.current(), False, MODEL)) == before
    monkeypatch.setattr(flows.mart, "scope_controls", lambda *a: mart.discover_scopes(a[0], a[1]).select("*", F.lit(7).cast("long").alias("rows"), F.lit(D(1)).alias("sum_amount")))
    with pytest.raises(RuntimeError, match="differ from their source"):
        flows.load_mart(invoices(spark, third[1]), MODEL, target)
    monkeypatch.undo()
    assert Revisions(spark, target).current() == now.at


def test_a_load_of_few_scopes_goes_on_with_their_rows_alone(spark, monkeypatch):
    target = scratch_folder(spark)
    flows.load_mart(invoices(spark, *FIRST), MODEL, target)
    seen, real = [], flows.merge_members
    monkeypatch.setattr(flows, "merge_members", lambda stage, *a: seen.append(stage) or real(stage, *a))
    load = flows.load_mart(invoices(spark, *SECOND, FIRST[1]), MODEL, target)
    assert load.at.details["loaded"] == {"scopes": 1, "rows": 2}
    assert sorted(r["invoice"] for r in spark.read.parquet(*seen[0].inputFiles()).collect()) == ["3", "4"]  # what is read again from now on
    assert "Join" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_exports_need_an_approval_of_this_revision(spark, tmp_path):
    target, out = scratch_folder(spark), str(tmp_path / "out")
    load = flows.load_mart(invoices(spark, *FIRST), MODEL, target)
    flows.export_mart(load, out, "a")
    with pytest.raises(PermissionError, match="isn't approved"):
        flows.publish_export(load, out, "a", f"{out}/public")
    with pytest.raises(ValueError, match="reviewer"):
        flows.approve_export(load, out, "a", " ")
    assert flows.approve_export(load, out, "a", "me")["revision"] == 1
    with pytest.raises(FileExistsError):
        flows.approve_export(load, out, "a", "me again")
    one = flows.publish_export(load, out, "a", f"{out}/public")
    assert (one.number, one.details["reviewer"], Revisions(spark, f"{out}/public").read("data", one).count()) == (1, "me", 3)
    with pytest.raises(StaleRevision):  # another publisher that has seen no version
        flows.publish_export(load, out, "a", f"{out}/public", seen=0)
    load2 = flows.load_mart(invoices(spark, *SECOND), MODEL, target)
    with pytest.raises(PermissionError, match="of revision 1"):
        flows.publish_export(load, out, "a", f"{out}/public", seen=1)
    with pytest.raises(PermissionError, match="of revision 1"):
        flows.approve_export(load2, out, "a", "me")
    flows.export_mart(load2, out, "b")
    flows.approve_export(load2, out, "b", "me")
    assert flows.publish_export(load2, out, "b", f"{out}/public", seen=1).number == 2
    spark.read.parquet(f"{out}/candidate=b/data").limit(1).write.mode("append").parquet(f"{out}/candidate=b/data")
    with pytest.raises(ValueError, match="isn't as it was exported"):
        flows.approve_export(load2, out, "b", "me")


LANDED = "file string, hash string, period string, code string, sales string"


def landed(spark, *rows):
    return spark.createDataFrame(rows, LANDED)


def load(store, rows, approve=True, **options):
    made = flows.inspect_load(rows, store, ["code"], ["sales"], **options)
    return flows.publish_load(made, made.snapshot) if approve else made


def content(store, revision=None):
    return sorted(tuple(r) for r in store.read("rows", revision or store.current()).select("period", "code", "sales").collect())


@pytest.fixture
def dataset(spark):
    """Two files of three periods, of which the second one has two."""
    store = Revisions(spark, scratch_folder(spark))
    load(store, landed(spark, ("a.csv", "h1", "2024-01", "001", "1000"), ("b.csv", "h2", "2024.2", "001", "1500"), ("b.csv", "h2", "202403", "001", "1,600.50")))
    return store


def test_periods_are_normalised_once(spark, dataset):
    assert content(dataset) == [("2024-01", "001", "1000"), ("2024-02", "001", "1500"), ("2024-03", "001", "1,600.50")]
    files = {tuple(r) for r in flows.loaded_files(dataset).collect()}
    assert files == {("a.csv", "h1", "2024-01"), ("b.csv", "h2", "2024-02"), ("b.csv", "h2", "2024-03")}
    load(dataset, landed(spark, ("c_202404.csv", "h3", " ", "5", "1"), ("d.csv", "h4", "20240531", "6", "2")))
    assert content(dataset)[-2:] == [("2024-04", "5", "1"), ("2024-05", "6", "2")]  # a period from the file's name
    with pytest.raises(ValueError, match="isn't valid.*'bad_periods': 1"):
        load(dataset, landed(spark, ("e.csv", "h5", "2024-06", "1", "1"), ("e.csv", "h5", "someday", "2", "1")))
    with pytest.raises(ValueError, match="isn't valid.*'blank_periods': 1"):
        load(dataset, landed(spark, ("e_202406.csv", "h5", "2024-06", "1", "1"), ("e_202406.csv", "h5", "", "2", "1")))


def test_a_period_that_a_file_no_longer_has_is_cleared(spark, dataset):
    made = load(dataset, landed(spark, ("b.csv", "h9", "2024-03", "001", "7")), approve=False)
    assert list(made.targets) == ["2024-02", "2024-03"]
    flows.publish_load(made, made.snapshot)
    assert content(dataset) == [("2024-01", "001", "1000"), ("2024-03", "001", "7")]
    assert {tuple(r) for r in flows.loaded_files(dataset).collect()} == {("a.csv", "h1", "2024-01"), ("b.csv", "h9", "2024-03")}
    assert dataset.current().details["rows"] == 2
    assert content(dataset, dataset.revision(1))[1] == ("2024-02", "001", "1500")  # an earlier revision has it still
    dataset.roll_back(1)
    assert len(content(dataset)) == 3


def test_headers_are_each_files_own(spark, dataset):
    rows = landed(spark, ("c.csv", "h3", "2024-04", "5", "1"))
    have = lambda *h: spark.createDataFrame([("c.csv", list(h))], "file string, header array<string>")
    with pytest.raises(ValueError, match="missing_columns"):
        load(dataset, rows, headers=have("period", "code"), required=["period", "code", "sales"])
    with pytest.raises(ValueError, match="files' headers"):
        load(dataset, rows, required=["period"])
    load(dataset, rows, headers=have("sales", "code", "period"), required=["period", "code", "sales"], baseline=["period", "code", "sales"])
    assert len(content(dataset)) == 4


def test_period_loads_are_refused(spark, dataset):
    with pytest.raises(ValueError, match="conflict"):
        load(dataset, landed(spark, ("x.csv", "n1", "2024-04", "1", "1"), ("y.csv", "n2", "2024-04", "2", "1")))
    with pytest.raises(ValueError, match="isn't valid"):
        load(dataset, landed(spark, ("x.csv", "n1", "2024-04", "1", "what")))
    made = load(dataset, landed(spark, ("x.csv", "n1", "2024-04", "1", "5")), approve=False)
    other = made.snapshot.withColumn("fingerprint", F.lit("1/2"))  # rows and totals are the same, the content isn't
    with pytest.raises(PermissionError):
        flows.publish_load(made, other)
    assert len(content(dataset)) == 3 and flows.loaded_files(dataset).count() == 3
    rival = load(dataset, landed(spark, ("z.csv", "n3", "2024-05", "1", "5")), approve=False)
    flows.publish_load(rival, rival.snapshot)
    with pytest.raises(StaleRevision):  # inspected against what is no longer current
        flows.publish_load(made, made.snapshot)
    assert [r[0] for r in content(dataset)] == ["2024-01", "2024-02", "2024-03", "2024-05"]
    with pytest.raises(ValueError, match="lost a file"):
        store = Revisions(spark, scratch_folder(spark))
        load(store, landed(spark, ("p.csv", "1", "2024-01", "1", "1")))
        shared = landed(spark, ("p.csv", "1", "2024-01", "1", "1"), ("q.csv", "2", "2024-01", "2", "1"))
        load(store, shared)
        load(store, landed(spark, ("q.csv", "3", "2024-01", "2", "9")))


def test_a_folder_is_loaded_from_its_path(spark, tmp_path):
    store = Revisions(spark, scratch_folder(spark))
    inbox = tmp_path / "in box"
    inbox.mkdir()
    (inbox / "sales_a.csv").write_text('period,code,sales,note\n2024-01,001,5,"x\ny"\n')
    (inbox / "sales_b.csv").write_text("code,period,sales\n002,202402,6\n")
    (inbox / "other.csv").write_text("what\n1\n")
    folder = lambda: flows.inspect_folder(spark, str(inbox), store, ["code"], ["sales"], include=["SALES"], exclude=["draft"])
    made = folder()
    flows.publish_load(made, made.snapshot)
    assert content(store) == [("2024-01", "001", "5"), ("2024-02", "002", "6")]
    assert [r["note"] for r in store.read("rows", store.current()).orderBy("period").collect()] == ["x\ny", None]
    again = folder()
    assert list(again.targets) == [] and again.files.isEmpty()
    (inbox / "sales_c.csv").write_text("period,code\n2024-03,003\n")
    with pytest.raises(ValueError, match="missing_columns"):
        folder()
    (inbox / "sales_c.csv").write_text("")
    with pytest.raises(ValueError, match="empty files"):
        folder()
    (inbox / "sales_c.csv").write_text("period,code,sales\n")  # a header without rows changes nothing
    assert list(folder().targets) == []


def test_numbers_of_rows(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), F.lit("x").alias("v")).repartition(7)
    got = star.number_rows(df, ["k"], "row", 5, 4).collect()
    assert sorted((r["k"], r["row"]) for r in got) == [(k, k + 5) for k in range(1000)]
    assert star.number_rows(df.limit(0), ["k"]).count() == 0


def test_stored_spec(spark):
    spec = aggregate.AggregationSpec(keys=["a"], measures=["m"], groups=[aggregate.ColumnGroup("g", ["m", "n"])], ratios=[aggregate.Ratio("r", "g", "m", 100.0)], filters=[Condition("a", "in", ["x", "y"])], constants={"c": "007"})
    text = aggregate.spec_to_json(spec)
    assert aggregate.spec_to_json(aggregate.spec_from_json(text)) == text and aggregate.spec_from_json(text).groups == [aggregate.ColumnGroup("g", ["m", "n"])]
    with pytest.raises(ValueError, match="unknown entries"):
        aggregate.spec_from_json('{"keys": [], "colour": 1}')


def test_rules_that_share_an_id_keep_their_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    rules = [Rule("r", "first", [Condition("k", "==", "a")]), Rule("r", "second", [Condition("k", "==", "b")])]
    assert [tuple(r) for r in mapping.first_match_classify(df, rules, "t").orderBy("k").collect()] == [("a", "r", "first"), ("b", "r", "second"), ("z", None, "Unmapped")]


def test_cardinality_and_blank_promotion_ids(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"))
    assert tuple(aggregate.group_cardinality(df, ["k"]).first()) == (10, True)
    assert tuple(aggregate.group_cardinality(df, ["k"], cap=4).first()) == (4, False)
    assert tuple(aggregate.group_cardinality(df.limit(0), ["k"]).first()) == (0, True)
    master = spark.createDataFrame([("A", "n"), ("A", "n"), ("", "n"), (" ", "n"), (None, "n")], "promotion_id string, promotion_name string")
    rules = spark.createDataFrame([], "support_rule_id string, promotion_id string, model_code string, start_date string, end_date string, support_per_unit string, currency string")
    got = sorted((r["key"] or "", r["message"]) for r in ranges.promotion_rule_validation(master, rules).collect())
    assert got == [("", "required"), ("", "required"), (" ", "required"), ("A", "duplicate"), ("A", "duplicate")]


def test_approval_needs_equal_content(spark):
    df = spark.createDataFrame([("2024-01", "5")], "period string, sales string")
    a = flows.inspection_snapshot(df, ["sales"])
    assert periods.approval_gate(a, a, ["sales"]).first()[0] is True
