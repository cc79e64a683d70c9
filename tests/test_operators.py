"""Operators on small fixtures: the shapes and figures that the semantics fix."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates, money, numbers, text
from tallyforge.operators import aggregate as agg
from tallyforge.operators import filters as flt
from tallyforge.operators import mapping, periods, profile, ranges, reference, star
from tallyforge.operators import mart as mt
from tallyforge.session import as_dealt, scratch_folder, written_dealt
from tallyforge.sources import landing, sinks
from tallyforge.sources.revisions import Revisions, StaleRevision
from tallyforge.streaming.periods import stream_period_files


def column(spark, values, make):
    """make(column) over values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(make(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_strict_numbers(spark):
    english = ["1,234.56", "1.", ".5", "-12", "1e3", "1,2e3", "12,34", "", " - ", None, "1234,567", "x", "1e999", "+1,000"]
    got = column(spark, english, lambda c: numbers.parse_number_strict(c))
    assert [g["value"] for g in got] == [1234.56, 1.0, 0.5, -12.0, 1000.0, None, None, None, None, None, None, None, None, 1000.0]
    assert [g["state"] for g in got] == ["ok"] * 5 + ["invalid"] * 2 + ["missing"] * 3 + ["invalid"] * 3 + ["ok"]
    polish = ["1 234,56", "1.000.000,00", "1 234,5", "1 000", "12.34", "1 23", ",5", "1.000 000"]
    assert [g["value"] for g in column(spark, polish, lambda c: numbers.parse_number_strict(c, "Polish"))] == [1234.56, 1e6, 1234.5, 1000.0, None, None, 0.5, None]
    with pytest.raises(ValueError, match="number mode"):
        numbers.parse_number_strict(F.lit("1"), "French")


def test_preserving_numbers(spark):
    got = column(spark, ["1 234,50", "007", "0,5", "−5", "1.000", "12,", "", "0", "1 23"], lambda c: numbers.parse_number_preserving(c, "Polish"))
    assert [(g["value"], g["scale"]) for g in got] == [(Decimal("1234.50"), 2), (None, None), (Decimal("0.5"), 1), (Decimal(-5), 0), (Decimal(1000), 0), (None, None), (None, None), (Decimal(0), 0), (None, None)]
    assert got[1]["text"] == "007"


def test_auto_numbers_and_syntax(spark):
    assert column(spark, ["10,000", "1234,56", "1.234,56", "1,234.56", "1234,5678", "x"], numbers.parse_number_auto) == [Decimal(10000), Decimal("1234.56"), Decimal("1234.56"), Decimal("1234.56"), Decimal("1234.5678"), None]
    assert column(spark, ["12.34", "12,34", "1 234,5", "", "-", None], lambda c: numbers.number_syntax_ok(c, "eu")) == [False, True, True, True, True, True]


def test_facts_of_a_near_key_are_dealt_before_they_are_summed(spark):
    df = spark.createDataFrame([("a", 1, 1.5, None), ("a", 1, 2.5, 2.0), ("b", 1, None, 4.0), (None, 2, 3.0, 6.0)], "g string, h int, p double, q double")
    dealt = star.price_fact(df, ["g", "h"], ["p", "q"], 3)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, star.price_fact(df, ["g", "h"], ["p", "q"]).collect()))
    plan = dealt._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange") and plan.count("Exchange") == 1


def test_lossless_decimals_at_the_edges(spark):
    assert column(spark, ["9999.99", "9999.995", "1.20" + "0" * 30, "1.20" + "0" * 30 + "1", "1.1949999999999999999999", "-9999.990"], lambda c: numbers.decimal_lossless(c, 6, 2)) == [True, False, True, False, False, True]


def test_lossless_decimals_and_text(spark):
    assert column(spark, ["1.20", "1.234", "1e2", "12345.6", "", None, "x", "5.95E-11"], lambda c: numbers.decimal_lossless(c, 6, 2)) == [True, False, True, False, True, True, False, False]
    assert column(spark, ["0.000", "-0.5000", "120", "0.0000000001", "12.30"], lambda c: numbers.plain_decimal_text(c.cast("decimal(30,18)"))) == ["0", "-0.5", "120", "0.0000000001", "12.3"]
    assert column(spark, ["0", "0.0120", "1200", "123456789012345678"], lambda c: numbers.significant_digits(c.cast("decimal(38,18)"))) == [1, 2, 2, 18]


def test_dates_and_periods(spark):
    d = dt.date
    assert column(spark, ["2024-01-05", "2024/1/5", "5.1.2024", "13-01-2024", "01/13/2024", "01/02/2024", "2024-13-01", "31.02.2024", "x", None], dates.parse_date_unambiguous) == [d(2024, 1, 5)] * 3 + [d(2024, 1, 13)] * 2 + [None] * 5
    assert column(spark, ["2024-1", "202401", "20240115", "2024년 1월", "24년 3월", "2024-13", "202413", "", None], dates.normalize_period) == ["2024-01"] * 4 + ["2024-03"] + [None] * 4
    assert column(spark, ["sales_202401.csv", "x-2024-02-y.csv", "v1.csv"], dates.period_from_name) == ["2024-01", "2024-02", None]
    assert dates.expand_period_spec("2026-Q1, 202605, 2026/06") == ["2026-01", "2026-02", "2026-03", "2026-05", "2026-06"]
    assert dates.expand_period_spec("ALL") is None and len(dates.expand_period_spec("2026")) == 12
    for bad in ("2026-13", "1800", "abc"):
        with pytest.raises(ValueError, match="period"):
            dates.expand_period_spec(bad)


def test_texts(spark):
    assert column(spark, ["a\r\n\nb", "x y", "z"], text.flatten_linebreaks) == ["a b", "x y", "z"]
    got = column(spark, [" Raw [510001] ", "plain"], text.split_account_code)
    assert [(g["code"], g["name"]) for g in got] == [("510001", "Raw"), ("", "plain")]
    assert column(spark, ["", None, " a "], text.null_to_unknown) == ["UNKNOWN", "UNKNOWN", "a"]
    assert column(spark, ["0"], lambda c: money.safe_ratio(F.lit(1), c.cast("double"))) == [0.0]


LEDGER = [("202511", "A", "x", "100", "10"), ("202512", "A", "y", "-", "5"), ("202601", "B", "x", "0", "7"), ("202601", "B", " x ", "1,000.5", "bad")]


def test_summary(spark):
    df = spark.createDataFrame(LEDGER, "month string, div string, cust string, sales string, cost string")
    spec = agg.AggregationSpec(keys=["div"], measures=["sales"], functions={"sales": "mean"}, groups=[agg.ColumnGroup("all", ["sales", "cost"])], ratios=[agg.Ratio("r", "all", "sales", 100)], strict=False)
    rows = {r["div"]: r for r in agg.aggregate_spec(df, spec).collect()}
    assert rows["A"]["sales"] == 100 and rows["A"]["all"] == 115 and rows["B"]["sales"] == 500.25 and rows["B"]["all"] == 1007.5
    assert rows["A"]["r"] == pytest.approx(115)
    with pytest.raises(Exception, match="no English number"):
        agg.aggregate_spec(df, agg.AggregationSpec(keys=["div"], measures=["cost"])).collect()
    year = agg.aggregate_spec(df, agg.AggregationSpec(keys=["month", "tag"], measures=["sales"], month="month", annual="year", constants={"tag": "007"})).collect()
    assert [(r["year"], r["tag"], r["sales"]) for r in year] == [("2025", "007", 100.0), ("2026", "007", 1000.5)] and list(year[0].asDict()) == ["year", "tag", "sales"]
    with pytest.raises(flt.MissingColumnError):
        agg.aggregate_spec(df, agg.AggregationSpec(keys=["nope"]))
    with pytest.raises(ValueError, match="one another"):
        agg.ratio_order([agg.Ratio("a", "b", "x"), agg.Ratio("b", "a", "x")])
    few = agg.group_cardinality(df, ["cust", "month"], cap=2).first()
    assert (few["groups"], few["exact"]) == (2, False)
    counts = agg.number_counts(df, ["sales", "cost"]).collect()
    assert [(c["column"], c["missing"], c["invalid"], c["examples"]) for c in counts] == [("sales", 1, 0, ""), ("cost", 0, 1, "bad")]
    assert flt.filter_spec(df, [flt.Condition("cust", "==", "x"), flt.Condition("div", "nonsense", 1)]).count() == 3


def test_summary_doesnt_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_returnflag", "l_quantity")
    spec = agg.AggregationSpec(keys=["l_returnflag"], measures=["l_quantity"], functions={"l_quantity": "mean"})
    results = [agg.aggregate_spec(df.repartition(n), spec).collect() for n in (1, 3, 17)]
    assert results[0] == results[1] == results[2]


def test_rule_predicates_on_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("Ab",), ("7",)], "v string")
    hit = lambda op, v=None, cs=False: [r[0] for r in df.select(flt.condition_column(flt.Condition("v", op, v, cs))).collect()]
    assert hit("is_null") == [True, True, False, False]
    assert hit("not_contains", "a") == [True, True, False, True]
    assert hit("not_in", "ab, x") == [True, True, False, True]
    assert hit("==", "AB") == [False, False, True, False] and hit("==", "AB", True) == [False] * 4
    assert hit(">", "6.5") == [False, False, False, True]
    for bad in (">", "what"):
        with pytest.raises(ValueError, match="number|operator"):
            flt.condition_column(flt.Condition("v", bad, "x"))


def test_first_match_and_stats(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "n int")
    rules = [mapping.Rule("a", "low", [flt.Condition("n", "<", 3)]), mapping.Rule("b", "lower", [flt.Condition("n", "<", 5)])]
    out, stats, top = mapping.classify_dataset(df, rules, "t", "rest", ["n"], 2)
    assert [r["t"] for r in out.orderBy("n").collect()] == ["low"] * 3 + ["lower"] * 2 + ["rest"] * 5
    assert {r["rule_id"]: (r["matched"], r["share"]) for r in stats.collect()} == {"a": (3, 30.0), "b": (2, 20.0), None: (5, 50.0)}
    assert [r["value"] for r in top.orderBy("value").collect()] == ["5", "6"]


def test_ranges(spark):
    rows = [("r1", "m", dt.date(2026, 1, 3), dt.date(2026, 1, 7)), ("r2", "m", dt.date(2026, 1, 7), dt.date(2026, 1, 8)), ("r3", "m", dt.date(2026, 1, 1), dt.date(2026, 1, 31)), ("r4", "k", dt.date(2026, 1, 9), dt.date(2026, 1, 2)), ("r5", "m", dt.date(2026, 1, 7), dt.date(2026, 1, 7))]
    df = spark.createDataFrame(rows, "id string, model_code string, start_date date, end_date date")
    days = ranges.expand_date_ranges(df).where("id = 'r1'").orderBy("applied_date").collect()
    assert len(days) == 5 and days[0]["applied_date"] == dt.date(2026, 1, 3)
    assert ranges.expand_date_ranges(df).where("id = 'r4'").count() == 0
    assert {r["model_code"]: r["pairs"] for r in ranges.interval_overlap_count(df.where("id <> 'r4'"), "model_code").collect()} == {"m": 6}


def test_period_replacement_and_guards(spark, tmp_path):
    store = Revisions(spark, str(tmp_path / "data"))
    rows = lambda *r: spark.createDataFrame(r, "period string, v int")
    content = lambda: sorted((r["period"], r["v"]) for r in store.read("rows", store.current()).collect())
    periods.replace_periods(store, rows(("2024-01", 1), ("2024-02", 2), ("2024-03", 3)))
    for _ in range(2):  # a rerun changes nothing
        periods.replace_periods(store, rows(("2024-02", 5), ("2024-02", 6)), ["2024-02", "2024-03"])
    assert content() == [("2024-01", 1), ("2024-02", 5), ("2024-02", 6)]
    periods.replace_periods(store, rows().limit(0), ["2024-01"])
    assert content() == [("2024-02", 5), ("2024-02", 6)]
    with pytest.raises(ValueError, match="type of v"):
        periods.replace_periods(store, spark.createDataFrame([("2024-02", "x")], "period string, v string"))
    now = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p3")], "file string, period string")
    hist = spark.createDataFrame([("a", "p2"), ("b", "p3"), ("z", "p1"), ("a", "p1")], "file string, period string")
    got = periods.target_period_closure(now, hist, spark.createDataFrame([("a",)], "file string"))
    assert sorted(r[0] for r in got.collect()) == ["p1", "p2", "p3"]
    assert [tuple(r) for r in periods.half_period_guard(now, hist, got).collect()] == [("p1", 1)]


def test_fingerprints_count_repeats(spark):
    one = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    assert periods.content_fingerprint(one).first() == periods.content_fingerprint(one.repartition(3)).first()
    assert periods.content_fingerprint(one).first() != periods.content_fingerprint(one.distinct()).first()
    assert periods.content_fingerprint(one).first() != periods.content_fingerprint(spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")).first()


def test_star_totals(spark):
    wide = spark.createDataFrame([("2026-01", "PLN", Decimal(100), Decimal(10), Decimal(60)), ("2026-01", "EUR", Decimal(10), Decimal(1), Decimal(5))], "period string, currency string, REV decimal(18,6), DED decimal(18,6), COGS decimal(18,6)")
    rules = spark.createDataFrame([("REV", "GROSS_REVENUE", 1), ("DED", "SALES_DEDUCTION", -1), ("COGS", "COGS", -1)], "account_code string, statement_line string, sign_multiplier int")
    rates = spark.createDataFrame([("2026-01", "EUR", Decimal("4.5"))], "period string, currency string, rate decimal(18,8)")
    long = star.long_amounts(star.unpivot_accounts(wide, ["period", "currency"], ["REV", "DED", "COGS"]), rules, rates, "PLN")
    assert long.count() == 6
    w = star.waterfall_rollup(long, ["period"]).first()
    assert (w["net_revenue"], w["gross_margin"], w["operating_profit"]) == (Decimal("130.5"), Decimal(48), Decimal(48))
    with pytest.raises(Exception, match="no exchange rate"):
        star.long_amounts(star.unpivot_accounts(wide.withColumn("currency", F.lit("USD")), ["period", "currency"], ["REV"]), rules, rates, "PLN").collect()
    with pytest.raises(ValueError, match="without a rule"):
        star.unmapped_account_guard(star.long_amounts(star.unpivot_accounts(wide, ["period", "currency"], ["REV"]), rules.where("account_code <> 'REV'"), rates, "PLN"))


def test_the_signed_waterfall_is_reconciled_in_both_currencies(spark):
    rows = [("2026-01", "p", "GROSS_REVENUE", "100", "450"), ("2026-01", "p", "COGS", "-60", "-270"), ("2026-01", "q", "SUBTOTAL_IGNORED", "0", "0"), ("2026-02", "q", None, "0", "0")]
    long = spark.createDataFrame([(*r[:3], Decimal(r[3]), Decimal(r[4])) for r in rows], "period string, code string, statement_line string, signed decimal(18,6), signed_reporting decimal(38,6)")
    assert star.signed_waterfall_reconcile(long, ["period", "code"]).first().asDict() == {"left_total": Decimal(180), "right_total": Decimal(180), "left_local": Decimal(40), "right_local": Decimal(40), "ok": True}
    lost = long.unionByName(long.limit(1).withColumns({"statement_line": F.lit("NO_SUCH_LINE"), "signed_reporting": F.lit(0).cast("decimal(38,6)")}))
    got = star.signed_waterfall_reconcile(lost, ["period", "code"]).first()
    assert got["left_total"] == got["right_total"] and got["left_local"] - got["right_local"] == 100 and not got["ok"]  # only the local amounts differ


def test_keys_never_change(spark):
    none = spark.createDataFrame([], "sk long, nk string")
    codes = lambda *c: spark.createDataFrame([(x,) for x in c], "nk string")
    first = star.assign_surrogate_keys(none, codes("b", "A", "a ", ""))
    assert sorted(map(tuple, first.collect())) == [(1, "A"), (2, "B")]
    kept = spark.createDataFrame(first.collect(), first.schema)
    second = star.assign_surrogate_keys(kept, codes("0", "b", "c"))
    assert sorted(map(tuple, second.collect())) == [(1, "A"), (2, "B"), (3, "0"), (4, "C")]
    dim = star.build_dimension(codes("a", "b").withColumnRenamed("nk", "code"), "code", ["name"], kept)
    assert sorted(map(tuple, dim.collect())) == [(-1, "UNKNOWN", "UNKNOWN"), (1, "A", "UNKNOWN"), (2, "B", "UNKNOWN")]


def test_dimension_merge(spark):
    dim = spark.createDataFrame([(1, "x", "2024-02", "old"), (2, "y", "2024-05", "kept")], "sk long, k string, per string, name string")
    stage = spark.createDataFrame([("x", "2024-03", "new"), ("y", "2024-01", "late"), ("z", "2024-01", "first"), ("x", "2024-01", "older")], "k string, per string, name string")
    stage = stage.withColumn("k", F.upper("k"))
    out, audit = star.merge_dimension_type1(dim.withColumn("k", F.upper("k")), stage, "k", ["name"], "per")
    assert sorted((r["sk"], r["k"], r["name"]) for r in out.collect()) == [(1, "X", "new"), (2, "Y", "kept"), (3, "Z", "first")]
    assert [(r["sk"], r["name"]) for r in audit.collect()] == [(1, "old")]


MODEL = mt.MartModel("period", ["invoice"], [mt.Measure("amount", 10, 2, "cost")], [mt.Dimension("customer", ["customer"])], ["entity"])


def test_mart(spark):
    rows = spark.createDataFrame([("2024-01", "A", "i1", "c", "1.25"), ("2024-01", "A", "i1", "c", "2.75"), ("2024-01", "A", "i2", "c", ""), ("2024-01", "A", "i2", "d", None), ("2024-01", "A", "i3", "e", "1e1")], "period string, entity string, invoice string, customer string, amount string")
    faults = mt.scope_row_validation(rows, MODEL).first()
    assert (faults["inexact"], faults["repeated_keys"], faults["blank_key"]) == (0, 2, 0)
    typed = mt.typed_stage(rows, MODEL).withColumn("seq", F.monotonically_increasing_id())
    one = {r["invoice"]: r for r in mt.collapse_duplicate_grain(typed, ["period", "entity", "invoice"], ["amount"], "seq").collect()}
    assert one["i1"]["amount"] == Decimal("4.00") and one["i2"]["amount"] is None and one["i2"]["customer"] == "c" and one["i3"]["amount"] == Decimal(10)
    with pytest.raises(Exception, match="isn't exact"):
        mt.typed_stage(rows.withColumn("amount", F.lit("1.234")), MODEL).collect()
    for bad in ({"row_key": ["amount"]}, {"measures": [mt.Measure("a"), mt.Measure("A")]}, {"excluded": ["PERIOD"]}):
        with pytest.raises(ValueError, match="roles|twice"):
            mt.MartModel(**{"period": "period", "row_key": ["k"], "measures": [mt.Measure("amount")], **bad})
    with pytest.raises(ValueError, match="granularity"):
        mt.select_mart(rows, first="2024-01", last="202402")
    archive = mt.archive_replaced_rows(rows, rows.limit(1), ["period", "entity"], 3)
    assert mt.archive_verified(archive, rows, rows.limit(1), ["period", "entity"])


def test_wide_recipe_unpivots_sums(spark):
    measures = [f"m{i}" for i in range(207)]
    star_rows = spark.createDataFrame([("202401", *[Decimal(i % 50 == 0) * 10 for i in range(207)]), ("202402", *[Decimal(i % 70 == 0) * 5 for i in range(207)])], "p string, " + ", ".join(f"{m} decimal(18,2)" for m in measures))
    entries = spark.createDataFrame([(m, "amount", m, m, "x", "", "", 1, i) for i, m in enumerate(measures)], "source_column string, measure_type string, account_code string, display_name string, major_category string, medium_category string, minor_category string, sign int, sort_order int")
    recipe = mt.Recipe("long_detail", ["p"])
    assert mt.run_recipe(star_rows, measures, entries, recipe).count() == 5 + 3
    assert mt.recipe_reconcile(star_rows, measures, entries, recipe).first()["matches"]
    with pytest.raises(ValueError, match="without a mapping"):
        mt.run_recipe(star_rows, measures, entries.where("source_column <> 'm0'"), recipe)
    other = mt.run_recipe(star_rows, measures, entries.where("source_column <> 'm0'"), mt.Recipe("wide_rollup", ["p"], unmapped="other_bucket")).orderBy("p").first()
    assert other["other"] == Decimal(10)


def test_profiling(spark):
    assert profile.precision_scale(5, 2) == (18, 2) and profile.precision_scale(5, 13) == (38, 15) and profile.precision_scale(30, 0) == (38, 2)
    df = spark.createDataFrame([("5.95E-11",), ("1,234.5",), ("120",), (None,), ("x",)], "v string")
    assert profile.infer_precision_scale(df, ["v"]) == {"v": profile.precision_scale(4, 13)}
    names = spark.createDataFrame([("매출수량[400001]",), ("매출액[410000]",), ("원재료비(변동)[510001]",), ("감가상각비(고정)[520001]",), ("매출원가계[500000]",), ("미세조정비[530001]",)], "source_column string")
    got = {r["account_code"]: (r["kind"], r["sign"]) for r in profile.classify_account_names(names).collect()}
    assert got == {"400001": ("non_monetary", 1), "410000": ("revenue", 1), "510001": ("variable", -1), "520001": ("fixed", -1), "500000": ("subtotal", 1), "530001": ("other", 1)}


def test_reference_tables(spark):
    rates = spark.createDataFrame([("2026-Q1", "EUR", Decimal("4.5")), ("2026-01", "PLN", Decimal(2)), ("2026-02", "USD", Decimal(0))], "period string, currency string, rate decimal(18,8)")
    assert reference.expand_rate_periods(rates).count() == 5
    assert sorted(r["message"] for r in reference.rate_faults(rates, "PLN").collect()) == ["rate is not positive", "reporting currency is not 1"]
    rules = spark.createDataFrame([("A", "COGS", 1), ("a", "NOPE", 2), ("", "COGS", 1)], "account_code string, statement_line string, sign_multiplier int")
    assert sorted(r["message"] for r in reference.account_rule_faults(rules).collect()) == ["code is blank", "code is given twice", "sign is not 1 or -1", "unknown statement line"]


def test_additivity(spark):
    m = spark.createDataFrame([("a", "1", 1.0, 10.0, 2.0), ("a", "2", 2.0, 30.0, 4.0)], "k string, p string, qty double, stock double, dio double")
    r = star.additivity_safe_rollup(m, ["k"], "p", {"qty": "ADDITIVE", "stock": "SEMI_ADDITIVE", "dio": ("WEIGHTED", "qty")}).first()
    assert (r["qty"], r["stock"]) == (3.0, 30.0) and r["dio"] == pytest.approx(10 / 3)
    with pytest.raises(ValueError, match="rolled up"):
        star.additivity_safe_rollup(m, ["k"], "p", {"qty": "NON_ADDITIVE"})


def test_repairs_of_split_rows():
    rows = [["1", "a", "x"], ["tail"], ["2", "b"], ["rest", "y"], [], ["3", "c"], ["4", "d", "z"], ["5"]]
    got, n = landing.repair_rows(rows[:2], 3)
    assert got == [["1", "a", "x tail"]] and n == 1
    assert landing.repair_rows(rows[2:4], 3) == ([["2", "b rest", "y"]], 1)
    assert landing.repair_rows([["3", "c"]], 3) == ([["3", "c"]], 0)


def test_broken_file(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('report\n\n\nId;Name;Balance\n1;"a;b";"1 234,50"\n2;cut\nname;"1.000.000,00"\n3;c;x\nmore\n', encoding="utf-8")
    table, stats = landing.clean_table(spark, str(p), ";")
    assert sorted(tuple(r) for r in table.collect()) == [("1", "a;b", "1234.50"), ("2", "cut name", "1000000.00"), ("3", "c", "x more")]
    assert stats.first()["rows"] == 3
    wide = landing.indexed_records(spark, str(p), ";")
    with pytest.raises(ValueError, match="over 1 cells"):
        landing.reject_overwide_records(wide, 1, fail=True)


def test_encodings_and_delimiters(spark, tmp_path):
    samples = {"utf-8": "zażółć;1\ngęś;2\n", "cp1250": "zażółć;1\ngęś;2\n", "utf-16": "a;1\nb;2\n", "cp949": "갂래선;1\n상품;2\n"}
    for name, t in samples.items():
        (tmp_path / f"{name}.csv").write_bytes(t.encode(name))
    got = {r["path"].rsplit("/", 1)[1]: r for r in landing.profile_landing_files(spark, str(tmp_path), "*.csv").collect()}
    assert {n: got[f"{n}.csv"]["encoding"] for n in samples} == {n: n for n in samples}
    assert all(r["delimiter"] == ";" and r["columns"] == 2 and len(r["sha256"]) == 64 for r in got.values())
    assert landing.header_names(["﻿a ", "", "a", None]) == ["a", "Column2", "a_1", "Column4"]


def test_encodings_of_long_files(spark, tmp_path):
    """Legacy letters after an ASCII start of over 1 MB, at 33 or 66 % of the file or anywhere in its first MB."""
    plain, pl, ko = "abc;1\n" * 200_000, "zażółć;1\n" * 150_000, "갂래선;1\n" * 150_000
    files = {"cp1250": (plain + pl).encode("cp1250"), "cp949": (plain + ko).encode("cp949"), "utf-8": (plain + pl).encode(), "early": ("abc;1\n" * 20_000 + "ś;1\n" + plain).encode("cp1250"), "ascii": plain.encode()}
    # The start and the probes decode as cp1250; the end has bytes that it lacks.
    files["ends"] = b"abc;1\n" * 200_000 + "가;1\n".encode("cp949") * 300_000 + "갂;1\n".encode("cp949") * 100
    for n, raw in files.items():
        (tmp_path / f"{n}.csv").write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1][:-4]: r["encoding"] for r in landing.profile_landing_files(spark, str(tmp_path), "*.csv").collect()}
    assert got == {"cp1250": "cp1250", "cp949": "cp949", "utf-8": "utf-8", "early": "cp1250", "ascii": "utf-8", "ends": "cp949"}
    shifted = ["래선상품갂갂".encode("cp949")[1:]]
    assert landing.guess_encoding(b"abc", shifted) == "cp949"


def test_queries_see_whole_tables(spark, monkeypatch):
    """Number and date queries against plain versions over all forms; profiles are given all rows."""
    import re
    from collections import Counter
    from decimal import Decimal, InvalidOperation

    from tallyforge.operators import profile
    from tallyforge.plans import queries

    sf = "/root/testdata/sf0.001"
    tables = queries.Source(spark, sf)

    def number(t):
        x = (t or "").strip(" ")
        eu = re.fullmatch("[+-]?[0-9]{1,3}([ .][0-9]{3})+,[0-9]+", x) or re.fullmatch("[+-]?[0-9]+,([0-9]{1,2}|[0-9]{4,})", x)
        try:
            return float(Decimal(x.replace(".", "").replace(" ", "").replace(",", ".") if eu else x.replace(",", "")))
        except InvalidOperation:
            return None

    def period(t):
        for g in ("^([0-9]{4})[-./_]([0-9]{1,2})$", "^([0-9]{4})([0-9]{2})$", "^([0-9]{4})([0-9]{2})[0-9]{2}$", r"([0-9]{4}|[0-9]{2})[년./\s]+([0-9]{1,2})월?"):
            m = re.search(g, (t or "").strip())
            if m and 1 <= int(m[2]) <= 12:
                return f"{m[1] if len(m[1]) == 4 else '20' + m[1]}-{int(m[2]):02d}"

    texts = tables.numtext.collect()
    want = Counter((r["l_orderkey"], r["l_linenumber"], number(r["t"])) for r in texts)
    assert any("e" in (r["t"] or "") for r in texts)
    assert Counter(tuple(r) for r in queries.QUERIES["parse_number_auto_all_forms"](spark, sf).select("l_orderkey", "l_linenumber", "v").collect()) == want
    want = {r["o_orderkey"]: period(r["t"]) for r in tables.datetext.collect()}
    assert {k % 10 for k in want} == set(range(10))
    assert {r["o_orderkey"]: r["period"] for r in queries.QUERIES["normalize_period_all_forms"](spark, sf).collect()} == want

    seen = {}
    infer, inner = profile.infer_precision_scale, profile.inspect_schema
    monkeypatch.setattr(profile, "infer_precision_scale", lambda df, columns: seen.update(numbers=df.count()) or infer(df, columns))
    monkeypatch.setattr(profile, "inspect_schema", lambda df, *a, **k: seen.update(files=df.count()) or inner(df, *a, **k))
    assert [tuple(r) for r in queries.QUERIES["infer_precision_scale"](spark, sf).collect()] == [("t", 18, 2)]
    assert queries.QUERIES["inspect_schema"](spark, sf).count() == 3
    assert seen == {"numbers": len(texts), "files": tables.files.count()} and seen["files"] > 1000


def test_publishing(spark, tmp_path):
    target = str(tmp_path / "t")
    df = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "period string, v int")
    with pytest.raises(PermissionError):
        sinks.publish_versioned_snapshot(df, target, "period", False)
    one = sinks.publish_versioned_snapshot(df, target, "period", True)
    now = sinks.publish_versioned_snapshot(df.limit(1), target, "period", True, seen=1)
    assert (one["version"], now["version"]) == (1, 2) and spark.read.parquet(now["path"]).count() == 1
    assert spark.read.parquet(one["path"]).count() == 2
    with pytest.raises(StaleRevision):  # a publisher that has seen the first version only
        sinks.publish_versioned_snapshot(df, target, "period", True, seen=1)
    df.limit(1).write.mode("append").parquet(now["path"])
    with pytest.raises(PermissionError, match="isn't as it was published"):
        sinks.publish_versioned_snapshot(df, target, "period", True)
    made = sinks.export_candidate(df, str(tmp_path / "c"), "x", {"model": "m"})
    assert made["rows"] == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.export_candidate(df, str(tmp_path / "c"), "x")


def test_stream_of_files(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.csv").write_text("period,v\n202401,1\n2024-02,2\n")
    run = lambda: stream_period_files(spark, str(land), "period string, v int", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert run()
    (land / "b.csv").write_text("period,v\n2024.2,7\n")
    assert run()
    store = Revisions(spark, str(tmp_path / "out"))
    assert sorted((r["period"], r["v"]) for r in store.read("rows", store.current()).collect()) == [("2024-01", 1), ("2024-02", 7)]
    assert store.current().number == 2 and store.current().details["batch"] == 1


def test_sampled_key_uniqueness(spark):
    df = spark.createDataFrame([("2024-01", "a"), ("2024-01", " a "), ("2024-01", None), ("2024-01", ""), ("", "b"), (None, "b"), ("2024-02", "a"), ("2024-02", "a")], "p string, k string")
    look = lambda *a: tuple(periods.sampled_key_uniqueness(df, *a).first())
    assert look("p", ["k"]) == (3, 8) and look("p", ["k"], 7) == (2, 7) and look("p", ["k"], None) == (3, 8)
    assert look("q", ["k"]) == look("p", ["q"]) == look("p", []) == look("p", ["p"]) == (0, 0)
    assert tuple(periods.sampled_key_uniqueness(df.limit(0), "p", ["k"]).first()) == (0, 0)


def premart_facts(spark):
    d = lambda x: Decimal(x)
    pnl = spark.createDataFrame([("m", "a", 1, "C1", d("1.50")), ("m", "a", 1, "C1", d("2.25")), ("m", "a", -1, "Z", d("0.25")), ("m", "a", -1, "Y", None), ("m", "b", 2, "C2", d("4.00"))], "period string, code string, sk long, customer string, amount decimal(12,2)")
    stock = spark.createDataFrame([("m", "a", "w1", d("10.000000"), d("3.000000")), ("m", "a", "w2", d("30.000000"), d("5.000000")), ("m", "c", "w1", d("-1.000000"), d("8.000000")), ("m", "c", None, d("0.000000"), None)], "period string, code string, w string, value decimal(18,6), dio decimal(12,6)")
    offers = spark.createDataFrame([("m", "b", "k1", d("7.10")), ("m", "b", "k1", None), ("m", "b", "k2", d("8.10")), ("n", "a", "k2", None)], "period string, code string, channel string, price decimal(12,2)")
    return pnl, stock, offers


def test_premarts_equal_the_joined_ones_with_one_shuffle(spark):
    pnl, stock, offers = premart_facts(spark)
    grain = ["period", "code"]
    want = star.drill_across({"p": star.product_premart(pnl, grain, ["amount"], "sk", "customer"), "i": star.inventory_premart(stock, grain, "value", [], "w"), "o": star.price_premart(offers, grain, ["price"], "channel")}, grain)
    got = star.premarts([star.PremartPart(pnl, "customers", star.customer("sk", "customer"), ["amount"]), star.PremartPart(stock, "warehouses", F.col("w"), ["value"], weight="value"), star.PremartPart(offers, "channels", F.col("channel"), prices=["price"])], grain)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and want.count() == 4
    assert dict(got.dtypes) == dict(want.dtypes)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_premarts_of_dealt_facts_need_no_shuffle(spark):
    facts = premart_facts(spark)
    grain, more = ["code", "period"], [("m", "b", "w9", Decimal(2), None), ("n", "a", "w1", Decimal(3), Decimal(4))]
    facts = [facts[0], facts[1].unionByName(spark.createDataFrame(more, facts[1].schema)), facts[2]]
    parts = lambda p, i, o: [star.PremartPart(p, "customers", star.customer("sk", "customer"), ["amount"]), star.PremartPart(i, "warehouses", F.col("w"), ["value"], weight="value"), star.PremartPart(o, "channels", F.col("channel"), prices=["price"])]
    want = star.premarts(parts(*facts), grain)
    dealt = [written_dealt(f.repartition(3, "code"), scratch_folder(spark), "code", 3, grain) for f in facts]
    with as_dealt(spark, 3):
        got = star.dealt_premarts(parts(*dealt), grain)
        rows = sorted(map(repr, got.select(*want.columns).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
    assert rows == sorted(map(repr, want.collect())) and len(rows) == 4
    assert "hashpartitioning" not in plan
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None  # as they were


def test_a_join_leaves_rows_in_their_buckets(spark):
    rows, dim = spark.range(300).select((F.col("id") % 40).cast("string").alias("code"), "id"), spark.range(40).select(F.col("id").cast("string").alias("nk"), F.col("id").alias("sk"))
    path = scratch_folder(spark)
    with as_dealt(spark, 3):  # fewer than the session's shuffle partitions
        joined = star.lookup_surrogate_left(rows.repartition(3, "code"), dim.hint("merge"), "code", "nk", "sk", "key", exact=True)
        got = written_dealt(joined, path, "code", 3, ["code", "key"])
        once = got.groupBy("code", "id").count()
        assert "hashpartitioning" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 300
    assert len(got.inputFiles()) == 3


def test_sums_by_grain_are_compared_without_dealing_rows(spark):
    pnl, _, _ = premart_facts(spark)
    grain = ["period", "code"]
    mart = pnl.groupBy(*grain).agg(F.sum("amount").alias("amount"))
    assert star.same_by_grain(mart, [(pnl, ["amount"])], grain)
    moved = mart.withColumn("amount", F.when(F.col("code") == "a", F.col("amount") + 1).otherwise(F.col("amount") - 1))  # the total stays
    assert not star.same_by_grain(moved, [(pnl, ["amount"])], grain)
    split = mart.unionByName(mart.withColumn("amount", F.lit(0).cast("decimal(22,2)")))
    assert not star.same_by_grain(split, [(pnl, ["amount"])], grain)
    assert not star.same_by_grain(mart.withColumn("amount", F.lit("1e15").cast("decimal(38,6)")), [(pnl, ["amount"])], grain)
