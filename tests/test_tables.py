"""Reference tables from files: shapes, precedence, and what is refused."""

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.reference import period_months, rate_entry_faults, rates_for, rule_entry_faults
from tallyforge.sources import tables


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def pairs(df):
    return {(r["period"], r["currency"]): r["rate"] for r in df.collect()}


def test_period_months(spark):
    df = spark.createDataFrame([(t,) for t in ["2024", "2024-q2", "2024Q4", "202403", "2024/12", " 2024-01 ", "default", "2024-13", "1899", "2024-Q5", "x", "", None]], "t string").select("t", period_months(F.col("t")).alias("m"))
    got = {r["t"]: r["m"] for r in df.collect()}
    assert got["2024"] == [f"2024-{m:02d}" for m in range(1, 13)] and got["2024-q2"] == ["2024-04", "2024-05", "2024-06"]
    assert (got["2024Q4"][0], got["202403"], got["2024/12"], got[" 2024-01 "], got["default"]) == ("2024-10", ["2024-03"], ["2024-12"], ["2024-01"], ["DEFAULT"])
    assert all(got[t] is None for t in ("2024-13", "1899", "2024-Q5", "x", "", None))


def test_rates_from_json(spark, tmp_path):
    path = put(tmp_path, "fx.json", "\ufeff" + json.dumps({"2024-01": {"eur": 4.5, "PLN": 1}, "2024-Q1": {"EUR": "4,3"}, "2024-02": {"EUR": 4.4}, "DEFAULT": {"USD": 4}}))
    last, short = pairs(tables.load_rates(spark, path, "PLN")), pairs(tables.load_rates(spark, path, "PLN", specific=True))
    assert last == {("2024-01", "EUR"): D("4.3"), ("2024-02", "EUR"): D("4.4"), ("2024-03", "EUR"): D("4.3"), ("2024-01", "PLN"): 1, ("DEFAULT", "USD"): 4}
    assert short == {**last, ("2024-01", "EUR"): D("4.5")}


def test_rates_from_csv(spark, tmp_path):
    path = put(tmp_path, "fx.csv", '\ufeff Period ,Currency,rate\n2024,EUR,"4,5"\n,,\n2024-02,eur,4.6\n')
    got = pairs(tables.load_rates(spark, path, "PLN"))
    assert len(got) == 12 and (got["2024-01", "EUR"], got["2024-02", "EUR"]) == (D("4.5"), D("4.6"))


@pytest.mark.parametrize(
    ("text", "message"),
    [('{"2024-01": {"EUR": -1}}', "not positive"), ('{"2024-01": {"PLN": 1.1}}', "reporting currency"), ('{"2024-01": {"EUR": "x"}}', "not a number"), ('{"2024-99": {"EUR": 1}}', "period can't be read"), ('{"2024-01": {"EUR": NaN}}', "not a number|incomplete"), ("[1]", "incomplete"), ("no json", "incomplete"), ("{}", "incomplete|no rates"), ("", "no rates")],
)
def test_refused_rates(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        tables.load_rates(spark, put(tmp_path, "fx.json", text), "PLN")
    with pytest.raises(ValueError, match="neither CSV nor JSON"):
        tables.load_rates(spark, put(tmp_path, "fx.txt", text), "PLN")


def test_rates_without_their_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="has the columns"):
        tables.load_rates(spark, put(tmp_path, "fx.csv", "period,fx_rate\n2024,1\n"), "PLN")
    faults = rate_entry_faults(tables.scan_rates(spark, put(tmp_path, "gap.csv", "period,currency_code,fx_rate\n2024-01,,1\n2024-02,EUR,\n")), "PLN")
    assert [r["message"] for r in faults.collect()] == ["entry is incomplete"] * 2


def test_default_rates(spark):
    rates = spark.createDataFrame([("2024-01", "EUR", D("4.5")), ("DEFAULT", "EUR", D("4")), ("DEFAULT", "USD", D("3"))], "period string, currency string, rate decimal(18,8)")
    wanted = spark.createDataFrame([("2024-01", "EUR"), ("2024-01", "EUR"), ("2024-02", "EUR"), ("2024-02", "PLN"), ("2024-02", "CHF")], "period string, currency string")
    got = {(r["period"], r["currency"]): (r["rate"], r["basis"]) for r in rates_for(wanted, rates, "PLN", fallback=True).collect()}
    assert got == {("2024-01", "EUR"): (D("4.5"), "month"), ("2024-02", "EUR"): (4, "default"), ("2024-02", "PLN"): (1, "reporting"), ("2024-02", "CHF"): (None, None)}
    assert pairs(rates_for(wanted, rates, "PLN"))["2024-02", "EUR"] is None


RULE = {"account_code": "A1", "account_name": "Sales", "statement_line": "gross_revenue", "waterfall_step": "gross_margin", "cost_category": "revenue", "sign_multiplier": 1, "is_subtotal": False}


@pytest.mark.parametrize("shape", ["rules", "list", "keyed", "csv"])
def test_account_rules(spark, tmp_path, shape):
    second = {**RULE, "account_code": " B2", "statement_line": "COGS", "cost_category": "COGS", "sign_multiplier": "-1", "is_subtotal": "yes"}
    both = [RULE, second]
    if shape == "csv":
        path = put(tmp_path, "rules.csv", ",".join(RULE) + "\n" + "".join(",".join(str(v) for v in r.values()) + "\n" for r in both))
    else:
        path = put(tmp_path, "rules.json", json.dumps({"rules": {"rules": both}, "list": both, "keyed": {r["account_code"]: {k: v for k, v in r.items() if k != "account_code"} for r in both}}[shape]))
    got = [tuple(r) for r in tables.load_account_rules(spark, path).orderBy("account_code").collect()]
    assert got == [("A1", "Sales", "GROSS_REVENUE", "GROSS_MARGIN", "REVENUE", 1, False), ("B2", "Sales", "COGS", "GROSS_MARGIN", "COGS", -1, True)]


@pytest.mark.parametrize(
    ("change", "message"),
    [({"sign_multiplier": 2}, "sign"), ({"sign_multiplier": True}, "sign"), ({"sign_multiplier": "1.0"}, "sign"), ({"is_subtotal": "maybe"}, "neither true nor false"), ({"waterfall_step": "X"}, "unknown waterfall step"), ({"cost_category": "X"}, "unknown cost category"), ({"statement_line": "X"}, "unknown statement line"), ({"account_name": " "}, "name is blank"), ({"account_code": ""}, "code is blank"), ({"account_name": None}, "lacks account_name")],
)
def test_refused_rules(spark, tmp_path, change, message):
    path = put(tmp_path, "rules.json", json.dumps([{**RULE, **change}]))
    assert any(message in r["message"] for r in rule_entry_faults(tables.scan_account_rules(spark, path)).collect())
    with pytest.raises(ValueError, match=message):
        tables.load_account_rules(spark, path)


def test_rules_given_twice_or_not_at_all(spark, tmp_path):
    with pytest.raises(ValueError, match="given twice"):
        tables.load_account_rules(spark, put(tmp_path, "twice.json", json.dumps([RULE, RULE])))
    with pytest.raises(ValueError, match="lacks the columns"):
        tables.load_account_rules(spark, put(tmp_path, "few.csv", "account_code\nA\n"))
    for text in ("[]", '{"rules": []}', "{}", "oops"):
        with pytest.raises(ValueError):
            tables.load_account_rules(spark, put(tmp_path, "none.json", text))
