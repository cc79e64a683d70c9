"""Suggested roles: by names alone, by values, and in wide tables."""

import pytest

from tallyforge.operators import profile, roles


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "column string, rows long, distinct_values long, role string")


def got(df):
    return {r["column"]: (r["role"], r["dimension"], r["kind"]) for r in df.collect()}


def test_korean_names(nothing):
    r = got(roles.suggest_roles(nothing, ["기준년월", "법인코드", "전표번호", "거래처코드", "거래처명", "상품코드", "상품명", "매출액", "매출원가", "판매수량", "비고"]))
    assert (r["기준년월"][0], r["법인코드"][0]) == ("period", "partition")
    assert r["거래처코드"][:2] == ("dim_key", "고객/거래처") and r["거래처명"][:2] == ("dim_attr", "고객/거래처")
    assert r["상품코드"][:2] == ("dim_key", "제품/품목") and r["상품명"][:2] == ("dim_attr", "제품/품목")
    assert (r["매출액"], r["매출원가"], r["판매수량"]) == (("measure", None, "value"), ("measure", None, "cost"), ("measure", None, "quantity"))
    assert r["전표번호"][0] == "row_key" and r["비고"][0] == "unassigned"


def test_english_families(nothing):
    names = ["YYYYMM", "Division", "Subsidiary", "Subsidiary(R&R)", "Product Lvl4 Code", "Product Lvl4", "Model Suffix", "Bill To Customer", "Bill To Customer Name", "Ship To Customer", "Ship To Customer Name", "Net Sales"]
    r = got(roles.suggest_roles(nothing, names))
    assert r["Product Lvl4 Code"][:2] == ("dim_key", "Product_Lvl4") and r["Product Lvl4"][:2] == ("dim_attr", "Product_Lvl4")
    assert r["Model Suffix"][:2] == ("dim_key", "Product_Lvl4") and r["Division"][0] == "dim_key"
    assert (r["Subsidiary"][0], r["Subsidiary(R&R)"][0], r["Net Sales"][0], r["YYYYMM"][0]) == ("partition", "dim_attr", "measure", "period")
    for side in ("Bill", "Ship"):
        assert r[f"{side} To Customer"][:2] == ("dim_key", f"{side}_To_Customer") and r[f"{side} To Customer Name"][0] == "dim_attr"
    assert "unassigned" not in {x[0] for x in r.values()}


def test_families_without_a_head(nothing):
    r = got(roles.suggest_roles(nothing, ["YYYYMM", "Product Lvl4 Code", "Product Lvl4 Model Suffix", "Internal Exp Amount", "External Revenue"]))
    assert r["Product Lvl4 Code"][0] == "dim_key" and r["Product Lvl4 Model Suffix"][0] == "dim_attr" and r["Product Lvl4 Code"][1] == r["Product Lvl4 Model Suffix"][1]
    assert r["Internal Exp Amount"][0] == r["External Revenue"][0] == "measure"


def test_values_decide_before_names(spark):
    df = spark.createDataFrame([(f"2024-{m:02d}", f"x{m % 2}", f"{m}.5", f"{m:03d}", f"n{m}", "PLN") for m in range(1, 13)], "col1 string, entity string, abc string, zip string, line_id string, currency string")
    r = got(roles.suggest_roles(profile.profile_columns(df), df.columns))
    assert r == {"col1": ("period", None, None), "entity": ("partition", None, None), "abc": ("measure", None, "value"), "zip": ("unassigned", None, None), "line_id": ("row_key", None, None), "currency": ("dim_key", "통화", None)}


def test_wide_tables_and_edges(spark, nothing):
    wide = spark.createDataFrame([("2024-01", *[str(k) for k in range(10)], None)], ", ".join(["period string", *[f"m{k} string" for k in range(10)], "zz string"]))
    assert got(roles.suggest_roles(profile.profile_columns(wide), wide.columns))["zz"] == ("measure", None, "value")
    few = wide.drop("m9")
    assert got(roles.suggest_roles(profile.profile_columns(few), few.columns))["zz"][0] == "unassigned"
    assert got(roles.suggest_roles(nothing, ["only"])) == {"only": ("period", None, None)}
    assert got(roles.suggest_roles(nothing, [])) == {}
