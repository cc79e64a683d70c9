"""The driver's contract: queries and oracles agree on the smallest tables, for a sample of each kind."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("aggregate_spec", "first_match_classify", "parse_number_auto", "waterfall_rollup", "interval_overlap_self_join", "assign_surrogate_keys", "replace_periods", "drill_across_full_outer", "scan_incoming_folder", "clean_table_statistics", "normalize_period", "mart_load_export", "price_check", "sketched_cardinality", "additivity_safe_rollup")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = entry.queries()[name](spark, d)
    want = con.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    key = lambda r: repr(r)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    at = [want.columns.index(c) for c in order]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_every_oracle_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
    assert entry.entry(spark).count() > 0


def test_the_library_stands_without_its_optional_part():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "tallyforge").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tallyforge.llm" not in p.read_text()
