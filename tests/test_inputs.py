"""Inputs of the queries."""

from tallyforge.plans.inputs import INPUTS, Source
from tallyforge.plans.queries import QUERIES


def test_base_meets_customers_before_lines_and_is_written_once(spark):
    s = Source(spark, "/root/testdata/sf0.001")
    plain = s.spark.sql(INPUTS["base"], lineitem=s.lineitem, orders=s.orders, customer=s.customer, part=s.part)
    whole = Source(spark, s.dir).stored("base")
    assert whole.columns == plain.columns
    assert whole.exceptAll(plain).isEmpty() and plain.exceptAll(whole).isEmpty()
    base = s.stored("base", "l_linenumber", "period", "entity", "warehouse_code", "product_code", "currency", "qty", "price")
    assert base.count() == plain.count() and s.base is base
    plan = s.inv._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_joins_of_shuffled_rows_sort_no_side(spark):
    star_rejoin = QUERIES["star_rejoin"]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    whole = sorted(star_rejoin(spark, "/root/testdata/sf0.001").collect())
    spark.conf.set(limit, "-1")
    try:
        df = star_rejoin(spark, "/root/testdata/sf0.001")
        assert sorted(df.collect()) == whole
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set(limit, before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_sessions_own_limit_of_hash_tables_stays(spark):
    limit = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1m")
    try:
        Source(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.set(limit, before)


def test_shares_grow_with_a_table(spark):
    s = Source(spark, "/root/testdata/sf0.001")
    n = s.lineitem.count()
    assert s.shares("lineitem", 100) == -(-n // 100) and s.shares("lineitem", n) == spark.sparkContext.defaultParallelism
