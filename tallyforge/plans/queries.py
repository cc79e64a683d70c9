"""One query per operator over the given tables, and its oracle where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import dates, money, numbers, text
from tallyforge.operators import aggregate as agg
from tallyforge.operators import filters as flt
from tallyforge.operators import flows, mapping, periods, profile, ranges, roles, star
from tallyforge.operators import mart as mt
from tallyforge.operators.filters import Condition as C
from tallyforge.operators.filters import Rule
from tallyforge.session import scratch_folder
from tallyforge.sources import landing, sinks, tables
from tallyforge.sources.revisions import Revisions, StaleRevision

from .inputs import Source, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(make: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Source(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return make

    return register


def dbl(df: DataFrame, *names: str) -> DataFrame:
    """Exact decimals as doubles, to compare."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- scans and sinks

S3COLS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
CUSTOMER_TEXT = "SELECT CAST(c_custkey AS STRING) AS c_custkey, c_name, CAST(c_nationkey AS STRING) AS c_nationkey, c_mktsegment FROM {customer}"


def landed(s: Source, sep: str = ";", charset: str = "windows-1250") -> str:
    path = scratch_folder(s.spark)
    s.sql(CUSTOMER_TEXT).write.option("header", True).option("sep", sep).option("encoding", charset).csv(path)
    return path


@query("scan_delimited_text", CUSTOMER_TEXT)
def _(s):
    s.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return landing.scan_delimited_text(s.spark, landed(s), ";", "cp1250", S3COLS)


@query("profile_landing_files", """SELECT 'utf-8' AS encoding, ';' AS delimiter, CAST(4 AS INTEGER) AS columns, CAST(sum(length(CAST(c_custkey AS STRING)) + length(c_name) + length(CAST(c_nationkey AS STRING)) + length(c_mktsegment) + 4) AS BIGINT) AS bytes FROM {customer}""")
def _(s):
    header = len(";".join(S3COLS)) + 1
    out = landing.profile_landing_files(s.spark, landed(s, ";", "UTF-8"), "*.csv")
    return out.groupBy("encoding", "delimiter", "columns").agg((F.sum("size") - header * F.count(F.lit(1))).alias("bytes"))


#: A file for each nation; its records have two cells, but for those of every seventh customer, which have three.
LANDED_RECORDS = "(SELECT CAST(c_nationkey AS STRING) AS file, c_custkey AS line, CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 2 END AS width, c_name FROM {customer})"


@query("find_table_header", f"""SELECT h.file, h.header, r.c_name AS first_name, CAST((SELECT count(*) FROM {LANDED_RECORDS} AS b WHERE b.file = h.file AND b.line < h.header) AS BIGINT) AS skipped
    FROM (SELECT a.file, min(a.line) AS header FROM {LANDED_RECORDS} AS a JOIN (SELECT file, max(width) AS n FROM {LANDED_RECORDS} AS m GROUP BY file) AS w ON a.file = w.file AND a.width = w.n GROUP BY a.file) AS h JOIN {LANDED_RECORDS} AS r ON r.file = h.file AND r.line = h.header""")
def _(s):
    cells = F.when(F.col("c_custkey") % 7 == 0, F.array("c_name", "c_mktsegment", "c_phone" if "c_phone" in s.customer.columns else "c_mktsegment")).otherwise(F.array("c_name", "c_mktsegment"))
    records = s.customer.select(F.col("c_nationkey").cast("string").alias("file"), F.col("c_custkey").alias("line"), cells.alias("cells"))
    return landing.find_table_header(records).select("file", "header", F.get("names", F.lit(0)).alias("first_name"), "skipped")


@query("reject_overwide_records", "SELECT c_custkey FROM (SELECT CAST(c_custkey AS STRING) AS c_custkey, c_name FROM {customer}) AS t WHERE CAST(c_custkey AS BIGINT) % 100 = 0")
def _(s):
    path = scratch_folder(s.spark)
    s.customer.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"a,'), "c_name", F.lit('"')), F.when(F.col("c_custkey") % 100 == 0, "extra")).alias("line")).write.text(path)
    return landing.reject_overwide_records(landing.indexed_records(s.spark, path, ","), 2).select(F.get("cells", F.lit(0)).alias("c_custkey"))


#: A file for each period, and one for each priority in June and December. Those of 1995 are known; for 1994 others were.
INBOX = "(SELECT DISTINCT CASE WHEN CAST(substring(period, 6, 2) AS INTEGER) % 6 = 0 THEN concat(period, '_', file) ELSE concat('sales_', period, '.csv') END AS file, period FROM {files})"


@query("scan_incoming_folder", f"""SELECT f.file, f.period, CASE WHEN substring(f.period, 6, 2) = '11' THEN 'missing_columns' WHEN substring(f.period, 6, 2) = '10' THEN 'order_mismatch' ELSE 'ok' END AS header_state,
    CASE WHEN substring(f.period, 1, 4) = '1995' THEN 'unchanged' WHEN n > 1 THEN 'conflict' WHEN substring(f.period, 1, 4) = '1994' THEN 'modified_period' ELSE 'new_period' END AS status
    FROM {INBOX} AS f JOIN (SELECT period, count(*) AS n FROM {INBOX} AS g GROUP BY period) AS h ON f.period = h.period""")
def _(s):
    once = s.files.select(F.when(F.substring("period", 6, 2).cast("int") % 6 == 0, F.concat("period", F.lit("_"), "file")).otherwise(F.concat(F.lit("sales_"), "period", F.lit(".csv"))).alias("file"), "period").distinct()
    month = F.substring("period", 6, 2)
    header = F.when(month == "11", F.array(F.lit("period"))).when(month == "10", F.array(F.lit("amount"), F.lit("period"))).otherwise(F.array(F.lit("period"), F.lit("amount")))
    incoming = once.withColumns({"hash": F.sha2("file", 256), "header": header})
    year = F.substring("period", 1, 4)
    history = incoming.where(year == "1995").select("file", "hash", "period").unionByName(incoming.where(year == "1994").select("file", F.lit("old").alias("hash"), "period"))
    return landing.scan_incoming_folder(incoming, history, baseline=["period", "amount"]).select("file", "period", "header_state", "status")


@query("distinct_periods_per_file", "SELECT DISTINCT file, period FROM {files}")
def _(s):
    return periods.distinct_periods_per_file(s.files, "file", "period_raw")


@query("scan_parquet", "SELECT r_regionkey, r_name FROM {region}")
def _(s):
    return s.region


@query("scan_master_records", "SELECT upper(trim(concat(' c', CAST(c_custkey AS STRING)))) AS code, CASE WHEN trim(c_mktsegment) = '' THEN 'UNKNOWN' ELSE trim(c_mktsegment) END AS segment, 'UNKNOWN' AS country FROM {customer}")
def _(s):
    return star.scan_master_records(s.customer.select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_mktsegment").alias("segment")), "code", ["segment", "country"])


@query("validated_reference_tables", """SELECT kind, key, message FROM (SELECT 'rate' AS kind, concat(period, ' ', currency) AS key, 'reporting currency is not 1' AS message FROM {rates} WHERE currency = 'PLN' AND rate <> 1
    UNION ALL SELECT 'rate' AS kind, concat(period, ' ', currency) AS key, 'rate is not positive' AS message FROM {rates} WHERE currency = 'USD' AND rate - 3.85 <= 0) AS t""")
def _(s):
    from tallyforge.operators.reference import rate_faults

    shifted = s.rates.withColumn("rate", F.when(F.col("currency") == "USD", F.col("rate") - F.lit(3.85).cast("decimal(18,8)")).otherwise(F.col("rate")))
    return rate_faults(shifted, "PLN")


RATE_ENTRIES = "(SELECT substr(period, 1, 4) AS token, currency, rate FROM {rates} WHERE period LIKE '%-01' UNION ALL SELECT concat(substr(period, 1, 4), '-Q2') AS token, currency, rate FROM {rates} WHERE period LIKE '%-06' UNION ALL SELECT period AS token, currency, rate FROM {rates} WHERE period LIKE '%-03' OR period LIKE '%-05')"
_MONTH_OF = "SELECT y.year, concat(y.year, '-', lpad(CAST(m AS VARCHAR), 2, '0')) AS period, m, currency FROM (SELECT DISTINCT substr(period, 1, 4) AS year, currency FROM {rates}) AS y CROSS JOIN range(1, 13) AS t(m)"


@query("rates_from_json", f"""SELECT n.period, n.currency, CAST(coalesce(q.rate, own.rate, a.rate) AS DOUBLE) AS last_rate, CAST(coalesce(own.rate, q.rate, a.rate) AS DOUBLE) AS shortest_rate FROM ({_MONTH_OF}) AS n
    LEFT JOIN (SELECT token, currency, rate FROM {RATE_ENTRIES} AS e) AS a ON a.token = n.year AND a.currency = n.currency LEFT JOIN (SELECT token, currency, rate FROM {RATE_ENTRIES} AS e) AS q ON q.token = concat(n.year, '-Q2') AND q.currency = n.currency AND m BETWEEN 4 AND 6
    LEFT JOIN (SELECT token, currency, rate FROM {RATE_ENTRIES} AS e) AS own ON own.token = n.period AND own.currency = n.currency WHERE coalesce(q.rate, own.rate, a.rate) IS NOT NULL""")
def _(s):
    """Years, months and quarters of one file, in that order of a year's tokens: the last and the shortest entry of each month."""
    path = scratch_folder(s.spark)
    every = s.sql(f"SELECT * FROM {RATE_ENTRIES} AS e").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("currency", F.col("rate").cast("string")))).alias("of"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("token", "of"))), lambda e: F.struct(e["token"], F.map_from_entries(e["of"])))
    every.agg(F.to_json(F.map_from_entries(tokens)).alias("value")).write.text(path)
    last, shortest = (tables.load_rates(s.spark, path, "PLN", "json", specific=x).withColumnRenamed("rate", n) for x, n in ((False, "last_rate"), (True, "shortest_rate")))
    return dbl(last.join(shortest, ["period", "currency"]), "last_rate", "shortest_rate")


@query("rates_with_default", """SELECT DISTINCT b.period, b.currency, CAST(CASE WHEN r.rate IS NOT NULL THEN r.rate WHEN b.currency = 'USD' THEN 3.5 WHEN b.currency = 'PLN' THEN 1 END AS DOUBLE) AS rate, CASE WHEN r.rate IS NOT NULL THEN 'month' WHEN b.currency = 'USD' THEN 'default' WHEN b.currency = 'PLN' THEN 'reporting' END AS basis
    FROM {base} AS b LEFT JOIN (SELECT * FROM {rates} WHERE currency <> 'PLN' AND (period LIKE '%-02' OR period LIKE '%-11')) AS r ON b.period = r.period AND b.currency = r.currency""")
def _(s):
    """The pairs of the facts, from a file of some months and a default for one currency."""
    from tallyforge.operators.reference import rates_for

    path = scratch_folder(s.spark)
    rows = s.sql("SELECT period, currency AS currency_code, CAST(rate AS STRING) AS fx_rate FROM {rates} WHERE currency <> 'PLN' AND (period LIKE '%-02' OR period LIKE '%-11') UNION ALL SELECT 'default' AS period, ' usd ' AS currency_code, '3,5' AS fx_rate FROM {region} WHERE r_regionkey = 0")
    sinks.write_result_csv(rows, path)
    return dbl(rates_for(s.base, tables.load_rates(s.spark, path, "PLN", "csv"), "PLN", fallback=True), "rate")


RULE_OF = """SELECT p_type AS account_code, concat(p_type, ' of ', CAST(min(p_size) AS STRING)) AS account_name, CASE min(p_partkey) % 3 WHEN 0 THEN 'GROSS_REVENUE' WHEN 1 THEN 'COGS' ELSE 'FIXED_SGNA' END AS statement_line,
    CASE min(p_partkey) % 3 WHEN 2 THEN 'OPERATING_PROFIT' ELSE 'GROSS_MARGIN' END AS waterfall_step, CASE min(p_partkey) % 3 WHEN 0 THEN 'REVENUE' WHEN 1 THEN 'COGS' ELSE 'FIXED_COST' END AS cost_category,
    CASE min(p_partkey) % 3 WHEN 0 THEN 1 ELSE -1 END AS sign_multiplier, min(p_partkey) % 2 = 0 AS is_subtotal FROM {part} GROUP BY p_type"""


@query("account_rules_from_json", RULE_OF)
def _(s):
    """Rules kept by their codes, written loosely, loaded, saved as a list and loaded again."""
    keyed, listed = scratch_folder(s.spark), scratch_folder(s.spark)
    loose = s.sql(RULE_OF).withColumns({"statement_line": F.concat(F.lit(" "), F.lower("statement_line")), "sign_multiplier": F.concat(F.col("sign_multiplier").cast("string"), F.lit(" ")), "is_subtotal": F.when(F.col("is_subtotal"), "Yes").otherwise("")})
    rule = F.struct(*[c for c in loose.columns if c != "account_code"])
    loose.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("account_code", rule.alias("rule")))))).alias("value")).write.text(keyed)
    tables.save_account_rules(tables.load_account_rules(s.spark, keyed, "json"), listed)
    return tables.load_account_rules(s.spark, listed, "json")


@query("reference_file_faults", """SELECT 'rate' AS kind, concat(period, ' ', currency) AS key, 'rate is not positive' AS message FROM {rates} WHERE period LIKE '%-02' UNION ALL SELECT 'rate', concat(period, ' ', currency), 'rate is not a number' FROM {rates} WHERE period LIKE '%-03'
    UNION ALL SELECT 'rate', period, 'entry is incomplete' FROM {rates} WHERE period LIKE '%-04' UNION ALL SELECT 'rate', concat(substr(period, 1, 4), '-13 ', currency), 'period can''t be read' FROM {rates} WHERE period LIKE '%-05'
    UNION ALL SELECT 'rate', concat(period, ' PLN'), 'reporting currency is not 1' FROM {rates} WHERE period LIKE '%-06' AND currency = 'PLN'
    UNION ALL SELECT 'account', upper(account_code), CASE WHEN statement_line = 'COGS' THEN 'unknown cost category' WHEN statement_line = 'FIXED_SGNA' THEN 'sign is not 1 or -1' ELSE 'subtotal is neither true nor false' END FROM (""" + RULE_OF + ") AS r")
def _(s):
    from tallyforge.operators.reference import rate_entry_faults, rule_entry_faults

    rates, rules = scratch_folder(s.spark), scratch_folder(s.spark)
    bad = s.sql("""SELECT CASE WHEN period LIKE '%-05' THEN concat(substr(period, 1, 4), '-13') ELSE period END AS period, CASE WHEN period LIKE '%-04' THEN '' ELSE currency END AS currency,
        CASE WHEN period LIKE '%-02' THEN '-1' WHEN period LIKE '%-03' THEN 'abc' WHEN period LIKE '%-06' AND currency = 'PLN' THEN '1,01' ELSE CAST(rate AS STRING) END AS rate FROM {rates}""")
    sinks.write_result_csv(bad, rates)
    line = F.col("statement_line")
    odd = s.sql(RULE_OF).withColumns({"cost_category": F.when(line == "COGS", "FREIGHT").otherwise(F.col("cost_category")), "sign_multiplier": F.when(line == "FIXED_SGNA", "1.0").otherwise(F.col("sign_multiplier").cast("string")), "is_subtotal": F.when(line == "GROSS_REVENUE", "maybe").otherwise(F.col("is_subtotal").cast("string"))})
    sinks.write_result_csv(odd, rules)
    return rate_entry_faults(tables.scan_rates(s.spark, rates, "csv"), "PLN").unionByName(rule_entry_faults(tables.scan_account_rules(s.spark, rules, "csv")))


def reread(s: Source, df: DataFrame, **kw) -> DataFrame:
    path = scratch_folder(s.spark)
    sinks.write_parquet(df, path, **kw)
    return s.spark.read.schema(df.schema).parquet(path)


@query("write_result_csv", "SELECT CAST(l_orderkey AS STRING) AS l_orderkey, replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',') AS price FROM {lineitem}")
def _(s):
    path = scratch_folder(s.spark)
    sinks.write_result_csv(s.lineitem.select("l_orderkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("price")), path, polish=True)
    return landing.scan_delimited_text(s.spark, path, ";")


@query("write_parquet", "SELECT o_orderkey, o_orderstatus FROM {orders}")
def _(s):
    return reread(s, s.orders.select("o_orderkey", "o_orderstatus"), by=["o_orderstatus"])


@query("publish_versioned_snapshot", "SELECT period, o_orderkey FROM {files} WHERE o_orderkey % 2 = 1")
def _(s):
    target = scratch_folder(s.spark)
    sinks.publish_versioned_snapshot(s.files.select("period", "o_orderkey"), target, "period", True, seen=0)
    try:
        sinks.publish_versioned_snapshot(s.files.select("period", "o_orderkey"), target, "period", True, seen=0)
        raise AssertionError("a publisher that had seen no version wasn't refused")
    except StaleRevision:
        pass
    now = sinks.publish_versioned_snapshot(s.files.where("o_orderkey % 2 = 1").select("period", "o_orderkey"), target, "period", True)
    return s.spark.read.parquet(now["path"])


@query("export_bundle", "SELECT 'nation' AS name, CAST(count(*) AS BIGINT) AS n FROM {nation} UNION ALL SELECT 'region' AS name, CAST(count(*) AS BIGINT) AS n FROM {region}")
def _(s):
    now = sinks.export_bundle({"nation": s.nation, "region": s.region}, scratch_folder(s.spark))
    read = lambda n: s.spark.read.parquet(now["paths"][n]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return read("nation").unionByName(read("region"))


@query("export_candidate", "SELECT s_suppkey, s_name FROM {supplier}")
def _(s):
    return s.spark.read.parquet(sinks.export_candidate(s.supplier.select("s_suppkey", "s_name"), scratch_folder(s.spark), "a")["path"])


# --- projection and filters

SPEC = agg.AggregationSpec(
    keys=["month", "division", "customer"], measures=["qty", "sales"], groups=[agg.ColumnGroup("costs", ["cost1", "cost2", "cost3"])], ratios=[agg.Ratio("cost_ratio", "costs", "sales", 100.0)],
    filters=[C("division", "in", ["A", "R"]), C("model", "!=", "M3")],
)
SLICE = """SELECT month, division, customer, sum(qty) AS qty, sum(sales) AS sales, sum(cost1) + sum(cost2) + sum(cost3) AS costs, CASE WHEN sum(sales) <> 0 THEN (sum(cost1) + sum(cost2) + sum(cost3)) / sum(sales) * 100 ELSE CAST(0 AS DOUBLE) END AS cost_ratio
    FROM {ledger} WHERE division IN ('A', 'R') AND model <> 'M3' GROUP BY month, division, customer"""


@query("aggregate_spec", SLICE)
def aggregate_spec(s):
    return agg.aggregate_spec(s.ledger, SPEC)


@query("slice_dataset", SLICE)
def _(s):
    path = scratch_folder(s.spark)
    s.spark.createDataFrame([(agg.spec_to_json(SPEC),)], "spec string").write.text(path)
    return agg.aggregate_spec(s.ledger, agg.spec_from_json(s.spark.read.text(path).first()[0]))


@query("project_required_columns", "SELECT month, division, customer, qty, sales, cost1, cost2, cost3, model FROM {ledger}")
def _(s):
    return s.ledger.select(*agg.required_columns(SPEC))


@query("filter_spec", "SELECT l_orderkey, l_linenumber FROM {ledger} WHERE division = 'A' AND model LIKE '%1%' AND customer NOT IN ('F') AND month <> '199401'")
def _(s):
    return flt.filter_spec(s.ledger, [C("division", "==", " A "), C("model", "contains", "1"), C("customer", "not in", ["F"]), C("month", "!=", "199401"), C("qty", "~", 1)]).select("l_orderkey", "l_linenumber")


@query("rule_predicates", """SELECT p_partkey, lower(p_brand) = 'brand#2' AS eq, p_type LIKE '%ECON%' AS has, NOT (lower(p_name) LIKE '%red%') AS hasnt, lower(p_name) LIKE 'small%' AS starts, lower(p_name) LIKE '%ring' AS ends, p_size > 20 AS gt, p_size <= 5 AS le,
    lower(p_type) IN ('economy', 'promo') AS inn, NOT (lower(p_type) IN ('economy')) AS nin, p_name IS NULL OR trim(p_name) = '' AS nul, regexp_matches(lower(p_name), '^(red|blue) ') AS rex, false AS bad FROM {part}""")
def _(s):
    t = {"eq": C("p_brand", "==", "BRAND#2"), "has": C("p_type", "contains", "ECON", True), "hasnt": C("p_name", "not_contains", "RED"), "starts": C("p_name", "startswith", "Small"), "ends": C("p_name", "endswith", "RING"), "gt": C("p_size", ">", "20"), "le": C("p_size", "<=", 5),
         "inn": C("p_type", "in", "economy, promo"), "nin": C("p_type", "not_in", ["economy"]), "nul": C("p_name", "is_null"), "rex": C("p_name", "regex", "^(red|blue) "), "bad": C("p_name", ">", 1)}
    return s.part.select("p_partkey", *[flt.condition_column(c).alias(n) for n, c in t.items()])


@query("rule_combine", "SELECT p_partkey FROM {part} WHERE (p_size > 10 AND p_type = 'ECONOMY') OR (p_size < 3 OR lower(p_name) LIKE '%red%')")
def _(s):
    a = Rule("a", "x", [C("p_size", ">", 10), C("p_type", "==", "economy")])
    b = Rule("b", "y", [C("p_size", "<", 3), C("p_name", "contains", "red")], "OR")
    off = Rule("c", "z", [C("p_size", ">", -1)], enabled=False)
    return s.part.where(flt.rule_column(a, s.part.columns) | flt.rule_column(b, s.part.columns) | flt.rule_column(off, s.part.columns)).select("p_partkey")


@query("entity_isolation_filter", "SELECT l_orderkey, l_linenumber, period FROM {base} WHERE entity = 'PL' AND period IN ('1997-01', '1997-02', '1997-03')")
def _(s):
    return flt.isolate_entity(s.base, "pl", ["PLN", "EUR", "USD"], "1997-Q1")[0].select("l_orderkey", "l_linenumber", "period")


@query("period_spec_filter", "SELECT o_orderkey FROM {files} WHERE period LIKE '1996-%' OR period IN ('1997-04', '1997-05', '1997-06', '1998-02')")
def _(s):
    return flt.period_spec_filter(s.files, "period", "1996, 1997-Q2, 199802").select("o_orderkey")


@query("export_filters", "SELECT invoice, amount * 1.0e0 AS amount FROM {mart} WHERE entity = 'A' AND period >= '1996-03' AND period <= '1997-02'")
def _(s):
    return dbl(mt.select_mart(s.mart, ["invoice", "amount"], filters={"entity": "A"}, period="period", first="1996-03", last="1997-02"), "amount")


@query("constant_columns", "SELECT division, '007' AS code, sum(qty) AS qty FROM {ledger} GROUP BY division")
def _(s):
    return agg.aggregate_spec(s.ledger, agg.AggregationSpec(keys=["division", "code"], measures=["qty"], constants={"code": "007"}))


@query("annual_rollup", "SELECT substring(month, 1, 4) AS year, division, sum(sales) AS sales FROM {ledger} GROUP BY substring(month, 1, 4), division")
def _(s):
    return agg.aggregate_spec(s.ledger, agg.AggregationSpec(keys=["month", "division"], measures=["sales"], month="month", annual="year"))


@query("output_column_selection", "SELECT division, sum(cost1) + sum(cost2) AS both_costs, sum(sales) AS sales FROM {ledger} GROUP BY division")
def _(s):
    return agg.aggregate_spec(s.ledger, agg.AggregationSpec(keys=["division"], measures=["sales"], groups=[agg.ColumnGroup("both_costs", ["cost1", "cost2"]), agg.ColumnGroup("hidden", ["cost3"], False)], order=["both_costs"]))


@query("null_to_unknown", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 3 = 1 THEN 'UNKNOWN' ELSE o_orderstatus END AS status FROM {orders}")
def _(s):
    return s.orders.select("o_orderkey", text.null_to_unknown(F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), "o_orderstatus"))).alias("status"))


# --- scalar functions

EN = "'^[+-]?(([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
PL = "'^[+-]?(([0-9]+|[0-9]{1,3}([.][0-9]{3})+|[0-9]{1,3}( [0-9]{3})+)(,[0-9]+)?|,[0-9]+)([eE][+-]?[0-9]+)?$'"


@query("parse_number_strict", f"""SELECT l_orderkey, l_linenumber, CASE WHEN t IS NULL OR trim(t) IN ('', '-') THEN 'missing' WHEN regexp_matches(trim(t), {EN}) THEN 'ok' ELSE 'invalid' END AS en_state,
    CASE WHEN trim(t) NOT IN ('', '-') AND regexp_matches(trim(t), {EN}) THEN CAST(replace(trim(t), ',', '') AS DOUBLE) END AS en,
    CASE WHEN trim(t) NOT IN ('', '-') AND regexp_matches(trim(t), {PL}) THEN CAST(replace(replace(replace(trim(t), '.', ''), ' ', ''), ',', '.') AS DOUBLE) END AS pl FROM {{numtext}}""")
def _(s):
    en, pl = numbers.parse_number_strict(F.col("t")), numbers.parse_number_strict(F.col("t"), "Polish")
    return s.numtext.select("l_orderkey", "l_linenumber", en["state"].alias("en_state"), en["value"].alias("en"), pl["value"].alias("pl"))


@query("parse_number_preserving", """SELECT l_orderkey, l_linenumber, t AS text, CASE WHEN regexp_matches(trim(t), '^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)?([.][0-9]+)?$') AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(replace(trim(t), ',', ''), '^[+-]?0[0-9]')
    THEN CAST(CAST(replace(trim(t), ',', '') AS DECIMAL(38,18)) AS DOUBLE) END AS value,
    CASE WHEN regexp_matches(trim(t), '^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)?([.][0-9]+)?$') AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(replace(trim(t), ',', ''), '^[+-]?0[0-9]') THEN CAST(length(regexp_extract(trim(t), '[.]([0-9]+)$', 1)) AS DOUBLE) END AS scale FROM {numtext}""")
def _(s):
    p = numbers.parse_number_preserving(F.col("t"))
    return s.numtext.select("l_orderkey", "l_linenumber", p["text"].alias("text"), p["value"].cast("double").alias("value"), p["scale"].cast("double").alias("scale"))


AUTO = """CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9]{1,3}([ .][0-9]{3})+(,[0-9]+)$') OR regexp_matches(trim(t), '^[+-]?[0-9]+,([0-9]{1,2}|[0-9]{4,})$') THEN replace(replace(replace(trim(t), '.', ''), ' ', ''), ',', '.') ELSE replace(trim(t), ',', '') END"""


AUTO_VALUES = f"SELECT l_orderkey, l_linenumber, CASE WHEN t LIKE '%e%' THEN CAST(t AS DOUBLE) ELSE CAST(TRY_CAST({AUTO} AS DECIMAL(38,6)) AS DOUBLE) END AS v FROM {{numtext}}"


@query("parse_number_auto_all_forms", AUTO_VALUES)
@query("parse_number_auto", AUTO_VALUES)
def _(s):
    """The whole table, exponents and missing cells too."""
    return s.numtext.select("l_orderkey", "l_linenumber", numbers.parse_number_auto(F.col("t")).cast("double").alias("v"))


@query("validate_number_syntax", "SELECT l_orderkey, l_linenumber, t IS NULL OR trim(t) IN ('', '-') OR regexp_matches(trim(t), '^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?$') AS us FROM {numtext}")
def _(s):
    return s.numtext.select("l_orderkey", "l_linenumber", numbers.number_syntax_ok(F.col("t"), "us").alias("us"))


@query("check_decimal_lossless", "SELECT l_orderkey, l_linenumber, cents % 10 = 0 AND cents < 10000000 AS ok FROM {cents}")
def _(s):
    price = F.concat(F.floor(F.col("cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    return s.cents.select("l_orderkey", "l_linenumber", numbers.decimal_lossless(price, 6, 1).alias("ok"))


@query("parse_date_unambiguous", """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN CASE WHEN d > 12 THEN v END WHEN 3 THEN CASE WHEN d > 12 THEN v END WHEN 9 THEN v END AS v
    FROM (SELECT *, concat(CAST(y AS STRING), '-', lpad(CAST(m AS STRING), 2, '0'), '-', lpad(CAST(d AS STRING), 2, '0')) AS v FROM {datetext}) AS x""")
def _(s):
    return s.datetext.select("o_orderkey", dates.parse_date_unambiguous(F.col("t")).cast("string").alias("v"))


#: A day and a month with a point or slash between them read as a year of two digits and a month.
PERIODS = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (4, 5, 6, 7, 9) THEN concat(CAST(y AS STRING), '-', lpad(CAST(m AS STRING), 2, '0')) WHEN o_orderkey % 10 IN (1, 2) AND d >= 10 THEN concat('20', CAST(d AS STRING), '-', lpad(CAST(m AS STRING), 2, '0')) END AS period FROM {datetext}"""


@query("normalize_period_all_forms", PERIODS)
@query("normalize_period", PERIODS)
def _(s):
    """The whole table, full dates too."""
    return s.datetext.select("o_orderkey", dates.normalize_period(F.col("t")).alias("period"))


@query("period_parts", "SELECT o_orderkey, CAST(substring(period, 1, 4) AS INTEGER) * 100 + CAST(substring(period, 6, 2) AS INTEGER) AS date_sk, CAST(substring(period, 1, 4) AS INTEGER) AS year, concat(substring(period, 1, 4), '-Q', CAST(CAST(floor((CAST(substring(period, 6, 2) AS INTEGER) + 2) / 3) AS BIGINT) AS STRING)) AS quarter, CAST(substring(period, 6, 2) AS INTEGER) AS month FROM {files}")
def _(s):
    return s.files.select("o_orderkey", dates.period_parts(F.col("period")).alias("p")).select("o_orderkey", "p.*")


@query("normalize_business_key", "SELECT c_custkey, concat('00', upper(trim(c_name))) AS k FROM {customer}")
def _(s):
    return s.customer.select("c_custkey", text.business_key(F.concat(F.lit(" 00"), F.lower("c_name"), F.lit(" "))).alias("k"))


@query("flatten_linebreaks", "SELECT doc_id, regexp_replace(text, '[\\r\\n\\x0b\\x0c\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g') AS text, regexp_matches(text, '[\\r\\n]') AS had FROM {documents}")
def _(s):
    return s.documents.select("doc_id", text.flatten_linebreaks(F.col("text")).alias("text"), text.has_linebreak(F.col("text")).alias("had"))


@query("safe_ratio", "SELECT l_orderkey, l_linenumber, CASE WHEN cost3 <> 0 THEN sales / cost3 * 100 ELSE CAST(0 AS DOUBLE) END AS r FROM {ledger}")
def _(s):
    return s.ledger.select("l_orderkey", "l_linenumber", money.safe_ratio(F.col("sales"), F.col("cost3"), 100).alias("r"))


@query("column_group_sum", "SELECT l_orderkey, l_linenumber, cost1 + cost2 + cost3 AS g FROM {ledger}")
def _(s):
    return s.ledger.select("l_orderkey", "l_linenumber", money.column_group_sum([F.col("cost1"), F.col("cost2"), F.col("cost3"), F.lit(None).cast("double")]).alias("g"))


@query("fx_convert", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(REV_GROSS AS DECIMAL(24,6)) * rate, 6) AS DOUBLE) AS v FROM {wide} AS w JOIN {rates} AS r ON w.period = r.period AND w.currency = r.currency")
def _(s):
    return money.fx_convert(s.wide, s.rates, ["REV_GROSS"], "PLN").select("l_orderkey", "l_linenumber", F.col("REV_GROSS_reporting").cast("double").alias("v"))


@query("split_account_code", "SELECT source_column, regexp_extract(source_column, '\\[([0-9]+)\\]', 1) AS code, trim(regexp_extract(source_column, '^([^\\[]*)', 1)) AS name FROM {accounts}")
def _(s):
    return s.accounts.select("source_column", text.split_account_code(F.col("source_column")).alias("p")).select("source_column", "p.*")


@query("significant_digits", "SELECT l_orderkey, l_linenumber, CAST(greatest(length(rtrim(CAST(cents AS STRING), '0')), 1) AS INTEGER) AS n FROM {cents}")
def _(s):
    return s.cents.select("l_orderkey", "l_linenumber", numbers.significant_digits((F.col("cents") / 100).cast("decimal(18,2)")).alias("n"))


@query("json_payload", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('{\"event_id\":', CAST(event_id AS STRING), ',\"event_type\":\"', event_type, '\"}') AS payload FROM {events}")
def _(s):
    return s.events.select("event_id", text.json_field(F.col("props"), "$.k").cast("long").alias("k"), text.json_payload("event_id", "event_type").alias("payload"))


@query("plain_decimal_text", "SELECT l_orderkey, l_linenumber, CASE WHEN cents % 100 = 0 THEN CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) WHEN cents % 10 = 0 THEN concat(CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING), '.', CAST(CAST(cents % 100 / 10 AS BIGINT) AS STRING)) ELSE concat(CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING), '.', lpad(CAST(cents % 100 AS STRING), 2, '0')) END AS t FROM {cents}")
def _(s):
    return s.cents.select("l_orderkey", "l_linenumber", numbers.plain_decimal_text((F.col("cents") / 100).cast("decimal(18,6)")).alias("t"))


@query("content_fingerprint", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS rows, true AS same FROM {orders} GROUP BY o_orderstatus")
def _(s):
    a = periods.content_fingerprint(s.orders, ["o_orderstatus"])
    b = periods.content_fingerprint(s.orders.repartition(5, "o_custkey"), ["o_orderstatus"]).withColumnsRenamed({"h1": "g1", "h2": "g2"}).drop("rows")
    return a.join(b, "o_orderstatus").select("o_orderstatus", "rows", ((F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).alias("same"))


@query("bucket_label", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE concat(p_type, '_', p_brand) END AS label FROM {part}")
def _(s):
    return s.part.select("p_partkey", text.bucket_label(F.col("p_type"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")), "medium").alias("label"))


# --- joins

@query("lookup_surrogate_left", "SELECT l_orderkey, l_linenumber, customer_code, coalesce(sk, -1) AS customer_sk FROM {base} LEFT JOIN {dim_customer} ON upper(customer_code) = nk")
def _(s):
    d = star.append_unknown_member(s.dim_customer, "sk", ["nk", "customer_name", "channel_group"])
    return star.lookup_surrogate_left(s.base, d, "customer_code", "nk", "sk", "customer_sk").select("l_orderkey", "l_linenumber", "customer_code", "customer_sk")


@query("lookup_surrogate_inner", "SELECT l_orderkey, l_linenumber, sk FROM {base} JOIN {dim_product} ON upper(product_code) = nk")
def _(s):
    return s.base.join(s.dim_product, F.upper("product_code") == F.col("nk")).select("l_orderkey", "l_linenumber", "sk")


MISSING = """SELECT 'customer' AS "column", upper(customer_code) AS code, CAST(count(*) AS BIGINT) AS n FROM {base} WHERE upper(customer_code) NOT IN (SELECT nk FROM {dim_customer}) GROUP BY upper(customer_code)
    UNION ALL SELECT 'product' AS "column", upper(product_code) AS code, CAST(count(*) AS BIGINT) AS n FROM {base} WHERE upper(product_code) NOT IN (SELECT nk FROM {dim_product}) GROUP BY upper(product_code)"""


def missing_codes(s):
    fact = s.base.select(F.upper("customer_code").alias("customer"), F.upper("product_code").alias("product"))
    return star.fk_missing(fact, {"customer": (s.dim_customer, "nk"), "product": (s.dim_product, "nk")})


@query("fk_anti_join_failfast", MISSING)
def _(s):
    return missing_codes(s)


@query("top_missing_codes", f"SELECT * FROM ({MISSING}) AS t ORDER BY n DESC, code LIMIT 20")
def _(s):
    return missing_codes(s).orderBy(F.desc("n"), "code").limit(20)


@query("fx_left_join", "SELECT l_orderkey, l_linenumber, CAST(rate AS DOUBLE) AS rate FROM {base} AS b LEFT JOIN (SELECT * FROM {rates} WHERE currency <> 'USD') AS r ON b.period = r.period AND b.currency = r.currency")
def _(s):
    return dbl(s.base.join(s.rates.where("currency <> 'USD'"), ["period", "currency"], "left").select("l_orderkey", "l_linenumber", "rate"), "rate")


GRAIN = ["period", "entity", "product_code"]
#: What the inputs "inv" and "prices" have of "base", and the customers; "wide" has the rest.
FACTS = ("l_linenumber", "period", "entity", "customer_code", "product_code", "warehouse_code", "channel_code", "currency", "qty", "price", "retail")
PNL_PART = "(SELECT period, entity, product_code, sum(price) AS revenue FROM {base} WHERE l_linenumber % 2 = 0 GROUP BY period, entity, product_code)"
INV_PART = "(SELECT period, entity, product_code, sum(qty) AS stock FROM {base} WHERE l_linenumber % 3 = 0 GROUP BY period, entity, product_code)"
PRICE_PART = "(SELECT period, entity, product_code, max(retail) AS retail FROM {base} WHERE l_linenumber % 5 = 0 GROUP BY period, entity, product_code)"


@query("drill_across_full_outer", f"""SELECT coalesce(p.period, i.period, r.period) AS period, coalesce(p.entity, i.entity, r.entity) AS entity, coalesce(p.product_code, i.product_code, r.product_code) AS product_code, CAST(coalesce(revenue, 0) AS DOUBLE) AS revenue, CAST(coalesce(stock, 0) AS DOUBLE) AS stock, CAST(retail AS DOUBLE) AS retail
    FROM {PNL_PART} AS p FULL OUTER JOIN {INV_PART} AS i ON p.period = i.period AND p.entity = i.entity AND p.product_code = i.product_code
    FULL OUTER JOIN {PRICE_PART} AS r ON coalesce(p.period, i.period) = r.period AND coalesce(p.entity, i.entity) = r.entity AND coalesce(p.product_code, i.product_code) = r.product_code""")
def _(s):
    f = lambda k, e: s.base.where(F.col("l_linenumber") % k == 0).groupBy(*GRAIN).agg(e)
    facts = {"pnl": f(2, F.sum("price").alias("revenue")), "inv": f(3, F.sum("qty").alias("stock")), "price": f(5, F.max("retail").alias("retail"))}
    return dbl(star.drill_across(facts, GRAIN, ["revenue", "stock"]), "revenue", "stock", "retail")


@query("star_rejoin", "SELECT l_orderkey, l_linenumber, channel_group, category FROM {base} JOIN {dim_customer} AS c ON upper(customer_code) = c.nk JOIN {dim_product} AS p ON upper(product_code) = p.nk")
def _(s):
    fact = star.lookup_surrogate_left(star.lookup_surrogate_left(s.base, s.dim_customer, "customer_code", "nk", "sk", "customer_sk"), s.dim_product, "product_code", "nk", "sk", "product_sk")
    dims = {"customer_sk": s.dim_customer.select(F.col("sk").alias("customer_sk"), "channel_group"), "product_sk": s.dim_product.select(F.col("sk").alias("product_sk"), "category")}
    return mt.star_rejoin(fact, dims).select("l_orderkey", "l_linenumber", "channel_group", "category")


@query("natural_key_join", "SELECT invoice, sk FROM {mart} JOIN (SELECT customer, entity, CAST(row_number() OVER (ORDER BY customer, entity) AS BIGINT) AS sk FROM (SELECT DISTINCT customer, entity FROM {mart}) AS d) AS r ON {mart}.customer = r.customer AND {mart}.entity = r.entity".replace("{mart}.", "mart."))
def _(s):
    reg = star.number_rows(s.mart.select("customer", "entity").distinct(), ["customer", "entity"], "sk").select(F.lit("customer").alias("dimension"), F.col("customer").alias("k0"), F.col("entity").alias("k1"), "sk")
    return mt.natural_key_join(s.mart, reg, "customer", ["customer", "entity"], "sk").select("invoice", "sk")


@query("not_exists_new_keys", "SELECT DISTINCT upper(customer_code) AS nk FROM {base} WHERE upper(customer_code) NOT IN (SELECT nk FROM {dim_customer})")
def _(s):
    return star.new_keys(s.base.select(F.col("customer_code").alias("nk")), s.dim_customer)


OVERLAP = "SELECT a.model_code, CAST(count(*) AS BIGINT) AS pairs FROM {promos} AS a JOIN {promos} AS b ON a.model_code = b.model_code AND a.o_orderkey < b.o_orderkey AND a.start_date <= b.end_date AND b.start_date <= a.end_date WHERE a.end_date >= a.start_date AND b.end_date >= b.start_date GROUP BY a.model_code"


@query("interval_overlap_self_join", OVERLAP)
def _(s):
    return longs(ranges.interval_overlap_count(s.promos.where("end_date >= start_date"), "model_code").where("pairs > 0"), "pairs")


@query("qty_amount_grain_join", """SELECT a.period, a.currency, a.product_code, CAST(amount AS DOUBLE) AS amount, CAST(coalesce(qty, 0) AS DOUBLE) AS qty FROM (SELECT period, currency, product_code, sum(REV_GROSS) AS amount FROM {wide} GROUP BY period, currency, product_code) AS a
    LEFT JOIN (SELECT period, currency, product_code, sum(qty) AS qty FROM {wide} WHERE l_linenumber > 1 GROUP BY period, currency, product_code) AS q ON a.period = q.period AND a.currency = q.currency AND a.product_code = q.product_code""")
def _(s):
    return dbl(star.grain_join(s.wide.withColumnRenamed("REV_GROSS", "amount"), s.wide.where("l_linenumber > 1"), ["period", "currency", "product_code"], ["amount"]), "amount", "qty")


@query("cross_join_scalar", "SELECT nk, top FROM {dim_product} CROSS JOIN (SELECT max(sk) AS top FROM {dim_customer}) AS m")
def _(s):
    return s.dim_product.select("nk").crossJoin(F.broadcast(s.dim_customer.agg(F.max("sk").alias("top"))))


# --- aggregations

def one_function(fn: str, *measures: str):
    return lambda s: agg.aggregate_spec(s.ledger, agg.AggregationSpec(keys=["division", "model"], measures=list(measures), functions={m: fn for m in measures}))


for _name, _fn, _sql in (("agg_sum", "sum", "sum(qty)"), ("agg_mean", "mean", "avg(qty)"), ("agg_count", "count", "CAST(count(qty) AS BIGINT)"), ("agg_min", "min", "min(qty)"), ("agg_max", "max", "max(qty)")):
    query(_name, f"SELECT division, model, {_sql} AS qty FROM {{ledger}} GROUP BY division, model")(one_function(_fn, "qty"))


@query("agg_min_max", "SELECT division, min(qty) AS qty, max(sales) AS sales FROM {ledger} GROUP BY division")
def _(s):
    return agg.aggregate_spec(s.ledger, agg.AggregationSpec(keys=["division"], measures=["qty", "sales"], functions={"qty": "min", "sales": "max"}))


@query("multi_function_measures", "SELECT division, avg(qty) AS qty, sum(qty) + sum(cost3) AS total FROM {ledger} GROUP BY division")
def _(s):
    return agg.aggregate_spec(s.ledger, agg.AggregationSpec(keys=["division"], measures=["qty"], functions={"qty": "mean"}, groups=[agg.ColumnGroup("total", ["qty", "cost3"])]))


@query("missing_number_counts", f"SELECT 't' AS \"column\", CAST(sum(CASE WHEN t IS NULL OR trim(t) IN ('', '-') THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN t IS NOT NULL AND trim(t) NOT IN ('', '-') AND NOT regexp_matches(trim(t), {EN}) THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM {{numtext}}")
def _(s):
    return agg.number_counts(s.numtext, ["t"]).drop("examples")


@query("group_cardinality", "SELECT CAST(count(DISTINCT (model, month)) AS BIGINT) AS groups, true AS exact FROM {ledger} WHERE division = 'A'")
def _(s):
    return agg.group_cardinality(s.ledger, ["model", "month"], [C("division", "==", "A")])


LONG = """(SELECT l_orderkey, l_linenumber, period, entity, customer_code, product_code, currency, account_code, amount FROM (
    SELECT *, 'REV_GROSS' AS account_code, REV_GROSS AS amount FROM {wide} UNION ALL SELECT *, 'DED_REBATE' AS account_code, DED_REBATE AS amount FROM {wide} UNION ALL SELECT *, 'COGS_MAT' AS account_code, COGS_MAT AS amount FROM {wide}
    UNION ALL SELECT *, 'COST_LOG' AS account_code, COST_LOG AS amount FROM {wide} UNION ALL SELECT *, 'COST_PROMO' AS account_code, COST_PROMO AS amount FROM {wide} UNION ALL SELECT *, 'COST_WARRANTY' AS account_code, COST_WARRANTY AS amount FROM {wide}
    UNION ALL SELECT *, 'COST_FIXED' AS account_code, COST_FIXED AS amount FROM {wide}) AS u)"""
ACCOUNTS = ["REV_GROSS", "DED_REBATE", "COGS_MAT", "COST_LOG", "COST_PROMO", "COST_WARRANTY", "COST_FIXED", "CALC_GROSS"]
IDS = ["l_orderkey", "l_linenumber", "period", "entity", "customer_code", "product_code", "currency"]
SIGNED = f"(SELECT u.*, statement_line, amount * sign_multiplier AS signed, round(CAST(amount * sign_multiplier AS DECIMAL(24,6)) * rate, 6) AS reporting FROM {LONG} AS u JOIN {{rules}} USING (account_code) JOIN {{rates}} AS x ON u.period = x.period AND u.currency = x.currency)"


def long(s):
    return star.unpivot_accounts(s.wide, IDS, ACCOUNTS, ["CALC_GROSS"])


def signed(s):
    return star.long_amounts(long(s), s.rules, s.rates, "PLN")


def line_sum(line, c="reporting"):
    return f"coalesce(sum(CASE WHEN statement_line = '{line}' THEN {c} END), 0)"


_GR, _SD, _CG, _LC, _PC, _WC, _FX = (line_sum(x) for x in star.STATEMENT_LINES)
WATERFALL = f"""SELECT period, entity, CAST({_GR} AS DOUBLE) AS gross_revenue, CAST({_SD} AS DOUBLE) AS sales_deduction, CAST({_CG} AS DOUBLE) AS cogs, CAST({_LC} AS DOUBLE) AS logistics_cost, CAST({_PC} AS DOUBLE) AS promotion_cost, CAST({_WC} AS DOUBLE) AS warranty_cost, CAST({_FX} AS DOUBLE) AS fixed_sgna,
    CAST({_GR} + {_SD} AS DOUBLE) AS net_revenue, CAST({_GR} + {_SD} + {_CG} AS DOUBLE) AS gross_margin, CAST({_LC} + {_PC} + {_WC} AS DOUBLE) AS variable_cost, CAST({_GR} + {_SD} + {_CG} + {_LC} + {_PC} + {_WC} AS DOUBLE) AS contribution_margin,
    CAST({_GR} + {_SD} + {_CG} + {_LC} + {_PC} + {_WC} + {_FX} AS DOUBLE) AS operating_profit FROM {SIGNED} AS f GROUP BY period, entity"""
WATER = [x.lower() for x in star.STATEMENT_LINES] + ["net_revenue", "gross_margin", "variable_cost", "contribution_margin", "operating_profit"]


@query("waterfall_rollup", WATERFALL)
def _(s):
    return dbl(star.wide_waterfall(s.wide, ACCOUNTS, s.rules, s.rates, "PLN", ["period", "entity"]), *WATER)


INVENTORY = "SELECT period, warehouse_code, product_code, CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum(value) AS DOUBLE) AS value, CAST(sum(cost) AS DOUBLE) AS cost, CASE WHEN sum(value) > 0 THEN CAST(sum(CAST(value AS DECIMAL(24,6)) * dio) AS DOUBLE) / CAST(sum(value) AS DOUBLE) ELSE CAST(sum(dio) AS DOUBLE) / count(dio) END AS dio FROM {inv} GROUP BY period, warehouse_code, product_code"


@query("inventory_fact", INVENTORY)
def _(s):
    landed_names = {"warehouse_code": "Warehouse", "currency": "currency_code", "entity": "entity_code", "qty": "stock_qty", "value": "ending_inventory_val", "dio": "dio_days", "cost": "logistics_cost"}
    return dbl(star.inventory_fact(star.inventory_source(s.inv.withColumnsRenamed(landed_names)), ["period", "warehouse_code", "product_code"], s.shares("lineitem")), "qty", "value", "cost")


@query("price_fact", "SELECT period, channel_code, product_code, CAST(sum(our_price) AS DOUBLE) / count(our_price) AS our_price, CAST(sum(competitor_price) AS DOUBLE) / count(competitor_price) AS competitor_price FROM {prices} GROUP BY period, channel_code, product_code")
def _(s):
    return star.price_fact(s.prices, ["period", "channel_code", "product_code"], ["our_price", "competitor_price"], s.shares("lineitem"))


PREMART_STOCK = "(SELECT period, product_code, sum(value) AS value, sum(cost) AS cost, CASE WHEN sum(value) > 0 THEN CAST(sum(CAST(value AS DECIMAL(24,6)) * dio) AS DOUBLE) / CAST(sum(value) AS DOUBLE) ELSE CAST(sum(dio) AS DOUBLE) / count(dio) END AS dio, CAST(count(DISTINCT warehouse_code) AS BIGINT) AS warehouses FROM {inv} GROUP BY period, product_code)"
PREMART_PRICE = "(SELECT period, product_code, CAST(sum(our_price) AS DOUBLE) / count(our_price) AS our_price, CAST(min(our_price) AS DOUBLE) AS min_our_price, CAST(max(our_price) AS DOUBLE) AS max_our_price, CAST(count(DISTINCT channel_code) AS BIGINT) AS channels FROM {prices} GROUP BY period, product_code)"


@query("product_premart", f"""SELECT p.period, p.product_code, p.price, p.qty, customers, CAST(i.value AS DOUBLE) AS value, CAST(i.cost AS DOUBLE) AS cost, i.dio, warehouses, our_price, min_our_price, max_our_price, channels FROM (SELECT period, product_code, CAST(sum(price) AS DOUBLE) AS price, CAST(sum(qty) AS DOUBLE) AS qty, CAST(count(DISTINCT CASE WHEN sk IS NULL THEN concat('?', customer_code) ELSE CAST(sk AS STRING) END) AS BIGINT) AS customers FROM {{base}} LEFT JOIN {{dim_customer}} ON upper(customer_code) = nk GROUP BY period, product_code) AS p
    JOIN {PREMART_STOCK} AS i ON p.period = i.period AND p.product_code = i.product_code JOIN {PREMART_PRICE} AS r ON p.period = r.period AND p.product_code = r.product_code""")
def _(s):
    s.stored("base", *FACTS)
    fact, grain = star.lookup_surrogate_left(s.base, s.dim_customer, "customer_code", "nk", "sk", "customer_sk"), ["period", "product_code"]
    parts = [
        star.PremartPart(fact, "customers", star.customer("customer_sk", "customer_code"), ["price", "qty"]),
        star.PremartPart(s.inv, "warehouses", F.col("warehouse_code"), ["value", "cost"], weight="value"),
        star.PremartPart(s.prices, "channels", F.col("channel_code"), prices=["our_price"]),
    ]
    return dbl(star.premarts(parts, grain), "price", "qty", "value", "cost", "min_our_price", "max_our_price")


@query("sum_null_propagating", "SELECT period, CASE WHEN count(quantity) = count(*) THEN CAST(sum(quantity) AS DOUBLE) END AS quantity FROM {mart} GROUP BY period")
def _(s):
    return s.mart.groupBy("period").agg(mt.sum_null_propagating("quantity").cast("double").alias("quantity"))


@query("collapse_duplicate_grain", "SELECT period, customer, arg_min(entity, seq) AS entity, arg_min(invoice, seq) AS invoice, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(quantity) AS DOUBLE) AS quantity FROM {mart} GROUP BY period, customer")
def _(s):
    return dbl(mt.collapse_duplicate_grain(s.mart.drop("labor"), ["period", "customer"], ["amount", "quantity"], "seq"), "amount", "quantity")


@query("summary_metrics", "SELECT CAST(count(*) AS BIGINT) AS rows, min(period) AS first_period, max(period) AS last_period, CAST(count(DISTINCT period) AS BIGINT) AS periods, CAST(sum(CAST(amount AS DECIMAL(38,6))) AS DOUBLE) AS total_amount FROM {files}")
def _(s):
    return dbl(periods.summary_metrics(s.files, "period_raw", ["amount"]), "total_amount")


@query("period_metrics", "SELECT period, CAST(count(*) AS BIGINT) AS rows, CAST(sum(CAST(amount AS DECIMAL(38,6))) AS DOUBLE) AS total_amount FROM {files} GROUP BY period")
def _(s):
    return dbl(periods.period_metrics(s.files.drop("period"), "period_raw", ["amount"]), "total_amount")


@query("duplicate_key_groups", "SELECT CAST(count(*) AS BIGINT) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM {files} GROUP BY period, o_custkey HAVING count(*) > 1) AS t")
def _(s):
    return periods.duplicate_key_groups(s.files, ["period", "o_custkey"])


@query("sampled_key_uniqueness", """SELECT CAST(count(CASE WHEN n > 1 AND period <> '' THEN 1 END) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST((SELECT count(*) FROM (SELECT 1 FROM {files} GROUP BY period, o_custkey HAVING count(*) > 1) AS a) AS BIGINT) AS all_groups, CAST((SELECT count(*) FROM {files}) AS BIGINT) AS all_rows
    FROM (SELECT period, o_custkey, count(*) AS n FROM (SELECT * FROM {files} ORDER BY o_orderkey LIMIT 1000) AS h GROUP BY period, o_custkey) AS t""")
def _(s):
    """The quick look at 1,000 rows, and the same of all rows."""
    quick, whole = (periods.sampled_key_uniqueness(s.files, "period", ["o_custkey"], n, ["o_orderkey"] if n else ()) for n in (1000, None))
    return quick.crossJoin(whole.withColumnsRenamed({"groups": "all_groups", "rows": "all_rows"}))


CONTROLS = "SELECT period, entity, CAST(count(*) AS BIGINT) AS rows, CAST(sum(amount) AS DOUBLE) AS sum_amount FROM {mart} GROUP BY period, entity"


@query("scope_controls", CONTROLS)
def _(s):
    return dbl(mt.scope_controls(s.mart, ["period", "entity"], ["amount"]), "sum_amount")


RULES = [
    Rule("r1", "big economy", [C("p_size", ">", 30), C("p_type", "==", "economy")]),
    Rule("r2", "red or blue", [C("p_name", "contains", "red"), C("p_name", "contains", "BLUE")], "OR"),
    Rule("r3", "off", [C("p_size", ">", 0)], enabled=False),
    Rule("r4", "brand one", [C("p_brand", "regex", "^brand#1[0-9]$")]),
    Rule("r5", "small", [C("p_size", "<=", "5"), C("p_name", "not_contains", "ring")]),
]
RULE_ID = """CASE WHEN p_size > 30 AND lower(p_type) = 'economy' THEN 'r1' WHEN lower(p_name) LIKE '%red%' OR lower(p_name) LIKE '%blue%' THEN 'r2' WHEN regexp_matches(lower(p_brand), '^brand#1[0-9]$') THEN 'r4' WHEN p_size <= 5 AND NOT (lower(p_name) LIKE '%ring%') THEN 'r5' END"""
CLASSED = f"(SELECT *, {RULE_ID} AS rule_id FROM {{part}})"
LABEL = "CASE rule_id WHEN 'r1' THEN 'big economy' WHEN 'r2' THEN 'red or blue' WHEN 'r4' THEN 'brand one' WHEN 'r5' THEN 'small' ELSE 'other' END"


@query("first_match_classify", f"SELECT p_partkey, rule_id, {LABEL} AS label FROM {CLASSED} AS c")
def first_match_classify(s):
    return mapping.first_match_classify(s.part, RULES, "label", "other").select("p_partkey", "rule_id", "label")


LEDGER_RULES = [
    Rule("l1", "returned", [C("l_returnflag", "==", "r"), C("l_quantity", ">=", "25")]), Rule("l2", "dear", [C("l_extendedprice", ">", 90000)]),
    Rule("l3", "open cheap", [C("l_linestatus", "==", "O"), C("l_discount", "<", "0.02")]), Rule("l4", "either", [C("l_tax", "==", "0.08"), C("l_linenumber", "in", "6,7")], "OR"), Rule("l5", "accepted", [C("l_returnflag", "startswith", "a")]),
]


@query("classify_lineitem", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_quantity >= 25 THEN 'returned' WHEN l_extendedprice > 90000 THEN 'dear' WHEN l_linestatus = 'O' AND l_discount < 0.02 THEN 'open cheap'
    WHEN l_tax = 0.08 OR l_linenumber IN (6, 7) THEN 'either' WHEN l_returnflag = 'A' THEN 'accepted' ELSE 'other' END AS label FROM {lineitem}""")
def _(s):
    return mapping.first_match_classify(s.lineitem, LEDGER_RULES, "label", "other").select("l_orderkey", "l_linenumber", "label")


@query("rule_match_stats", f"SELECT r.rule_id, CAST(coalesce(n, 0) AS BIGINT) AS matched, coalesce(n, 0) * 100.0e0 / (SELECT count(*) FROM {{part}}) AS share FROM (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), (NULL)) AS r(rule_id) LEFT JOIN (SELECT rule_id, count(*) AS n FROM {CLASSED} AS c GROUP BY rule_id) AS g ON r.rule_id IS NOT DISTINCT FROM g.rule_id")
def _(s):
    return mapping.rule_match_stats(mapping.first_match_classify(s.part, RULES, "label"), RULES)


TOP = f"""SELECT "column", value, n FROM (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM (SELECT 'p_type' AS "column", p_type AS value, CAST(count(*) AS BIGINT) AS n FROM {CLASSED} AS a WHERE rule_id IS NULL GROUP BY p_type
    UNION ALL SELECT 'p_brand' AS "column", p_brand AS value, CAST(count(*) AS BIGINT) AS n FROM {CLASSED} AS b WHERE rule_id IS NULL GROUP BY p_brand) AS t) AS u WHERE k <= 3"""


@query("unmapped_top_values", TOP)
def _(s):
    return mapping.unmapped_top_values(mapping.first_match_classify(s.part, RULES, "label", unmapped_only=True), ["p_type", "p_brand"], 3)


@query("classify_dataset", f"""SELECT 'unmapped ' || "column" AS kind, value AS name, n FROM ({TOP}) AS t UNION ALL SELECT 'rule' AS kind, r.rule_id AS name, CAST((SELECT count(*) FROM {CLASSED} AS c WHERE c.rule_id IS NOT DISTINCT FROM r.rule_id) AS BIGINT) AS n FROM (VALUES ('r1'), ('r2'), ('r3'), ('r4'), ('r5'), (NULL)) AS r(rule_id)
    UNION ALL SELECT 'label' AS kind, {LABEL} AS name, CAST(count(*) AS BIGINT) AS n FROM {CLASSED} AS d GROUP BY {LABEL}""")
def _(s):
    rows, stats, top = mapping.classify_dataset(s.part, RULES, "label", "other", ["p_type", "p_brand"], 3)
    top = top.select(F.concat(F.lit("unmapped "), "column").alias("kind"), F.col("value").alias("name"), "n")
    labels = rows.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), "name", "n")
    return top.unionByName(stats.select(F.lit("rule").alias("kind"), F.col("rule_id").alias("name"), F.col("matched").alias("n"))).unionByName(labels)


@query("distinct_pairs", "SELECT DISTINCT period, currency FROM {base}")
def _(s):
    return s.base.select("period", "currency").distinct()


@query("estimate_daily_rows", "SELECT CAST(sum(end_date - start_date + 1) AS BIGINT) AS days FROM {promos} WHERE end_date >= start_date")
def _(s):
    return ranges.estimate_daily_rows(s.promos.where("end_date >= start_date"))


@query("repair_statistics", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN regexp_matches(trim(t), '^[+-]?([0-9]+|[0-9]{1,3}([.][0-9]{3})+|[0-9]{1,3}( [0-9]{3})+)?(,[0-9]+)?$') AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(replace(replace(trim(t), '.', ''), ' ', ''), '^[+-]?0[0-9]') THEN 1 ELSE 0 END) AS BIGINT) AS numbers,
    CAST(0 AS BIGINT) AS dates, CAST(0 AS BIGINT) AS flattened, CAST(0 AS BIGINT) AS large_numbers FROM {numtext}""")
def _(s):
    return landing.repair_statistics(s.numtext, ["t"], "Polish")


@query("clean_table_statistics", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(2 * count(*) AS BIGINT) AS numbers, CAST(count(*) AS BIGINT) AS dates, CAST(0 AS BIGINT) AS flattened, CAST(0 AS BIGINT) AS large_numbers, CAST(sum(CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS repaired, CAST(8 AS BIGINT) AS skipped FROM {customer}")
def _(s):
    """The counters of a cleaned table's one pass, over four files with split records."""
    path = scratch_folder(s.spark)
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.concat("c_name", F.lit("\nmore"))).otherwise(F.col("c_name"))
    value = F.concat_ws(";", k.cast("string"), name, F.translate(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), ".", ","), F.lit("2024-05-31"))
    junk = s.spark.createDataFrame([("report", -3), ("", -2), ("id;name;balance;day", -1)], "value string, i long")
    body = s.customer.select(value.alias("value"), k.alias("i"), (k % 4).alias("file"))
    every = body.unionByName(junk.withColumn("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))))
    every.repartition(4, "file").sortWithinPartitions("file", "i").select("value", "file").write.partitionBy("file").text(f"{path}/files")
    done = landing.write_clean_table(s.spark, f"{path}/files/*/*", f"{path}/clean", ";")
    return s.spark.createDataFrame([done], ", ".join(f"{n} long" for n in done))


# --- ordered analytics, sorting, samples

@query("latest_authority_row", "SELECT customer, arg_max(entity, seq) AS entity, max(seq) AS seq FROM {mart} GROUP BY customer")
def _(s):
    return star.latest_authority_row(s.mart.select("customer", "entity", "seq"), "customer", "seq")


KEYS = "SELECT sk, nk FROM {dim_customer} WHERE sk % 3 <> 0 UNION ALL SELECT (SELECT max(sk) FROM {dim_customer} WHERE sk % 3 <> 0) + CAST(row_number() OVER (ORDER BY nk) AS BIGINT) AS sk, nk FROM (SELECT DISTINCT upper(customer_code) AS nk FROM {base}) AS b WHERE nk NOT IN (SELECT nk FROM {dim_customer} WHERE sk % 3 <> 0)"


def registered(s):
    return star.assign_surrogate_keys(s.dim_customer.where("sk % 3 <> 0").select("sk", "nk"), s.base.select(F.col("customer_code").alias("nk")))


@query("assign_surrogate_keys", KEYS)
def _(s):
    return registered(s)


@query("key_registry", KEYS)
def _(s):
    once = reread(s, registered(s))
    return star.assign_surrogate_keys(once, s.base.select(F.col("customer_code").alias("nk")))


@query("row_sequence", "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS BIGINT) AS row FROM {orders}")
def _(s):
    return star.number_rows(s.orders.select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("first_by_input_order", "SELECT customer, arg_min(invoice, seq) AS invoice FROM {mart} GROUP BY customer")
def _(s):
    return star.first_by_input_order(s.mart.select("customer", "invoice", "seq"), ["customer"], "seq").select("customer", "invoice")


@query("dedup_keep_first", "SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM {part} GROUP BY p_brand")
def _(s):
    return star.dedup_keep_first(s.part.select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey")


@query("repair_split_records", "SELECT CAST(c_custkey AS STRING) AS a, CASE WHEN c_custkey % 7 = 0 THEN concat(c_name, ' more') WHEN c_custkey % 5 = 0 THEN concat(c_name, ' cut') ELSE c_name END AS b, c_mktsegment AS c FROM {customer}")
def _(s):
    k = F.col("c_custkey")
    tail = F.concat(F.lit(","), "c_mktsegment")
    line = F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit(","), "c_name", F.lit("\nmore"), tail)).when(k % 5 == 0, F.concat(k.cast("string"), F.lit(","), "c_name", F.lit("\ncut"), tail)).otherwise(F.concat(k.cast("string"), F.lit(","), "c_name", tail))
    path = scratch_folder(s.spark)
    s.customer.select(line.alias("value")).write.text(path)
    out = landing.repair_split_records(landing.indexed_records(s.spark, path, ","), 3)
    return out.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate("abc")])


@query("clean_table", "SELECT CAST(c_custkey AS STRING) AS id, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) AS balance FROM {customer}")
def _(s):
    path = scratch_folder(s.spark)
    money_text = F.translate(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), ".", ",")
    body = star.number_rows(s.customer.select("c_custkey", F.concat_ws(";", F.col("c_custkey").cast("string"), money_text).alias("value")), ["c_custkey"], "i")
    junk = s.spark.createDataFrame([("report", -3), ("", -2), ("id;balance", -1)], "value string, i long")
    # Each file has the junk and the header before its rows.
    files = 4
    every = body.select("value", "i", (F.col("i") % files).alias("file")).unionByName(junk.withColumn("file", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(files - 1).cast("long")))))
    every.repartition(files, "file").sortWithinPartitions("file", "i").select("value", "file").write.partitionBy("file").text(f"{path}/files")
    return landing.clean_table(s.spark, f"{path}/files/*/*", ";")[0]


@query("ordered_output", "SELECT period, entity, CAST(sum(amount) AS DOUBLE) AS amount FROM {mart} GROUP BY period, entity ORDER BY period, entity")
def _(s):
    return dbl(s.mart.groupBy("period", "entity").agg(F.sum("amount").alias("amount")), "amount").orderBy("period", "entity")


@query("preview_head", SLICE.replace("FROM {ledger}", "FROM (SELECT * FROM {ledger} ORDER BY l_orderkey, l_linenumber LIMIT 2000) AS t") + " ORDER BY month, division, customer LIMIT 15")
def _(s):
    return agg.preview(s.ledger, SPEC, 2000, 15, ["l_orderkey", "l_linenumber"])


@query("paged_sample", "SELECT period, invoice FROM (SELECT DISTINCT period, invoice FROM {mart}) AS t ORDER BY period, invoice LIMIT 100 OFFSET 200")
def _(s):
    return mt.paged_sample(s.mart.select("period", "invoice").distinct(), ["period", "invoice"], 100, 200)


@query("daily_preview", "SELECT support_rule_id, model_code, CAST(CAST(d AS DATE) AS STRING) AS day FROM (SELECT support_rule_id, model_code, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS d FROM {promos} WHERE end_date >= start_date) AS t ORDER BY day, support_rule_id LIMIT 20")
def _(s):
    return ranges.daily_preview(s.promos, 20, ["applied_date", "support_rule_id"]).select("support_rule_id", "model_code", F.col("applied_date").cast("string").alias("day"))


# --- sets, reshape, expansion

@query("union_files_by_name", "SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, NULL AS o_orderstatus FROM {orders} WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL AS o_custkey, o_orderstatus FROM {orders} WHERE o_orderkey % 2 = 1")
def _(s):
    return periods.union_files_by_name([s.orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderkey"), s.orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus")])


@query("append_unknown_member", "SELECT sk, nk, category FROM {dim_product} UNION ALL SELECT -1 AS sk, 'UNKNOWN' AS nk, 'UNKNOWN' AS category")
def _(s):
    return star.append_unknown_member(s.dim_product.select("sk", "nk", "category"), "sk", ["nk", "category"])


@query("unpivot_accounts", f"SELECT l_orderkey, l_linenumber, account_code, CAST(amount AS DOUBLE) AS amount FROM {LONG} AS u")
def _(s):
    return dbl(long(s).select("l_orderkey", "l_linenumber", "account_code", "amount"), "amount")


@query("subtotal_exclusion", f"SELECT account_code, CAST(count(*) AS BIGINT) AS n FROM {LONG} AS u GROUP BY account_code")
def _(s):
    return long(s).groupBy("account_code").agg(F.count(F.lit(1)).alias("n"))


MEASURES = ["amount", "labor", "quantity"]


@query("long_cost_export", "SELECT invoice, 'amount' AS measure, CAST(amount AS DOUBLE) AS value FROM {mart} UNION ALL SELECT invoice, 'labor' AS measure, CAST(labor AS DOUBLE) AS value FROM {mart}")
def _(s):
    return dbl(mt.long_cost_export(s.mart, ["invoice"], [mt.Measure("amount", kind="cost"), mt.Measure("labor", kind="cost")]), "value")


DETAIL = """(SELECT period, entity, '410000' AS account_code, 'revenue' AS major_category, sum(amount) AS amount FROM {mart} GROUP BY period, entity UNION ALL SELECT period, entity, '520001' AS account_code, 'cogs' AS major_category, -sum(labor) AS amount FROM {mart} GROUP BY period, entity)"""
RECIPE = mt.Recipe("long_detail", ["period", "entity"], apply_sign=True)


@query("long_detail_recipe", f"SELECT period, entity, account_code, major_category, CAST(amount AS DOUBLE) AS amount FROM {DETAIL} AS d WHERE amount <> 0")
def _(s):
    return dbl(mt.run_recipe(s.mart, MEASURES, s.mapping, RECIPE).select("period", "entity", "account_code", "major_category", "amount"), "amount")


@query("wide_rollup_recipe", "SELECT period, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue, CAST(-coalesce(sum(labor), 0) AS DOUBLE) AS cogs_fixed FROM {mart} GROUP BY period")
def _(s):
    return dbl(mt.run_recipe(s.mart, MEASURES, s.mapping, mt.Recipe("wide_rollup", ["period"], "medium", apply_sign=True)), "revenue", "cogs_fixed")


@query("wide_raw_recipe", "SELECT entity, CAST(sum(amount) AS DOUBLE) AS amount, CASE WHEN count(quantity) = count(*) THEN CAST(sum(quantity) AS DOUBLE) END AS quantity FROM {mart} GROUP BY entity")
def _(s):
    return dbl(mt.run_recipe(s.mart, ["amount", "quantity"], s.mapping, mt.Recipe("wide_raw", ["entity"])), "amount", "quantity")


@query("expand_date_ranges", "SELECT support_rule_id, model_code, CAST(CAST(d AS DATE) AS STRING) AS day FROM (SELECT support_rule_id, model_code, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS d FROM {promos} WHERE end_date >= start_date) AS t")
def _(s):
    return ranges.expand_date_ranges(s.promos).select("support_rule_id", "model_code", F.col("applied_date").cast("string").alias("day"))


@query("expand_calendar", """SELECT CAST(year(d) * 100 + month(d) AS INTEGER) AS date_sk, concat(CAST(year(d) AS STRING), '-', lpad(CAST(month(d) AS STRING), 2, '0')) AS period, CAST(year(d) AS INTEGER) AS year, concat(CAST(year(d) AS STRING), '-Q', CAST(quarter(d) AS STRING)) AS quarter, CAST(month(d) AS INTEGER) AS month
    FROM (SELECT CAST(unnest(generate_series(DATE '1991-04-01', CAST(date_trunc('month', max(o_orderdate)) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS d FROM {orders}) AS t""")
def _(s):
    registered = s.spark.createDataFrame([("1991-05",)], "period string")
    return star.expand_calendar(s.files.select("period"), "1991-Q2", registered)


@query("union_all_rows", "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name AS name FROM {region}")
def _(s):
    return s.nation.select(F.col("n_name").alias("name")).unionByName(s.region.select(F.col("r_name").alias("name")))


# --- quality, validation, reconciliation

@query("inspect_dataset", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN p = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_periods, CAST(sum(CASE WHEN p = '1997-13' THEN 1 ELSE 0 END) AS BIGINT) AS bad_periods, CAST(0 AS BIGINT) AS blank_o_orderkey,
    CAST(sum(CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_amount, CAST(0 AS BIGINT) AS duplicate_groups, false AS is_valid FROM (SELECT *, CASE WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 97 = 0 THEN '1997-13' ELSE period_raw END AS p FROM {files}) AS t""")
def _(s):
    k = F.col("o_orderkey")
    df = s.files.withColumn("p", F.when(k % 101 == 0, "").when(k % 97 == 0, "1997-13").otherwise(F.col("period_raw"))).withColumn("amount", F.when(k % 89 == 0, "x1").otherwise(F.col("amount")))
    return periods.inspect_dataset(df, "p", ["o_orderkey"], ["amount"])


PROMO_RULES = "(SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(start_date AS STRING) END AS s, CASE WHEN o_orderkey % 17 = 0 THEN '-1' ELSE '5.00' END AS amount FROM {promos})"
ISSUES = f"""SELECT 'rules' AS sheet, support_rule_id AS key, 'start_date' AS "column", 'not a date' AS message FROM {PROMO_RULES} AS a WHERE s = 'x' UNION ALL SELECT 'rules' AS sheet, support_rule_id AS key, 'promotion_id' AS "column", 'not in master' AS message FROM {PROMO_RULES} AS b WHERE promotion_id = 'P0'
    UNION ALL SELECT 'rules' AS sheet, support_rule_id AS key, 'end_date' AS "column", 'before start' AS message FROM {PROMO_RULES} AS c WHERE s <> 'x' AND end_date < start_date UNION ALL SELECT 'rules' AS sheet, support_rule_id AS key, 'support_per_unit' AS "column", 'negative' AS message FROM {PROMO_RULES} AS d WHERE amount = '-1'"""


def promo_tables(s):
    k = F.col("o_orderkey")
    rules = s.promos.select("support_rule_id", "promotion_id", "model_code", F.when(k % 13 == 0, "x").otherwise(F.col("start_date").cast("string")).alias("start_date"), F.col("end_date").cast("string").alias("end_date"), F.when(k % 17 == 0, "-1").otherwise("5.00").alias("support_per_unit"), F.lit("PLN").alias("currency"))
    master = s.promos.where("promotion_id <> 'P0'").select("promotion_id").distinct().withColumn("promotion_name", F.concat(F.lit("n"), "promotion_id"))
    return master, rules


@query("promotion_rule_validation", ISSUES)
def _(s):
    return ranges.promotion_rule_validation(*promo_tables(s))


GOOD_RULES = f"(SELECT * FROM {PROMO_RULES} AS r WHERE s <> 'x' AND promotion_id <> 'P0' AND end_date >= start_date AND amount <> '-1')"


@query("normalize_promotions", f"""SELECT 'day' AS kind, support_rule_id AS key, CAST(CAST(d AS DATE) AS STRING) AS value FROM (SELECT support_rule_id, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS d FROM {GOOD_RULES} AS g) AS t
    UNION ALL SELECT 'issue' AS kind, key, concat("column", ' ', message) AS value FROM ({ISSUES}) AS i UNION ALL SELECT 'days' AS kind, NULL AS key, CAST(CAST(sum(end_date - start_date + 1) AS BIGINT) AS STRING) AS value FROM {GOOD_RULES} AS h
    UNION ALL SELECT 'pairs' AS kind, NULL AS key, CAST(CAST(count(*) AS BIGINT) AS STRING) AS value FROM {GOOD_RULES} AS a JOIN {GOOD_RULES} AS b ON a.model_code = b.model_code AND a.o_orderkey < b.o_orderkey AND a.start_date <= b.end_date AND b.start_date <= a.end_date""")
def _(s):
    days, issues, counts = ranges.normalize_promotions(*promo_tables(s))
    made = days.select(F.lit("day").alias("kind"), F.col("support_rule_id").alias("key"), F.col("applied_date").cast("string").alias("value"))
    made = made.unionByName(issues.select(F.lit("issue").alias("kind"), "key", F.concat_ws(" ", "column", "message").alias("value")))
    one = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(None).cast("string").alias("key"), F.col(c).cast("long").cast("string").alias("value")) for c in ("days", "pairs")])).alias("r"))
    return made.unionByName(one.select("r.*"))


@query("wide_long_reconcile", f"SELECT CAST(sum(REV_GROSS + DED_REBATE + COGS_MAT + COST_LOG + COST_PROMO + COST_WARRANTY + COST_FIXED) AS DOUBLE) AS left_total, CAST((SELECT sum(amount) FROM {LONG} AS u) AS DOUBLE) AS right_total, true AS ok FROM {{wide}}")
def _(s):
    wide = s.wide.withColumn("v", sum((F.col(a).cast("decimal(18,6)") for a in ACCOUNTS[1:-1]), F.col(ACCOUNTS[0])))
    return dbl(star.reconcile(wide, long(s), "v", "amount"), "left_total", "right_total")


@query("signed_waterfall_reconcile", f"""SELECT CAST((SELECT sum(reporting) FROM {SIGNED} AS f) AS DOUBLE) AS left_total, CAST(sum(rep) AS DOUBLE) AS right_total, CAST((SELECT sum(signed) FROM {SIGNED} AS f) AS DOUBLE) AS left_local, CAST(sum(loc) AS DOUBLE) AS right_local, true AS ok
    FROM (SELECT period, product_code, {_GR} + {_SD} + {_CG} + {_LC} + {_PC} + {_WC} + {_FX} AS rep, {" + ".join(line_sum(x, "signed") for x in star.STATEMENT_LINES)} AS loc FROM {SIGNED} AS f GROUP BY period, product_code) AS w""")
def _(s):
    return dbl(star.signed_waterfall_reconcile(signed(s), ["period", "product_code"]), "left_total", "right_total", "left_local", "right_local")


UNMAPPED = """SELECT 'pnl_customer' AS kind, period, upper(customer_code) AS code, currency, CAST(count(*) AS BIGINT) AS rows, CAST(sum(price) AS DOUBLE) AS impact FROM {base} WHERE upper(customer_code) NOT IN (SELECT nk FROM {dim_customer}) GROUP BY period, upper(customer_code), currency
    UNION ALL SELECT 'price_product' AS kind, period, upper(product_code) AS code, currency, CAST(count(*) AS BIGINT) AS rows, CAST(max(retail) AS DOUBLE) AS impact FROM {base} WHERE upper(product_code) NOT IN (SELECT nk FROM {dim_product}) GROUP BY period, upper(product_code), currency"""


def unmapped(s):
    c = star.lookup_surrogate_left(s.base, s.dim_customer, "customer_code", "nk", "sk", "customer_sk")
    p = star.lookup_surrogate_left(s.base, s.dim_product, "product_code", "nk", "sk", "product_sk")
    return dbl(star.unmapped_code_report({"pnl_customer": (c, "customer_sk", "customer_code", F.sum("price")), "price_product": (p, "product_sk", "product_code", F.avg("retail"))}), "impact")


@query("unmapped_code_report", UNMAPPED)
def _(s):
    return unmapped(s)


AUDIT_WIDE = """(SELECT w.period, upper(w.customer_code) AS customer_code, upper(w.product_code) AS product_code, w.currency, COST_LOG, round(CAST(COST_LOG AS DECIMAL(24,6)) * rate, 6) AS COST_LOG_R, REV_GROSS - DED_REBATE AS net, REV_GROSS - DED_REBATE - COGS_MAT - COST_PROMO - COST_WARRANTY - COST_FIXED AS op,
    round(CAST(REV_GROSS AS DECIMAL(24,6)) * rate, 6) - round(CAST(DED_REBATE AS DECIMAL(24,6)) * rate, 6) AS net_r, round(CAST(REV_GROSS AS DECIMAL(24,6)) * rate, 6) - round(CAST(DED_REBATE AS DECIMAL(24,6)) * rate, 6) - round(CAST(COGS_MAT AS DECIMAL(24,6)) * rate, 6) - round(CAST(COST_PROMO AS DECIMAL(24,6)) * rate, 6) - round(CAST(COST_WARRANTY AS DECIMAL(24,6)) * rate, 6) - round(CAST(COST_FIXED AS DECIMAL(24,6)) * rate, 6) AS op_r
    FROM (SELECT * REPLACE (CASE WHEN currency = 'EUR' THEN 0 ELSE REV_GROSS END AS REV_GROSS, CASE WHEN currency = 'EUR' THEN 0 ELSE DED_REBATE END AS DED_REBATE) FROM {wide} WHERE entity = 'PL') AS w JOIN {rates} AS r ON w.period = r.period AND w.currency = r.currency)"""
_SALES = "CAST(count(*) AS BIGINT) AS rows, CAST(CASE WHEN sum(net) <> 0 THEN sum(net) ELSE sum(abs(op)) END AS DOUBLE) AS impact_local, CAST(CASE WHEN sum(net_r) <> 0 THEN sum(net_r) ELSE sum(abs(op_r)) END AS DOUBLE) AS impact_reporting, 'net revenue or absolute operating profit' AS basis"


@query("unmapped_code_audit", f"""SELECT 'pnl_customer' AS kind, period, customer_code AS code, currency, {_SALES} FROM {AUDIT_WIDE} AS w WHERE customer_code NOT IN (SELECT nk FROM {{dim_customer}}) GROUP BY period, customer_code, currency
    UNION ALL SELECT 'pnl_product', period, product_code, currency, {_SALES} FROM {AUDIT_WIDE} AS w WHERE product_code NOT IN (SELECT nk FROM {{dim_product}}) GROUP BY period, product_code, currency
    UNION ALL SELECT 'pnl_account', period, 'COST_LOG', currency, CAST(count(*) AS BIGINT), CAST(sum(COST_LOG) AS DOUBLE), CAST(sum(COST_LOG_R) AS DOUBLE), 'raw account amount' FROM {AUDIT_WIDE} AS w GROUP BY period, currency
    UNION ALL SELECT 'inventory_product', i.period, upper(i.product_code), i.currency, CAST(count(*) AS BIGINT), CAST(sum(value) AS DOUBLE), CAST(sum(round(CAST(value AS DECIMAL(24,6)) * rate, 6)) AS DOUBLE), 'stock value' FROM {{inv}} AS i JOIN {{rates}} AS r ON i.period = r.period AND i.currency = r.currency WHERE entity = 'PL' AND upper(i.product_code) NOT IN (SELECT nk FROM {{dim_product}}) GROUP BY i.period, upper(i.product_code), i.currency
    UNION ALL SELECT 'price_product', p.period, upper(p.product_code), p.currency, CAST(count(*) AS BIGINT), CAST(max(our_price) AS DOUBLE), CAST(max(round(CAST(our_price AS DECIMAL(24,6)) * rate, 6)) AS DOUBLE), 'mean price' FROM {{prices}} AS p JOIN {{rates}} AS r ON p.period = r.period AND p.currency = r.currency WHERE entity = 'PL' AND upper(p.product_code) NOT IN (SELECT nk FROM {{dim_product}}) GROUP BY p.period, upper(p.product_code), p.currency""")
def _(s):
    """All branches of a star whose rules lack an account, and whose euro rows have no revenue."""
    s.stored("base")
    none = F.lit(0).cast("decimal(18,6)")
    wide = s.wide.withColumns({c: F.when(F.col("currency") == "EUR", none).otherwise(F.col(c)) for c in ("REV_GROSS", "DED_REBATE")})
    got = flows.tolerant_star(wide, s.inv, s.prices, s.customers, s.products, s.rules.where("account_code <> 'COST_LOG'"), s.rates, entity="PL", currencies=["PLN", "EUR", "USD"], reporting="PLN", accounts=ACCOUNTS, allow_unmapped=True)
    return dbl(got.checks["unmapped"], "impact_local", "impact_reporting")


@query("unmapped_code_log", UNMAPPED)
def _(s):
    path, report = scratch_folder(s.spark), unmapped(s)
    sinks.write_result_csv(report, path)  # the audit file
    log = landing.scan_delimited_text(s.spark, path)
    return log.select(*[F.col(c).cast(t).alias(c) for c, t in report.dtypes])


@query("unmapped_account_guard", "SELECT 'COST_LOG' AS account_code, CAST(count(*) AS BIGINT) AS rows, CAST(sum(COST_LOG) AS DOUBLE) AS impact FROM {wide}")
def _(s):
    f = star.long_amounts(long(s), s.rules.where("account_code <> 'COST_LOG'"), s.rates, "PLN")
    return dbl(star.unmapped_account_guard(f, allow=True), "impact")


@query("fanout_check", "SELECT true AS grain_unique, CAST(0 AS DOUBLE) AS max_diff_price, CAST(0 AS DOUBLE) AS max_diff_qty, true AS ok")
def _(s):
    mart = s.base.groupBy("period", "product_code").agg(F.sum("price").alias("price"), F.sum("qty").alias("qty"))
    return dbl(star.fanout_check(mart, s.base, ["period", "product_code"], ["price", "qty"]), "max_diff_price", "max_diff_qty")


@query("dimension_uniqueness", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT sk) AS BIGINT) AS keys, CAST(count(DISTINCT upper(trim(nk))) AS BIGINT) AS codes, true AS ok FROM {dim_product}")
def _(s):
    return star.dimension_uniqueness(s.dim_product, "sk", "nk")


@query("master_key_check", "SELECT upper(trim(p_brand)) AS key, CAST(count(*) AS BIGINT) AS n FROM {part} GROUP BY upper(trim(p_brand)) HAVING count(*) > 1")
def _(s):
    return star.master_key_check(s.part, "p_brand")


@query("reconcile_scopes", "SELECT DISTINCT period, entity, period <> '1997-01' AS matches FROM {mart}")
def _(s):
    stored = mt.scope_controls(s.mart, ["period", "entity"], ["amount"]).withColumn("sum_amount", F.col("sum_amount") + F.when(F.col("period") == "1997-01", 1).otherwise(0))
    return mt.reconcile_scopes(stored, s.mart, ["period", "entity"], ["amount"])


@query("recipe_reconcile", f"SELECT major_category, CAST(sum(amount) AS DOUBLE) AS source_total, CAST(sum(amount) AS DOUBLE) AS exported_total, true AS matches FROM {DETAIL} AS d GROUP BY major_category")
def _(s):
    return dbl(mt.recipe_reconcile(s.mart, MEASURES, s.mapping, RECIPE), "source_total", "exported_total")


NOW = "(SELECT DISTINCT file, period FROM {files} WHERE NOT (file = 'sales_5-LOW.csv' AND period = '1997-01'))"


@query("half_period_guard", f"SELECT period, CAST(count(*) AS BIGINT) AS missing FROM (SELECT DISTINCT file, period FROM {{files}} EXCEPT SELECT file, period FROM {NOW} AS n) AS t GROUP BY period")
def _(s):
    hist = s.files.select("file", "period").distinct()
    now = hist.where("NOT (file = 'sales_5-LOW.csv' AND period = '1997-01')")
    return periods.half_period_guard(now, hist, hist.select("period").distinct())


@query("conflicting_attributes", "SELECT customer, period, CAST(count(DISTINCT entity) AS BIGINT) AS versions FROM (SELECT customer, period, CASE WHEN seq % 37 = 0 THEN 'X' ELSE entity END AS entity FROM {mart}) AS t GROUP BY customer, period HAVING count(DISTINCT entity) > 1")
def _(s):
    df = s.mart.withColumn("entity", F.when(F.col("seq") % 37 == 0, "X").otherwise(F.col("entity")))
    return star.conflicting_attributes(df, "customer", "period", ["entity"])


@query("approval_gate", "SELECT true AS approved, true AS same UNION ALL SELECT false AS approved, false AS same")
def _(s):
    a = periods.summary_metrics(s.files, "period", ["amount"])
    changed = periods.summary_metrics(s.files.where("o_orderkey % 2 = 0"), "period", ["amount"])
    return periods.approval_gate(a, a, ["amount"]).withColumn("same", F.lit(True)).unionByName(periods.approval_gate(a, changed, ["amount"]).withColumn("same", F.lit(False)))


@query("scope_row_validation", "SELECT CAST(0 AS BIGINT) AS blank_scope, CAST(0 AS BIGINT) AS blank_key, CAST((SELECT count(*) FROM {mart} WHERE amount <> round(amount, 1)) AS BIGINT) AS inexact, CAST((SELECT count(*) FROM {mart} WHERE period = '1995-07') AS BIGINT) AS odd_periods, CAST((SELECT CASE WHEN min(length(customer)) < max(length(customer)) THEN 1 ELSE 0 END FROM {mart}) AS BIGINT) AS mixed_authorities, CAST((SELECT count(*) FROM (SELECT 1 AS one FROM {mart} GROUP BY period, entity, customer HAVING count(*) > 1) AS g) AS BIGINT) AS repeated_keys, CAST((SELECT count(*) FROM {mart} WHERE period < '1997-01') AS BIGINT) AS outside")
def _(s):
    dims = [mt.Dimension("a", ["labor"], ["quantity"], "customer"), mt.Dimension("b", ["labor"], ["quantity"], "period")]
    model = mt.MartModel("period", ["customer"], [mt.Measure("amount", 18, 1)], dims, ["entity"])
    scopes = s.mart.where("period >= '1997-01'").select("period", "entity").distinct()
    odd = s.mart.withColumn("period", F.when(F.col("period") == "1995-07", "1995-17").otherwise(F.col("period")))
    return mt.scope_row_validation(odd.withColumn("amount", F.col("amount").cast("string")), model, scopes)


@query("unmapped_measures", "SELECT source_column FROM {accounts} WHERE source_column LIKE '% misc %' OR source_column LIKE '% admin %'")
def _(s):
    category = F.when(F.col("source_column").contains(" admin "), " ").otherwise("cogs")
    mapping = s.accounts.where(~F.col("source_column").contains(" misc ")).select("source_column", F.lit("amount").alias("measure_type"), category.alias("major_category"))
    return mt.unmapped_measures(s.accounts, mapping)


@query("recipe_left_out", """SELECT source_column, CASE WHEN source_column LIKE '% qty %' THEN 'non_monetary' WHEN source_column LIKE '% total %' THEN 'subtotal' ELSE 'unmapped' END AS reason FROM {accounts}
    WHERE source_column LIKE '% qty %' OR source_column LIKE '% total %' OR source_column LIKE '% misc %' OR source_column LIKE '% admin %'""")
def _(s):
    """Of all accounts, where those named misc have no entry and those named admin no category."""
    has = lambda w: F.col("source_column").contains(f" {w} ")
    kind = F.when(has("qty"), "non_monetary").when(has("total"), "subtotal").otherwise("amount")
    entries = s.accounts.where(~has("misc")).select("source_column", kind.alias("measure_type"), F.when(~has("admin"), "cost").alias("major_category"))
    return mt.recipe_left_out(s.accounts, entries)


# --- incremental state

REPLACED = "SELECT period, o_orderkey FROM {files} WHERE o_orderkey % 2 = 0 AND period NOT IN (SELECT period FROM {files} WHERE o_orderkey % 2 = 1 AND period >= '1998-01') UNION ALL SELECT period, o_orderkey FROM {files} WHERE o_orderkey % 2 = 1 AND period >= '1998-01'"


@query("replace_periods", f"SELECT * FROM ({REPLACED}) AS r WHERE period NOT BETWEEN '1996-05' AND '1996-08'")
def _(s):
    """New rows for the periods from 1998 on, and none for four target periods of 1996, which are gone then."""
    store = Revisions(s.spark, scratch_folder(s.spark))
    periods.replace_periods(store, s.files.where("o_orderkey % 2 = 0").select("period", "o_orderkey"))
    now = periods.replace_periods(store, s.files.where("o_orderkey % 2 = 1 AND period >= '1998-01'").select("period", "o_orderkey"), [f"1996-0{k}" for k in range(5, 9)])
    return store.read("rows", now).select("period", "o_orderkey")


@query("target_period_closure", "SELECT DISTINCT period FROM {files} WHERE substring(period, 1, 4) = '1997'")
def _(s):
    now = s.files.select(F.concat(F.lit("f"), F.substring("period", 1, 4), F.floor((F.substring("period", 6, 2).cast("int") - 1) / 2).cast("string")).alias("file"), "period").distinct()
    hist = s.files.select(F.concat(F.lit("h"), F.substring("period", 1, 4), F.floor(F.substring("period", 6, 2).cast("int") / 2).cast("string")).alias("file"), "period").distinct()
    return periods.target_period_closure(now, hist, now.where("period = '1997-05'").select("file"))


@query("replace_scope", "SELECT invoice, entity FROM {mart} WHERE NOT (period = '1997-01' AND entity = 'A') OR seq % 2 = 0")
def _(s):
    incoming = s.mart.where("period = '1997-01' AND entity = 'A' AND seq % 2 = 0")
    return mt.replace_scope(s.mart, incoming, ["period", "entity"]).select("invoice", "entity")


@query("load_all_scopes", "SELECT period, entity, CAST(count(*) AS BIGINT) AS n FROM {mart} GROUP BY period, entity")
def _(s):
    path = scratch_folder(s.spark)
    mt.load_all_scopes(s.mart.select("period", "entity", "invoice"), path, ["period", "entity"])
    return s.spark.read.schema("invoice string, period string, entity string").parquet(path).groupBy("period", "entity").agg(F.count(F.lit(1)).alias("n"))


OLD_DIM = "(SELECT nk, sk, CASE WHEN sk % 4 = 0 THEN '2030-01' ELSE '1990-01' END AS period, 'old' AS entity FROM (SELECT DISTINCT customer AS nk FROM {mart} WHERE CAST(customer AS BIGINT) % 3 <> 0) AS d JOIN (SELECT customer AS nk2, CAST(row_number() OVER (ORDER BY customer) AS BIGINT) AS sk FROM (SELECT DISTINCT customer FROM {mart} WHERE CAST(customer AS BIGINT) % 3 <> 0) AS e) AS f ON nk = nk2)"


@query("merge_dimension_type1", f"""SELECT coalesce(o.sk, n.sk) AS sk, coalesce(o.nk, n.customer) AS customer, CASE WHEN o.sk IS NULL OR o.period < n.period THEN n.entity ELSE 'old' END AS entity FROM {OLD_DIM} AS o FULL OUTER JOIN
    (SELECT customer, entity, period, CASE WHEN CAST(customer AS BIGINT) % 3 = 0 THEN (SELECT max(sk) FROM {OLD_DIM} AS m) + CAST(row_number() OVER (PARTITION BY CAST(customer AS BIGINT) % 3 = 0 ORDER BY customer) AS BIGINT) END AS sk FROM (SELECT customer, max(period) AS period, max(entity) AS entity FROM {{mart}} GROUP BY customer) AS l) AS n ON o.nk = n.customer""")
def _(s):
    members = s.mart.where("CAST(customer AS BIGINT) % 3 <> 0").select("customer").distinct()
    old = star.number_rows(members, ["customer"], "sk").withColumn("period", F.when(F.col("sk") % 4 == 0, "2030-01").otherwise("1990-01")).withColumn("entity", F.lit("old"))
    dim, _ = star.merge_dimension_type1(old.select("sk", "customer", "period", "entity"), s.mart.select("customer", "period", "entity").distinct(), "customer", ["entity"], "period")
    return dim.select("sk", "customer", "entity")


@query("upsert_master", "SELECT upper(p_brand) AS code, 'new' AS note FROM {part} GROUP BY upper(p_brand) HAVING min(p_size) < 3 UNION ALL SELECT upper(p_brand) AS code, 'old' AS note FROM {part} GROUP BY upper(p_brand) HAVING min(p_size) >= 3")
def _(s):
    brands = s.part.groupBy(F.lower("p_brand").alias("code")).agg(F.min("p_size").alias("m"))
    return star.upsert_master(brands.select("code", F.lit("old").alias("note")), brands.where("m < 3").select(F.upper("code").alias("code"), F.lit("new").alias("note")), "code")


@query("build_dimensions", """SELECT 'customer' AS dim, sk, nk AS code FROM {dim_customer} UNION ALL SELECT 'product' AS dim, sk, nk AS code FROM {dim_product}
    UNION ALL SELECT 'warehouse' AS dim, CAST(row_number() OVER (ORDER BY code) AS BIGINT) AS sk, code FROM (SELECT DISTINCT upper(warehouse_code) AS code FROM {inv}) AS w UNION ALL SELECT 'channel' AS dim, CAST(row_number() OVER (ORDER BY code) AS BIGINT) AS sk, code FROM (SELECT DISTINCT upper(channel_code) AS code FROM {prices}) AS c
    UNION ALL SELECT 'account' AS dim, CAST(row_number() OVER (ORDER BY account_code) AS BIGINT) AS sk, account_code AS code FROM {rules} UNION ALL SELECT 'date' AS dim, CAST(replace(period, '-', '') AS BIGINT) AS sk, period AS code FROM (SELECT DISTINCT period FROM {base}) AS d
    UNION ALL SELECT dim, CAST(-1 AS BIGINT) AS sk, 'UNKNOWN' AS code FROM (VALUES ('customer'), ('product'), ('warehouse'), ('channel')) AS u(dim)""")
def _(s):
    s.stored("base", *FACTS)
    dims = flows.build_dimensions(s.customers, s.products, s.inv, s.prices, s.rules, s.base.select("period").distinct())
    code = {"customer": "customer_code", "product": "product_code", "warehouse": "warehouse_code", "channel": "channel_code", "account": "account_code", "date": "period"}
    number = {"account": "account_sk", "date": "date_sk"}
    parts = [d.select(F.lit(n).alias("dim"), F.col(number.get(n, "sk")).cast("long").alias("sk"), F.col(code[n]).alias("code")) for n, d in dims.items()]
    return reduce(DataFrame.unionByName, parts)


@query("archive_replaced_rows", "SELECT invoice, CAST(6 AS BIGINT) AS replaced_by FROM {mart} WHERE period = '1997-01'")
def _(s):
    return mt.archive_replaced_rows(s.mart, s.mart.where("period = '1997-01'"), ["period", "entity"], 6).select("invoice", "replaced_by")


@query("ingestion_history", "SELECT DISTINCT file, period FROM {files} WHERE o_orderkey % 2 = 0 AND file NOT IN ('sales_5-LOW.csv')")
def _(s):
    f = s.files.where("o_orderkey % 2 = 0").select("file", "period").distinct().withColumn("hash", F.sha2("file", 256))
    return periods.new_files(f, f.where("file = 'sales_5-LOW.csv'")).select("file", "period")


@query("accumulate_inspect_publish", """SELECT period, o_orderkey FROM {files} WHERE (o_orderkey % 2 = 0 AND substring(period, 1, 4) <> '1997') OR (o_orderkey % 2 = 1 AND period BETWEEN '1997-01' AND '1997-06')""")
def _(s):
    """Files of a year each, with periods in three forms. That of 1997 comes again with other rows, of six months only; two new files of one period are refused."""
    landed_rows = s.files.select(F.concat(F.lit("sales_"), F.substring("period", 1, 4), F.lit(".csv")).alias("file"), F.col("period_raw").alias("period"), "o_orderkey", "o_custkey", "amount", F.col("period").alias("month"))
    store, wanted = Revisions(s.spark, scratch_folder(s.spark)), ["period", "o_orderkey", "amount"]
    headers = landed_rows.select("file", F.array(*[F.lit(c) for c in wanted]).alias("header")).distinct()

    def load(rows, hash_):
        made = flows.inspect_load(rows.drop("month").withColumn("hash", F.lit(hash_)), store, ["o_orderkey"], ["amount"], headers.join(rows.select("file").distinct(), "file", "left_semi"), wanted)
        return flows.publish_load(made, made.snapshot)

    load(landed_rows.where("o_orderkey % 2 = 0"), "first")
    now = load(landed_rows.where("o_orderkey % 2 = 1 AND month BETWEEN '1997-01' AND '1997-06'"), "second")
    twice = landed_rows.where("month = '1996-01'").withColumn("file", F.when(F.col("o_orderkey") % 3 == 0, "a.csv").otherwise("b.csv")).withColumn("month", F.lit(None))
    try:
        flows.inspect_load(twice.drop("month").withColumn("hash", F.col("file")), store, ["o_orderkey"], ["amount"])
        raise AssertionError("two new files of one period weren't refused")
    except ValueError:
        pass
    return store.read("rows", now).select("period", "o_orderkey")


# --- pipelines of the stars and the mart

LINE_SUMS = ", ".join(f"{line_sum(x)} AS {x.lower()}" for x in star.STATEMENT_LINES)
TOLERANT_STOCK = """(SELECT period, product_code, sum(qty) AS stock_qty, sum(v) AS stock_value, sum(c) AS stock_cost, CASE WHEN sum(v) > 0 THEN CAST(sum(CAST(v AS DECIMAL(24,6)) * dio) AS DOUBLE) / CAST(sum(v) AS DOUBLE) ELSE CAST(sum(dio) AS DOUBLE) / count(dio) END AS dio, count(DISTINCT warehouse_code) AS warehouses
    FROM (SELECT i.period, upper(product_code) AS product_code, warehouse_code, qty, round(CAST(value AS DECIMAL(24,6)) * rate, 6) AS v, round(CAST(cost AS DECIMAL(24,6)) * rate, 6) AS c, dio FROM {inv} AS i JOIN {rates} AS x ON i.period = x.period AND i.currency = x.currency WHERE entity = 'PL') AS t GROUP BY period, product_code)"""
TOLERANT_PRICE = """(SELECT period, product_code, CAST(sum(p) AS DOUBLE) / count(p) AS our_price, min(p) AS min_our_price, max(q) AS max_competitor_price, count(DISTINCT channel_code) AS channels
    FROM (SELECT i.period, upper(product_code) AS product_code, channel_code, round(CAST(our_price AS DECIMAL(24,6)) * rate, 6) AS p, round(CAST(competitor_price AS DECIMAL(24,6)) * rate, 6) AS q FROM {prices} AS i JOIN {rates} AS x ON i.period = x.period AND i.currency = x.currency WHERE entity = 'PL') AS t GROUP BY period, product_code)"""


@query("pnl_star_tolerant", f"""SELECT l.period, l.product_code, coalesce(d.sk, -1) AS product_sk, CAST(gross_revenue AS DOUBLE) AS gross_revenue, CAST(gross_revenue + sales_deduction AS DOUBLE) AS net_revenue, CAST(logistics_cost + promotion_cost + warranty_cost AS DOUBLE) AS variable_cost, CAST(gross_revenue + sales_deduction + cogs + logistics_cost + promotion_cost + warranty_cost + fixed_sgna AS DOUBLE) AS operating_profit,
    CAST(q.qty AS DOUBLE) AS qty, CAST(customers AS BIGINT) AS customers, CAST(stock_qty AS DOUBLE) AS stock_qty, CAST(stock_value AS DOUBLE) AS stock_value, CAST(stock_cost AS DOUBLE) AS stock_cost, dio, CAST(warehouses AS BIGINT) AS warehouses, our_price, CAST(min_our_price AS DOUBLE) AS min_our_price, CAST(max_competitor_price AS DOUBLE) AS max_competitor_price, CAST(channels AS BIGINT) AS channels
    FROM (SELECT f.period, upper(f.product_code) AS product_code, {LINE_SUMS} FROM {SIGNED} AS f WHERE entity = 'PL' GROUP BY f.period, upper(f.product_code)) AS l
    JOIN (SELECT period, upper(product_code) AS product_code, sum(qty) AS qty, count(DISTINCT customer_code) AS customers FROM {{base}} WHERE entity = 'PL' GROUP BY period, upper(product_code)) AS q ON l.period = q.period AND l.product_code = q.product_code
    JOIN {TOLERANT_STOCK} AS i ON l.period = i.period AND l.product_code = i.product_code JOIN {TOLERANT_PRICE} AS r ON l.period = r.period AND l.product_code = r.product_code LEFT JOIN {{dim_product}} AS d ON l.product_code = d.nk""")
def _(s):
    s.stored("base")
    got = flows.tolerant_star(s.wide, s.inv, s.prices, s.customers, s.products, s.rules, s.rates, entity="PL", currencies=["PLN", "EUR", "USD"], reporting="PLN", accounts=ACCOUNTS, target=scratch_folder(s.spark))
    exact = ["gross_revenue", "net_revenue", "variable_cost", "operating_profit", "qty", "stock_qty", "stock_value", "stock_cost", "min_our_price", "max_competitor_price"]
    return dbl(got.mart.select("period", "product_code", "product_sk", *exact, "customers", "dio", "warehouses", "our_price", "channels"), *exact)


@query("pnl_star_strict", """SELECT l_orderkey, l_linenumber, ck.sk AS customer_sk, CAST(g AS DOUBLE) AS gross, CAST(g - d - c AS DOUBLE) AS margin, CAST(round(g * rate, 2) - round(d * rate, 2) AS DOUBLE) AS net_reporting FROM (SELECT w.*, rate, CAST(REV_GROSS AS DECIMAL(18,2)) AS g, CAST(DED_REBATE AS DECIMAL(18,2)) AS d, CAST(COGS_MAT AS DECIMAL(18,2)) AS c
    FROM {wide} AS w JOIN {rates} AS r ON w.period = r.period AND w.currency = r.currency) AS t JOIN (SELECT concat('C', lpad(CAST(c_custkey AS STRING), 12, '0')) AS nk, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS sk FROM {customer}) AS ck ON upper(customer_code) = ck.nk""")
def _(s):
    customers = star.number_rows(s.customer.select(F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("nk")), ["nk"], "sk")
    products = star.number_rows(s.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("nk")), ["nk"], "sk")
    lines = {"GROSS_REVENUE": ["REV_GROSS"], "SALES_DEDUCTION": ["DED_REBATE"], "COGS": ["COGS_MAT"]}
    out = flows.strict_star(s.wide, {"customer_code": (customers, "nk"), "product_code": (products, "nk")}, s.rates, lines)
    return out.select("l_orderkey", "l_linenumber", F.col("customer_code_sk").alias("customer_sk"), F.col("gross_revenue_local").cast("double").alias("gross"), F.col("gross_margin_local").cast("double").alias("margin"), F.col("net_revenue_reporting").cast("double").alias("net_reporting"))


MART_MODEL = mt.MartModel("period", ["invoice"], [mt.Measure(m) for m in MEASURES], [mt.Dimension("customer", ["customer"], ["entity"])], ["entity"], duplicates="sum")


@query("mart_load_export", f"SELECT period, entity, account_code, CAST(amount AS DOUBLE) AS amount, CAST(2 AS BIGINT) AS revision FROM {DETAIL} AS d WHERE amount <> 0")
def _(s):
    target = scratch_folder(s.spark)
    rows = s.stored("mart").withColumns({m: F.col(m).cast("string") for m in MEASURES})
    wrong = rows.withColumn("amount", F.when(F.col("period") == "1997-01", F.lit("0.00")).otherwise(F.col("amount")))
    flows.load_mart(wrong, MART_MODEL, target, "seq")
    load = flows.load_mart(rows, MART_MODEL, target, "seq")  # corrects the scopes of one period; the others are as they were
    out = scratch_folder(s.spark)
    flows.export_mart(load, out, "all")
    flows.approve_export(load, out, "all", "a reviewer")
    done = flows.publish_export(load, out, "all", f"{out}/published")
    fact = Revisions(s.spark, f"{out}/published").read("data", done)
    if not mt.recipe_reconcile(fact, MEASURES, s.mapping, RECIPE).where("NOT matches").isEmpty():
        raise ValueError("the export differs from the mart")
    return dbl(mt.run_recipe(fact, MEASURES, s.mapping, RECIPE).select("period", "entity", "account_code", "amount"), "amount").withColumn("revision", F.lit(load.revision).cast("long"))


@query("additivity_safe_rollup", """SELECT entity, CAST(sum(amount) AS DOUBLE) AS amount, CAST((SELECT sum(value) FROM {inv} AS z WHERE z.entity = t.entity AND z.period = max(t.period)) AS DOUBLE) AS value, CAST(sum(wd) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS dio FROM (SELECT entity, period, sum(cost) AS amount, sum(CAST(cost AS DECIMAL(24,6)) * dio) AS wd FROM {inv} GROUP BY entity, period) AS t GROUP BY entity""")
def _(s):
    m = s.inv.withColumnRenamed("cost", "amount")
    path = scratch_folder(s.spark)
    sinks.write_parquet(star.with_additivity(m, {"amount": "ADDITIVE", "value": "SEMI_ADDITIVE", "dio": ("WEIGHTED", "amount")}), path)
    return dbl(star.additivity_safe_rollup(s.spark.read.parquet(path), ["entity"], "period"), "amount", "value")


@query("price_check", "SELECT true AS grain_unique, CAST(count(DISTINCT concat(period, '/', product_code)) AS BIGINT) AS strays, CAST(0 AS DOUBLE) AS max_diff_our_price, count(*) = 0 AS ok FROM {prices} WHERE product_code LIKE 'p1%'")
def _(s):
    """A mart that lacks the prices of some products."""
    grain = ["period", "product_code"]
    mart = star.price_premart(s.prices, grain, ["our_price"], "channel_code").where("product_code NOT LIKE 'p1%'")
    return star.price_check(mart, s.prices, grain, ["our_price"])


@query("sketched_cardinality", "SELECT substring(period, 1, 4) AS year, CAST(count(DISTINCT o_custkey) AS BIGINT) AS exact, true AS within FROM {files} GROUP BY substring(period, 1, 4)")
def _(s):
    """Distinct customers of each year by sketches of its periods, held against the exact count within three standard errors."""
    year = F.substring("period", 1, 4).alias("year")
    exact = s.files.groupBy(year).agg(F.count_distinct("o_custkey").alias("exact"))
    sketches = agg.period_sketches(s.files, ["o_custkey"], "period")
    guess = sketches.groupBy(year).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("guess"))
    return exact.join(guess, "year").select("year", "exact", (F.abs(F.col("guess") - F.col("exact")) <= 0.027 * F.col("exact")).alias("within"))


# --- profiling

@query("profile_columns", """SELECT "column", rows, null_ratio, distinct_values, role FROM (SELECT 'o_orderstatus' AS "column", CAST(count(*) AS BIGINT) AS rows, CAST(0 AS DOUBLE) AS null_ratio, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS distinct_values, 'general' AS role FROM {files}
    UNION ALL SELECT 'period_raw' AS "column", CAST(count(*) AS BIGINT) AS rows, CAST(0 AS DOUBLE) AS null_ratio, CAST(count(DISTINCT period_raw) AS BIGINT) AS distinct_values, 'period' AS role FROM {files}
    UNION ALL SELECT 'amount' AS "column", CAST(count(*) AS BIGINT) AS rows, CAST(0 AS DOUBLE) AS null_ratio, CAST(count(DISTINCT amount) AS BIGINT) AS distinct_values, 'numeric' AS role FROM {files}) AS t""")
def _(s):
    return profile.profile_columns(s.files, ["o_orderstatus", "period_raw", "amount"]).select("column", "rows", "null_ratio", "distinct_values", "role")


ROLE_COLUMNS = "SELECT concat('L', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS line_id, concat('L', CAST(l_orderkey AS STRING)) AS repeat_id, period, entity, customer_code, product_code, currency, qty, price FROM {base}"
_ROW_KEY = "CASE WHEN count(DISTINCT {c}) > 0.8 * count(*) THEN 'row_key' ELSE 'dim_key' END"
_NUMERIC = "CASE WHEN count_if(TRY_CAST({c} AS DOUBLE) IS NOT NULL) >= 0.85 * count({c}) THEN 'measure' ELSE 'unassigned' END"


@query("suggest_roles", " UNION ALL ".join(f"""SELECT {k} AS at, '{c}' AS "column", {role.format(c=c)} AS role, {dim.format(c=c, role=role.format(c=c))} AS dimension, {kind} AS kind FROM ({ROLE_COLUMNS}) AS t""" for k, (c, role, dim, kind) in enumerate((
    ("line_id", _ROW_KEY, "CASE WHEN {role} = 'dim_key' THEN 'line' END", "NULL"), ("repeat_id", _ROW_KEY, "CASE WHEN {role} = 'dim_key' THEN 'repeat' END", "NULL"), ("period", "CASE WHEN count_if(regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}$')) >= 0.8 * count({c}) THEN 'period' ELSE 'unassigned' END", "NULL", "NULL"),
    ("entity", "CASE WHEN count(DISTINCT {c}) <= 10 THEN 'partition' ELSE 'unassigned' END", "NULL", "NULL"), ("customer_code", "CASE WHEN count({c}) > 0 THEN 'dim_key' END", "'고객/거래처'", "NULL"), ("product_code", "CASE WHEN count({c}) > 0 THEN 'dim_key' END", "'제품/품목'", "NULL"), ("currency", "CASE WHEN count({c}) > 0 THEN 'dim_key' END", "'통화'", "NULL"), ("qty", _NUMERIC, "NULL", "'quantity'"), ("price", _NUMERIC, "NULL", "'value'"),
))))
def _(s):
    df = s.sql(ROLE_COLUMNS)
    return roles.suggest_roles(profile.profile_columns(df), df.columns).drop("confidence")


@query("vote_number_format", "SELECT 't' AS \"column\", CAST(sum(CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9]{1,3}([ .][0-9]{3})+,[0-9]+$') OR regexp_matches(trim(t), '^[+-]?[0-9]+,([0-9]{1,2}|[0-9]{4,})$') THEN 1 ELSE 0 END) AS BIGINT) AS eu, CAST(sum(CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?$') OR regexp_matches(trim(t), '^[+-]?[0-9]+[.]([0-9]{1,2}|[0-9]{4,})$') THEN 1 ELSE 0 END) AS BIGINT) AS us FROM {numtext}")
def _(s):
    return profile.vote_number_format(s.numtext, ["t"]).drop("format")


@query("inspect_schema", "SELECT 'o_orderstatus' AS \"column\", 'dimension' AS candidate UNION ALL SELECT 'period_raw' AS \"column\", 'month' AS candidate UNION ALL SELECT 'amount' AS \"column\", 'measure' AS candidate FROM (SELECT count(*) FROM {files}) AS t")
def _(s):
    return profile.inspect_schema(s.files.select("o_orderstatus", "period_raw", "amount"), None).select("column", "candidate")


@query("infer_precision_scale", "SELECT 't' AS \"column\", 18 AS p, 2 AS s FROM (SELECT max(cents) AS c FROM {cents}) AS x")
def _(s):
    got = profile.infer_precision_scale(s.numtext, ["t"])
    return s.spark.createDataFrame([(c, p, k) for c, (p, k) in got.items()], "column string, p int, s int")


@query("classify_account_names", """SELECT source_column, CASE WHEN source_column LIKE '% qty %' THEN 'non_monetary' WHEN source_column LIKE '% total %' THEN 'subtotal' WHEN source_column LIKE '% freight %' THEN 'variable' WHEN source_column LIKE '% rent %' THEN 'fixed' WHEN source_column LIKE '% admin %' THEN 'sga' WHEN source_column LIKE '% cost %' THEN 'generic_cost' WHEN source_column LIKE '% sales %' THEN 'revenue' ELSE 'other' END AS kind FROM {accounts}""")
def _(s):
    return profile.classify_account_names(s.accounts).select("source_column", "kind")
