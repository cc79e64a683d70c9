"""Inputs that the queries derive from the given tables, in SQL that Spark and the oracle both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators.star import number_rows
from tallyforge.session import hash_joins, written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

INPUTS = {
    # money in whole cents and whole quantities: sums of doubles are then exact in any order
    "ledger": """SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING) AS month, l_returnflag AS division, l_linestatus AS customer,
        concat('M', CAST(l_suppkey % 20 AS STRING)) AS model, l_quantity AS qty, round(l_extendedprice * 100) AS sales, round(l_discount * 100) AS cost1,
        round(l_tax * 100) AS cost2, CAST(l_orderkey % 7 AS DOUBLE) AS cost3, l_orderkey, l_linenumber FROM {lineitem}""",
    "cents": """SELECT l_orderkey, l_linenumber, l_orderkey % 12 AS form, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM {lineitem}""",
    "parts3": """SELECT l_orderkey, l_linenumber, form, CAST(floor(cents / 100000) AS BIGINT) AS thousands, CAST(floor(cents / 100) AS BIGINT) AS whole,
        lpad(CAST(CAST(floor(cents / 100) AS BIGINT) % 1000 AS STRING), 3, '0') AS rest, lpad(CAST(cents % 100 AS STRING), 2, '0') AS frac FROM {cents}""",
    "numtext": """SELECT l_orderkey, l_linenumber, CASE form
        WHEN 0 THEN concat(CAST(whole AS STRING), '.', frac) WHEN 1 THEN concat(CAST(thousands AS STRING), ',', rest, '.', frac)
        WHEN 2 THEN concat(CAST(thousands AS STRING), ' ', rest, ',', frac) WHEN 3 THEN '-' WHEN 4 THEN '  ' WHEN 5 THEN concat(CAST(thousands AS STRING), ',', frac)
        WHEN 6 THEN concat(CAST(l_linenumber AS STRING), '.5e3') WHEN 7 THEN concat('00', CAST(whole AS STRING)) WHEN 8 THEN concat(CAST(whole AS STRING), ',', frac)
        WHEN 9 THEN concat('-', CAST(whole AS STRING), '.', frac) WHEN 10 THEN concat(' +', CAST(thousands AS STRING), '.', rest, ',', frac, ' ') END AS t FROM {parts3}""",
    "datetext": """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CASE o_orderkey % 10
        WHEN 0 THEN concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))
        WHEN 1 THEN concat(CAST(day(o_orderdate) AS STRING), '.', CAST(month(o_orderdate) AS STRING), '.', CAST(year(o_orderdate) AS STRING))
        WHEN 2 THEN concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
        WHEN 3 THEN concat(CAST(month(o_orderdate) AS STRING), '-', CAST(day(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) AS STRING))
        WHEN 4 THEN CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) WHEN 5 THEN CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS STRING)
        WHEN 6 THEN concat(CAST(year(o_orderdate) AS STRING), '.', CAST(month(o_orderdate) AS STRING)) WHEN 7 THEN concat(CAST(year(o_orderdate) AS STRING), '년 ', CAST(month(o_orderdate) AS STRING), '월')
        WHEN 8 THEN concat(CAST(year(o_orderdate) AS STRING), '-13') ELSE concat(' ', CAST(year(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), ' ') END AS t FROM {orders}""",
    "base": """SELECT l_orderkey, l_linenumber, concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS period,
        CASE WHEN c_nationkey % 4 = 0 THEN 'DE' ELSE 'PL' END AS entity, concat('c', lpad(CAST(o_custkey AS STRING), 12, '0')) AS customer_code, concat('p', CAST(l_partkey AS STRING)) AS product_code,
        concat('w', CAST(l_suppkey % 15 AS STRING)) AS warehouse_code, o_orderpriority AS channel_code, CASE c_nationkey % 3 WHEN 0 THEN 'PLN' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency,
        CAST(l_quantity AS DECIMAL(18,6)) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax,
        CAST(p_retailprice AS DECIMAL(12,2)) AS retail
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey""",
    "wide": """SELECT l_orderkey, l_linenumber, period, entity, customer_code, product_code, currency, qty, CAST(price AS DECIMAL(18,6)) AS REV_GROSS, CAST(price * disc AS DECIMAL(18,6)) AS DED_REBATE,
        CAST(price * CAST(0.55 AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS COGS_MAT, CAST(qty * CAST(1.25 AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS COST_LOG, CAST(price * tax AS DECIMAL(18,6)) AS COST_PROMO,
        CAST(qty * CAST(0.10 AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS COST_WARRANTY, CAST(10 AS DECIMAL(18,6)) AS COST_FIXED, CAST(price * CAST(0.45 AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS CALC_GROSS FROM {base}""",
    "inv": """SELECT period, entity, warehouse_code, product_code, currency, qty, CAST(price AS DECIMAL(18,6)) AS value, CAST(l_linenumber * 10 AS DECIMAL(12,6)) AS dio, CAST(qty * CAST(0.50 AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS cost FROM {base}""",
    "prices": """SELECT period, entity, channel_code, product_code, currency, CAST(retail AS DECIMAL(18,6)) AS our_price, CAST(retail + l_linenumber AS DECIMAL(18,6)) AS competitor_price FROM {base}""",
    "rules": """SELECT * FROM (VALUES ('REV_GROSS', 'GROSS_REVENUE', 1), ('DED_REBATE', 'SALES_DEDUCTION', -1), ('COGS_MAT', 'COGS', -1), ('COST_LOG', 'LOGISTICS_COST', -1),
        ('COST_PROMO', 'PROMOTION_COST', -1), ('COST_WARRANTY', 'WARRANTY_COST', -1), ('COST_FIXED', 'FIXED_SGNA', -1), ('CALC_GROSS', 'SUBTOTAL_IGNORED', 1)) AS t(account_code, statement_line, sign_multiplier)""",
    "rates": """SELECT period, currency, CAST(CASE currency WHEN 'PLN' THEN CAST(1 AS DECIMAL(9,4)) WHEN 'EUR' THEN CAST(4.25 AS DECIMAL(9,4)) + CAST(m AS DECIMAL(9,4)) * CAST(0.01 AS DECIMAL(4,2))
        ELSE CAST(3.9 AS DECIMAL(9,4)) - CAST(m AS DECIMAL(9,4)) * CAST(0.01 AS DECIMAL(4,2)) END AS DECIMAL(18,8)) AS rate
        FROM (SELECT DISTINCT concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS period, month(o_orderdate) AS m FROM {orders}) AS p CROSS JOIN (VALUES ('PLN'), ('EUR'), ('USD')) AS c(currency)""",
    "customers": """SELECT concat('C', lpad(CAST(c_custkey AS STRING), 12, '0')) AS customer_code, c_name AS customer_name, c_mktsegment AS channel_group FROM {customer} WHERE c_custkey % 10 <> 0""",
    "products": """SELECT concat('P', CAST(p_partkey AS STRING)) AS product_code, p_name AS product_name, p_brand AS division, p_type AS category FROM {part} WHERE p_partkey % 10 <> 0""",
    "dim_customer": """SELECT CAST(row_number() OVER (ORDER BY customer_code) AS BIGINT) AS sk, customer_code AS nk, customer_name, channel_group FROM {customers}""",
    "dim_product": """SELECT CAST(row_number() OVER (ORDER BY product_code) AS BIGINT) AS sk, product_code AS nk, product_name, division, category FROM {products}""",
    "promos": """SELECT o_orderkey, concat('R', CAST(o_orderkey AS STRING)) AS support_rule_id, concat('P', CAST(o_custkey % 40 AS STRING)) AS promotion_id, concat('M', CAST(o_custkey % 50 AS STRING)) AS model_code,
        CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 - 1 AS INTEGER) AS end_date FROM {orders}""",
    "files": """SELECT concat('sales_', o_orderpriority, '.csv') AS file, o_orderkey, o_custkey, o_orderstatus,
        CASE o_orderkey % 3 WHEN 0 THEN CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) WHEN 1 THEN concat(CAST(year(o_orderdate) AS STRING), '.', CAST(month(o_orderdate) AS STRING))
        ELSE concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) END AS period_raw,
        concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS period, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) AS amount FROM {orders}""",
    "mart": """SELECT concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS period, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS entity,
        concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS invoice, l_orderkey * 10 + l_linenumber AS seq, CAST(o_custkey AS STRING) AS customer,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS quantity,
        CASE WHEN l_linenumber = 1 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(l_tax AS DECIMAL(18,2)) END AS labor FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "mapping": """SELECT * FROM (VALUES ('amount', 'amount', '410000', 'Sales', 'revenue', '', '', 1, 1), ('labor', 'amount', '520001', 'Labor', 'cogs', 'fixed', '', -1, 2), ('quantity', 'non_monetary', '400001', 'Units', 'units', '', '', 1, 3))
        AS t(source_column, measure_type, account_code, display_name, major_category, medium_category, minor_category, sign, sort_order)""",
    "accounts": """SELECT DISTINCT concat(p_type, ' ', CASE p_size % 8 WHEN 0 THEN 'sales' WHEN 1 THEN 'freight' WHEN 2 THEN 'rent' WHEN 3 THEN 'admin' WHEN 4 THEN 'cost' WHEN 5 THEN 'total' WHEN 6 THEN 'qty' ELSE 'misc' END, ' [', CAST(500000 + p_size AS STRING), ']') AS source_column FROM {part}""",
}

#: Inputs whose window over all rows is worked out by ranges of the key instead; the text above is for the oracle.
_NUMBERED = {"dim_customer": ("customers", "customer_code"), "dim_product": ("products", "product_code")}

#: Inputs whose joins are put in another order where they are written, to the same rows: the orders get their customers before
#: the many lines meet them, so that no line is dealt by customer. Elsewhere the part comes last: what sums by product reads
#: its rows from there, and can add most of them up before they are shuffled.
_REORDERED = {
    "base": (
        "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey",
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, c_nationkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS o ON l_orderkey = o_orderkey",
    ),
}

_NAMES = re.compile(r"\{([a-z]\w*)\}")


def needs(sql: str) -> list[str]:
    """The inputs that a text with {names} builds on, each after those that it needs itself."""
    out: list[str] = []
    for n in _NAMES.findall(sql):
        if n in INPUTS:
            out += [m for m in [*needs(INPUTS[n]), n] if m not in out]
    return out


def oracle(sql: str) -> str:
    """The text with its inputs as common table expressions."""
    plain = lambda s: _NAMES.sub(r"\1", s)
    ctes = [f"{n} AS ({plain(INPUTS[n])})" for n in needs(sql)]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + plain(sql)


class Source:
    """Tables of a folder, and inputs as DataFrames over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir, {}
        hash_joins(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in _NUMBERED and name not in self._made:
            keys, code = _NUMBERED[name]
            plain = getattr(self, keys).withColumnRenamed(code, "nk")
            self._made[name] = number_rows(plain, ["nk"], "sk")
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet") if name in TABLES else self.sql(INPUTS[name])
        return self._made[name]

    def shares(self, table: str, rows: int = 500_000) -> int:
        """So many partitions that each has about `rows` rows of a table at most, and one a core at least; the number of
        rows is in the table's files."""
        return max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, table).count() // rows))

    def stored(self, name: str, *columns: str) -> DataFrame:
        """An input, or some of its columns, written once, for queries that read it several times; inputs that are asked for
        from now on build on it."""
        made = self.sql(INPUTS[name].replace(*_REORDERED[name])) if name in _REORDERED else getattr(self, name)
        self._made[name] = written(made.select(*columns or "*"))
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in dict.fromkeys(_NAMES.findall(text))})
