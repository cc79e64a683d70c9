"""What the columns of a table could be in a star: suggested from their names and their profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.session import written

#: Words in column names (Korean, English, Polish), as users' files have them.
PERIOD_FIRST = r"(?i)(기준년월|년월|기간|일자|period|month|date|yyyymm)"
PERIOD_WORDS = r"(?i)(기준년월|년월|기간|일자|연도|분기|월|period|month|date|yyyymm|year|quarter)"
PARTITION_WORDS = r"(?i)(법인|회사코드|entity|company_code|subsidiary|spolka)"
ROW_KEY_WORDS = r"(?i)(전표번호|전표|행번호|라인번호|seq|line_no|slip_no|doc_no|id|uuid)$"
KEY_ENDS = r"(?i)(?:^|[\s_\-])(코드|번호|사번|식별자|code|id|no|key|cd|uuid)$|(코드|번호)$"
ATTRIBUTE_ENDS = (
    r"(?i)(?:^|[\s_\-])(명|이름|성명|상호|내역|설명|비고|유형|구분|분류|규격|단위|지역|국가|통화|"
    r"name|desc|description|type|class|category|group|unit|currency|curr|suffix|model|lvl\d*|level\d*)$|"
    r"(명|이름|내역|설명|비고|유형|구분)$"
)
MEASURE_WORDS = (
    r"(?i)(?:금액|단가|매출액|매출|이익|원가|수량|실적|예산|비용|잔액|손익|손실|세금|할인|충당|상각|마진|판관비|노무비|경비)|"
    r"(?<![a-zA-Z])(?:amt|amount|qty|quantity|sales|profit|revenue|cost|costs|price|balance|total|"
    r"exp|expense|expenses|inc|income|loss|cogs|opex|ebit|ebitda|gp|gross|net|tax|taxes|depr|amort|"
    r"alloc|variance|diff|difference|adjustment|margin|discount|d/c|trade\s*term|charge|material|"
    r"o/h|overhead|royalty|refund|waste|valuation|gap|sg&a|selling|admin|r&d|svc|labor|"
    r"commission|advertising|promotion|bad\s*debt)(?![a-zA-Z])"
)
QUANTITY_WORDS = r"(?i)(수량|qty|quantity|count)"
COST_WORDS = r"(?i)(원가|비용|경비|판관비|노무비|cost|expense|exp|cogs|opex)"
NAMING_WORDS = r"(?i)(code|id|name|suffix|desc|no|type|class|model|코드|명|번호|유형|규격)"
MODEL_NAMES = r"(?i)^(model|model[\s_\-]*suffix|model[\s_\-]*code|품번|모델|모델코드)$"
CURRENCY_NAMES = r"(?i)^(currency|curr|currency[\s_\-]*code|curr[\s_\-]*code|통화|통화코드)$"
PRODUCT_WORDS = r"(?i)(product|item|제품|품목|상품)"
#: Fixed values: (dimension, names of its keys, names of its attributes), tried in this order.
ENTITIES = (
    ("고객/거래처", r"(?i)(거래처코드|고객코드|매출처코드|customer_id|customer_code|client_code|partner_code|klient_kod)", r"(?i)(거래처명|고객명|매출처명|상호|대표자|사업자번호|customer_name|client_name|partner_name|klient_nazwa)"),
    ("제품/품목", r"(?i)(상품코드|품목코드|제품코드|자재코드|product_id|product_code|item_code|sku|kod_produktu)", r"(?i)(상품명|품목명|제품명|규격|단위|카테고리|분류|product_name|item_name|category|brand|nazwa_produktu)"),
    ("계정/손익과목", r"(?i)(계정코드|과목코드|손익코드|항목코드|account_code|account_id|gl_code|kod_konta)", r"(?i)(계정명|과목명|손익항목|비용항목|account_name|gl_name|account_desc|nazwa_konta)"),
    ("조직/부서", r"(?i)(부서코드|팀코드|사업부코드|본부코드|조직코드|dept_code|team_code|org_code|division_code|^division$|^dept$|^department$|^사업부$|^부서$)", r"(?i)(부서명|팀명|사업부명|본부명|조직명|지점명|dept_name|team_name|org_name|division_name|subsidiary\(r&r\))"),
    ("채널/매장", r"(?i)(매장코드|채널코드|점포코드|store_code|channel_code|shop_code)", r"(?i)(매장명|채널명|점포명|유통채널|store_name|channel_name|shop_name)"),
)
#: A wide table has this many measures at least; empty columns after its first one are taken for measures.
WIDE_MEASURES = 10
_BREAK = r"[\s_\-(]+"


def _families(rest: DataFrame) -> DataFrame:
    """(at, dimension, part): columns that begin with the same words, each in the family of the most words.

    A column belongs to a family if nothing follows the words, a naming word follows, or the words are a column. Keys are
    the members that end like keys, or without any the shortest one.
    """
    words = F.split(F.trim("column"), _BREAK)
    begun = rest.select("at", "column", words.alias("w")).select("at", "column", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"))
    begun = begun.select("at", "column", "n", F.lower(F.array_join(F.slice("w", 1, F.col("n")), " ")).alias("stem"), F.array_join(F.slice("w", 1, F.col("n")), "_").alias("title"), F.array_join(F.slice("w", F.col("n") + 1, F.size("w")), " ").alias("after"))
    of_stem = Window.partitionBy("stem")
    able = begun.withColumn("head", F.max(F.col("after") == "").over(of_stem)).where(F.col("head") | F.col("after").rlike(NAMING_WORDS))
    able = able.withColumn("members", F.count(F.lit(1)).over(of_stem)).where("members > 1")
    longest = able.withColumn("best", F.max("n").over(Window.partitionBy("at"))).where("n = best")
    longest = longest.withColumn("members", F.count(F.lit(1)).over(of_stem)).where("members > 1")  # others may have left for a longer one
    key = F.col("column").rlike(KEY_ENDS)
    shortest = F.min(F.struct(F.length("column"), "at")).over(of_stem)["at"]
    is_key = F.when(F.max(key).over(of_stem), key).otherwise(F.col("at") == shortest)
    return longest.select("at", F.min("title").over(of_stem).alias("dimension"), F.when(is_key, "dim_key").otherwise("dim_attr").alias("part"))


def suggest_roles(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(at, column, role, dimension, kind, confidence) of each column, from a profile of profile_columns; columns without
    a profile, or without a value, are judged by name.

    The first rule that holds decides: the period (the first column of periods, else the first so named, else the first),
    one partition of ten values at most, measures (numbers, or empty with a measure's name; with ten of them, empty ones
    after the first too), keys and attributes of known dimensions, of families of names, a model or a currency, a row
    key, any other numbers, and other keys; the rest stays unassigned. All tables here have a row a column.
    """
    spark = profile.sparkSession
    listed = spark.createDataFrame(list(enumerate(columns)), "at int, column string")
    known = profile.select("column", F.col("rows").alias("n"), F.col("distinct_values").alias("values"), F.col("role").alias("seen"))
    base = written(listed.join(known, "column", "left").select("at", "column", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("values", F.lit(0)).alias("values"), F.coalesce("seen", F.lit("")).alias("seen")))
    name, empty = F.col("column"), F.col("values") == 0
    at = lambda hit: F.min(F.when(hit, F.col("at")))
    other = name.rlike(KEY_ENDS) | name.rlike(ATTRIBUTE_ENDS) | name.rlike(PERIOD_WORDS)

    with_period = base.crossJoin(F.broadcast(base.agg(F.coalesce(at(F.col("seen") == "period"), at(name.rlike(PERIOD_FIRST)), F.min("at")).alias("p"))))
    entity = (F.col("at") != F.col("p")) & name.rlike(PARTITION_WORDS) & ~name.rlike(r"\(.*\)") & (F.col("values") <= 10)
    with_part = with_period.crossJoin(F.broadcast(with_period.agg(at(entity).alias("e"))))
    free = (F.col("at") != F.col("p")) & ~F.col("at").eqNullSafe(F.col("e"))
    with_measure = with_part.withColumn("measure", free & ((F.col("seen") == "numeric") & ~other | empty & name.rlike(MEASURE_WORDS) & ~other))
    band = with_measure.agg(F.count_if("measure").alias("m"), at(F.col("measure")).alias("first"))
    banded = free & ~F.col("measure") & (F.col("m") >= WIDE_MEASURES) & (F.col("at") > F.col("first")) & empty & (F.col("n") > 0) & ~other & ~name.rlike(ROW_KEY_WORDS)
    kind = F.when(name.rlike(QUANTITY_WORDS), "quantity").when(name.rlike(COST_WORDS), "cost").otherwise("value")
    first = with_measure.crossJoin(F.broadcast(band)).withColumn("role", F.when(F.col("at") == F.col("p"), "period").when(F.col("at") == F.col("e"), "partition").when(F.col("measure") | banded, "measure"))
    first = written(first.withColumn("confidence", F.when(F.col("role") == "period", 0.9).when(banded, 0.75).when(F.col("role").isNotNull(), 0.85)).select("at", "column", "n", "values", "seen", "role", "confidence"))

    dim, part = _first_entity(name)
    entities = first.where("role IS NULL").select("at", "column", dim.alias("dimension"), part.alias("part"))
    of_dim = Window.partitionBy("dimension")
    keyless = F.max(F.col("part") == "dim_key").over(of_dim) == F.lit(False)
    matched = entities.where("dimension IS NOT NULL").select("at", "dimension", F.when(keyless & (F.col("at") == F.min("at").over(of_dim)), "dim_key").otherwise(F.col("part")).alias("part"))
    members = written(matched.unionByName(_families(entities.where("dimension IS NULL").select("at", "column"))))

    product = members.where(F.col("dimension").rlike(PRODUCT_WORDS)).groupBy("dimension").agg(F.min("at").alias("a"), F.count_if(F.col("part") == "dim_key").alias("k")).agg(F.coalesce(F.min_by("dimension", "a"), F.lit(ENTITIES[1][0])).alias("product"), F.coalesce(F.min_by("k", "a"), F.lit(0)).alias("keys"))
    out = first.join(members, "at", "left").crossJoin(F.broadcast(product))
    model = name.rlike(MODEL_NAMES)
    rest = F.when(F.col("part").isNotNull(), F.col("part")).when(model, F.when(F.col("keys") < 2, "dim_key").otherwise("dim_attr")).when(name.rlike(CURRENCY_NAMES), "dim_key")
    rest = rest.when(name.rlike(ROW_KEY_WORDS) & (empty | (F.col("values") > 0.8 * F.col("n")) | (F.col("seen") == "key")), "row_key").when(F.col("seen") == "numeric", "measure").when(name.rlike(KEY_ENDS), "dim_key").otherwise("unassigned")
    title = F.when(F.col("part").isNotNull(), F.col("dimension")).when(model, F.col("product")).when(name.rlike(CURRENCY_NAMES), F.lit("통화")).otherwise(F.regexp_replace(F.regexp_replace(name, r"(?i)[\s_\-]*(코드|번호|사번|식별자|code|id|no|key|cd|uuid)$", ""), " ", "_"))
    sure = F.when(rest.isin("row_key", "dim_attr"), 0.75).when(rest == "dim_key", F.when(F.col("part").isNotNull(), 0.8).otherwise(0.7)).when(rest == "measure", 0.6).otherwise(0.5)
    role = F.coalesce("role", rest)
    return out.select("at", "column", role.alias("role"), F.when(role.startswith("dim_"), title).alias("dimension"), F.when(role == "measure", kind).alias("kind"), F.coalesce("confidence", sure).alias("confidence"))


def _first_entity(name: Column) -> tuple[Column, Column]:
    """(dimension, part) of the first known dimension that the name belongs to, nulls for others."""
    hits = [(name.rlike(g), title, part) for title, keys, attributes in ENTITIES for g, part in ((keys, "dim_key"), (attributes, "dim_attr"))]
    dim = part = None
    for hit, d, p in hits:
        dim, part = (F.when(hit, d), F.when(hit, p)) if dim is None else (dim.when(hit, d), part.when(hit, p))
    return dim, part
