"""Filter interaction audit: folds of higher-order functions over every order in which filters can be applied."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Most filters of one audit: 6 have 720 orders and so 4,320 counts a mask.
MOST = 6
_SPACES = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Four failure conditions of a text: few words, few different ones, many capitals, odd signs."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_masks(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic): rows of the same part, id and text together; bit k of mask is the k-th filter's failure.

    The last filter fails a text that equals the text of a smaller id. Texts are read once and met by their SHA-256;
    equal rows are counted before they are shuffled, ids of a text spread over tasks, and null ids by their texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = list(text_filters(text).values())
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), mask.alias("mask"))
    rows = saved(rows.groupBy("id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n")))
    firsts = rows.where(F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(1))
    marked = rows.join(firsts, ["sha", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(1 << 16))).otherwise(0).cast("long")
    joined = marked.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    lost = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    whole = (F.col("mask") + F.when(copy, 1 << len(fails)).otherwise(0)).cast("int")
    return joined.groupBy("part", whole.alias("mask")).agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))


def audit_orders(cells: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Counts of each part for every order of the filters and every step of it, from mask cells (part, mask, n, good, toxic).

    A cell's mask folds along each order of a constant array and gives a struct of weighted counts a step; the arrays of
    a part's cells, 2 ** len(names) at most, are merged by sums of their elements. Columns: part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    if not 0 < len(names) <= MOST or len(set(names)) < len(names):
        raise ValueError(f"{names!r}: 1 to {MOST} different filters")
    k = len(names)
    orders = list(permutations(range(k)))
    bits = F.lit([[1 << f for f in o] for o in orders])
    step_type = "array<struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">>"
    none = F.lit([]).cast(step_type)

    def fold(cell: Column, order: Column) -> Column:
        """The steps' counts of one cell along one order; the bits of the filters before a step are carried along."""

        def step(done: Column, bit: Column) -> Column:
            fails, gone = cell["mask"].bitwiseAND(bit) != 0, cell["mask"].bitwiseAND(done["bits"]) != 0
            weigh = lambda when, w: F.when(when, cell[w]).otherwise(F.lit(0).cast("long"))
            now = F.struct(
                weigh(~fails & ~gone, "n").alias("kept"),
                weigh(fails & ~gone, "n").alias("removed"),
                weigh(fails & gone, "n").alias("redundant"),
                weigh(cell["mask"] == bit, "n").alias("unique_fails"),
                weigh(fails & ~gone, "good").alias("good_lost"),
                weigh(fails & ~gone, "toxic").alias("toxic_lost"),
            )
            return F.struct(done["bits"].bitwiseOR(bit).alias("bits"), F.concat(done["steps"], F.array(now)).alias("steps"))

        return F.aggregate(order, F.struct(F.lit(0).alias("bits"), none.alias("steps")), step, lambda done: done["steps"])

    add = lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in _COUNTS))
    zeros = F.transform(F.sequence(F.lit(1), F.lit(k * len(orders))), lambda _: F.struct(*(F.lit(0).cast("long").alias(c) for c in _COUNTS)))
    merged = F.aggregate("cells", zeros, lambda total, cell: F.zip_with(total, F.flatten(F.transform(bits, lambda o: fold(cell, o))), add))
    of_filter = F.lit([f for o in orders for f in o])
    both = F.arrays_zip(F.col("merged").alias("counts"), of_filter.alias("filter"))
    shapley = F.transform(F.lit(list(range(k))), lambda f: F.aggregate(F.filter("both", lambda x: x["filter"] == f), F.lit(0).cast("long"), lambda total, x: total + x["counts"]["removed"]))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    parts = parts.select("part", merged.alias("merged")).withColumn("both", both).withColumn("by_filter", shapley)
    steps = parts.select("part", "by_filter", F.posexplode("both").alias("at", "x"))
    return steps.select(
        "part",
        F.get(F.lit(["".join(names[f] for f in o) for o in orders]), F.floor(F.col("at") / k).cast("int")).alias("filter_order"),
        (F.col("at") % k + 1).cast("int").alias("step"),
        *(F.col("x")["counts"][c].alias(c) for c in _COUNTS),
        F.get(F.col("by_filter"), F.col("x")["filter"]).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What five filters do to each part of the documents in each of their 120 orders (see text_filters and audit_orders).

    E fails a text that any smaller id has too, wherever it is and whether or not that one was removed. A null text
    counts as empty, a null part as the empty string; a row with a null id is never a later copy and has no labels;
    repeated rows count each; several labels of an id count if any is 1. An empty table gives no rows; other columns
    aren't read.
    """
    return audit_orders(filter_masks(docs, labels, id_col, text_col, part_col), "ABCDE")
