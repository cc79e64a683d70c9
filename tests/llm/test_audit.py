"""The filter audit against filters applied one after another in every order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import types as T

from tallyforge.llm import audit

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("source", T.StringType())])
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs):
    """(row, letters of the filters that it fails), filter by filter over whole lists."""
    smallest = {}
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            smallest[t] = min(smallest.get(t, r["doc_id"]), r["doc_id"])
    for r in docs:
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = r["doc_id"] is not None and smallest[t] < r["doc_id"]
        yield r, {f for f, x in fails.items() if x}


def plain_audit(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    parts = defaultdict(list)
    for r, fails in failures(docs):
        parts[r["source"] or ""].append((r["doc_id"], fails))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            held = rows
            for step, f in enumerate(order, 1):
                lost, held = [r for r in held if f in r[1]], [r for r in held if f not in r[1]]
                shapley[f] += len(lost)
                out[part, "".join(order), step] = [
                    len(held), len(lost), sum(f in r[1] for r in rows) - len(lost), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in lost), sum(r[0] in toxic for r in lost)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("name", ["real_docs", "hard_docs"])
def test_audit_equals_filters_run_one_after_another(spark, request, name):
    docs = request.getfixturevalue(name)
    if name == "hard_docs":  # null ids, null texts in null sources, later copies of a text whose first is twice there
        extra = [(None, "repeated row", "en", None, 1), (None, "nobody", "en", "s0", 1), (2000, "repeated row", "en", "s0", 1), (2001, "", None, "", 0), (2002, "A $ " * 300, None, "s1", 0)]
        docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
        labels = [(1, 1, 0, "x"), (1, 0, 1, "x"), (4, None, 1, "x"), (1000, 1, None, None), (None, 1, 1, None), (2002, 1, 1, "y"), (99, 1, 1, "z")]
        labels = spark.createDataFrame(labels, LABELS)
    else:
        labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = audit.audit_filters(docs, labels)
    assert got.columns == ["part", "filter_order", "step", *COUNTS, "shapley"]
    rows = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*COUNTS, "shapley")] for r in got.collect()}
    assert got.count() == len(rows)
    assert rows == plain_audit(docs.collect(), labels.collect())


def test_shapley_shares_out_what_all_orders_remove(spark, real_docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for r in audit.audit_filters(real_docs, labels).where("filter_order = 'ABCDE'").groupBy("part").agg({"shapley": "sum", "removed": "sum"}).collect():
        assert r["sum(shapley)"] == 120 * r["sum(removed)"]


def test_audit_of_nothing_and_of_fewer_filters(spark, no_docs):
    assert audit.audit_filters(no_docs, spark.createDataFrame([], LABELS)).count() == 0
    cells = spark.createDataFrame([("p", 3, 5, 2, 0), ("p", 1, 4, 0, 1), ("p", 0, 9, 9, 9)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in audit.audit_orders(cells, "XY").collect()}
    assert got == {("XY", 1): (9, 9, 0, 4, 2, 1, 13), ("XY", 2): (9, 0, 5, 0, 0, 0, 5), ("YX", 1): (13, 5, 0, 0, 2, 0, 5), ("YX", 2): (9, 4, 5, 4, 0, 1, 13)}
    with pytest.raises(ValueError, match="different filters"):
        audit.audit_orders(cells, "ABCDEFG")


def test_a_hot_part_text_and_null_id_leave_no_rows_in_one_task(spark):
    """Copies are counted before they are shuffled: a text that is there 3,000 times in one source with null ids is one row."""
    docs = spark.range(3000, numPartitions=2).selectExpr("CAST(NULL AS bigint) doc_id", "'the same text' text", "'hot' source")
    cells = audit.filter_masks(docs, spark.createDataFrame([], LABELS), "doc_id", "text", "source").collect()
    assert [(r["part"], r["mask"], r["n"], r["good"], r["toxic"]) for r in cells] == [("hot", 1, 3000, 0, 0)]
