"""Landed files: headers of their own, quoted line breaks and split records, over files of many blocks."""

import csv
import datetime as dt
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import files, landing


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_with_unlike_headers(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('﻿id;name\n007;"x;y"\n')
    (tmp_path / "c.csv").write_text("name;id\nz;008\n")
    (tmp_path / "d.csv").write_text("id;extra\n009;e\n")
    got = sorted((r["id"], r["name"], r["extra"]) for r in landing.scan_delimited_text(spark, str(tmp_path), ";").collect())
    assert got == [("007", "x;y", None), ("008", "z", None), ("009", None, "e")]
    assert [r["id"] for r in landing.scan_delimited_text(spark, str(tmp_path / "c.csv"), ";", columns=["id"]).collect()] == ["008"]


def test_quoted_line_breaks(spark, tmp_path, small_blocks):
    rows = [[str(i), f"line one of {i}\nline, two\n\n\"quoted\" three" if i % 7 == 0 else f"plain {i}", "end"] for i in range(400)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "x.csv").write_text(out.getvalue())
    (tmp_path / "y.csv").write_text("a,b,c\n")
    records = landing.indexed_records(spark, str(tmp_path), ",")
    got = [list(r["cells"]) for r in records.where("file LIKE '%x.csv'").orderBy("line").collect()]
    assert got == rows
    assert records.where("file LIKE '%y.csv'").count() == 1


def test_split_records_over_many_blocks(spark, tmp_path, small_blocks):
    lines, want = [], []
    for i in range(500):
        if i % 9 == 0:  # split within its second cell
            lines += [f"{i},text", f"goes on,{i}"]
            want.append([str(i), "text goes on", str(i)])
        elif i % 11 == 0:  # a lone piece that belongs to the last cell
            lines += [f"{i},b,c", "more"]
            want.append([str(i), "b", "c more"])
        else:
            lines.append(f"{i},b,c")
            want.append([str(i), "b", "c"])
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    got = landing.repair_split_records(landing.indexed_records(spark, str(tmp_path), ","), 3)
    rows = [list(r["cells"]) for r in got.orderBy("island", "place").collect()]
    assert rows == want
    assert got.agg({"repaired": "sum"}).first()[0] == sum(i % 9 == 0 or i % 11 == 0 for i in range(500))


def test_a_long_run_of_short_records_is_streamed(spark):
    rows = (["x"] if i % 3 else ["k", "v"] for i in range(100_000))
    got = sum(1 for _ in landing.repaired(rows, 5))
    assert 0 < got <= 100_000
    assert list(landing.repaired(iter([]), 3)) == []
    assert list(landing.repaired(iter([["a"], ["b"]]), 5)) == [(["a"], 0), (["b"], 0)]


@pytest.mark.parametrize("delimiter", [",", ";", "|", "\t"])
def test_cells_equal_the_csv_module(spark, delimiter):
    random.seed(3)
    lines = ["".join(random.choice('ab",; ""') for _ in range(random.randint(0, 14))) for _ in range(3000)] + [",a", "a,", '"a",', '""', '"', 'a"b,c"d', '"a"b"c,d"e', '"x""y",z', "a,,b", ",", ",,"]
    lines = [x.replace(",", delimiter) for x in lines]
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    for r in df.select("v", landing.csv_cells(F.col("v"), delimiter).alias("cells")).collect():
        assert list(r["cells"]) == next(csv.reader([r["v"]], delimiter=delimiter), []), r["v"]


def test_random_files_equal_the_csv_module_over_many_blocks(spark, tmp_path):
    random.seed(4)
    for k in range(20):
        (tmp_path / f"f{k}.csv").write_text("".join(random.choice('ab",\n""x') for _ in range(2000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    rows = landing.indexed_records(spark, str(tmp_path)).orderBy("file", "line").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    for k in range(20):
        text = (tmp_path / f"f{k}.csv").read_text()
        want = list(csv.reader(io.StringIO(text)))
        if want[-1] and want[-1][-1].endswith("\n"):  # quotes that don't close have the file's last line break there
            want = list(csv.reader(io.StringIO(text[:-1])))
        assert [list(r["cells"]) for r in rows if r["file"].endswith(f"/f{k}.csv")] == want


def test_a_quoted_cell_of_ten_megabytes(spark, tmp_path):
    big = 'a""b,\n' * 1_700_000
    (tmp_path / "x.csv").write_text(f'h1,h2\n1,"{big}"\n2,z\n')
    rows = landing.indexed_records(spark, str(tmp_path)).orderBy("line").collect()
    assert [len(r["cells"]) for r in rows] == [2, 2, 2]
    assert rows[1]["cells"][1] == big.replace('""', '"') and list(rows[2]["cells"]) == ["2", "z"]


def test_unlike_headers_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n')
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    got = {(r["x"], r["y"]) for r in landing.scan_delimited_text(spark, str(tmp_path), multiline=True).collect()}
    assert got == {("1", "two\nlines"), ("4", "3")}
    (tmp_path / "c.csv").write_text('x,"long\nname, ""quoted"""\n5,6\n')
    df = landing.scan_delimited_text(spark, [str(tmp_path / "c.csv"), str(tmp_path / "b.csv")], file="file")
    assert df.columns == ["y", "x", 'long\nname, "quoted"', "file"]
    assert {(r[0], r[1], r[2], r["file"].rsplit("/", 1)[1]) for r in df.collect()} == {("3", "4", None, "b.csv"), (None, "5", "6", "c.csv")}


def test_clean_tables_of_unlike_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a report\nid;when;value\n1;2024-01-05;1 234,50\n2;cut\nhere;7\n")
    (tmp_path / "b.csv").write_text("value;id\n3;9\n")
    table, stats = landing.clean_table(spark, str(tmp_path), ";", places=True)
    rows = [(r["__file"].rsplit("/", 1)[1], r["id"], r["when"], r["value"]) for r in table.orderBy("__file", "__island", "__place").collect()]
    assert rows == [("a.csv", "1", "2024-01-05", "1234.50"), ("a.csv", "2", "cut here", "7"), ("b.csv", "9", None, "3")]
    done = landing.write_clean_table(spark, str(tmp_path), str(tmp_path / "out"), ";")
    assert done == {"rows": 3, "numbers": 6, "dates": 1, "flattened": 0, "large_numbers": 0, "repaired": 1, "skipped": 1}
    assert {k: done[k] for k in stats.columns} == stats.first().asDict()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError, match="over 2 cells"):
        landing.reject_overwide_records(landing.indexed_records(spark, str(tmp_path / "a.csv"), ";"), 2, fail=True)


def test_profiles_of_large_and_odd_files(spark, tmp_path):
    big = tmp_path / "big one+%.bin"
    with open(big, "wb") as f:  # a hole of 2.2 GB, which no row of a table could hold
        f.write(b"a;b\n1;2\n")
        f.truncate(2_200_000_000)
        f.seek(0, 2)
        f.write(b"end")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "s.csv").write_text("id,zażółć\n1,2\n")
    got = {r["path"].rsplit("/", 1)[1]: r for r in landing.profile_landing_files(spark, str(tmp_path)).collect()}
    digest = hashlib.sha256()
    with open(big, "rb") as f:
        while block := f.read(1 << 24):
            digest.update(block)
    assert (got[big.name]["size"], got[big.name]["sha256"]) == (2_200_000_003, digest.hexdigest())
    assert (got["s.csv"]["encoding"], got["s.csv"]["delimiter"], got["s.csv"]["columns"]) == ("utf-8", ",", 2)
    assert got["empty.csv"]["sha256"] == hashlib.sha256(b"").hexdigest() and got["s.csv"]["modified"].date() >= dt.date(2020, 1, 1)


def test_one_of_several_creators_wins(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    (tmp_path / "log").mkdir()
    assert [files.create_once(spark, path, str(k)) for k in range(3)] == [True, False, False]
    assert files.read_text(spark, path) == "0" and [n for n in files.names(spark, str(tmp_path / "log")) if not n.startswith(".")] == ["1.json"]
    assert files.names(spark, str(tmp_path / "nowhere")) == []


def test_headers_are_read_without_a_sort(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(f"a{i};b\n" + "1;2\n" * 2500 * i)
    got = landing.file_headers(spark, str(tmp_path), ";")
    assert sorted(tuple(r["names"]) for r in got.collect()) == [(f"a{i}", "b") for i in range(5)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
