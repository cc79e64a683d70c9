"""Landing zone: what files are, where their tables start, broken records, and the cleaned table."""

from __future__ import annotations

import codecs
import csv
import io
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyforge.functions.dates import normalize_period, parse_date_unambiguous, period_from_name
from tallyforge.functions.numbers import fixed_text, parse_number_preserving, significant_digits
from tallyforge.functions.text import flatten_linebreaks, has_linebreak
from tallyforge.session import written

from .files import decoded_path, listing

#: Java names of code pages that only the legacy setting of the session can read.
CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16", "cp1250": "windows-1250", "cp1252": "windows-1252", "iso-8859-2": "ISO-8859-2", "cp949": "x-windows-949", "cp852": "IBM852"}
DELIMITERS = (";", ",", "\t", "|")
LOOK_AHEAD = 20


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Trimmed names without byte order mark; blanks become ColumnN, repeats get _1, _2 and so on."""
    out: list[str] = []
    for i, c in enumerate(cells, 1):
        name = base = (c or "").lstrip("﻿").strip() or f"Column{i}"
        k = 0
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def _first_lines(batches: Iterator) -> Iterator:
    """The first row of each run of one uri: a file's first block is read by one task, in order and in one go, so nothing is sorted or held."""
    import pyarrow.compute as pc

    last = None
    for batch in batches:
        uris = batch.column("uri")
        if not batch.num_rows or (uris[0].as_py() == last == uris[-1].as_py()):
            continue
        starts = [i + 1 for i, differs in enumerate(pc.not_equal(uris[1:], uris[:-1]).to_pylist()) if differs]
        if uris[0].as_py() != last:
            starts.insert(0, 0)
        last = uris[-1].as_py()
        yield batch.take(starts)


def file_headers(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(file, names, broken): the cells of each file's first record, and whether it has line breaks within quotes.

    Only the files' first blocks are read, but for files whose first line ends within quotes.
    """
    lines = spark.read.option("encoding", CHARSETS.get(encoding.lower(), encoding)).text(paths)
    first = lines.where(F.col("_metadata.file_block_start") == 0).select(F.col("_metadata.file_path").alias("uri"), "value")
    heads = first.mapInArrow(_first_lines, "uri string, value string")
    heads = heads.select(decoded_path(F.col("uri")).alias("file"), csv_cells(F.col("value"), delimiter).alias("names"), (~_closed(F.col("value"), delimiter)).alias("broken"))
    open_ = [r[0] for r in heads.where("broken").select("file").collect()]  # one row a file
    if not open_:
        return heads
    records = indexed_records(spark, open_, delimiter, encoding)
    whole = records.groupBy("file").agg(F.min_by("cells", "line").alias("names")).withColumn("file", decoded_path(F.col("file"))).withColumn("broken", F.lit(True))
    return heads.where("NOT broken").unionByName(whole)


def scan_delimited_text(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", encoding: str = "utf-8", columns: Sequence[str] | None = None, multiline: bool = False, file: str | None = None) -> DataFrame:
    """All cells as text, by each file's own header: files with unlike headers are matched by column name, and a column
    that a file lacks is null there. With multiline, cells may have line breaks, and a file is one task; files whose
    header has some are read so in any case. With `file`, a column of that name has each row's file."""
    reader = lambda many: spark.read.option("sep", delimiter).option("quote", '"').option("escape", '"').option("encoding", CHARSETS.get(encoding.lower(), encoding)).option("multiLine", many)
    every = [paths] if isinstance(paths, str) else list(paths)
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for r in file_headers(spark, every, delimiter, encoding).collect():  # one row a file
        groups.setdefault((tuple(header_names(r["names"])), multiline or r["broken"]), []).append(r["file"])
    if not groups:
        raise ValueError("no file has a header")
    if len(groups) == 1:
        groups = {next(iter(groups)): every}
    out = None
    for (names, many), files in sorted(groups.items(), key=lambda g: g[1][0]):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = reader(many).option("header", True).option("enforceSchema", True).schema(schema).csv(files)
        if file:
            df = df.withColumn(file, decoded_path(F.col("_metadata.file_path")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    wanted = [*(columns or (c for c in out.columns if c != file)), *([file] if file else [])]
    return out.select(*[F.col(f"`{c}`") for c in wanted])


def clean_header(names: Column) -> Column:
    """Header cells, trimmed and without byte order mark; blank ones go."""
    bare = F.transform(names, lambda c: F.trim(F.regexp_replace(c, "^\ufeff", "")))
    return F.filter(bare, lambda c: c != "")


_PROFILE = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.TimestampType()), T.StructField("sha256", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("delimiter", T.StringType()), T.StructField("columns", T.IntegerType())]
)
#: Bytes of a file that a profile's task holds at once.
BLOCK = 8 << 20


def guess_encoding(head: bytes, probes: Sequence[bytes] = (), parts: Sequence[bytes] = ()) -> str:
    """By byte order mark, share of zero bytes, UTF-8, else the first legacy page that decodes all with the fewest control characters.

    head is the file's start. Where it is ASCII only, it is UTF-8 if the probes further on are. parts are pieces of the
    middle and the end that a legacy page must decode besides; they and the probes may start and end within a character.
    """
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head[:2] in (b"\xff\xfe", b"\xfe\xff") or (head and head[:4096].count(0) > 0.2 * len(head[:4096])):
        return "utf-16"
    if _odd(head, "utf-8") is not None and (not head.isascii() or all(_utf8(p) for p in probes)):
        return "utf-8"
    odd = {}
    for e in ("cp1250", "cp949", "cp1252", "iso-8859-2", "cp852"):
        found = [_odd(head[:524_288], e)]
        starts = (0, 1) if e == "cp949" else (0,)
        found += [min((n for k in starts if (n := _odd(p[k:], e)) is not None), default=None) for p in (*probes, *parts)]
        if None not in found:
            odd[e] = sum(found)
    return min(odd, key=odd.get, default="iso-8859-2")


def _odd(part: bytes, encoding: str) -> int | None:
    """Control characters of a piece that may end within a character; None if it can't be decoded."""
    try:
        return sum("\x80" <= c <= "\x9f" for c in codecs.getincrementaldecoder(encoding)().decode(part))
    except UnicodeDecodeError:
        return None


def _utf8(part: bytes) -> bool:
    """A piece that may start and end within a character."""
    cut = 0
    while cut < min(3, len(part)) and part[cut] & 0xC0 == 0x80:
        cut += 1
    return _odd(part[cut:], "utf-8") is not None


def guess_delimiter(text: str, lines: int = 50) -> tuple[str, int]:
    """The delimiter with the most records of one width over 1 among the first lines, and that width."""
    best = (0, 0, ",", 1)
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
    for d in DELIMITERS:
        widths = [len(r) for r in csv.reader(io.StringIO("\n".join(text.splitlines()[:lines])), delimiter=d) if r]
        wide = [w for w in widths if w > 1]
        if wide:
            common = max(set(wide), key=lambda w: (wide.count(w), w))
            best = max(best, (wide.count(common), common, d, common), key=lambda x: x[:2])
    return best[2], best[3]


def _open(path: str):
    """A listed file as a stream that can seek; only what is asked for is read."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if "/" in scheme or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if scheme == "file" else path).lstrip("/"))
    system, place = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_file(place)


def _profiled(path: str, size: int, sample_bytes: int) -> tuple[str, str, str, int]:
    """(hash, encoding, delimiter, width) of one file, read in blocks and at a few places."""
    from hashlib import sha256

    with _open(path) as f:
        digest = sha256()
        while block := f.read(BLOCK):
            digest.update(block)

        def at(place: int, n: int) -> bytes:
            f.seek(max(0, place))
            return f.read(n)

        head = at(0, sample_bytes)
        probes = [at(int(share * size), 65_536) for share in (0.33, 0.66)] if size > sample_bytes else []
        parts = [at(size // 2, 262_144)] if size > 1_048_576 else []
        parts += [at(size - 262_144, 262_144)] if size > 2_097_152 else []
    encoding = guess_encoding(head, probes, parts)
    return digest.hexdigest(), encoding, *guess_delimiter(head.decode(encoding, "replace"))


def profile_landing_files(spark: SparkSession, path: str, glob: str = "*", sample_bytes: int = 1 << 20) -> DataFrame:
    """One row per file: size, time of change, hash, encoding, delimiter and width; hashes are of the whole content.

    Encodings are guessed from the start, from 64 KB at 33 and 66 % of the file, and from 256 KB of the middle of files
    over 1 MB and of the end of those over 2 MB; delimiters from the start. Files are opened in the tasks as streams and
    hashed in blocks, so that their size doesn't matter; the file system must be one that Arrow opens, on every machine.
    """

    def profile(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for f in pdf.itertuples(index=False):
                row = (f.file, f.size, f.modified, *_profiled(f.file, f.size, sample_bytes))
                yield pd.DataFrame([row], columns=[x.name for x in _PROFILE])

    return listing(spark, path, glob).select("file", "size", "modified").mapInPandas(profile, _PROFILE)


def chosen(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), every: bool = False, column: str = "path") -> DataFrame:
    """Files whose names have any (or every) one of the keywords to include, and none of those to exclude, in any case."""
    name = F.lower(F.element_at(F.split(F.col(column), "/"), -1))
    hits = [name.contains(k.strip().lower()) for k in include if k.strip()]
    out = files.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hits)) if hits else files
    for k in exclude:
        if k.strip():
            out = out.where(~name.contains(k.strip().lower()))
    return out


def indexed_records(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(file, line, cells): the records of text files, with their order in each file. A quoted cell may have line breaks.

    line is a struct of the block of the file and the place in it. Whether a line begins within quotes follows from the
    lines before it: what each does to that state is carried on within blocks and from block to block, so that no task
    reads a whole file. Quotes within an unquoted cell are ordinary characters, as in Python's csv; a file's last line
    break is in no cell.
    """
    lines = spark.read.option("encoding", CHARSETS.get(encoding.lower(), encoding)).text(path)
    order = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    text = lines.select(F.col("_metadata.file_path").alias("file"), order.alias("line"), "value")
    if text.where(~_closed(F.col("value"), delimiter)).isEmpty():
        return text.select("file", "line", csv_cells(F.col("value"), delimiter).alias("cells"))
    starts = _quote_states(text, delimiter).withColumn("starts", (F.col("inside") == 0).cast("long")).drop("inside")
    placed = running_sum(starts, "starts").withColumn("record", F.col("before") + F.col("starts"))
    joined = placed.groupBy("file", "record").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return joined.select("file", "line", csv_cells(F.col("value"), delimiter).alias("cells"))


def _quote_states(text: DataFrame, delimiter: str) -> DataFrame:
    """text with `inside`: 1 where a line begins within quotes.

    A line maps each of the two states to one. Such maps are the same state, the other one, or a fixed one: the state
    before a line is the last fixed one (or the block's first), changed by the number of changes since.
    """
    value = F.col("value")
    out = text.withColumns({"from0": (~_closed(value, delimiter)).cast("int"), "from1": (~_closed(value, delimiter, True)).cast("int")})
    here = Window.partitionBy("file", "line.b").orderBy("line.i").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(F.when((F.col("from0") == 1) & (F.col("from1") == 0), 1).otherwise(0)).over(here), F.lit(0))
    fixed = F.when(F.col("from0") == F.col("from1"), F.struct(F.col("from0").alias("state"), F.col("flips").alias("flips")))
    held = written(out.withColumn("flips", flips).withColumn("fixed", F.last(fixed, ignorenulls=True).over(here)))

    def state(start: Column) -> Column:
        return F.when(F.col("fixed").isNull(), (start + F.col("flips")) % 2).otherwise((F.col("fixed.state") + F.col("flips") - F.col("fixed.flips")) % 2).cast("int")

    after = lambda start: F.when(state(F.lit(start)) == 0, F.col("from0")).otherwise(F.col("from1"))
    ends = held.groupBy("file", F.col("line.b").alias("b")).agg(F.max_by(F.struct(after(0).alias("from0"), after(1).alias("from1")), "line.i").alias("map"))
    blocks = F.array_sort(F.collect_list(F.struct("b", "map")))  # one entry a block of the file
    walk = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("now"), F.lit([]).cast("array<struct<b:bigint,start:int>>").alias("seen")),
        lambda acc, x: F.struct(F.when(acc["now"] == 0, x["map"]["from0"]).otherwise(x["map"]["from1"]).alias("now"), F.concat(acc["seen"], F.array(F.struct(x["b"].alias("b"), acc["now"].alias("start")))).alias("seen")),
        lambda acc: acc["seen"],
    )
    starts = ends.groupBy("file").agg(walk.alias("seen")).select("file", F.explode("seen").alias("x")).select("file", "x.b", "x.start")
    return held.withColumn("b", F.col("line.b")).join(starts, ["file", "b"]).withColumn("inside", state(F.col("start"))).select("file", "line", "value", "inside")


def running_sum(rows: DataFrame, column: str) -> DataFrame:
    """rows (file, line, ...) with `before`: the sum of the column over the file's earlier rows; by block, and from block to block."""
    blocks = rows.groupBy("file", F.col("line.b").alias("b")).agg(F.sum(column).alias("n"))
    carried = blocks.withColumn("carried", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    here = Window.partitionBy("file", "line.b").orderBy("line.i").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum(column).over(here), F.lit(0))).withColumn("b", F.col("line.b"))
    return inside.join(carried, ["file", "b"]).withColumn("before", F.col("carried") + F.col("inside")).drop("b", "carried", "inside")


#: What stands between quotes. Its loop gives nothing back, which Java's patterns run without recursion at any length.
_QUOTED = '"(?:[^"]|"")*+'


def _grammar(delimiter: str) -> tuple[str, str]:
    """Patterns of the delimiter and of what ends a cell."""
    d = {"|": "\\|", "\t": "\\t"}.get(delimiter, delimiter)
    return d, f"[^{d}]*+"


def _closed(line: Column, delimiter: str, inside: bool = False) -> Column:
    """Whether a line that begins outside (or inside) quotes ends outside of them."""
    d, rest = _grammar(delimiter)
    cell = f'(?:{_QUOTED}"{rest}|(?!"){rest})'
    cells = f"(?:{cell}{d})*+{cell}\\z"
    pattern = f'^{_QUOTED[1:]}"{rest}(?:\\z|{d}{cells})' if inside else f"^{cells}"
    return F.when(line.contains('"'), line.rlike(pattern)).otherwise(F.lit(not inside))


def csv_cells(line: Column, delimiter: str) -> Column:
    """Cells of one record as Python's csv reads them, in linear time and constant stack; an empty line has no cells.

    Doubled quotes inside quotes are quotes, what follows a closing quote is appended, quotes elsewhere are ordinary, and
    quotes that don't close take the rest.
    """
    d, rest = _grammar(delimiter)
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f'{d}({_QUOTED}"{rest}|{_QUOTED}\\z|{rest})'), F.lit(1))
    body = lambda x: F.regexp_extract(x, f'^"({_QUOTED[1:]})', 1)
    unquoted = lambda x: F.concat(F.replace(body(x), F.lit('""'), F.lit('"')), F.substring(x, F.length(body(x)) + 3, F.length(x)))
    clean = F.transform(raw, lambda x: F.when(x.startswith('"'), unquoted(x)).otherwise(x))
    return F.when(F.length(line) > 0, F.when(line.contains('"'), clean).otherwise(raw)).otherwise(F.array().cast("array<string>"))


def find_table_header(records: DataFrame, n: int | None = None) -> DataFrame:
    """(file, header, names, skipped): each file's first record of its greatest width (or of n cells), and the records before it."""
    width = F.size("cells")
    if n is None:
        w = records.groupBy("file").agg(F.max(width).alias("n"))
        at = records.join(w, "file").where(width == F.col("n"))
    else:
        at = records.where(width == n)
    head = at.groupBy("file").agg(F.min_by("cells", "line").alias("cells"), F.min("line").alias("header"))
    skipped = records.join(head.select("file", "header"), "file").where("line < header").groupBy("file").agg(F.count(F.lit(1)).alias("skipped"))
    return head.join(skipped, "file", "left").select("file", "header", F.col("cells").alias("names"), F.coalesce("skipped", F.lit(0)).cast("long").alias("skipped"))


def reject_overwide_records(records: DataFrame, n: int, fail: bool = False) -> DataFrame:
    """Records of over n cells; short ones are allowed. With fail, the first ones are raised."""
    wide = records.where(F.size("cells") > n)
    if fail and (some := wide.orderBy("file", "line").limit(3).collect()):
        raise ValueError(f"records with over {n} cells: {[list(r['cells']) for r in some]}")
    return wide


def repaired(rows: Iterator[list[str]], n: int) -> Iterator[tuple[list[str], int]]:
    """Records with split ones joined, each with how many joins it took. A one-cell row after a full one belongs to its
    last cell; another short row takes up to LOOK_AHEAD rows that follow while the joined width comes to n exactly, else
    it stays as it is. LOOK_AHEAD rows are held, however many there are."""
    ahead: deque[list[str]] = deque()
    last: tuple[list[str], int] | None = None

    def there(k: int) -> bool:
        while len(ahead) <= k and (row := next(rows, None)) is not None:
            ahead.append(list(row))
        return len(ahead) > k

    while there(0):
        row, joins = ahead.popleft(), 0
        if 0 < len(row) < n:
            if len(row) == 1 and last and len(last[0]) == n:
                last[0][-1] = f"{last[0][-1]} {row[0]}".strip()
                last = (last[0], last[1] + 1)
                continue
            joined, k = list(row), 0
            while len(joined) < n and k < LOOK_AHEAD and there(k) and len(ahead[k]) < n and len(joined) + max(len(ahead[k]), 1) - 1 <= n:
                if ahead[k]:
                    joined[-1] = f"{joined[-1]} {ahead[k][0]}".strip()
                    joined += ahead[k][1:]
                k += 1
            if len(joined) == n and k:
                row, joins = joined, 1
                for _ in range(k):
                    ahead.popleft()
        if last:
            yield last
        last = (row, joins)
    if last:
        yield last


def repair_rows(rows: list[list[str]], n: int) -> tuple[list[list[str]], int]:
    """The joined records of one stretch, and how many joins were made."""
    got = list(repaired(iter(rows), n))
    return [r for r, _ in got], sum(k for _, k in got)


def repair_split_records(records: DataFrame, n: int) -> DataFrame:
    """(file, island, place, cells, repaired): records with split ones joined again.

    A join never crosses a record of n cells or more, so each such record and the short ones after it are an island of
    its own, numbered by block of the file. Full records without short neighbours never reach Python; the rows of the
    other islands pass through it in order, of which it holds a few at a time.
    """
    full = F.size("cells") >= n
    counted = running_sum(records.withColumn("full", full.cast("long")), "full").withColumn("island", F.col("before") + F.col("full")).drop("before")
    short = counted.where("full = 0").select("file", "island").distinct()
    whole = counted.where("full = 1").join(short, ["file", "island"], "left_anti").select("file", "island", F.lit(0).cast("long").alias("place"), "cells", F.lit(0).cast("long").alias("repaired"))
    broken = counted.join(short, ["file", "island"], "left_semi").select("file", "island", "line", "cells")
    ordered = broken.repartition("file", "island").sortWithinPartitions("file", "island", "line").select("file", "island", "cells")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("island", T.LongType()), T.StructField("place", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("repaired", T.LongType())])

    def join(batches: Iterator) -> Iterator:
        import pandas as pd

        rows = ((f, i, list(c)) for pdf in batches for f, i, c in pdf.itertuples(index=False))
        out: list[tuple] = []
        for (f, i), island in groupby(rows, key=lambda r: r[:2]):
            for place, (cells, k) in enumerate(repaired((c for _, _, c in island), n)):
                out.append((f, i, place, cells, k))
                if len(out) == 5000:
                    yield pd.DataFrame(out, columns=[x.name for x in schema])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=[x.name for x in schema])

    return whole.unionByName(ordered.mapInPandas(join, schema))


def _parsed(df: DataFrame, columns: Sequence[str], mode: str) -> DataFrame:
    """df with each cell as a date and as a number, to be read several times."""
    out = {}
    for i, c in enumerate(columns):
        out |= {f"__date{i}": parse_date_unambiguous(F.col(f"`{c}`")), f"__number{i}": parse_number_preserving(F.col(f"`{c}`"), mode)}
    return df.withColumns(out)


def _cleaned(parsed: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = {}
    for i, c in enumerate(columns):
        num, fixed = F.col(f"__number{i}"), fixed_text(F.col(f"__number{i}.value"))
        number = F.when(num["scale"] > 0, F.substring(fixed, F.lit(1), F.length(fixed) - 18 + num["scale"])).otherwise(F.substring_index(fixed, ".", 1))
        out[c] = F.coalesce(F.col(f"__date{i}").cast("string"), F.when(num["value"].isNotNull(), number), flatten_linebreaks(F.col(f"`{c}`")))
    return parsed.withColumns(out).drop(*(f"__{n}{i}" for i in range(len(columns)) for n in ("date", "number")))


def clean_cells(df: DataFrame, columns: Sequence[str], mode: str = "Polish") -> DataFrame:
    """Dates as ISO text, numbers as plain text of their scale, line breaks as blanks; anything else is left."""
    return _cleaned(_parsed(df, columns, mode), columns)


def _counters(columns: Sequence[str]) -> list[Column]:
    """Counts over parsed cells."""
    total = lambda hit: F.coalesce(F.sum(sum((F.coalesce(hit(i, F.col(f"`{c}`")), F.lit(False)).cast("long") for i, c in enumerate(columns)), F.lit(0))), F.lit(0)).cast("long")
    num = lambda i: F.col(f"__number{i}.value")
    return [
        F.count(F.lit(1)).alias("rows"), total(lambda i, c: num(i).isNotNull()).alias("numbers"), total(lambda i, c: F.col(f"__date{i}").isNotNull()).alias("dates"),
        total(lambda i, c: has_linebreak(c)).alias("flattened"), total(lambda i, c: significant_digits(num(i)) > 15).alias("large_numbers"),
    ]


def repair_statistics(df: DataFrame, columns: Sequence[str], mode: str = "Polish") -> DataFrame:
    """One row: rows, and cells that are numbers, dates, had line breaks, or have over 15 significant digits."""
    return _parsed(df, columns, mode).agg(*_counters(columns))


_PLACE = ("__file", "__island", "__place", "__repaired")


def _joined_table(spark: SparkSession, path: str, delimiter: str, encoding: str) -> tuple[DataFrame, list[str], int]:
    """(rows with the places of _PLACE, column names, skipped records): each file's rows under its own header."""
    records = indexed_records(spark, path, delimiter, encoding)
    heads = written(find_table_header(records))
    groups: dict[tuple[str, ...], list[str]] = {}
    skipped = 0
    for r in heads.collect():  # one row a file
        groups.setdefault(tuple(header_names(r["names"])), []).append(r["file"])
        skipped += r["skipped"]
    if not groups:
        raise ValueError("no table header")
    body = records.join(F.broadcast(heads.select("file", "header", F.size("names").alias("__n"))), "file").where("line > header").drop("header")
    if some := body.where(F.size("cells") > F.col("__n")).orderBy("file", "line").limit(3).collect():
        raise ValueError(f"records with more cells than their header: {[list(r['cells']) for r in some]}")
    out, every = None, list(dict.fromkeys(n for g in groups for n in g))
    for names, files in groups.items():
        mine = body.where(F.col("file").isin(files)) if len(groups) > 1 else body
        joined = repair_split_records(mine.drop("__n"), len(names)).where(F.size("cells") > 0)
        table = joined.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)], *[F.col(p.strip("_")).alias(p) for p in _PLACE])
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out, every, skipped


def clean_table(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", mode: str = "Polish", places: bool = False) -> tuple[DataFrame, DataFrame]:
    """(table, statistics) of landed files: headers found, split records joined, cells normalised.

    Each file has its own header; tables are put together by column names. With places, the columns __file, __island and
    __place tell each row's file and its order there.
    """
    rows, names, _ = _joined_table(spark, path, delimiter, encoding)
    table = clean_cells(rows, names, mode)
    return table.select(*names, *(_PLACE[:3] if places else ())), repair_statistics(rows, names, mode)


def write_clean_table(spark: SparkSession, path: str, target: str, delimiter: str = ",", encoding: str = "utf-8", mode: str = "Polish") -> dict[str, int]:
    """Write the cleaned table as Parquet, with its rows' places, and give its statistics, counted while it is written.

    Statistics: rows, numbers, dates, flattened, large_numbers, repaired (joins of split records) and skipped (records
    before the headers).
    """
    rows, names, skipped = _joined_table(spark, path, delimiter, encoding)
    seen = Observation()
    counted = _parsed(rows, names, mode).observe(seen, *_counters(names), F.coalesce(F.sum("__repaired"), F.lit(0)).alias("repaired"))
    _cleaned(counted, names).select(*names, *_PLACE[:3]).write.parquet(target)
    return {**seen.get, "skipped": skipped}


def scan_incoming_folder(files: DataFrame, history: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), every: bool = False, baseline: Sequence[str] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """(file, period, hash, header_state, status) of files(file, hash, period, header array) against history(file, hash, period).

    header_state: empty, missing_columns (of the required ones, or of the baseline where none are named), order_mismatch
    (other than the baseline; rows are matched by name all the same) or ok. Status: unchanged (the hash is known),
    conflict (several new files of one period), modified_period, new_period.
    """
    out, state = chosen(files, include, exclude, every, "file"), F.lit("ok")
    needed = list(required) or list(baseline or ())
    if needed:
        lacks = F.size(F.array_except(F.lit(needed), "header")) > 0
        order = F.slice("header", 1, len(baseline)) != F.lit(list(baseline)) if baseline else F.lit(False)
        state = F.when(F.coalesce(F.size("header"), F.lit(0)) < 1, "empty").when(lacks, "missing_columns").when(order, "order_mismatch").otherwise("ok")
    out = out.withColumn("header_state", state).withColumn("period", F.coalesce(normalize_period(F.col("period")), period_from_name(F.col("file"))))
    known = history.select(F.col("hash").alias("__h")).distinct()
    periods = history.select(F.col("period").alias("__p")).distinct()
    out = out.join(known, F.col("hash") == F.col("__h"), "left").join(periods, F.col("period") == F.col("__p"), "left")
    fresh = out.where("__h IS NULL").groupBy("period").agg(F.count_distinct("file").alias("__n")).select(F.col("period").alias("__q"), "__n")
    out = out.join(fresh, F.col("period") == F.col("__q"), "left")
    status = F.when(F.col("__h").isNotNull(), "unchanged").when(F.col("__n") > 1, "conflict").when(F.col("__p").isNotNull(), "modified_period").otherwise("new_period")
    return out.select("file", "period", "hash", "header_state", status.alias("status"))
