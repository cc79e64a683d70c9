"""What the text operators share: the scratch folder, Arrow mapping, and the word splitters."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that stand for themselves or, for A-Z, for their lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with all but 0-9, a-z and the bytes of non-ASCII characters made blank.
ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)
#: White space in the sense of the word contracts.
BLANK = " \t\n\x0b\x0c\r"
#: Text that one step of a Python worker holds as word objects at once.
STEP_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where PYTHONPATH or the working folder don't already."""
    root = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == root for p in known):
        return
    sc = spark.sparkContext
    if getattr(sc, "_tallyforge_shipped", False):
        return
    import zipfile

    target = Path(tempfile.mkdtemp(prefix="spark-")) / "tallyforge.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "tallyforge").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._tallyforge_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_tallyforge_scratch", None)
        if base is None:
            base = spark.sparkContext._tallyforge_scratch = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array, and where each starts and the last one ends; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def byte_ranges(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes each; one longer text makes a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, end
        start = end


def text_steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of consecutive texts of about `limit` bytes each, with their texts; only these become Python objects."""
    for start, end in byte_ranges(column, limit):
        yield start, end, column.slice(start, end - start).to_pylist()


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of texts are of `rows` rows where the session leaves Spark's default, so that a worker and its executor hold few texts at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(rows))


@contextmanager
def tidy() -> Iterator[None]:
    """Gives the memory that a task freed back to the machine at its end, as its Python worker lives on."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # the C library may be another one
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType) -> DataFrame:
    """mapInArrow with state made once a task."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            one = make()
            for b in batches:
                if b.num_rows and (out := one(b)) is not None and out.num_rows:
                    yield out
            del one

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], step: int = STEP_BYTES) -> DataFrame:
    """df with new columns worked out from its texts; a column of the same name is replaced.

    make() gives a function from a list of texts to one list or array per field.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in fields]
    kept = df.drop(*[n for n in names if n != text_col]) if text_col not in names else df
    schema = T.StructType([*kept.schema.fields, *fields])
    arrow = to_arrow_schema(T.StructType(fields))

    def build():
        one = make()

        def on_batch(b: pa.RecordBatch) -> pa.RecordBatch:
            parts: list[list] = [[] for _ in fields]
            for _, _, texts in text_steps(b.column(b.schema.get_field_index(text_col)), step):
                for p, x in zip(parts, one(texts), strict=True):
                    p.extend(x.tolist() if isinstance(x, np.ndarray) else x)
            new = [pa.array(p, f.type) for p, f in zip(parts, arrow, strict=True)]
            return pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

        return on_batch

    return map_arrow(kept, build, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the table's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def crc_mod(id_col: str | Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; a null id counts as remainder 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % m, F.lit(0)).cast("int")


def lower_words(text: str | None) -> list[bytes]:
    """Words between blanks, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


class WordIds:
    """Word -> row of a growing table of per-word values, forgotten when it takes `most` bytes.

    values(list of new words) gives their values as an array; lookup() returns the rows of any words.
    """

    def __init__(self, values: Callable[[list[bytes]], np.ndarray], most: int = 32 << 20):
        self.values, self.most = values, most
        self.rows: dict[bytes, int] = {}
        self.table: np.ndarray | None = None
        self.held = 0

    def lookup(self, words: list[bytes]) -> np.ndarray:
        if self.held > self.most:
            self.rows, self.table, self.held = {}, None, 0
        new = [w for w in set(words) if w not in self.rows]
        if new:
            got = self.values(new)
            n = len(self.rows)
            self.held += sum(map(len, new)) + 150 * len(new) + got.nbytes
            if self.table is None:
                self.table = got
            else:
                if n + len(new) > len(self.table):
                    grown = np.empty((max(2 * len(self.table), n + len(new)), *got.shape[1:]), got.dtype)
                    grown[:n] = self.table[:n]
                    self.table = grown
                self.table[n : n + len(new)] = got
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
