"""Packing by concatenate and cut: prefix sums over partition totals, then fixed windows with boundary records."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import byte_ranges, map_arrow, saved, ship, small_batches, tidy
from .tokens import STEP, Encoder

#: Totals of the first pass' partitions (16 bytes each) are broadcast up to this count and joined by shuffle beyond.
BROADCAST_PARTS = 2_000_000
_TOKENS = T.StructType([T.StructField("part", T.LongType()), T.StructField("before", T.LongType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
_PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def tokenized(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """First pass, written to the shared folder: every document's ids, its partition, and the ids before it there."""
    ship(df.sparkSession)

    def run(batches):
        encoder, part, total = Encoder.of_process(tokenizer, end_id), TaskContext.get().partitionId(), 0
        with tidy():
            for b in batches:
                for i, j in byte_ranges(b.column(1), STEP):
                    ids, n = encoder.encode(b.column(1).slice(i, j - i))
                    before = total + np.cumsum(n) - n
                    total += int(n.sum())
                    flat = ids.astype("<u2" if encoder.small else "<u4")
                    at = np.r_[0, np.cumsum(n)] * flat.itemsize
                    held = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, np.int64)), pa.array(before), b.column(0).slice(i, j - i), pa.array(n), held], names=[f.name for f in _TOKENS])

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(run, _TOKENS), "zstd")


def cut_pieces(tokens: DataFrame, length: int = 2048) -> DataFrame:
    """Second pass: the pieces of the windows of `length` ids, one boundary record each."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per partition of the first pass, not per document.
    firsts = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("first"))
    firsts = saved(firsts)
    small = firsts.count() <= BROADCAST_PARTS
    placed = tokens.join(F.broadcast(firsts) if small else firsts, "part").select("id", (F.col("first") + F.col("before")).alias("at"), "n", "ids")

    def make():
        def on_batch(b: pa.RecordBatch) -> pa.RecordBatch:
            at, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            first, last = at // length, (at + n - 1) // length
            many = last - first + 1
            row = np.repeat(np.arange(len(at)), many)
            seq = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[row]
            lo = np.maximum(seq * length, at[row])
            size = np.minimum((seq + 1) * length, at[row] + n[row]) - lo
            start = lo - at[row]
            crc, ids, held = np.empty(len(row), np.int64), b.column(3), -1
            for k, (r, s, z) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
                if r != held:
                    raw, held = ids[r].as_py(), r
                    whole = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n[r] else "<u4").astype("<u4").tobytes())
                crc[k] = zlib.crc32(whole[4 * s : 4 * (s + z)])
            cols = [b.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int64)) for x in (start, size, crc, n[row], seq, lo - seq * length))]
            return pa.RecordBatch.from_arrays(cols, names=[f.name for f in _PIECES])

        return on_batch

    return map_arrow(placed, make, _PIECES)


def concatenate_and_cut(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of `length` ids; only the last one can be shorter.

    The documents follow one another in the order of the first pass' partitions. Columns: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset (long). A null or empty text is a document of the end id only; null
    ids are kept; repeated rows are packed each; an empty table gives no rows; other columns aren't read. Texts are
    tokenized once; nothing but one total per partition is brought together.
    """
    return cut_pieces(tokenized(df, tokenizer, id_col, text_col, end_id), length)
