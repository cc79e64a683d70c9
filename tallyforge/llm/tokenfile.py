"""Token ids as Simple-8b files: an encoder and decoder over numpy, a sorted writer and a reader."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import byte_ranges, map_arrow, saved, shared_folder, ship, small_batches, tidy
from .tokens import STEP, Encoder

#: Selector -> (ids a word, bits an id); in a word, the selector is in the top four bits, the first id lowest.
MODES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: This selector says that the next word is an id as it is, for ids of over 60 bits.
ESCAPE = 15
BLOCK = 65_536
#: Text of a range that one task writes.
PART_BYTES = 64 << 20
#: Bits of small ids.
_LENGTH = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)
MAGIC = b"TFS8\x01\x00\x00\x00"


def encode_block(ids: np.ndarray) -> np.ndarray:
    """Words of a block of ids (uint64). Each word takes as many ids as fit; the last one is filled with zeros."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(60, np.uint64)])
    top = int(ids.max())
    if top < len(_LENGTH):
        need = _LENGTH[ids]
    else:
        need = np.zeros(n + 60, np.uint8)
        for b in range(top.bit_length()):
            need += ids >= np.uint64(1 << b)
    mode = np.full(n, ESCAPE, np.uint8)
    widest, k = need[:n].copy(), 1
    for s in range(len(MODES) - 1, -1, -1):
        many, bits = MODES[s]
        while k < many:
            np.maximum(widest, need[k : n + k], out=widest)
            k += 1
        fits = widest <= bits
        if not fits.any():
            break
        mode[fits] = s
    mode[need[:n] > 60] = ESCAPE
    skip = np.array([*(m for m, _ in MODES), 1, 1], np.int64)[mode]
    follow = (np.arange(n) + skip).tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i = follow[i]
    at = np.array(at, np.int64)
    chosen = mode[at]
    place = np.arange(len(at)) + np.r_[0, np.cumsum(chosen == ESCAPE)[:-1]]
    out = np.zeros(len(at) + int((chosen == ESCAPE).sum()), np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[place[here]] = np.uint64(ESCAPE << 60)
            out[place[here] + 1] = ids[at[here]]
            continue
        many, bits = MODES[s]
        word = np.full(len(here), int(s) << 60, np.uint64)
        for k in range(many):
            word |= ids[at[here] + k] << np.uint64(k * bits)
        out[place[here]] = word
    return out


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block's words."""
    top = (words >> np.uint64(60)).astype(np.int64)
    if (top == ESCAPE).any():  # the word after an escape is no selector
        raw, i = np.zeros(len(words), bool), 0
        for i in np.flatnonzero(top == ESCAPE):
            if not raw[i]:
                raw[i + 1] = True
        head = np.flatnonzero(~raw)
    else:
        head = np.arange(len(words))
    mode = top[head]
    many = np.array([*(m for m, _ in MODES), 1, 1], np.int64)[mode]
    to = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.uint64)
    for s in np.unique(mode):
        here = np.flatnonzero(mode == s)
        if s == ESCAPE:
            out[to[here]] = words[head[here] + 1]
            continue
        count, bits = MODES[s]
        for k in range(count):
            out[to[here] + k] = (words[head[here]] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out[:n]


def encode_file(docs: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """Magic, numbers of documents, ids and blocks, then per document validity, id and count, block offsets in words, words."""
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = np.array([len(docs), len(ids), len(blocks)], "<u8")
    valid = np.array([d is not None for d in docs], np.uint8)
    keys = np.array([0 if d is None else d for d in docs], "<i8")
    return b"".join([MAGIC, head.tobytes(), valid.tobytes(), keys.tobytes(), counts.astype("<u8").tobytes(), offsets.tobytes(), *(b.astype("<u8").tobytes() for b in blocks)])


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Document ids, counts, and the blocks' ids, decoded one by one."""
    if raw[:8] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    docs, ids, blocks = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    at = 32
    valid = np.frombuffer(raw, np.uint8, docs, at)
    keys = np.frombuffer(raw, "<i8", docs, at := at + docs)
    counts = np.frombuffer(raw, "<u8", docs, at := at + 8 * docs)
    offsets = np.frombuffer(raw, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
    words = np.frombuffer(raw, "<u8", int(offsets[-1]), at + 8 * (blocks + 1))
    parts = (decode_block(words[offsets[b] : offsets[b + 1]], min(BLOCK, ids - b * BLOCK)) for b in range(blocks))
    return [int(k) if v else None for k, v in zip(keys, valid, strict=True)], counts.astype(np.int64), parts


def _store(folder: str, name: str, content: bytes) -> None:
    """Write under a name of this attempt, then rename: a file is whole or not there, and a retry writes the same."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as f:
        f.write(content)
    where.move(part, f"{path}/{name}")


_LISTED = T.StructType([T.StructField("file", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])
_READ = T.StructType([T.StructField("file", T.StringType()), T.StructField("doc", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def write_token_files(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, partitions: int | None = None, file_ids: int = 4_000_000) -> DataFrame:
    """Encode the texts and write them in ascending id order as files of about file_ids ids; gives (file, docs, ids).

    Files sort by name as their documents do. The rows are dealt by ranges of (id, text hash), so an id that many rows
    share is split as well; equal pairs come in any order, which can't be seen. Null ids come first; a null text is
    empty and has the end id only; an empty table gives no files; other columns aren't read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = rows.repartitionByRange(partitions, "id", "h").sortWithinPartitions("id", "h")
    ship(spark)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made = Encoder.of_process(tokenizer, end_id), TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, counts, held, total, made
            name = f"ids-{part:08d}-{made:06d}.s8b"
            _store(folder, name, encode_file(docs, np.concatenate(counts), np.concatenate(held)))
            out = pa.RecordBatch.from_pylist([{"file": name, "docs": len(docs), "ids": total}], pa.schema([("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))
            docs, counts, held, total, made = [], [], [], 0, made + 1
            return out

        with tidy():
            for b in batches:
                for i, j in byte_ranges(b.column(1), STEP):
                    ids, n = encoder.encode(b.column(1).slice(i, j - i))
                    docs += b.column(0).slice(i, j - i).to_pylist()
                    counts.append(n)
                    held.append(ids.astype(np.uint16) if encoder.small else ids)
                    total += len(ids)
                    if total >= file_ids:
                        yield flush()
            if docs:
                yield flush()

    return saved(rows.mapInArrow(run, _LISTED))


def read_token_files(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """Per document of the listed files: id, start (ids of all documents before it), n_tokens, ids_crc32 (long)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def make():
        def on_batch(b: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {f.name: [] for f in _READ}
            for name, content in zip(b.column(0), b.column(1), strict=True):
                docs, counts, parts = decode_file(content.as_py())
                ends = np.cumsum(counts)
                crcs = _checksums(counts, parts)
                out["file"] += [name.as_py()] * len(docs)
                out["doc"] += docs
                out["before"] += (ends - counts).tolist()
                out["n_tokens"] += counts.tolist()
                out["ids_crc32"] += crcs
            return pa.RecordBatch.from_pydict(out, pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("doc", "before", "n_tokens", "ids_crc32"))]))

        return on_batch

    # One row per file, of bounded size: small enough for one window over all of them.
    first = listed.select("file", (F.sum("ids").over(Window.orderBy("file")) - F.col("ids")).alias("first"))
    docs = map_arrow(files, make, _READ).join(first, "file")
    return docs.select(F.col("doc").alias("doc_id"), (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _checksums(counts: np.ndarray, parts: Iterator[np.ndarray]) -> list[int]:
    """crc32 of each document's ids as 32-bit numbers, from consecutive blocks."""
    out, held, at = [], b"", 0
    for n in counts.tolist():
        crc, left = 0, 4 * n
        while left:
            if at == len(held):
                held, at = next(parts).astype("<u4").tobytes(), 0
            piece = held[at : at + left]
            crc = zlib.crc32(piece, crc)
            at += len(piece)
            left -= len(piece)
        out.append(crc)
    return out


def token_files(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Write the texts' ids to a new folder of the shared one and read them back."""
    folder = os.path.join(shared_folder(df.sparkSession), "ids")
    listed = write_token_files(df, folder, tokenizer, id_col, text_col, end_id)
    if listed.isEmpty():
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]))
    return read_token_files(df.sparkSession, folder, listed)
