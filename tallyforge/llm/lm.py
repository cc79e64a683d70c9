"""Language-model scores: context-tree weighting over bytes, and a unigram base over words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, append_columns, crc_mod, saved, ship, small_batches, text_steps, tidy

DEPTH = 4
#: Byte sequences with at least this share of all bytes are looked up in a broadcast table, of 2**21 rows at most (25 MB); the others by a join. This chooses a way, not a result.
FREQUENT = 2.0**-21
#: The same for words with at least this share of all training tokens: 2**19 at most.
COMMON = 2.0**-19
END = b"\n"  # the end token; no word holds it
#: Bytes that no UTF-8 text has: before a text, and its end.
_PAD, _STOP = b"\xfe", b"\xff"
#: Counted keys that a worker holds before it passes them on.
_HELD = 1_000_000


def _lower(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER) if text else b""


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the one text column; every text has one end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
            c.clear()
            return out

        with tidy():
            for b in batches:
                for _, _, texts in text_steps(b.column(0)):
                    for t in texts:
                        c.update(_lower(t).split())
                c[END] += b.num_rows
                if len(c) > _HELD // 4:
                    yield flush()
            if c:
                yield flush()

    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    ship(texts.sparkSession)
    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def _grams(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of every byte of the texts and of their ends, and where each text's keys start.

    A key has the byte in its lowest 8 bits and above it the `depth` bytes before it, the nearest lowest.
    """
    raw = [_lower(t) for t in texts]
    size = np.array([len(r) for r in raw], np.int64) + 1
    pad = _PAD * depth
    buf = np.frombuffer(pad + pad.join(r + _STOP for r in raw), np.uint8).astype(np.int64) if raw else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(depth * np.arange(1, len(raw) + 1), size)
    key = np.zeros(len(at), np.int64)
    for k in range(depth, -1, -1):
        key <<= 8
        key |= buf[at - k]
    return key, first


def gram_counts(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n, seen) over (text, learn): keys of all texts' bytes, how often they occur to learn from, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, where = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
            n, seen = (np.bincount(where, np.concatenate([h[i] for h in held])).astype(np.int64) for i in (1, 2))
            return key, n, seen

        with tidy():
            for b in batches:
                learn = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for i, j, texts in text_steps(b.column(0)):
                    key, first = _grams(texts, depth)
                    counted = np.repeat(learn[i:j], np.diff(np.r_[first, len(key)]))
                    k, where, seen = np.unique(key, return_inverse=True, return_counts=True)
                    held.append((k, np.bincount(where, counted).astype(np.int64), seen))
                    if sum(len(h[0]) for h in held) > _HELD:
                        held[:] = [merged()]
                        if len(held[0][0]) > _HELD // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["gram", "n", "seen"])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["gram", "n", "seen"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("gram", "n", "seen")])
    ship(texts.sparkSession)
    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, schema).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _stirling(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x of 16 and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


_HALVES = np.array([math.lgamma(k + 0.5) for k in range(16)])
_WHOLES = np.array([math.lgamma(k + 1.0) for k in range(16)])


def _log_gamma(n: np.ndarray, small: np.ndarray, more: float) -> np.ndarray:
    return np.where(n < 16, small[np.minimum(n, 15).astype(np.int64)], _stirling(np.maximum(n, 16) + more))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a zeros and b ones."""
    return _log_gamma(a, _HALVES, 0.5) + _log_gamma(b, _HALVES, 0.5) - math.log(math.pi) - _log_gamma(a + b, _WHOLES, 1.0)


@dataclass
class Level:
    """The binary decisions at all contexts of one depth: zeros and ones seen at each (context, bits decided so far).

    A byte is decided bit by bit from the highest; `keys` holds context * 256 + (the bits before, after a leading 1).
    """

    keys: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray, n: np.ndarray) -> Level:
        """From sorted context * 256 + byte and their counts."""
        context, byte = pairs >> 8, pairs & 255
        keys, zeros, ones = [], [], []
        for k in range(8):
            key = (context << 8) | (1 << k) | (byte >> (8 - k))
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            one = n * ((byte >> (7 - k)) & 1)
            keys.append(key[cut])
            ones.append(np.add.reduceat(one, cut))
            zeros.append(np.add.reduceat(n - one, cut))
        key = np.concatenate(keys)
        order = np.argsort(key)
        return cls(key[order], np.concatenate(zeros)[order].astype(float), np.concatenate(ones)[order].astype(float))

    def __post_init__(self):
        self.own = log_kt(self.a, self.b)

    def weigh(self, below: np.ndarray | None) -> None:
        """Log weighted probabilities, and the share of a node's own estimate in them; below: the sum over its children."""
        if below is None:
            self.weight, self.share = self.own, np.ones(len(self.own))
        else:
            self.weight = np.logaddexp(self.own, below) - math.log(2)
            self.share = 1 / (1 + np.exp(np.clip(below - self.own, -60, 60)))

    def mix(self, so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of a one, mixed over the depths down to this one, and the weight left to deeper ones."""
        return so_far + left * self.share * (self.b + 0.5) / (self.a + self.b + 1), left * (1 - self.share)


def _up(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the same decisions at the context that is one byte shorter; depth: of the keys given."""
    return ((keys >> 8) & ((1 << (8 * (depth - 1))) - 1)) << 8 | (keys & 255)


def levels(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[Level]:
    """Weighted levels `top` to `depth` of the grams' contexts."""
    out: list[Level] = []
    below = None
    for d in range(depth, top - 1, -1):
        pairs, where = np.unique(gram & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
        level = Level.of(pairs, np.bincount(where, n).astype(np.int64))
        if out:
            at = np.searchsorted(level.keys, _up(out[-1].keys, d + 1))
            below = np.bincount(at, out[-1].weight, len(level.keys))
        level.weigh(below)
        out.append(level)
    return out[::-1]


def costs(gram: np.ndarray, tree: list[Level], depth: int, so_far: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte after its context; so_far, left: the mix above the first level's keys."""
    top = depth - len(tree) + 1
    for d, level in zip(range(top, depth + 1), tree, strict=True):
        if d > top:
            at = np.searchsorted(above.keys, _up(level.keys, d))  # noqa: F821
            so_far, left = so_far[at], left[at]
        so_far, left = level.mix(so_far, left)
        above = level  # noqa: F841
    context, byte, out = gram >> 8, gram & 255, np.zeros(len(gram))
    for k in range(8):
        one = so_far[np.searchsorted(above.keys, (context << 8) | (1 << k) | (byte >> (8 - k)))]
        out += np.log10(np.where((byte >> (7 - k)) & 1, one, 1 - one))
    return out


def gram_costs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, seen, cost) of saved gram counts (gram, n, seen): log10 probability of each byte after its context.

    Contexts of all counted depths are weighed, rare ones too. The contexts that share their nearest two bytes are
    weighed by one task, at most 256**(depth - 2) of them, whatever the corpus; what they pass on is one row for each
    nearest byte and decision, 256 * 255 at most, from which the first two depths are weighed on the driver.
    """
    spark = grams.sparkSession
    nearest = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * min(2, depth))) - 1))
    dealt = saved(grams.select("gram", "n", "seen", nearest.alias("near")).repartition("near").sortWithinPartitions("near"))
    deep = min(2, depth)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole groups of nearest bytes, about 100,000 rows at once."""
        held: list[pa.Table] = []
        rows, enough = 0, 100_000
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows > enough:
                whole = pa.concat_tables(held)
                near = whole.column(3).to_numpy()
                if cut := int(np.searchsorted(near, near[-1])):
                    yield whole.slice(0, cut)
                held, rows = [whole.slice(cut)], len(near) - cut
                enough = max(100_000, 2 * rows)
        if held:
            yield pa.concat_tables(held)

    def numbers(t: pa.Table) -> list[np.ndarray]:
        return [t.column(k).to_numpy() for k in range(3)]

    def first(batches):
        with tidy():
            for t in groups(batches):
                gram, n, _ = numbers(t)
                level = levels(gram, n, depth, deep)[0]
                key, where = np.unique(_up(level.keys, deep) if deep else level.keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(where, x)) for x in (level.weight, level.a, level.b))], names=["key", "w", "a", "b"])

    passed = dealt.mapInArrow(first, "key long, w double, a double, b double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("w", "a", "b"))).toArrow()
    shared = spark.sparkContext.broadcast(_top(*(passed.column(c).to_numpy() for c in ("key", "w", "a", "b")), deep))

    def second(batches):
        with tidy():
            keys, so_far, left = shared.value
            for t in groups(batches):
                gram, n, seen = numbers(t)
                tree = levels(gram, n, depth, deep)
                at = np.searchsorted(keys, _up(tree[0].keys, deep) if deep else tree[0].keys)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(seen), pa.array(costs(gram, tree, depth, so_far[at], left[at]))], names=["gram", "seen", "cost"])

    return dealt.mapInArrow(second, "gram long, seen long, cost double")


def _top(keys: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mix of the depths above `deep` at every key there, from the sums over the keys' children."""
    order = np.argsort(keys)
    keys, weight, a, b = (x[order] for x in (keys, weight, a, b))
    if not deep:
        return keys, np.zeros(len(keys)), np.ones(len(keys))
    so_far, left = None, None
    chain = []
    for d in range(deep - 1, -1, -1):
        level = Level(keys, a, b)
        level.weigh(weight)
        chain.append(level)
        if d:
            keys, where = np.unique(_up(keys, d), return_inverse=True)
            weight, a, b = (np.bincount(where, x) for x in (level.weight, a, b))
    for d, level in enumerate(chain[::-1]):
        if d:
            at = np.searchsorted(above.keys, _up(level.keys, d))  # noqa: F821
            so_far, left = so_far[at], left[at]
        else:
            so_far, left = np.zeros(len(level.keys)), np.ones(len(level.keys))
        so_far, left = level.mix(so_far, left)
        above = level  # noqa: F841
    return chain[0].keys, so_far, left


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn=None, depth: int = DEPTH, frequent: float = FREQUENT, common: float = COMMON) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Learns from the rows where `learn` (a Column; by default crc32(id as text) mod 5 <> 1) holds. score is the
    context-tree model's log10 probability of the text (A-Z lower-cased) with its end; base_score sums the unigram
    estimates of its words and end. The tree has every context of up to `depth` bytes, however rare. Frequent byte
    sequences' costs and common words' counts are broadcast, of which there are 1 / frequent and 1 / common at most;
    the others are looked up by joins. Null texts are empty and have the end only; repeated rows are scored each; with
    no rows to learn from, all counts are 0; an empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    learn = F.coalesce(crc_mod("__id", 5) != 1 if learn is None else learn, F.lit(False))
    words = saved(word_counts(docs.where(learn).select("text")))
    row = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = row["n"] or 0, row["v"]
    known = {bytes(r["word"]): math.log10(r["n"] + 0.5) for r in words.where(F.col("n") >= max(2, math.ceil(total * common))).toLocalIterator()}
    grams = saved(gram_costs(saved(gram_counts(docs.select("text", learn.alias("learn")), depth)), depth))
    size = grams.agg(F.sum("seen")).first()[0] or 0
    often = grams.where(F.col("seen") >= max(1, math.ceil(size * frequent))).select("gram", "cost").toArrow()
    keys, cost = often.column(0).to_numpy(), often.column(1).to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], cost[order].astype(np.float32), known))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__sum", T.DoubleType()), T.StructField("__score", T.DoubleType()), T.StructField("__bytes", T.LongType()), T.StructField("__rare", T.ArrayType(T.BinaryType())), T.StructField("__grams", T.ArrayType(T.LongType()))]

    def make():
        keys, cost, known = shared.value
        get = known.get

        def on_texts(texts):
            n, found, sums, rare = [], [], [], []
            for t in texts:
                w = _lower(t).split()
                w.append(END)
                c = [get(x) for x in w]
                rest = [x for x, y in zip(w, c, strict=True) if y is None]
                n.append(len(w))
                found.append(len(w) - len(rest))
                sums.append(math.fsum(y for y in c if y is not None) if rest else math.fsum(c))
                rare.append(rest)
            key, first = _grams(texts, depth)
            distinct, where = np.unique(key, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, distinct), max(0, len(keys) - 1))
            have = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
            price = np.where(have, cost[at], 0.0) if len(keys) else np.zeros(len(distinct))
            lost = np.flatnonzero(~have[where])
            cuts = np.searchsorted(lost, np.r_[first, len(key)]).tolist()
            lost = key[lost]
            return [n, found, sums, np.add.reduceat(price[where], first), np.diff(np.r_[first, len(key)]), rare, [lost[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]]

        return on_texts

    rows = saved(append_columns(docs, "text", fields, make).drop("text").withColumn("__row", F.monotonically_increasing_id()))
    words_found = rows.select("__row", F.explode("__rare").alias("word")).join(words, "word", "left").groupBy("__row").agg(F.count("n").alias("__more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("__add"))
    grams_found = rows.select("__row", F.explode("__grams").alias("gram")).join(grams.select("gram", "cost"), "gram").groupBy("__row").agg(F.sum("cost").alias("__rest"))
    out = rows.drop("__rare", "__grams").join(words_found, "__row", "left").join(grams_found, "__row", "left")
    base = F.col("__sum") + F.coalesce("__add", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + 0.5 * (distinct + 1)))
    score = F.col("__score") + F.coalesce("__rest", F.lit(0.0))
    return out.select(
        F.col("__id").alias(id_col), (crc_mod("__id", 5) == 1).alias("held_out"), "n_tokens", (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), (-score / math.log10(2) / F.col("__bytes")).alias("bits_per_byte"),
    )
