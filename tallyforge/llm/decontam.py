"""Benchmark decontamination: an FM-index per shard of documents, searched backwards for the benchmark's windows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, append_columns, free_names, saved

WINDOW = 13
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of the sorted suffixes of s, whose last symbol is its only 0. Prefix doubling; only tied places are sorted again."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def groups(order: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """For each place of the order, the place in sa where its group of equal keys starts."""
        first = np.r_[True, keys[1:] != keys[:-1]]
        return base[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]

    start = groups(sa, s[sa], np.arange(n))
    rank[sa] = start
    tied = np.flatnonzero(np.r_[start[1:] == start[:-1], False] | np.r_[False, start[1:] == start[:-1]])
    step = 1
    while len(tied):
        here = sa[tied]
        key = rank[here] * (n + 1) + rank[np.minimum(here + step, n)] + 1
        order = np.argsort(key, kind="stable")
        here, key = here[order], key[order]
        sa[tied] = here
        start = groups(here, key, tied)
        rank[here] = start
        again = np.r_[start[1:] == start[:-1], False] | np.r_[False, start[1:] == start[:-1]]
        tied = tied[again]
        step *= 2
    return sa


class Bits:
    """A bit vector of one bit a place and one 32-bit count for each 64 of them; ranks by a count and a bit count."""

    def __init__(self, b: np.ndarray):
        whole = np.zeros((len(b) // 64 + 1) * 64, np.uint8)
        whole[: len(b)] = b
        self.words = np.packbits(whole, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place i."""
        word, below = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


@dataclass
class Wavelet:
    """Wavelet matrix of a sequence of symbols: rank and access go down one bit of the symbol at a time."""

    bits: int
    ones: list[Bits] = field(default_factory=list)
    zeros: list[int] = field(default_factory=list)
    first: np.ndarray | None = None

    @classmethod
    def of(cls, s: np.ndarray, symbols: int) -> Wavelet:
        w = cls(max(1, int(symbols - 1).bit_length()))
        for level in range(w.bits - 1, -1, -1):
            b = (s >> level) & 1
            w.ones.append(Bits(b))
            w.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate([s[b == 0], s[b == 1]])
        w.first = w._down(np.arange(symbols), np.zeros(symbols, np.int64))
        return w

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            r = ones.rank(i)
            i = np.where((c >> (self.bits - 1 - k)) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol c stands before place i."""
        return self._down(c, i) - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and their ranks there."""
        c = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            r, b = ones.rank(i), ones.at(i)
            c = c * 2 + b
            i = np.where(b == 1, zeros + r, i - r)
        return c, i - self.first[c]


class FMIndex:
    """Full-text index of a sequence of symbols 1.. (0 ends it), with suffix positions sampled every `every` places."""

    def __init__(self, s: np.ndarray, symbols: int, every: int = 16):
        s = np.r_[s, 0]
        sa = suffix_array(s)
        self.n, self.every = len(s), every
        self.wavelet = Wavelet.of(s[sa - 1], symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(s, minlength=symbols))]
        at = sa % every == 0
        self.sampled = np.r_[0, np.cumsum(at)]
        self.places = sa[at]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes that start with each pattern (a row of equal-length patterns)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: steps back until a sampled place."""
        out, walked, live = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            r = rows[live]
            known = self.sampled[r + 1] > self.sampled[r]
            out[live[known]] = self.places[self.sampled[r[known]]] + walked[live[known]]
            live = live[~known]
            c, rank = self.wavelet.access(rows[live])
            rows[live] = self.before[c] + rank
            walked[live] += 1
        return out


@dataclass
class Phrases:
    """A benchmark's distinct windows and the items that have each.

    by_length: for each window length, the windows as rows of word numbers (from 2), where each one's items start, and
    the items' places in `names`. It takes some ten times the bytes of the items' texts.
    """

    vocabulary: dict[bytes, int]
    names: list[str]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        names = sorted({item for item, _ in items if item is not None})
        place = {item: k for k, item in enumerate(names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 2) for w in words_of(text)], np.int32)
            if n := min(len(ids), window):
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), place.get(item, -1)))
        by_length = {}
        for n, parts in found.items():
            rows, where = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
            owner = np.repeat([k for _, k in parts], [len(w) for w, _ in parts])
            pairs = np.unique(np.stack([where.ravel()[owner >= 0], owner[owner >= 0]], 1), axis=0)  # an item without a name has windows only
            by_length[n] = (rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1].astype(np.int32))
        return cls(vocabulary, names, by_length)


def search_shard(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Word counts, merged spans of hit words and occurring items of each text; equal texts are indexed once.

    A window has benchmark words only, so the index's alphabet is the benchmark's vocabulary and one mark that stands
    for any run of other words; stretches of vocabulary words shorter than the shortest window can't hold one.
    """
    distinct: dict[str, int] = {}
    which = [distinct.setdefault(t or "", len(distinct)) for t in texts]
    get, parts, sizes = phrases.vocabulary.get, [], []
    for t in distinct:
        w = words_of(t)
        sizes.append(len(w))
        parts.append(np.fromiter(map(get, w, repeat(1)), np.int64, len(w)))
        parts.append(np.ones(1, np.int64))  # the mark ends a document
    sizes = np.array(sizes, np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    spans: list[list[tuple[int, int]]] = [[] for _ in distinct]
    items: list[set[str]] = [set() for _ in distinct]
    ids = np.concatenate(parts) if parts else np.ones(0, np.int64)
    known = np.r_[False, ids > 1, False]
    runs = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    if phrases.by_length:
        runs = runs[runs[:, 1] - runs[:, 0] >= min(phrases.by_length)]
        if len(runs):
            length = runs[:, 1] - runs[:, 0] + 1  # with the mark that follows
            ends = np.cumsum(length)
            place = np.arange(ends[-1]) + np.repeat(runs[:, 0] - (ends - length), length)
            index = FMIndex(ids[place], len(phrases.vocabulary) + 2)
            edge = np.zeros(len(ids) + 1, np.int64)
            present = np.zeros(len(phrases.vocabulary) + 2, bool)
            present[ids] = True
            for n, (patterns, first, owners) in phrases.by_length.items():
                likely = np.flatnonzero(present[patterns].all(axis=1))
                lo, hi = index.search(patterns[likely].astype(np.int64))
                hit = np.flatnonzero(lo < hi)
                if not len(hit):
                    continue
                many = hi[hit] - lo[hit]
                rows = np.arange(many.sum()) + np.repeat(lo[hit] - (np.cumsum(many) - many), many)
                at = place[index.locate(rows)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n, -1)
                docs = np.searchsorted(starts, at, side="right") - 1
                for d, p in np.unique(np.stack([docs, np.repeat(likely[hit], many)], 1), axis=0):
                    items[d].update(phrases.names[k] for k in owners[first[p] : first[p + 1]])
            covered = np.r_[False, np.cumsum(edge)[:-1] > 0, False]
            for a, b in np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2):
                d = int(np.searchsorted(starts, a, side="right") - 1)
                spans[d].append((int(a - starts[d]), int(b - starts[d])))
    return sizes[which] if len(sizes) else sizes, [spans[k] for k in which], [items[k] for k in which]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items (long), items_sha256, contaminated, and spans (array of word ranges) and items.

    Contaminated: n_hit > 0 and 20 * n_hit >= n_words. There is no shuffle: each task indexes its documents in shards
    of bounded text size and searches the broadcast windows. A benchmark over block_bytes of text is dealt into
    blocks by hash; each is broadcast and searched in a step of its own that extends the spans and items so far and is
    written before the next one begins, so that one block is held at a time: some ten times its text, whatever the
    benchmark's size (an item is not divided).

    Null, empty or wordless texts have no words and aren't contaminated; items without words match nothing; items with
    a null id count for hits and spans but have no name in items, n_items and items_sha256; repeated rows and items
    are each reported; an empty table gives no rows, an empty benchmark no hits; columns with an output's name are
    replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
    out, (old_spans, old_items) = docs, free_names(docs, "spans_before", "items_before")
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        shared = spark.sparkContext.broadcast(Phrases.of([(r["item"], r["text"]) for r in block], window))

        def make(shared=shared):
            def on_texts(texts):
                n, spans, found = search_shard(texts, shared.value)
                return [n, [[{"start": a, "end": e} for a, e in s] for s in spans], [sorted(x) for x in found]]

            return on_texts

        before = out.withColumnsRenamed({"spans": old_spans, "items": old_items}) if b else out
        out = append_columns(before, text_col, fields, make)
        if b:
            both = lambda new, old: F.concat(F.col(old), F.col(new))
            out = out.withColumns({"items": F.array_distinct(both("items", old_items)), "spans": _merge_column(both("spans", old_spans))}).drop(old_spans, old_items)
        if b < blocks - 1:
            out = saved(out)
            shared.unpersist()
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    out = out.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _merge_column(spans):
    """Overlapping or touching ranges joined."""
    start = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")
    step = lambda a, x: F.when((F.size(a) > 0) & (F.element_at(F.concat(a, F.array(x)), -2)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(F.concat(a, F.array(x)), -2)["start"].alias("start"), F.greatest(F.element_at(F.concat(a, F.array(x)), -2)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(F.array_sort(spans), start, step)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the ranges and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(LOWER))]
    out, last = [], 0
    for a, b in merged([(int(x), int(y)) for x, y in spans]):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """find_contamination's rows with the hit words cut out of the texts."""

    @F.udf(T.StringType())
    def cut(text, spans):
        return cut_spans(text, [(s["start"], s["end"]) for s in spans or ()])

    return found.withColumn(text_col, F.when(F.col("n_hit") > 0, cut(F.col(text_col), "spans")).otherwise(F.col(text_col)))
