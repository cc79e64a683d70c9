"""Token counts by rank-synchronous merging: ragged arrays of symbols in which each sequence's lowest-rank pair merges at once."""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, WordIds, byte_ranges, map_arrow, text_bytes
from .tokens import Encoder

#: Rank of a pair that doesn't merge.
NONE = np.int32(2**31 - 1)
#: Longer sequences are merged by a sweep over ranks, as each of their turns would read them whole.
SWEEP = 2048
#: One pre-token by itself under the byte-level pattern.
_WORD = re.compile(rb"[ ]?[A-Za-z]+")


class RankMerger:
    """The merges of a byte-level BPE model as sorted arrays.

    Needs the order that training gives: a pair ranks after the merges that made its parts, and no two pairs make the
    same symbol, so that merging all lowest-rank pairs of a sequence at once equals merging them one by one.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], byte_chars: list[str]):
        self.of_byte = np.array([vocab[c] for c in byte_chars], np.int64)
        left, right = np.array([vocab[a] for a, _ in merges], np.int64), np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.width = max(vocab.values()) + 1
        born = np.full(self.width, len(merges), np.int64)
        born[self.of_byte] = -1
        born[self.made] = np.arange(len(merges))
        if len(np.unique(self.made)) < len(merges) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("the merges aren't in the order of training")
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where it doesn't merge."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = a * self.width + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], NONE)

    @staticmethod
    def _alternate(follows: np.ndarray) -> np.ndarray:
        """Which of the places to take where each may overlap the one before it: every other one of a run, from its first."""
        i = np.arange(len(follows))
        return (i - np.maximum.accumulate(np.where(follows, 0, i))) % 2 == 0

    def survivors(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Symbols left of each byte sequence of a ragged array, whose k-th one lies from at[k] to at[k + 1]."""
        size = np.diff(at)
        out = size.copy()
        for k in np.flatnonzero(size > SWEEP).tolist():
            out[k] = self._sweep(self.of_byte[raw[at[k] : at[k + 1]]])
        short = size <= SWEEP
        row = np.repeat(np.arange(len(size)), np.where(short, size, 0))
        symbol = self.of_byte[raw[np.repeat(short, size)]]
        pair = np.full(len(row), NONE)
        inner = np.flatnonzero(row[:-1] == row[1:])
        pair[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            left = np.diff(np.r_[starts, len(row)])
            low = np.minimum.reduceat(pair, starts)
            out[row[starts]] = left
            if (low == NONE).any():
                goes_on = np.repeat(low < NONE, left)
                row, symbol, pair, left, low = row[goes_on], symbol[goes_on], pair[goes_on], left[low < NONE], low[low < NONE]
            take = np.flatnonzero(pair == np.repeat(low, left))
            if not len(take):
                break
            take = take[self._alternate(np.r_[False, take[1:] == take[:-1] + 1])]
            symbol[take] = self.made[pair[take]]
            stays = np.ones(len(row), bool)
            stays[take + 1] = False
            row, symbol, pair = row[stays], symbol[stays], pair[stays]
            here = take - np.arange(len(take))  # each merge before it moved it by one
            changed = np.concatenate([here, here[here > 0] - 1])
            pair[changed] = NONE
            changed = changed[changed + 1 < len(row)]
            changed = changed[row[changed] == row[changed + 1]]
            pair[changed] = self.rank(symbol[changed], symbol[changed + 1])
        return out

    def _sweep(self, symbol: np.ndarray) -> int:
        """Symbols left of one long sequence: the ranks present are taken in order, all places of one at once."""
        n = left = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.append(self.rank(symbol[:-1], symbol[1:]), NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[pair[places] < NONE]
            places = places[np.argsort(pair[places], kind="stable")]
            ranks = pair[places]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for part in np.split(places, cuts) if len(places) else ():
                r = int(pair[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[pair[places] == r]  # others have merged since
            if not len(places):
                continue
            places = places[self._alternate(np.r_[False, after[places[:-1]] == places[1:]])]
            gone = after[places]
            symbol[places], pair[gone] = self.made[r], NONE
            after[places] = after[gone]
            inside = after[places] < n
            before[after[places[inside]]] = places[inside]
            left -= len(places)
            changed = np.unique(np.concatenate([places, before[places][before[places] >= 0]]))
            pair[changed] = NONE
            inside = changed[after[changed] < n]
            pair[inside] = self.rank(symbol[inside], symbol[after[inside]])
            wait(inside)
        return left


class TokenCounter(Encoder):
    """Texts -> numbers of tokens, by the library's pre-tokens and the merges above.

    Texts are cut into pieces as for their ids; distinct pieces' counts are remembered up to a bounded memory.
    """

    def __init__(self, tokenizer: str):
        super().__init__(tokenizer)
        spec = json.loads(self.tok.to_str())
        model, added = spec["model"], self.tok.get_added_tokens_decoder().values()
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("not a plain byte-level BPE tokenizer")
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        chars = {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}
        self.bytes_of = str.maketrans({c: chr(b) for b, c in chars.items()})
        self.merger = RankMerger(model["vocab"], [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]], [chars[b] for b in range(256)])
        special = sorted((t.content for t in added if t.content), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.memory = WordIds(self.piece_counts)

    def piece_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece: its added tokens, and what its pre-tokens' bytes merge to."""
        counts, words, owner, split = np.zeros(len(pieces), np.int64), [], [], self.tok.pre_tokenizer.pre_tokenize_str
        for k, piece in enumerate(pieces):
            if _WORD.fullmatch(piece):
                words.append(piece)
                owner.append(k)
                continue
            text = piece.decode("utf-8", "replace")
            parts = self.special.split(text) if self.special else [text]
            counts[k] = len(parts) - 1
            for part in parts:
                if part:
                    new = [w.translate(self.bytes_of).encode("latin-1") for w, _ in split(part)]
                    words.extend(new)
                    owner.extend([k] * len(new))
        at = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        left = self.merger.survivors(np.frombuffer(b"".join(words), np.uint8), at)
        return counts + np.bincount(np.array(owner, np.int64), left, len(pieces)).astype(np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null texts have none."""
        if not len(texts):
            return np.zeros(0, np.int64)
        raw, at = text_bytes(texts)
        starts, firsts = self._pieces(raw, at)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        rows = self.memory.lookup(pieces.dictionary.to_pylist())
        ends = np.r_[0, np.cumsum(self.memory.table[rows][pieces.indices.to_numpy()])]
        return np.diff(ends[firsts])


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(df: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 512, keep_text: bool = True) -> DataFrame:
    """df with n_bytes (UTF-8) and n_tokens (long), and over_limit where a text has more than `limit` tokens.

    n_tokens is what the tokenizer of a byte-level BPE file gives for the whole text without added begin or end; a
    string of one of its added tokens counts as that token. A null or empty text has none; equal texts count alike; an
    empty table stays empty; columns with an output's name are replaced. No shuffle; a task holds about 1 MB of texts,
    or one longer text, and 32 MB of remembered pieces.
    """
    if text_col in ("n_bytes", "n_tokens", "over_limit"):
        raise ValueError(f"{text_col!r} has an output's name")
    kept = df.drop("n_bytes", "n_tokens", "over_limit").withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"))
    names = [c for c in kept.columns if keep_text or c != text_col]

    def make():
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = TokenCounter(tokenizer)
        counter = _COUNTERS[tokenizer]

        def on_batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(b.schema.get_field_index(text_col))
            n = np.concatenate([counter.count(texts.slice(i, j - i)) for i, j in byte_ranges(texts, STEP_BYTES)])
            return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(n)], names=[*names, "n_tokens"])

        return on_batch

    schema = T.StructType([*(f for f in kept.schema.fields if f.name in names), T.StructField("n_tokens", T.LongType())])
    return map_arrow(kept, make, schema).withColumn("over_limit", F.col("n_tokens") > limit)
