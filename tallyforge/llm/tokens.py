"""Token ids of texts by a public tokenizer, with a memory of the pieces met."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import text_bytes

_BYTE = np.arange(256)
#: A text is cut before these bytes ...
_BLANK = np.isin(_BYTE, [0x20, 0x0A])
#: ... where the character before is none of Unicode's white space, which is told by its last byte, or, for two-byte
#: characters other than U+0085 and U+00A0, by the byte before that.
_VISIBLE = ~np.isin(_BYTE, [*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
_TWO_BYTES = (_BYTE >= 0xC3) & (_BYTE <= 0xDF)
#: It is also cut between ASCII characters of unlike kinds (letters 1, digits 2, other visible ones 3, 4 for "'"), as
#: runs of each are pieces of their own; not after "'", which takes some letters along.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x27] = 4
#: Pairs of kinds (first * 8 + second) between which texts are cut.
_CHANGE = np.isin(np.arange(64), [8 * a + b for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b and (a, b) != (3, 4)])
#: The pre-tokenizers for which these cuts are right, by their patterns, besides the byte-level one's own.
_KNOWN = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)
#: Pieces of a word of Latin letters, with a blank before it at most: NFC leaves them as they are, and all pre-tokenizers
#: above hand them to the model whole.
_LATIN = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: Longer pieces are encoded anew each time, so that unbroken texts don't fill the memory.
LONGEST = 64
#: Bytes of text that are encoded at once.
STEP = 4 << 20
#: Bytes that a remembered piece takes besides its own and its ids'.
_ENTRY = 150


class Encoder:
    """Texts -> ids as unsigned 32-bit numbers, with the end id last; equal to the tokenizer's own on whole texts.

    The pre-tokenizers of the public files start a new piece at a blank or newline after a visible character and where
    ASCII letters, digits and signs meet, so a text's ids are those of its pieces between such places. Distinct pieces
    of a step are found by Arrow, encoded once while they are remembered, and put together by numpy. The memory is
    emptied when it takes `most` bytes. A text that holds one of the tokenizer's added tokens is encoded whole, as is
    any text if the tokenizer has another pre-tokenizer or looks for added tokens in normalised text.
    """

    def __init__(self, tokenizer: str, end_id: int = 1, most: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer)
        added = self.tok.get_added_tokens_decoder()
        self.added = [t.content.encode() for t in added.values() if t.content]
        self.whole = not _cuts_are_right(json.loads(self.tok.to_str())) or any(t.normalized for t in added.values())
        plain = [(i, t.content) for i, t in added.items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark = plain[0] if plain else None
        self.small = self.tok.get_vocab_size() <= 65_536 and end_id < 65_536
        self.latin = None if self.whole else self._latin_writer()
        self.end_id, self.most = end_id, most
        self._forget()

    def _latin_writer(self):
        """How the model is given a word of Latin letters: its bytes as the byte-level pre-tokenizer's characters, after
        the normaliser's lower case and loss of blanks, if it has them; none if the tokenizer doesn't agree on some words."""
        # A printable Latin-1 byte stands for itself, each of the others, in order, for the next character from U+0100.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        as_char = {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}
        table, blank = str.maketrans({chr(b): c for b, c in as_char.items()}), as_char[0x20]
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        lower, bare = ids("ABcÉ") == ids("abcé"), ids(" ab") == ids("ab")

        def write(x: str) -> str:
            x = x.lower() if lower else x
            x = x.lstrip(" ") if bare else x
            if x.isascii():
                return blank + x[1:] if x[0] == " " else x
            return x.encode().decode("latin-1").translate(table)

        words = [" " * k + w for k in (0, 1) for w in ("a", "Word", "elsewhere", "ÉTÉ", "größe", "Łódź", "œuvre", "ſs", "zażółć", "Straßenbahnen", "niño")]
        agrees = all([t.id for t in self.tok.model.tokenize(write(w))] == ids(w) for w in words)
        return write if agrees else None

    @classmethod
    def of_process(cls, tokenizer: str, end_id: int = 1) -> Encoder:
        """One encoder for all tasks of a worker process, so that its memory outlives a task."""
        key = (tokenizer, end_id)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(tokenizer, end_id)
        return _ENCODERS[key]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}  # only a text's end is an empty piece
        self.ids = np.full(1 << 16, self.end_id, np.uint32)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)
        self.rows = self.filled = 1
        self.held = 0

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces, and each one's number of ids; words of Latin letters go straight to the tokenizer's model."""
        texts = [w.decode("utf-8", "replace") for w in pieces]
        if self.whole or self.latin is None:
            return self._whole_ids_of(pieces, texts)
        model, write, fits = self.tok.model, self.latin, _LATIN.fullmatch
        lists = [[t.id for t in model.tokenize(write(x))] if fits(x) else None for x in texts]
        others = [k for k, x in enumerate(lists) if x is None]
        if others:
            ids, size = self._whole_ids_of([pieces[k] for k in others], [texts[k] for k in others])
            flat, at = ids.tolist(), np.r_[0, np.cumsum(size)].tolist()
            for i, k in enumerate(others):
                lists[k] = flat[at[i] : at[i + 1]]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size

    def _whole_ids_of(self, pieces: list[bytes], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by all of the tokenizer's steps. Many pieces go in one call, with an added token between them."""
        if self.mark and not any(len(w) > LONGEST and self.mark[1].encode() in w for w in pieces):
            got = self.tok.encode_batch_fast([self.mark[1].join([*texts[i : i + 200], ""]) for i in range(0, len(texts), 200)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(texts):
                return np.delete(ids, marks), np.diff(np.r_[-1, marks]) - 1
        lists = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size

    def _append(self, pieces: list[bytes]) -> np.ndarray:
        """Rows of new pieces."""
        first = self.rows
        for i in range(0, len(pieces), 10_000):
            part = pieces[i : i + 10_000]
            ids, size = self._ids_of(part)
            many, n = len(ids), len(part)
            self.ids = _room(self.ids, self.filled + many)
            self.start, self.size = _room(self.start, self.rows + n), _room(self.size, self.rows + n)
            self.ids[self.filled : self.filled + many] = ids
            self.start[self.rows : self.rows + n] = self.filled + np.cumsum(size) - size
            self.size[self.rows : self.rows + n] = size
            self.held += sum(map(len, part)) + _ENTRY * n + 4 * many
            self.filled += many
            self.rows += n
        rows = np.arange(first, self.rows)
        self.known.update((w, r) for w, r in zip(pieces, rows.tolist(), strict=True) if len(w) <= LONGEST)
        return rows

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start (each text's last one, its end, is empty), and each text's first piece and the end of all."""
        kind = _KIND[raw]
        change = _CHANGE[(kind[:-1] << 3) | kind[1:]] if len(raw) > 1 else np.zeros(0, bool)
        blank = np.flatnonzero(_BLANK[raw[1:]]) + 1
        before = raw[blank - 1]
        blank = blank[_VISIBLE[before] | ((before >= 0x80) & _TWO_BYTES[raw[blank - 2]])]
        marks = np.r_[False, change, False]
        marks[blank] = True
        if whole := self._whole_texts(raw, at):
            for t in whole:
                marks[at[t] : at[t + 1]] = False
        marks[at[:-1][at[1:] > at[:-1]]] = True
        marks[len(raw)] = False
        starts = np.flatnonzero(marks)
        ends = np.searchsorted(starts, at[1:])
        return np.insert(starts, ends, at[1:]), np.r_[0, ends + np.arange(1, len(at))]

    def _whole_texts(self, raw: np.ndarray, at: np.ndarray) -> list[int]:
        if self.whole:
            return list(range(len(at) - 1))
        joined, out = raw.tobytes(), set()
        for mark in self.added:
            i = joined.find(mark)
            while i >= 0:
                t = int(np.searchsorted(at, i, "right")) - 1
                if i + len(mark) <= at[t + 1]:
                    out.add(t)
                i = joined.find(mark, i + 1)
        return sorted(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and each text's number of ids."""
        if self.held > self.most:
            self._forget()
        raw, at = text_bytes(texts)
        starts, firsts = self._pieces(raw, at)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        _, at, held = pieces.dictionary.buffers()
        held, at = held.to_pybytes(), np.frombuffer(at, np.int32, len(pieces.dictionary) + 1).tolist()
        words, get = [held[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], self.known.get
        rows = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if len(new := np.flatnonzero(rows < 0)):
            rows[new] = self._append([words[k] for k in new.tolist()])
        row = rows[pieces.indices.to_numpy()]
        size = self.size[row]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[row] - (ends - size), size)
        return self.ids[place], np.diff(np.r_[0, ends][firsts])


def _cuts_are_right(tokenizer: dict) -> bool:
    """Whether the pre-tokenizer is a byte-level one with its own pattern, or splits by a known pattern first."""
    pre = tokenizer.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    level = steps[-1]
    if level.get("type") != "ByteLevel" or level.get("add_prefix_space") or len(steps) > 2:
        return False
    if len(steps) == 1:
        return level.get("use_regex", False)
    return steps[0].get("type") == "Split" and steps[0]["pattern"].get("Regex") in _KNOWN and not level.get("use_regex")


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}
