"""Fill-in-middle documents: a wavelet matrix over character classes counts and finds the boundaries where texts are cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import STEP_BYTES, byte_ranges, free_names, map_arrow, text_bytes
from .decontam import Wavelet

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of a text's bytes: a newline; a full stop or the like that ends a word before a blank; another byte that ends
#: a word; another byte that starts a character; and the bytes within characters, at a word's end and elsewhere.
NEWLINE, STOP, END, START, INNER_END, INNER = range(6)
#: The classes that end a unit. A text's last unit may lack its end.
UNITS = {"lines": (NEWLINE,), "sentences": (NEWLINE, STOP), "words": (STOP, END, INNER_END)}
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_STOP = np.isin(np.arange(256), list(b".!?"))
_FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def byte_classes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Class of each byte of texts that lie one after another."""
    following = np.append(raw[1:], np.uint8(0x20))
    following[at[1:][at[1:] > at[:-1]] - 1] = 0x20  # a text's end ends a word too
    inner, ends = (raw & 0xC0) == 0x80, ~_BLANK[raw] & _BLANK[following]
    out = np.where(inner, np.where(ends, INNER_END, INNER), np.where(ends, END, START)).astype(np.uint8)
    out[_STOP[raw] & ends & (following != 0x0A)] = STOP
    out[raw == 0x0A] = NEWLINE
    return out


class Boundaries:
    """Units, cuts and characters of texts that lie one after another, by ranks in one wavelet matrix of their classes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, unit: str = "lines"):
        self.at, self.ends = at, UNITS[unit]
        classes = byte_classes(raw, at)
        self.matrix = Wavelet.of(classes, 6)
        last = classes[np.maximum(at[1:] - 1, 0)] if len(raw) else np.zeros(len(at) - 1, np.uint8)
        self.open = (at[1:] > at[:-1]) & ~np.isin(last, self.ends)
        self.before = self._rank(self.ends, at)
        #: Units of each text.
        self.n = np.diff(self.before) + self.open

    def _rank(self, classes: tuple[int, ...], i: np.ndarray) -> np.ndarray:
        """Bytes of any of the classes before each place."""
        return sum(self.matrix.rank(np.full(len(i), c), i) for c in classes)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Place after the first k units of each text: the least one with so many ends before it, by bisection on ranks."""
        want, lo, hi = self.before[:-1] + k, self.at[:-1].copy(), self.at[1:].copy()
        lo[k >= self.n] = hi[k >= self.n]
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            enough = self._rank(self.ends, mid) >= want[open_]
            hi[open_[enough]] = mid[enough]
            lo[open_[~enough]] = mid[~enough] + 1
        return lo

    def characters(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Code points of the bytes from i to j: those bytes that aren't within a character."""
        return (j - i) - (self._rank((INNER, INNER_END), j) - self._rank((INNER, INNER_END), i))


def restore(output: Column, form: Column) -> Column:
    """The text as it was before it was cut, from output and form alone.

    The text holds no mark, and none can arise across the seam of a part and a mark, so that the marks are found again.
    """
    part = F.split(output, "<[PSM]>", 4)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines", rate: int = 100, spm_rate: int = 50, seed: int = 7, keep_text: bool = True) -> DataFrame:
    """df with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars and output.

    The first four 8-digit groups of the hex sha256 of `seed:id` are h1 to h4. The prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger; rate per cent of texts (by h3) are cut, spm_rate
    per cent of those (by h4) have the suffix first. Units are lines, sentences or words, each with what follows it up
    to the next one's start. A null or empty text and one that holds a mark are plain, with null counts; a null text's
    output is empty. Without keep_text the text itself isn't given back. A null id counts as the empty string. Equal rows are cut alike, rows of any table by themselves;
    an empty table stays empty; columns with an output's name are replaced. No shuffle; a task holds about 1 MB of
    texts, or one longer text, at once.
    """
    names = [f.name for f in _FIELDS]
    if unit not in UNITS or text_col in names or id_col in names:
        raise ValueError(f"unit {unit!r} isn't one of {sorted(UNITS)}, or {text_col!r} or {id_col!r} has an output's name")
    kept = df.drop(*names)
    lo, hi, form = free_names(kept, "h1", "h2", "form")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= rate)
    made = kept.withColumns({lo: h[0], hi: h[1], form: F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")})
    arrow = to_arrow_schema(T.StructType(_FIELDS))

    def make():
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

        def on_batch(b: pa.RecordBatch) -> pa.RecordBatch:
            column = lambda name: b.column(b.schema.get_field_index(name))
            texts, forms = column(text_col), column(form).to_pylist()
            a, z = column(lo).to_numpy(), column(hi).to_numpy()
            new: list[list] = [[] for _ in _FIELDS]
            for i, j in byte_ranges(texts, STEP_BYTES):
                raw, at = text_bytes(texts.slice(i, j - i))
                units = Boundaries(raw, at, unit)
                one, other = a[i:j] % (units.n + 1), z[i:j] % (units.n + 1)
                first, second = units.cut(np.minimum(one, other)), units.cut(np.maximum(one, other))
                sizes = [x.tolist() for x in (units.characters(at[:-1], first), units.characters(first, second))]
                whole = raw.tobytes()
                outputs = []
                for f, start, x, y, end in zip(forms[i:j], at[:-1].tolist(), first.tolist(), second.tolist(), at[1:].tolist(), strict=True):
                    if f == "plain":
                        outputs.append(whole[start:end])
                    elif f == "psm":
                        outputs.append(b"".join((p, whole[start:x], s, whole[y:end], m, whole[x:y])))
                    else:
                        outputs.append(b"".join((s, whole[y:end], p, whole[start:x], m, whole[x:y])))
                counts = [[None if f == "plain" else v for f, v in zip(forms[i:j], x, strict=True)] for x in sizes]
                for held, got in zip(new, (units.n.tolist(), forms[i:j], *counts, outputs), strict=True):
                    held.extend(got)
            out = [pa.array(x, pa.binary() if f.name == "output" else f.type).cast(f.type) for x, f in zip(new, arrow, strict=True)]
            return pa.RecordBatch.from_arrays([*(column(c) for c in kept_names), *out], names=[*kept_names, *names])

        return on_batch

    kept_names = [c for c in kept.columns if keep_text or c != text_col]
    return map_arrow(made, make, T.StructType([*(f for f in kept.schema.fields if f.name in kept_names), *_FIELDS]))
