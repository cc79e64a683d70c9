"""Hashed character n-grams of words, for many words at once."""

from __future__ import annotations

import numpy as np


def gram_ids(words: list[bytes], sizes: tuple[int, ...], buckets: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of all n-grams of code points of the words with a mark at either end.

    n-grams with a mark are the words' affixes. whole: also one bucket per word. buckets is a power of two.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts = ["\x02" + w.decode("utf-8", "surrogatepass") + "\x03" for w in words]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    end = np.repeat(np.cumsum(size), size)
    place, n_codes = np.arange(len(code)), len(code)
    p = np.uint64(0x9E3779B97F4A7C15)
    h, ids, owners = np.zeros(n_codes, np.uint64), [], []

    def bucket(x: np.ndarray, kind: int) -> np.ndarray:
        x = (x + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int64)

    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            h[: n_codes - n + 1] = h[: n_codes - n + 1] * p + code[n - 1 :]
            if n in sizes:
                ok = place + n <= end
                ids.append(bucket(h[ok], n))
                owners.append(owner[ok])
        if whole:
            key = code * p ** ((place - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64) + np.uint64(1))
            ids.append(bucket(np.add.reduceat(key, np.cumsum(size) - size), 99))
            owners.append(np.arange(len(texts)))
    return np.concatenate(ids), np.concatenate(owners)
