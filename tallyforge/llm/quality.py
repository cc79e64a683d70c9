"""Quality classifier: averaged word and character n-gram vectors under a softmax, trained by stochastic gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordIds, append_columns, crc_mod
from .ngrams import gram_ids

BUCKETS, DIM, SIZES = 1 << 16, 12, (3, 4)
#: Stands for "the word before, once more"; no text has it as a word, as white space ends words. It takes the place of
#: hashed word pairs, with which the classifier tells held-out labels far worse (see the README).
AGAIN = b"\x02 again"


def words_of(text: str | None) -> list[bytes]:
    """Words with their case, and after a word that repeats the one before, a mark of that."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    out = words[:1]
    for a, b in zip(words, words[1:], strict=False):
        out.append(b)
        if a == b:
            out.append(AGAIN)
    return out


@dataclass
class Embeddings:
    vectors: np.ndarray  # one per bucket
    output: np.ndarray  # DIM x 2
    bias: np.ndarray

    def parts(self, words: list[bytes]) -> np.ndarray:
        """Each word's part of the difference of the two logits, and its number of vectors."""
        ids, owner = gram_ids(words, SIZES, BUCKETS, whole=True)
        toward = (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)
        return np.stack([np.bincount(owner, toward[ids], len(words)), np.bincount(owner, minlength=len(words))], 1)


def train(rows: list[tuple[str, int]], passes: int = 10_000, rate: float = 0.5, batch: int = 32, seed: int = 3) -> Embeddings:
    """Softmax regression on the mean of the vectors of all features of a text, both learned, with a falling rate;
    `passes` counts the examples seen, so that few rows are seen more often."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    model = Embeddings(vectors, np.zeros((DIM, 2)), np.zeros(2))
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t, _ in rows]
    ids, owner = gram_ids(list(vocabulary), SIZES, BUCKETS, whole=True)
    ids = ids[np.argsort(owner, kind="stable")]
    many = np.bincount(owner, minlength=len(vocabulary))
    first = np.cumsum(many) - many
    label = np.array([y for _, y in rows])
    epochs = -(-passes // max(1, len(rows)))
    total, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = [d for d in order[i : i + batch] if len(docs[d])]
            step = rate * (1 - done / total)
            done += batch
            if not pick:
                continue
            word = np.concatenate([docs[d] for d in pick])
            doc = np.repeat(np.arange(len(pick)), [len(docs[d]) for d in pick])
            key, times = np.unique(doc * len(vocabulary) + word, return_counts=True)
            doc, word = key // len(vocabulary), key % len(vocabulary)
            n = many[word]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)
            feature, fdoc, weight = ids[at], np.repeat(doc, n), np.repeat(times, n).astype(float)
            weight /= np.bincount(fdoc, weight, len(pick))[fdoc]
            rowsum = np.stack([np.bincount(fdoc, weight * model.vectors[feature, k], len(pick)) for k in range(DIM)], 1)
            z = rowsum @ model.output + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = p.copy()
            slope[np.arange(len(pick)), label[pick]] -= 1
            back = slope @ model.output.T
            model.output -= step * rowsum.T @ slope / len(pick)
            model.bias -= step * slope.mean(axis=0)
            uniq, where = np.unique(feature, return_inverse=True)
            change = np.stack([np.bincount(where, weight * back[fdoc, k], len(uniq)) for k in range(DIM)], 1)
            model.vectors[uniq] -= step * 20 * change / len(pick) * min(len(pick), 8)
    model.vectors = model.vectors.astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> list[tuple[str, int]]:
    """At most `most` labelled texts: the least hashes of ids, picked from the narrow label table, then found in docs."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (crc_mod(id_col, 3) != 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    picked = usable.orderBy(F.xxhash64("__id", F.lit("sample")), "__y").limit(most)
    # At most `most` ids are broadcast.
    found = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(picked), F.col(id_col) == F.col("__id"))
    # Of the texts that share an id, the one with the least hash, so that one text at most comes for each id and label.
    found = found.groupBy("__id", "__y").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    return [(r["__text"] or "", r["__y"]) for r in sorted(found.collect(), key=lambda r: (r["__id"], r["__y"]))]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 3000) -> DataFrame:
    """docs with score (0 to 1, the probability of label 1), predicted (1 where score >= 0.5) and held_out.

    The classifier is fitted on at most train_rows labelled rows whose crc32(id as text) mod 3 is not 1, and has a
    fixed size. Null and empty texts get the bias' score; with no labelled row all scores are 0.5. Repeated rows get
    equal scores; labels that are null or neither 0 nor 1 aren't used; columns with an output's name are replaced.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, train_rows)
    model = train(rows) if rows else Embeddings(np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 2)), np.zeros(2))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        words = WordIds(model.parts)
        base = model.bias[1] - model.bias[0]

        def on_texts(texts):
            lists = [words_of(t) for t in texts]
            flat = [w for x in lists for w in x]
            z = np.zeros(len(texts))
            if flat:
                got = words.table[at] if (at := words.lookup(flat)) is not None else None
                doc = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
                n = np.bincount(doc, got[:, 1], len(texts))
                z = np.bincount(doc, got[:, 0], len(texts)) / np.maximum(n, 1)
            return [1 / (1 + np.exp(-np.clip(z + base, -500, 500)))]

        return on_texts

    out = append_columns(docs, text_col, [T.StructField("score", T.DoubleType())], make)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("held_out", crc_mod(id_col, 3) == 1)
