"""Language ID by a linear-chain conditional random field over the words of code-switched text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WordIds, append_columns, crc_mod, lower_words, saved
from .ngrams import gram_ids

BUCKETS = 1 << 16
#: Labelled texts that each language has in the training sample before any has more.
FLOOR = 50
SIZES = (2, 3, 4)
#: Bytes of text that are labelled at once; the recursions take a turn for each place of the longest text among them.
STEP = 2 << 20
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(w: bytes) -> bool:
    """Whether a character is a letter in Unicode's sense (category L), which number signs such as a half aren't."""
    if _ASCII_LETTER.search(w):
        return True
    return not w.isascii() and any(map(str.isalpha, w.decode("utf-8", "surrogatepass")))


@dataclass
class Crf:
    """Weights of affix and n-gram features (hashed) and of one lexicon feature per label, and the transitions."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[bytes, int]
    lexical: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Score of each word under each label, and in the last column whether it has a letter; words without are neutral."""
        out = np.zeros((len(words), len(self.labels) + 1), np.float32)
        ids, owner = gram_ids(words, SIZES, BUCKETS)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(owner, self.weights[ids, k], len(words))
        for i, w in enumerate(words):
            if (k := self.lexicon.get(w)) is not None:
                out[i, k] += self.lexical[k]
            out[i, -1] = _has_letter(w)
        out[out[:, -1] == 0, :-1] = 0
        return out


class Ragged:
    """Sequences of unlike lengths, laid out so that all that have a t-th word are neighbours."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        longest = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        self.at = np.r_[0, np.cumsum(self.active)]
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        plain = sizes[rank]
        t = np.arange(plain.sum()) - np.repeat(np.cumsum(plain) - plain, plain)
        self.place = self.at[t] + np.repeat(rank, plain)


def forward_backward(e: np.ndarray, shape: Ragged, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the words (in the ragged layout), scaled forward and backward parts. e: exponentials of emissions."""
    a, b = np.empty_like(e), np.empty_like(e)
    at, active = shape.at, shape.active
    for t in range(len(active)):
        x = e[at[t] : at[t + 1]] * (first if t == 0 else a[at[t - 1] : at[t - 1] + active[t]] @ moves)
        a[at[t] : at[t + 1]] = x / x.sum(axis=1, keepdims=True)
    back = moves.T.copy()
    for t in range(len(active) - 1, -1, -1):
        here = b[at[t] : at[t + 1]]
        go = active[t + 1] if t + 1 < len(active) else 0
        here[go:] = 1
        if go:
            x = (b[at[t + 1] : at[t + 2]] * e[at[t + 1] : at[t + 2]]) @ back
            here[:go] = x / x.sum(axis=1, keepdims=True)
    m = a * b
    return m / m.sum(axis=1, keepdims=True), a, b


def train_crf(rows: list[tuple[str, str]], turns: int = 25, rate: float = 0.5, seed: int = 7) -> Crf:
    """Fit by gradient ascent with per-weight rates. Documents' words carry their document's label; stretches of
    5 to 40 words of different documents are spliced by twos and threes, so that transitions are learned from switches."""
    rng = np.random.default_rng(seed)
    labels = sorted({lab for _, lab in rows})
    known = {lab: i for i, lab in enumerate(labels)}
    n_labels = len(labels)
    vocabulary: dict[bytes, int] = {}
    stretches = []
    for text, lab in rows:
        w = [vocabulary.setdefault(x, len(vocabulary)) for x in lower_words(text)]
        i = 0
        while i < len(w):
            n = int(rng.integers(5, 41))
            stretches.append((w[i : i + n], known[lab]))
            i += n
    words = list(vocabulary)
    per_label = [Counter() for _ in labels]
    for w, lab in stretches:
        per_label[lab].update(w)
    total = Counter()
    for c in per_label:
        total.update(c)
    lexicon = {words[w]: k for k, c in enumerate(per_label) for w, n in c.items() if n >= 3 and n >= 0.9 * total[w]}
    model = Crf(labels, np.zeros((BUCKETS, n_labels)), lexicon, np.zeros(n_labels), np.zeros((n_labels, n_labels)), np.full(n_labels, 1 / max(1, n_labels)))
    if n_labels < 2:
        model.moves = np.exp(model.moves)
        return model
    ids, owner = gram_ids(words, SIZES, BUCKETS)
    lettered = np.array([_has_letter(w) for w in words])
    use = lettered[owner]
    ids, owner = ids[use], owner[use]
    in_lexicon = np.array([lexicon.get(w, -1) for w in words])
    order = rng.permutation(len(stretches))
    groups, i = [], 0
    while i < len(order):
        n = int(rng.integers(2, 4))
        groups.append([stretches[k] for k in order[i : i + n]])
        i += n
    sizes = np.array([sum(len(w) for w, _ in g) for g in groups])
    flat = np.concatenate([np.array(w) for g in groups for w, _ in g])
    truth = np.concatenate([np.full(len(w), lab) for g in groups for w, lab in g])
    shape = Ragged(sizes)
    word = np.empty_like(flat)
    gold = np.empty_like(truth)
    word[shape.place], gold[shape.place] = flat, truth
    del stretches, groups, flat, truth
    places = np.arange(len(gold))
    at, active = shape.at, shape.active
    pairs = np.zeros((n_labels, n_labels))
    for t in range(1, len(active)):
        np.add.at(pairs, (gold[at[t - 1] : at[t - 1] + active[t]], gold[at[t] : at[t + 1]]), 1)
    scale = {k: np.full(v.shape, 1e-8) for k, v in (("w", model.weights), ("x", model.lexical), ("m", model.moves))}
    scale["f"] = np.full(n_labels, 1e-8)
    log_moves, log_first = np.zeros_like(model.moves), np.zeros(n_labels)
    starts = np.bincount(gold[: active[0]], minlength=n_labels)

    def climb(key: str, weights: np.ndarray, slope: np.ndarray) -> None:
        scale[key] += slope * slope
        weights += rate * slope / np.sqrt(scale[key])

    for _ in range(turns):
        score = np.stack([np.bincount(owner, model.weights[ids, k], len(words)) for k in range(n_labels)], 1)
        inside = np.flatnonzero(in_lexicon >= 0)
        score[inside, in_lexicon[inside]] += model.lexical[in_lexicon[inside]]
        score[~lettered] = 0
        e = (np.exp(score - score.max(axis=1, keepdims=True)) + 1e-30).astype(np.float32)[word]
        moves = np.exp(log_moves).astype(np.float32)
        m, a, b = forward_backward(e, shape, moves, np.exp(log_first).astype(np.float32))
        climb("f", log_first, (starts - m[: active[0]].sum(axis=0)) / len(gold))
        m[places, gold] -= 1
        slope = -np.stack([np.bincount(word, m[:, k], len(words)) for k in range(n_labels)], 1)
        del m
        expected = np.zeros_like(pairs)
        for t in range(1, len(active)):
            left = a[at[t - 1] : at[t - 1] + active[t]]
            right = e[at[t] : at[t + 1]] * b[at[t] : at[t + 1]]
            norm = ((left @ moves) * right).sum(axis=1, keepdims=True)
            expected += moves * ((left / norm).T @ right)
        n = len(gold)
        grams = np.stack([np.bincount(ids, slope[owner, k], BUCKETS) for k in range(n_labels)], 1)
        climb("w", model.weights, grams / n - 1e-7 * model.weights)
        climb("x", model.lexical, np.array([slope[inside[in_lexicon[inside] == k], k].sum() for k in range(n_labels)]) / n)
        climb("m", log_moves, (pairs - expected) / n)
    model.weights, model.moves = model.weights.astype(np.float32), np.exp(log_moves).astype(np.float32)
    model.first, model.lexical = np.exp(log_first).astype(np.float32), model.lexical.astype(np.float32)
    return model


class Tagger:
    """Texts -> per-word label probabilities under a trained model."""

    def __init__(self, model: Crf):
        self.model = model
        self.words = WordIds(model.emissions)

    def mark(self, texts: list[str | None]):
        """(mean probabilities, mean of the words' greatest, words with letters) of each text, and each text's word probabilities in order."""
        lists = [lower_words(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        n_labels = len(self.model.labels)
        if not sizes.sum():
            return np.zeros((len(texts), n_labels)), np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros((0, n_labels)), sizes
        at = self.words.lookup([w for x in lists for w in x])
        got = self.words.table[at]
        shape = Ragged(sizes)
        score = got[:, :-1]
        e = np.empty_like(score)
        e[shape.place] = np.exp(score - score.max(axis=1, keepdims=True)) + np.float32(1e-30)
        m = forward_backward(e, shape, self.model.moves, self.model.first)[0][shape.place]
        doc = np.repeat(np.arange(len(texts)), sizes)
        lettered = got[:, -1] > 0
        n = np.bincount(doc[lettered], minlength=len(texts))
        mean = np.stack([np.bincount(doc[lettered], m[lettered, k], len(texts)) for k in range(n_labels)], 1) / np.maximum(n, 1)[:, None]
        sure = np.bincount(doc[lettered], m[lettered].max(axis=1), len(texts)) / np.maximum(n, 1)
        return mean, sure, n, m, sizes


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int, floor: int = FLOOR) -> list[tuple[str, str]]:
    """At most `most` different labelled texts with a word: `floor` of each language first, taken in turn, then the least hashes.

    Each language's rows are counted without their texts; then those with hashes under a bound by which about four times
    as many as are wanted pass are written with their texts, and the least of these are taken. The bound is raised where
    too few have passed (rows without a word, and repeated ones, are counted but not taken), so that the rows are exactly
    the least of all, while no task holds more of a language than a few times `most`. Labels are few: the model has a
    weight vector for each.
    """
    spark, most_long = docs.sparkSession, 2**63 - 1
    key, lang = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("sample")), F.col(lang_col).cast("string")
    labelled = docs.where(F.col(lang_col).isNotNull() & (crc_mod(id_col, 4) != 2))
    counts = {r["__lang"]: r["count"] for r in labelled.groupBy(lang.alias("__lang")).count().collect()}
    if not counts or most < 1:
        return []
    usable = labelled.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(key.alias("__key"), lang.alias("__lang"), F.col(text_col).alias("__text"))
    factor = 4
    while True:
        bounds = {k: min(most_long, 2**64 * factor * most // n - 2**63) for k, n in counts.items()}
        small = spark.createDataFrame(list(bounds.items()), "__lang string, __bound long")
        under = usable.join(F.broadcast(small), "__lang").where(F.col("__key") <= F.col("__bound"))
        least = saved(under.groupBy("__key", "__lang").agg(F.first("__text").alias("__text")))
        got = {r["__lang"]: r["count"] for r in least.groupBy("__lang").count().collect()}
        if all(got.get(k, 0) >= most or bounds[k] == most_long for k in counts):
            break
        factor *= 8
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy("__key"))
    ranked = least.select("__key", "__lang").withColumn("__rank", rank).where(F.col("__rank") <= most)
    picked = ranked.orderBy(F.least("__rank", F.lit(floor + 1)), "__key", "__lang").limit(most)
    return [(r["__text"], r["__lang"]) for r in sorted(least.join(F.broadcast(picked), ["__key", "__lang"]).select("__key", "__lang", "__text").collect())]


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 1500, spans: bool = False) -> DataFrame:
    """docs with lang_pred, score, certainty and held_out, and with spans also array<struct<lang, start, end>> of word ranges.

    The model is fitted on a sample of at most train_rows labelled rows whose crc32(id as text) mod 4 is not 2, of
    which each language has FLOOR, or all it has, before any has more; it is small and of fixed size, and broadcast.
    lang_pred is the label with the greatest mean probability over a text's words with letters, score that mean, and
    certainty the mean of each such word's greatest probability, which is high in code-switched text too. Null, empty
    and letterless texts are `und` with score and certainty 0. With no labelled row all are `und`. Repeated rows get equal results; columns with an output's name are replaced.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, id_col, text_col, lang_col, train_rows)
    shared = spark.sparkContext.broadcast(train_crf(rows) if any(lower_words(t) for t, _ in rows) else None)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("certainty", T.DoubleType())]
    if spans:
        one = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        fields.append(T.StructField("spans", T.ArrayType(one)))

    def make():
        model = shared.value
        tagger = Tagger(model) if model else None

        def on_texts(texts):
            if not tagger:
                return [["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), *([[[]] * len(texts)] if spans else [])]
            mean, sure, n, m, sizes = tagger.mark(texts)
            best = mean.argmax(axis=1)
            out = [[model.labels[k] if c else "und" for k, c in zip(best, n, strict=True)], np.where(n > 0, np.minimum(mean.max(axis=1), 1.0), 0.0), np.where(n > 0, np.minimum(sure, 1.0), 0.0)]
            if spans:
                top, all_spans, at = m.argmax(axis=1), [], 0
                for z in sizes.tolist():
                    here = top[at : at + z]
                    cut = np.r_[0, np.flatnonzero(here[1:] != here[:-1]) + 1, z] if z else np.zeros(0, np.int64)
                    all_spans.append([{"lang": model.labels[here[i]], "start": int(i), "end": int(j)} for i, j in zip(cut[:-1], cut[1:], strict=True)])
                    at += z
                out.append(all_spans)
            return out

        return on_texts

    return append_columns(docs, text_col, fields, make, STEP).withColumn("held_out", crc_mod(id_col, 4) == 2)
