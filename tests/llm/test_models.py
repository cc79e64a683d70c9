import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import langid, lm, quality
from tallyforge.llm.common import lower_words


def crc_mod(i, m):
    return zlib.crc32(str(i).encode()) % m


class PlainTree:
    """Context-tree weighting by the recursive definition: one binary tree for each place in a byte's bits."""

    def __init__(self, texts, depth):
        self.depth, self.seen, self.children = depth, {}, {}
        for t in texts:
            for context, byte in self.places(t):
                for k in range(8):
                    t_ = (1 << k) | (byte >> (8 - k))
                    for d in range(depth + 1):
                        self.seen.setdefault((context[:d], t_), [0, 0])[(byte >> (7 - k)) & 1] += 1
                        if d:
                            self.children.setdefault((context[: d - 1], t_), set()).add(context[:d])
        self.weights = {}

    def places(self, text):
        """(bytes before, the nearest first; byte), with an end."""
        raw = b"\xfe" * self.depth + lm._lower(text) + b"\xff"
        return [(tuple(raw[i - self.depth : i][::-1]), raw[i]) for i in range(self.depth, len(raw))]

    @staticmethod
    def kt(a, b):
        out = 0.0
        for k in range(a):
            out += math.log((k + 0.5) / (k + 1))
        for k in range(b):
            out += math.log((k + 0.5) / (a + k + 1))
        return out

    def weight(self, context, t):
        if (context, t) not in self.weights:
            own = self.kt(*self.seen[context, t])
            below = sum(self.weight(c, t) for c in self.children.get((context, t), ()))
            top = max(own, below)
            w = own if len(context) == self.depth else top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
            self.weights[context, t] = (w, own, below)
        return self.weights[context, t][0]

    def one(self, context, t):
        p, left = 0.0, 1.0
        for d in range(self.depth + 1):
            if (context[:d], t) not in self.seen:
                break
            self.weight(context[:d], t)
            _, own, below = self.weights[context[:d], t]
            share = 1.0 if d == self.depth else 1 / (1 + math.exp(min(700, below - own)))
            a, b = self.seen[context[:d], t]
            p, left = p + left * share * (b + 0.5) / (a + b + 1), left * (1 - share)
        return p + left * 0.5

    def score(self, text):
        out = 0.0
        for context, byte in self.places(text):
            for k in range(8):
                one = self.one(context, (1 << k) | (byte >> (8 - k)))
                out += math.log10(one if (byte >> (7 - k)) & 1 else 1 - one)
        return out


@pytest.mark.parametrize(("depth", "frequent"), [(0, 0.01), (1, 0.01), (2, 1e-9), (3, 0.01), (5, 2.0)])
def test_scores_equal_the_plain_tree(spark, hard_docs, depth, frequent):
    """At any depth, with all, some or no byte sequences broadcast; NULs, rare contexts and unseen bytes included."""
    docs = hard_docs.where("length(text) < 2000 OR text IS NULL").unionByName(spark.createDataFrame([(5000, "nul \0 byte", None, None, 1), (5001, "nul \x01 byte", None, None, 1), (5002, "zzz unseen ~~", None, None, 1), (None, "no id", None, None, 1)], hard_docs.schema))
    got = [(r["text"], r["score"]) for r in lm.score_texts(docs, depth=depth, frequent=frequent).join(docs.distinct(), "doc_id").collect()]
    tree = PlainTree([r["text"] for r in docs.collect() if r["doc_id"] is None or crc_mod(r["doc_id"], 5) != 1], depth)
    assert len(got) > 20
    for text, score in got:
        assert score == pytest.approx(tree.score(text), rel=1e-4), text


def test_score_of_an_empty_table_and_of_clashing_columns(spark, no_docs):
    assert lm.score_texts(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "a text", 7.0, "x")], "doc_id long, text string, score double, __row string")
    r = lm.score_texts(docs, learn=F.lit(False)).first()
    assert r["n_tokens"] == 3 and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(7 * 8 * math.log10(0.5))


def test_base_is_exact(spark, hard_docs):
    docs = hard_docs.drop_duplicates()
    rows = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = {}
    for i, t in texts.items():
        if crc_mod(i, 5) != 1:
            for w in [*lower_words(t), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for i, t in texts.items():
        w = [*lower_words(t), b"\n"]
        base = sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (len(counts) + 1))) for x in w)
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(x in counts for x in w), total, crc_mod(i, 5) == 1)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_language_model_beats_unigrams_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")  # needs a few million words
    r = lm.score_texts(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg("bits_per_byte").alias("q")).first()
    assert r["s"] > r["b"] and r["q"] < 3


def test_languages_on_held_out_text(spark, hard_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_languages(docs).where("held_out").select((F.col("lang_pred") == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert got > 0.97
    hard = {r["doc_id"]: r for r in langid.identify_languages(hard_docs, spans=True).collect()}
    assert hard[1]["lang_pred"] == "und" and hard[1]["score"] == 0 and hard[4]["lang_pred"] == "und" and hard[10]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in hard.values())
    assert langid.identify_languages(no_docs).count() == 0


def test_training_sample_does_not_shrink_with_the_table(spark):
    """Few labels in a large table are all used, and a rare language is in the sample; ids may be null and rows repeated."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 400 == 0, "de").alias("lang"))
    want = {(f"text {i}", "de") for i in range(0, 40_000, 400) if crc_mod(i, 4) != 2}
    assert len(want) > 50 and set(langid.training_rows(docs, "doc_id", "text", "lang", 1500)) == want
    full = docs.withColumn("lang", F.when(F.col("doc_id") < 8, "rare").otherwise("de"))
    rare = {f"text {i}" for i in range(8) if crc_mod(i, 4) != 2}
    got = langid.training_rows(full, "doc_id", "text", "lang", 1500)
    assert len(got) == len(set(got)) == 1500 and {t for t, lang in got if lang == "rare"} == rare
    odd = full.withColumn("doc_id", F.lit(None).cast("long")).unionAll(full.limit(1).withColumn("text", F.lit(" ")))
    assert len(langid.training_rows(odd.unionAll(odd), "doc_id", "text", "lang", 1500)) == 1500


def test_words_of_code_switched_text_are_labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    by = {}
    for r in docs:
        if r["n_chars"] > 600:
            by.setdefault(r["lang"], []).append(r["text"])
    model = langid.train_crf([(t, lang) for lang, ts in by.items() for t in ts[:40]])
    tagger = langid.Tagger(model)
    a, b = by["de"][50].split()[:40], by["fr"][50].split()[:40]
    _, _, _, m, sizes = tagger.mark([" ".join(a + b)])
    top = [model.labels[k] for k in m.argmax(axis=1)]
    assert sizes[0] == 80 and top[:40].count("de") > 34 and top[40:].count("fr") > 34


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    moves, first, e = rng.random((3, 3)) + 0.1, np.full(3, 1 / 3), rng.random((5, 3)) + 0.1
    shape = langid.Ragged(np.array([2, 3]))
    inside = np.empty_like(e)
    inside[shape.place] = e
    m = langid.forward_backward(inside, shape, moves, first)[0][shape.place]
    want = np.zeros((3, 3))
    for x in np.ndindex(3, 3, 3):
        p = e[2, x[0]] * moves[x[0], x[1]] * e[3, x[1]] * moves[x[1], x[2]] * e[4, x[2]]
        for t in range(3):
            want[t, x[t]] += p
    assert np.allclose(m[2:], want / want.sum(axis=1, keepdims=True))


def test_quality_on_held_out_labels(spark, hard_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score_quality(docs, labels).where("held_out").join(labels, "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
    rows = quality.score_quality(hard_docs, labels.limit(0)).collect()
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    assert quality.score_quality(no_docs, labels).count() == 0


def test_quality_scores_equal_a_plain_mean(spark, hard_docs):
    """Of the vectors of all features of a text, under the trained weights; columns named like the outputs are replaced."""
    labels = hard_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    model = quality.train(quality.training_rows(hard_docs, labels, "doc_id", "text", "quality", 3000))
    got = quality.score_quality(hard_docs.withColumns({"score": F.lit("mine"), "predicted": F.lit("x"), "held_out": F.lit(1.5)}), labels).collect()
    assert len(got) == hard_docs.count()
    for r in got:
        rows = []
        for w in quality.words_of(r["text"]):
            t = "\x02" + w.decode() + "\x03"
            ids, _ = quality.gram_ids([w], quality.SIZES, quality.BUCKETS, whole=True)
            assert len(ids) == sum(max(0, len(t) - n + 1) for n in quality.SIZES) + 1
            rows += [model.vectors[k].astype(float) for k in ids]
        z = (np.mean(rows, axis=0) @ model.output if rows else np.zeros(2)) + model.bias
        p = np.exp(z - z.max())
        assert r["score"] == pytest.approx(p[1] / p.sum(), abs=1e-5)
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (crc_mod(r["doc_id"], 3) == 1)


def test_shared_ids_do_not_fill_the_driver(spark):
    """A labelled id that many documents share gives one text."""
    one = next(i for i in range(9) if crc_mod(i, 3) != 1)
    docs = spark.range(5000).select(F.lit(one).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(one, 1)], "doc_id long, quality int")
    assert len(quality.training_rows(docs, labels, "doc_id", "text", "quality", 3000)) == 1


def test_language_of_documents_is_the_greatest_mean_of_marginals(spark, hard_docs):
    """By plain recursions over each text's words under the model of the same rows; clashing columns are replaced."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train_crf(langid.training_rows(docs, "doc_id", "text", "lang", 1500))
    some = hard_docs.where("length(text) < 2000 OR text IS NULL").unionByName(docs.where("n_chars < 1500").limit(40))
    some = some.withColumns({"score": F.lit("mine"), "certainty": F.lit("mine"), "lang_pred": F.lit(7), "train": F.lit(1)})
    every = docs.withColumns({"score": F.lit("mine"), "certainty": F.lit("mine"), "lang_pred": F.lit(7), "train": F.lit(0)}).unionByName(some.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    got = [r for r in langid.identify_languages(every).collect() if r["train"] == 1]
    assert len(got) == some.count()
    for r in got:
        words = lower_words(r["text"])
        e = model.emissions(words).astype(float) if words else np.zeros((0, len(model.labels) + 1))
        lettered, x = e[:, -1] > 0, np.exp(e[:, :-1])
        if not lettered.any():
            assert (r["lang_pred"], r["score"], r["certainty"]) == ("und", 0, 0)
            continue
        ahead, behind = [model.first * x[0]], [np.ones(len(model.labels))]
        for t in range(1, len(x)):
            ahead.append(ahead[-1] / ahead[-1].sum() @ model.moves * x[t])
            behind.append(model.moves @ (x[-t] * behind[-1] / behind[-1].sum()))
        m = np.array(ahead) * np.array(behind[::-1])
        m = (m / m.sum(axis=1, keepdims=True))[lettered]
        mean = m.mean(axis=0)
        assert mean[model.labels.index(r["lang_pred"])] == pytest.approx(mean.max(), abs=1e-4)
        assert r["score"] == pytest.approx(mean.max(), abs=1e-3) and r["certainty"] == pytest.approx(m.max(axis=1).mean(), abs=1e-3)


def test_signs_that_are_no_letters_have_no_language(spark, real_docs):
    signs = ["½ ² ①", "Ⅷ", "٣ 4", "— … €", "½ ² ① word", "ª", "漢"]
    docs = real_docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(signs)], "doc_id long, text string, lang string"))
    got = {r["doc_id"] - 10**6: r["lang_pred"] for r in langid.identify_languages(docs).where(f"doc_id >= {10**6}").collect()}
    assert [got[k] == "und" for k in range(len(signs))] == [True, True, True, True, False, False, False]


def test_training_rows_are_the_least_hashes_of_each_language(spark):
    """Against a ranking of all rows: repeated rows, blank texts and a rare language among them."""
    rows = [(k, f"word{k % 700} text", "hot") for k in range(3000)] + [(k, " ", "hot") for k in range(3000, 6000)] + [(7, "copy", "hot")] * 500 + [(k, f"rare {k}", "rare") for k in range(9000, 9020)] + [(k, " ", "none") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (3, 60, 5000):
        got = langid.training_rows(docs, "doc_id", "text", "lang", most, 10)
        keys = docs.where("trim(text) <> ''").select(F.xxhash64("doc_id", "text", F.lit("sample")).alias("k"), "text", "lang", "doc_id").distinct().collect()
        keys = sorted((r["k"], r["lang"], r["text"]) for r in keys if crc_mod(r["doc_id"], 4) != 2)
        place, ranked = {}, []
        for k, lang, text in keys:
            place[lang] = place.get(lang, 0) + 1
            ranked.append((min(place[lang], 11), k, lang, text))
        want = sorted((k, lang, text) for _, k, lang, text in sorted(ranked)[:most])
        assert got == [(text, lang) for _, lang, text in want]
