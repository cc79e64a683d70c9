import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import neardup


def brute(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                up[b] = a
    return sorted((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows)))


def chain(n=40, words=100):
    """Near copies of near copies: neighbours are linked, the ends are not."""
    return [" ".join(f"c{k + 4 * i}" for k in range(words)) for i in range(n)]


@pytest.mark.parametrize("name", ["real", "hard", "chains"])
def test_components(spark, real_docs, hard_docs, name):
    if name == "real":
        docs = real_docs
    elif name == "hard":
        docs = hard_docs
    else:
        rng = np.random.default_rng(1)
        base = [f"b{k}" for k in range(150)]
        near = []
        for _ in range(60):  # a group in which some pairs are linked and some not
            x = list(base)
            for k in rng.choice(150, rng.integers(0, 5), replace=False):
                x[k] = f"z{rng.integers(10**6)}"
            near.append(" ".join(x))
        shared = " ".join(f"s{k}" for k in range(60))  # a passage that unlike documents share
        texts = chain() + near + [shared + " " + " ".join(f"u{i}_{k}" for k in range(40)) for i in range(30)]
        docs = spark.createDataFrame([(int(k), t) for k, t in zip(rng.permutation(len(texts)) + 5, texts, strict=True)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_and_null_ids(spark, no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {None: (None, True), 2: (2, True), 3: (3, True)}


@pytest.mark.parametrize("heavy", [2000, 3])
def test_rows_that_share_an_id(spark, monkeypatch, heavy):
    """Texts under one id are linked by themselves, and repeated rows alike, also where the rows of a key are dealt out."""
    monkeypatch.setattr(neardup, "HEAVY", heavy)
    texts = [" ".join(f"{c}{k}" for k in range(100)) for c in "xyz"]
    near = [t + " tail" for t in texts]
    rows = [(5, texts[0]), (5, texts[1]), (6, near[0]), (7, near[1]), (8, texts[2]), *[(9, near[2])] * 20, (3, near[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 3, False), *[(9, 3, False)] * 20]
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs.withColumn("gone", F.lit(1))).collect()) == [3, 5, 5]
    other = docs.unionByName(spark.createDataFrame([(4, texts[0] + " more"), (10, texts[2])], docs.schema))
    left = sorted((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(other).collect())
    assert left == [(3, near[2]), (4, texts[0] + " more"), (5, texts[1])]  # of the two texts under 5, one is a copy


def test_rows_dealt_to_blocks(spark):
    """20,000 unlike members of one family go to few blocks."""
    members = spark.range(20_000).select("id", F.lit(1).alias("family"), F.lit(100).alias("n"), F.col("id").alias("component"))
    assert neardup.dealt_blocks(members, "family").count() <= 3 * 20_000


def test_blocks_of_every_size_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "HEAVY", 5)
    texts = chain(30) + [" ".join([f"s{k}" for k in range(90)] + [f"u{i}_{k}" for k in range(35)]) for i in range(40)]
    docs = spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect())
    assert got == brute([(k + 1, t) for k, t in enumerate(texts)])


def test_estimates_follow_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 800, dtype=np.uint64)
    for keep in (0, 200, 400, 700):
        b = np.r_[a[:keep], rng.integers(0, 2**63, 800 - keep, dtype=np.uint64)]
        sig = neardup.low_bits(np.stack([neardup.minima(a), neardup.minima(b)])).view(np.uint64)
        differ = np.zeros(2, np.uint64)
        for j in range(neardup.BITS):
            differ |= sig[0, 2 * j : 2 * j + 2] ^ sig[1, 2 * j : 2 * j + 2]
        r = 1 - np.bitwise_count(differ).sum() / 128
        assert abs((r - 1 / 16) / (15 / 16) - keep / (1600 - keep)) < 0.2
