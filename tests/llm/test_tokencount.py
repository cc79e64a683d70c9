"""Token counts against the tokenizer's library on whole texts."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import tokencount
from tallyforge.llm.queries import tokenizer

from .conftest import SCHEMA, hard_texts

PATH = tokenizer("byte_bpe_50k.json")
ODD = [
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "aaaaaaaaaaaaaaaa" * 9, "ab" * 40_000, "a" * 50_001, "  \n\n  x   ", "'s 'S it's 'll' we've", "　全角　空白 em", "é" * 5000, "𝒳𝒴 ½²①Ⅷ ١٢٣",
    "".join(chr(97 + (i * i + 7 * i) % 26) for i in range(30_000)), "=" * 300 + "-" * 5000, "\x00\x01\x7f\x80", "x\u0085y z", "1234567890" * 500,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokencount.TokenCounter(PATH)


def in_library(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library_on_hard_and_real_texts(spark, library, hard_docs, real_docs):
    odd = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(ODD)], SCHEMA)
    for docs in (hard_docs, real_docs, odd):
        got = tokencount.count_tokens(docs, PATH).collect()
        assert len(got) == docs.count()
        for r in got:
            n = in_library(library, r["text"])
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 512), r["doc_id"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aAeétT '.\n1<|>", max_size=60), st.sampled_from(ODD[:3])), max_size=6))
def test_counts_of_any_text(texts):
    lib, own = _pair()
    assert own.count(pa.array(texts, pa.string())).tolist() == [in_library(lib, t) for t in texts]


def _pair(held=[]):  # noqa: B006 - made once
    if not held:
        held.extend([Tokenizer.from_file(PATH), tokencount.TokenCounter(PATH)])
    return held


def test_turns_and_sweep_agree(counter, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(list(b"aeinorst "), int(n))) for n in rng.integers(1, 3000, 60)] + [b"aaaa" * 300, b"a", b"", b"zq" * 700]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    got = {}
    for size in (0, 10, 10**9):
        monkeypatch.setattr(tokencount, "SWEEP", size)
        got[size] = counter.merger.survivors(raw, at).tolist()
    assert got[0] == got[10] == got[10**9]
    one_by_one = []
    for t in texts:
        s = counter.merger.of_byte[np.frombuffer(t, np.uint8)].tolist()
        while len(s) > 1:
            ranks = counter.merger.rank(np.array(s[:-1]), np.array(s[1:])).tolist()
            k = int(np.argmin(ranks))
            if ranks[k] == tokencount.NONE:
                break
            s[k : k + 2] = [int(counter.merger.made[ranks[k]])]
        one_by_one.append(len(s))
    assert got[0] == one_by_one


def test_memory_is_forgotten_and_counts_stay(counter, library):
    counter.memory.most = 1000
    texts = [f"alpha{i} beta{i % 7} ünïcode{i % 11}" for i in range(400)]
    for i in range(0, 400, 50):
        assert counter.count(pa.array(texts[i : i + 50])).tolist() == [in_library(library, t) for t in texts[i : i + 50]]
    counter.memory.most = 32 << 20


def test_tokenizers_of_other_kinds_and_untrained_orders_are_refused():
    with pytest.raises(ValueError, match="byte-level BPE"):
        tokencount.TokenCounter(tokenizer("word_bpe_49k.json"))
    chars = [chr(k + 0x100) for k in range(256)]
    a, b, c = chars[:3]
    vocab = {x: k for k, x in enumerate([*chars, a + b, a + b + c])}
    tokencount.RankMerger(vocab, [(a, b), (a + b, c)], chars)
    with pytest.raises(ValueError, match="order of training"):
        tokencount.RankMerger(vocab, [(a + b, c), (a, b)], chars)


def test_count_tokens_of_nothing_and_of_clashing_columns(spark, no_docs):
    assert tokencount.count_tokens(no_docs, PATH).count() == 0
    docs = spark.createDataFrame([(1, "two words", "old", 5)], "doc_id long, text string, n_tokens string, n_bytes int")
    assert tokencount.count_tokens(docs, PATH).first().asDict() == {"doc_id": 1, "text": "two words", "n_bytes": 9, "n_tokens": 2, "over_limit": False}
    assert tokencount.count_tokens(docs, PATH, limit=1, keep_text=False).first().asDict() == {"doc_id": 1, "n_bytes": 9, "n_tokens": 2, "over_limit": True}
    named = spark.createDataFrame([("a b c",)], "n_bytes string")
    with pytest.raises(ValueError, match="output's name"):
        tokencount.count_tokens(named, PATH, text_col="n_bytes")


def test_hard_texts_hold_what_they_should(library):
    assert any(library.token_to_id("<|endoftext|>") in library.encode(t).ids for t in hard_texts() if t)
