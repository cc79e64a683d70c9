"""Fill-in-middle cuts against pattern matching on whole texts."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import infill

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def units_of(text, unit="lines"):
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    out, now = [], ""
    for i, c in enumerate(text):
        now += c
        ends_word = c not in " \t\n\x0b\x0c\r" and (i + 1 == len(text) or text[i + 1] in " \t\n\x0b\x0c\r")
        stop = ends_word and c in ".!?" and text[i + 1 : i + 2] != "\n"
        if ends_word if unit == "words" else c == "\n" or stop:
            out.append(now)
            now = ""
    return out + [now] * (now != "")


def plain(doc_id, text, unit="lines", rate=100, spm=50, seed=7):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = units_of(text, unit)
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(docs, **options):
    out = infill.fill_in_middle(docs, **options).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    names = {"unit": "unit", "rate": "rate", "spm_rate": "spm", "seed": "seed"}
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], **{names[k]: v for k, v in options.items()}), r["doc_id"]
        assert r["restored"] == (r["text"] or "")
    return out


@pytest.mark.parametrize("unit", ["lines", "sentences", "words"])
def test_cuts_of_hard_and_real_texts(spark, hard_docs, real_docs, unit):
    rows = ["\n", "\n\n\n", "a\n", "a\nb", "\nb\n", "é\nü\n漢字", "has <P> mark\nand more\n", "near <P\n> marks <S\n<\n<M\n", "One. Two!  Three?\nFour...\n. ! ?", "end." * 3, "漢。 字. é! ", " \n", None, "", "🙂\n" * 500, "x" * 300_000 + "\n" + "y" * 5]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)] + [(None, "no\nid\n"), (5, "a\nb"), (5, "a\nb")], SCHEMA)
    for d in (docs, hard_docs, real_docs):
        assert len(check(d, unit=unit)) == d.count()


def test_rates_and_seeds(real_docs):
    forms = {r["form"] for r in check(real_docs, rate=40, spm_rate=20, seed=11)}
    assert forms == {"plain", "psm", "spm"}
    assert {r["form"] for r in check(real_docs, rate=0)} == {"plain"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é漢🙂\n. !", max_size=30), min_size=1, max_size=8), st.integers(0, 2**32 - 1))
def test_every_cut_of_any_text(texts, seed):
    encoded = [t.encode() for t in texts]
    raw, at = np.frombuffer(b"".join(encoded), np.uint8), np.r_[0, np.cumsum([len(t) for t in encoded])]
    for unit in infill.UNITS:
        b = infill.Boundaries(raw, at, unit)
        units = [units_of(t, unit) for t in texts]
        assert b.n.tolist() == [len(u) for u in units]
        k = np.random.default_rng(seed).integers(0, b.n + 1)
        cut = b.cut(k)
        assert (cut - at[:-1]).tolist() == [len("".join(u[:x]).encode()) for u, x in zip(units, k.tolist(), strict=True)]
        assert b.characters(at[:-1], cut).tolist() == [len("".join(u[:x])) for u, x in zip(units, k.tolist(), strict=True)]


def test_other_columns_stay_and_clashing_ones_go(spark, no_docs):
    assert infill.fill_in_middle(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "a\nb\n", 3, "x", 9)], "doc_id long, text string, n int, output string, h1 int")
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert (out.first()["n"], out.first()["h1"]) == (2, 9)
    assert "text" not in infill.fill_in_middle(docs, keep_text=False).columns
    with pytest.raises(ValueError, match="unit"):
        infill.fill_in_middle(docs, unit="pages")
    with pytest.raises(ValueError, match="output's name"):
        infill.fill_in_middle(docs, text_col="output")
