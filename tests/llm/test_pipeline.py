"""The pipeline against plain versions of its stages; the trained labels are taken from the operator."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import langid

from .test_exact import brute_hits, crc, plain_ids
from .test_neardup import brute


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    want = [r.asDict() for r in docs.collect()]
    labels = {r["doc_id"]: (r["lang_pred"], r["certainty"]) for r in langid.identify_languages(docs).collect()}
    want = [r for r in want if labels[r["doc_id"]][0] != "und" and labels[r["doc_id"]][1] >= 0.5]

    def check(k, got):
        assert got.columns == columns
        rows = sorted((r.asDict() for r in got.collect()), key=lambda r: r["doc_id"])
        assert rows == sorted(want, key=lambda r: r["doc_id"]), corpus_pipeline.STAGES[k][0]
        return spark.createDataFrame(rows, got.schema)

    at = check(0, corpus_pipeline.STAGES[0][1](spark, docs, sf))

    pages, lines = {}, {}
    worded = lambda x: re.search(r"[^\x20\x09-\x0D]", x)
    for r in want:
        pages[r["source"]] = pages.get(r["source"], 0) + 1
        for x in {x for x in r["text"].split("\n") if worded(x)}:
            lines[r["source"], x] = lines.get((r["source"], x), 0) + 1
    often = {k for k, n in lines.items() if n >= corpus_pipeline.SITE_PAGES and n > corpus_pipeline.SITE_RATIO * pages[k[0]]}
    after = []
    for r in want:
        kept = "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in often)
        if kept != r["text"]:
            if not worded(kept):
                continue
            r = {**r, "text": kept, "n_chars": len(kept)}
        after.append(r)
    want = after
    at = check(1, corpus_pipeline.STAGES[1][1](spark, at, sf))

    first = {i: c for i, _, c in brute([(r["doc_id"], r["text"]) for r in want])}
    want = [r for r in want if first[r["doc_id"]] == r["doc_id"]]
    at = check(2, corpus_pipeline.STAGES[2][1](spark, at, sf))

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = []
    for r in want:
        n, hit, _ = brute_hits(r["text"], items)
        if not (hit and 20 * len(hit) >= n):
            clean.append(r)
    want = clean
    at = check(3, corpus_pipeline.STAGES[3][1](spark, at, sf))

    ids = dict(plain_ids(at, "byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[4][1](spark, at, sf).collect()
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    assert all(p["ids_crc32"] == crc(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]) for p in pieces)


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    assert got.agg(F.count_distinct("doc_id")).first()[0] > 100 and set(got.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_awkward_documents_and_columns(spark, hard_docs, no_docs):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns named like the operators' own."""
    sf = "/root/testdata/sf0.001"
    mine = {c: F.lit(f"my {c}") for c in ("score", "lang_pred", "certainty", "held_out", "n_words", "spans", "items", "contaminated", "__n_lines", "__n_dropped", "host", "id", "component_id", "kept")}
    docs = hard_docs.withColumns(mine)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs.withColumns(mine), sf).count() == 0, name
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"my {c}" for r in rows for c in mine), name
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, sf).count() == 0
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    assert 1 not in kept and 4 not in kept and 10 in kept  # a null and an empty text have no language


def test_code_switched_text_is_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = [r["text"].split() for lang in ("de", "en", "fr") for r in docs.where((F.col("lang") == lang) & (F.col("n_chars") > 1500)).orderBy("doc_id").limit(1).collect()]
    assert len(parts) == 3
    mixed = " ".join(w for p in parts for w in p[:60])
    more = docs.unionByName(spark.createDataFrame([(10**9, mixed, None, "s", len(mixed))], docs.schema))
    assert corpus_pipeline.STAGES[0][1](spark, more, sf).where("doc_id = 1000000000").count() == 1
