"""The operators with production parameters on their whole tables, as queries with the columns of the contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontam, infill, langid, linededup, lm, neardup, packing, quality, rules, sharding, tokencount, tokenfile

#: A line on more than this share of a source's documents, and on as many of them, is boilerplate, at every size. A
#: template often serves one section of a site, so that a hundredth is enough; two pages may share a quotation, three
#: seldom do. Under a hundredth, whole copies of a document begin to pass, and all of them would lose their text.
SITE_RATIO, SITE_PAGES = 0.01, 3


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.ring_shards(_docs(spark, sf_dir), shards=16)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontam.find_contamination(_docs(spark, sf_dir).select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_cascade(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_docs(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.score_quality(_docs(spark, sf_dir).select("doc_id", "text"), labels)
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_docs(spark, sf_dir))


def op7_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.concatenate_and_cut(_docs(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, sf_dir))


def op9_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(_docs(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_site_lines(_docs(spark, sf_dir).select("doc_id", "source", "text"), ratio=SITE_RATIO, min_pages=SITE_PAGES)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count_tokens(_docs(spark, sf_dir).select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(_docs(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    sha = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ring_sharding, op2_decontamination, op3_quality_rules, op4_language_crf, op5_quality_embeddings, op6_context_tree_scores, op7_concat_and_cut, op8_near_duplicates,
        op9_simple8b_files, op10_site_lines, op11_filter_audit, op12_token_counts, op13_fill_in_middle,
    )
}
_WORDED = r"regexp_matches(x, '[^\x20\x09-\x0D]')"

#: The quality rules, the site lines, the filter audit and the cuts in SQL; the other operators are held to plain versions in the tests.
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_WORDED}) AS lines FROM documents),
        g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w) AS p),
        d AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
        r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g JOIN d USING (doc_id, k) CROSS JOIN (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
        c AS (SELECT w.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, regexp_replace(text, '\P{{L}}+', '', 'g') AS letters FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS one FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR word_chars < 2 * one OR word_chars > 16 * one OR 10 * n_symbols > one
            OR 100 * n_dup_lines > 30 * len(string_split(text, chr(10))) OR 2 * length(letters) < length(text) OR 2 * (length(letters) - length(regexp_replace(letters, '\p{{Lu}}+', '', 'g'))) > greatest(length(letters), 1)
            OR 5 * (length(text) - length(replace(text, '!', ''))) > one) AS kept FROM b""",
    "op10_site_lines": rf"""WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
        p AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_filter(ls, lambda x: {_WORDED}))) AS line FROM l) AS u GROUP BY source, line),
        t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
        o AS (SELECT p.source, list(line) AS often FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source WHERE n >= {SITE_PAGES} AND n > CAST({SITE_RATIO} AS DOUBLE) * total GROUP BY p.source),
        k AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT ({_WORDED} AND list_contains(coalesce(often, []), x))) AS kept FROM l LEFT JOIN o ON l.source IS NOT DISTINCT FROM o.source)
        SELECT doc_id, CAST(len(list_filter(ls, lambda x: {_WORDED})) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped, CASE WHEN len(ls) > len(kept) THEN array_to_string(kept, chr(10)) ELSE text END AS text FROM k""",
    "op11_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN coalesce(w.doc_id > lo, false) THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, b)),
        o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS done FROM o CROSS JOIN range(1, 6) AS r(step)),
        t AS (SELECT part, filter_order, step, bit, sum(CASE WHEN (mask & (bit | done)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN (mask & bit) <> 0 AND (mask & done) = 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN (mask & bit) <> 0 AND (mask & done) <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN (mask & bit) <> 0 AND (mask & done) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN (mask & bit) <> 0 AND (mask & done) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
            CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM t""",
    "op13_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units FROM d),
        k AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM k),
        o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END AS output FROM p)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o""",
}
