"""A corpus pipeline in five stages; each result is written as Parquet and read as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontam, langid, linededup, neardup, packing
from tallyforge.llm.common import saved
from tallyforge.llm.queries import SITE_PAGES, SITE_RATIO, tokenizer


#: Documents of which the words' labels are less certain than this, on the mean, are in no language.
CERTAIN = 0.5


def _aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the used ones under names that no operator has, and the columns as they were."""
    names = {c: c if c in used else f"__aside_{k}" for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(n).alias(c) for c, n in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those with no letter, and those whose words have no certain labels.

    Text that changes between languages stays. Null and empty texts go, as they have no letter; repeated rows and ties
    are judged alike; an empty table stays empty; other columns are kept whatever their names.
    """
    held, columns = _aside(docs, "doc_id", "text", "lang")
    out = langid.identify_languages(held)
    return out.where((F.col("lang_pred") != "und") & (F.col("certainty") >= CERTAIN)).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sites' boilerplate lines out of the texts; a document of nothing else goes. n_chars follows the text.

    A null or empty text stays as it is; a null source is one of its own; repeated rows are pages each; an empty table
    stays empty; other columns are kept whatever their names.
    """
    held, columns = _aside(docs, "text", "source", "n_chars")
    out = linededup.drop_site_lines(held, ratio=SITE_RATIO, min_pages=SITE_PAGES)
    changed = F.col("__n_dropped") > 0
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~changed | left)
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Null, empty and blank texts and rows with a null id stay; equal rows stay together; an empty table stays empty;
    all columns are kept.
    """
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth of the words or more.

    Null and empty texts stay; repeated rows are judged alike; an empty table stays empty, and an empty benchmark
    drops nothing; other columns are kept whatever their names.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held, columns = _aside(docs, "text")
    return decontam.find_contamination(held, benchmark).where(~F.col("contaminated")).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, one row per piece.

    A null or empty text is a document of the end id only; repeated rows and null ids are packed each; an empty table
    gives no rows; columns other than doc_id and text aren't read.
    """
    return packing.concatenate_and_cut(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("packing", pack)]

#: The trained labels, the tokenizer and the reachability of links have no SQL form; tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over documents, each stage's rows written to the shared folder; nulls, empty and repeated rows as the stages say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
