"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, saved


def _key(line: Column) -> Column:
    """96 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _worded(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate_lines(df: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): keys of the lines on more than `ratio` of the host's pages and on min_pages of them at least.

    A page counts once for a line. Counts are summed before the shuffle by (host, line), so that a host with most of
    the pages is dealt out by its lines. A host's array is bounded: it has under (mean lines a page) / ratio keys.
    """
    host = F.col(host_col).cast("string").alias("host")
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(text_col), "\n"), _worded), _key))
    counts = df.select(host, F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = df.select(host).groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    often = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("pages") > ratio * F.col("total"))
    return often.select("c.host", "line").groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_site_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """df with boilerplate lines taken out of its texts, and __n_lines and __n_dropped (long) before and after.

    All occurrences of such a line go; lines of blanks only stay and aren't counted. A null text stays null with no
    lines; a null host is a host of its own; repeated rows are pages of their own; an empty table gives no rows;
    other columns are kept, but for those with an output's name. Only hosts with boilerplate have a row in the joined table; Spark broadcasts it while its
    written size is under spark.sql.autoBroadcastJoinThreshold and else joins by shuffle, splitting large hosts.
    """
    host, often, lines, kept = free_names(df, "host", "often", "lines", "kept")
    lists = saved(boilerplate_lines(df, host_col, text_col, ratio, min_pages)).select(F.col("host").alias(host), F.col("lines").alias(often))
    both = df.join(lists, F.col(host_col).cast("string").eqNullSafe(F.col(host)), "left")
    split = F.split(F.col(text_col), "\n")
    left = F.when(F.col(often).isNull(), split).otherwise(F.filter(split, lambda x: ~(_worded(x) & F.array_contains(F.col(often), _key(x)))))
    both = both.withColumn(lines, split).withColumn(kept, left)
    out = both.withColumn("__n_lines", F.coalesce(F.size(F.filter(lines, _worded)), F.lit(0)).cast("long")).withColumn("__n_dropped", F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col("__n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))).drop(host, often, lines, kept)
