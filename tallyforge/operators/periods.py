"""Period datasets: which periods a load replaces, inspection, approval and the replacement itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.dates import normalize_period
from tallyforge.functions.numbers import parse_number_auto
from tallyforge.session import written
from tallyforge.sources.revisions import Revision, Revisions, replaced


def union_files_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all files, matched by column name; a column that a file lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_periods_per_file(df: DataFrame, file: str, period: str) -> DataFrame:
    return df.select(F.col(file).alias("file"), normalize_period(F.col(period)).alias("period")).where("period IS NOT NULL").distinct()


def target_period_closure(now: DataFrame, history: DataFrame, changed: DataFrame) -> DataFrame:
    """Periods to rebuild: those of the changed files now and before, closed over files that share a period.

    now and history are (file, period), changed (file). Each turn adds the periods of the files of the periods so
    far; the set only grows, so it ends. The set is small against the data and is cut off from its lineage each turn.
    """
    pairs = written(now.unionByName(history).distinct())
    periods = pairs.join(changed, "file", "left_semi").select("period").distinct()
    n = periods.count()
    while True:
        files = pairs.join(periods, "period", "left_semi").select("file").distinct()
        grown = pairs.join(files, "file", "left_semi").select("period").distinct()
        rows = grown.collect()  # periods are months: few, whatever the data
        if len(rows) == n:
            return df_of(now.sparkSession, rows)
        n, periods = len(rows), df_of(now.sparkSession, rows)


def df_of(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(r[0],) for r in rows], "period string")


def half_period_guard(now: DataFrame, history: DataFrame, targets: DataFrame) -> DataFrame:
    """(period, missing files): target periods that two files or more fed before, of which some aren't there now."""
    before = history.join(targets, "period", "left_semi").distinct()
    several = before.groupBy("period").agg(F.count(F.lit(1)).alias("files")).where("files >= 2").select("period")
    gone = before.join(several, "period", "left_semi").join(now.select("file", "period").distinct(), ["file", "period"], "left_anti")
    return gone.groupBy("period").agg(F.count(F.lit(1)).alias("missing"))


def replace_rows(current: DataFrame, incoming: DataFrame, period: str = "period", targets: DataFrame | None = None) -> DataFrame:
    """The dataset after a load: rows of the target periods and of the incoming ones are the incoming rows, which may be
    none; other periods are untouched."""
    gone = incoming.select(period)
    if targets is not None:
        gone = gone.unionByName(targets.select(period))
    return current.join(gone.distinct(), period, "left_anti").unionByName(incoming, allowMissingColumns=True)


def replace_periods(store: Revisions, incoming: DataFrame, targets: Sequence[str] = (), period: str = "period", details: Mapping[str, object] | None = None) -> Revision:
    """A revision of the store's rows in which the target periods and the incoming ones hold the incoming rows and no others.

    A target period without incoming rows is gone afterwards. Rows without a period keep a partition of their own.
    incoming may read from the store. Fails if the store changes meanwhile.
    """
    base = store.current()
    part = replaced(base.parts.get("rows"), store.write("rows", incoming, [period]), [f"{period}={t}" for t in targets])
    return store.commit(base, {"rows": part}, details)


def new_files(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files whose content hash hasn't been loaded: a rerun has none."""
    return files.join(history.select("hash").distinct(), "hash", "left_anti")


def numeric(column: str, fmt: str = "auto") -> Column:
    return parse_number_auto(F.col(column), fmt)


def summary_metrics(df: DataFrame, period: str, columns: Sequence[str], fmt: str = "auto") -> DataFrame:
    """One row: rows, first, last and number of periods, and the total of each numeric column."""
    p = normalize_period(F.col(period))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(p).alias("first_period"), F.max(p).alias("last_period"), F.count_distinct(p).alias("periods"), *[F.coalesce(F.sum(numeric(c, fmt)), F.lit(0)).alias(f"total_{c}") for c in columns])


def period_metrics(df: DataFrame, period: str, columns: Sequence[str], fmt: str = "auto") -> DataFrame:
    return df.groupBy(normalize_period(F.col(period)).alias("period")).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(numeric(c, fmt)), F.lit(0)).alias(f"total_{c}") for c in columns])


def duplicate_key_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: groups of equal keys with several rows, and the rows too many."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def sampled_key_uniqueness(df: DataFrame, period: str, keys: Sequence[str], sample_rows: int | None = 1000, order: Sequence[str] = ()) -> DataFrame:
    """One row: groups of equal keys (period and keys, trimmed, nulls as blanks) with several rows, and the rows looked at.

    A quick look at the first rows before keys are settled on, or with None at all rows. Rows without a period are
    looked at and belong to no group. Keys that df lacks are passed over; without the period or any key, nothing is looked at.
    """
    found = [k for k in keys if k in df.columns and k != period]
    if period not in df.columns or not found:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("groups"), F.lit(0).cast("long").alias("rows"))
    head = df.orderBy(*order) if order else df
    head = head if sample_rows is None else head.limit(sample_rows)
    cells = head.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"k{i}") for i, c in enumerate([period, *found])])
    each = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count_if((F.col("n") > 1) & (F.col("k0") != "")).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def inspect_dataset(df: DataFrame, period: str, keys: Sequence[str], columns: Sequence[str], duplicates: str = "error", fmt: str = "auto") -> DataFrame:
    """One row of counts of faults, and is_valid. One scan; the duplicates are a second aggregate of its keys."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    missing_number = lambda c: blank(c) | (F.trim(F.col(c).cast("string")) == "-")
    p = normalize_period(F.col(period))
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank(period)).alias("blank_periods"),
        F.count_if(~blank(period) & p.isNull()).alias("bad_periods"),
        *[F.count_if(blank(k)).alias(f"blank_{k}") for k in keys],
        *[F.count_if(~missing_number(c) & numeric(c, fmt).isNull()).alias(f"bad_{c}") for c in columns],
        *[F.count(numeric(c, fmt)).alias(f"__some_{c}") for c in columns],
    )
    dup = duplicate_key_groups(df.select(p.alias("__period"), *keys), ["__period", *keys])
    out = counts.crossJoin(dup.select(F.col("groups").alias("duplicate_groups")))
    wrong = (F.col("rows") == 0) | (F.col("blank_periods") > 0) | (F.col("bad_periods") > 0)
    for k in keys:
        wrong = wrong | (F.col(f"blank_{k}") > 0)
    for c in columns:
        wrong = wrong | (F.col(f"bad_{c}") > 0) | (F.col(f"__some_{c}") == 0)
    if duplicates == "error":
        wrong = wrong | (F.col("duplicate_groups") > 0)
    return out.withColumn("is_valid", ~wrong).drop(*[f"__some_{c}" for c in columns])


def inspection_delta(before: DataFrame, after: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """Rows and totals of each period before and after; null where a period is new or gone."""
    a, b = period_metrics(before, period, columns), period_metrics(after, period, columns)
    names = ["rows", *[f"total_{c}" for c in columns]]
    return a.select("period", *[F.col(n).alias(f"before_{n}") for n in names]).join(b.select("period", *[F.col(n).alias(f"after_{n}") for n in names]), "period", "full_outer")


def approval_gate(current: DataFrame, snapshot: DataFrame, columns: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """(approved): the one-row controls still equal those of the inspection; totals within the tolerance."""
    exact = [c for c in ("rows", "first_period", "last_period", "fingerprint") if c in current.columns and c in snapshot.columns]
    both = current.select(*[F.col(c).alias(f"n_{c}") for c in current.columns]).crossJoin(snapshot.select(*[F.col(c).alias(f"s_{c}") for c in snapshot.columns]))
    ok = F.lit(True)
    for c in exact:
        ok = ok & F.col(f"n_{c}").eqNullSafe(F.col(f"s_{c}"))
    for c in columns:
        ok = ok & (F.abs(F.col(f"n_total_{c}") - F.col(f"s_total_{c}")) <= tolerance)
    return both.select(F.coalesce(ok, F.lit(False)).alias("approved"))


def load_metrics(df: DataFrame, period: str, columns: Sequence[str], fmt: str = "auto") -> DataFrame:
    """(period, rows, total_<column>..., h1, h2) of each period, from one scan; such rows of unlike periods add up."""
    totals = [F.coalesce(F.sum(numeric(c, fmt)), F.lit(0)).cast("decimal(38,6)").alias(f"total_{c}") for c in columns]
    return df.groupBy(F.col(period).alias("period")).agg(F.count(F.lit(1)).alias("rows"), *totals, *fingerprint_sums([c for c in df.columns if c != period]))


def snapshot_of_metrics(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of a dataset's controls: rows, periods, totals, and a fingerprint of which rows are in which period."""
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), "period", "rows", "h1", "h2").cast("decimal(38,0)"))
    totals = [F.coalesce(F.sum(f"total_{c}"), F.lit(0)).alias(f"total_{c}") for c in columns]
    both = F.coalesce(F.concat_ws("/", one(1), one(2)), F.lit(""))
    return metrics.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("periods"), *totals, both.alias("fingerprint"))


def fingerprint_sums(columns: Sequence[str]) -> list[Column]:
    """h1 and h2: two 64-bit sums of independent row hashes: equal rows add up, which an exclusive or would cancel."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(columns)]
    return [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]


def content_fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rows, h1, h2): a hash of the rows as a multiset, whatever their order and partitions."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *fingerprint_sums([c for c in df.columns if c not in by]))
