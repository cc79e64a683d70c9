"""Results to CSV and Parquet; versioned snapshots, bundles and candidates, each there only once it is whole."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.periods import content_fingerprint

from .revisions import Part, Revision, Revisions, StaleRevision


def write_result_csv(df: DataFrame, path: str, polish: bool = False) -> None:
    """UTF-8 with a header; Polish mode has semicolons and decimal commas."""
    out = df
    if polish:
        out = df.select(*[(F.translate(F.col(c).cast("string"), ".", ",") if t in ("double", "float") or t.startswith("decimal") else F.col(c)).alias(c) for c, t in df.dtypes])
    out.write.mode("overwrite").option("header", True).option("sep", ";" if polish else ",").option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def publish_versioned_snapshot(df: DataFrame, target: str, period: str, approved: bool, seen: int | None = None) -> dict:
    """Publish the approved rows as the next immutable version, sorted by period. A failure leaves the last version current.

    With `seen`, the version that the publisher has compared with (0 for none), a version published since is refused;
    no version is ever overwritten, as only one publisher can take a number.
    """
    if not approved:
        raise PermissionError("the snapshot isn't approved")
    store = Revisions(df.sparkSession, target)
    done = publish_next(df.sparkSession, target, df.repartitionByRange(F.col(period)).sortWithinPartitions(period), store.current().number if seen is None else seen, period=period)
    path = next(iter(done.parts["data"].folders.values()))
    return {"version": done.number, "path": path, "rows": done.details["rows"], "details": done.details}


def publish_next(spark: SparkSession, target: str, df: DataFrame, seen: int, details: Mapping[str, object] | None = None, period: str | None = None) -> Revision:
    """df as version seen + 1. Refused if the target has another version by now, or if its data isn't what was published."""
    store = Revisions(spark, target)
    last = store.current()
    if last.number != seen:
        raise StaleRevision(f"the target has version {last.number}, the publisher has seen {seen}")
    if last.number:
        f = content_fingerprint(store.read("data", last)).first()
        if [f["rows"], str(f["h1"]), str(f["h2"])] != [last.details[k] for k in ("rows", "h1", "h2")]:
            raise PermissionError(f"version {last.number} isn't as it was published")
    part = store.write("data", df)
    written = store.read_part("data", part)
    f = content_fingerprint(written).first()
    facts = {"rows": f["rows"], "h1": str(f["h1"]), "h2": str(f["h2"]), "columns": written.columns}
    if period:
        ends = written.agg(F.min(period), F.max(period)).first()
        facts |= {"first_period": ends[0], "last_period": ends[1]}
    return store.commit(last, {"data": part}, {**(details or {}), **facts})


def export_bundle(tables: Mapping[str, DataFrame], target: str, made: Mapping[str, Part] | None = None) -> dict:
    """All tables of one run as one version, which is there once every one of them is written. Tables that the run has
    written to the target itself are given as what was made."""
    store = Revisions(next(iter(tables.values())).sparkSession, target)
    last = store.current()
    parts = {**(made or {}), **{name: store.write(name, df) for name, df in tables.items()}}
    counts = {name: store.read_part(name, part).count() for name, part in parts.items()}
    dropped = {name: Part(p.schema, {}) for name, p in last.parts.items() if name not in parts}
    done = store.commit(last, {**dropped, **parts}, {"tables": counts})
    return {"version": done.number, "tables": counts, "paths": {name: p.folders[""] for name, p in parts.items()}}


def read_candidate(spark: SparkSession, target: str, name: str) -> dict:
    """A candidate's manifest and its hash; raises if the data isn't what the manifest says."""
    text = "".join(r["value"] for r in spark.read.text(f"{target}/candidate={name}/manifest").collect())  # one line
    manifest = json.loads(text)
    f = content_fingerprint(spark.read.parquet(manifest["path"])).first()
    if [f["rows"], str(f["h1"]), str(f["h2"])] != [manifest[k] for k in ("rows", "h1", "h2")]:
        raise ValueError(f"candidate {name} isn't as it was exported")
    return manifest | {"sha256": sha256(text.encode()).hexdigest()}


def export_candidate(df: DataFrame, target: str, name: str, meta: Mapping[str, object] | None = None) -> dict:
    """An immutable extract and its manifest, with the multiset hash of its rows."""
    path = f"{target}/candidate={name}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/data")
    f = content_fingerprint(df.sparkSession.read.parquet(f"{path}/data")).first()
    manifest = {**(meta or {}), "rows": f["rows"], "h1": str(f["h1"]), "h2": str(f["h2"]), "path": f"{path}/data"}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")
    return manifest
