"""Tables that change as a whole: immutable data folders, and a log entry per revision that names the folders in force.

A load writes its data where no reader looks and then creates the log's next entry, which fails if someone else has
created it first. Readers take one entry and read what it names, so that they see a revision whole or not at all; what
a load left behind when it died is named by no entry. Replaced partitions stay in the folders of earlier revisions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import written_dealt

from .files import create_once, names, read_text

_WRITE = "write"


class StaleRevision(RuntimeError):
    """The table has a newer revision than the one that a change builds on."""


@dataclass(frozen=True)
class Part:
    """One table at one revision: its schema, and the folder of each partition ("" for a table without partitions)."""

    schema: str
    folders: Mapping[str, str]


@dataclass(frozen=True)
class Revision:
    number: int
    parts: Mapping[str, Part] = field(default_factory=dict)
    details: Mapping[str, object] = field(default_factory=dict)


class Revisions:
    """The tables of a folder under one log. An entry has about a hundred bytes a partition and is held by the driver,
    as Spark's own listing of the partitions is."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.target}/log") if n.endswith(".json") and not n.startswith(("_", "."))]

    def revision(self, number: int) -> Revision:
        raw = json.loads(read_text(self.spark, f"{self.target}/log/{number:08d}.json"))
        return Revision(number, {k: Part(**v) for k, v in raw["parts"].items()}, raw["details"])

    def current(self) -> Revision:
        """The newest revision; number 0 without tables where there is none."""
        numbers = self.numbers()
        return self.revision(max(numbers)) if numbers else Revision(0)

    def write(self, name: str, df: DataFrame, by: Sequence[str] = ()) -> Part:
        """Data folders of a table's (new) rows, by partition; no revision names them yet.

        The rows of a partition are gathered before, into one file for a few million of them.
        """
        root = self._new_folder(name)
        rows = df.select(*[c for c in df.columns if c not in by], *by)
        writer = (rows.hint("rebalance", *[F.col(c) for c in by]) if by else rows).write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(root)
        if not by:
            return Part(rows.schema.json(), {"": root})
        place = F.regexp_extract("path", f"/{_WRITE}=[0-9a-f]+/(.*)/[^/]+$", 1)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
        found = [r[0] for r in files.select(place).distinct().collect()] if names(self.spark, root) != ["_SUCCESS"] else []
        return Part(rows.schema.json(), {k: f"{root}/{k}" for k in sorted(found)})

    def write_dealt(self, name: str, df: DataFrame, column: str, buckets: int, order: Sequence[str] = ()) -> tuple[Part, DataFrame]:
        """A table's rows without partitions, as session.written_dealt writes them, and the rows that know how they are dealt."""
        root = self._new_folder(name)
        return Part(df.schema.json(), {"": root}), written_dealt(df, root, column, buckets, order)

    def _new_folder(self, name: str) -> str:
        return f"{self.target}/data/{name}/{_WRITE}={uuid.uuid4().hex}"

    def read(self, name: str, revision: Revision, only: Sequence[str] | None = None) -> DataFrame:
        """A table at a revision, or some of its partitions. Filters on partition columns prune folders."""
        return self.read_part(name, revision.parts[name], only)

    def read_part(self, name: str, part: Part, only: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(part.schema))
        folders = [part.folders[k] for k in (part.folders if only is None else only) if k in part.folders]
        if not folders:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField(_WRITE, T.StringType())])
        reader = self.spark.read.schema(whole).option("basePath", f"{self.target}/data/{name}")
        return reader.parquet(*folders).select(*[F.col(f"`{c}`") for c in schema.names])

    def commit(self, parent: Revision, parts: Mapping[str, Part], details: Mapping[str, object] | None = None) -> Revision:
        """The next revision: the parent's tables, of which `parts` are given anew. Only one change builds on a parent."""
        made = Revision(parent.number + 1, {**parent.parts, **parts}, dict(details or {}))
        text = json.dumps({"parts": {k: {"schema": v.schema, "folders": dict(v.folders)} for k, v in made.parts.items()}, "details": made.details}, ensure_ascii=False, default=str)
        if not create_once(self.spark, f"{self.target}/log/{made.number:08d}.json", text):
            raise StaleRevision(f"revision {made.number} exists already; the change builds on {parent.number}")
        return made

    def roll_back(self, number: int) -> Revision:
        """A new revision with the tables of an earlier one."""
        now, old = self.current(), self.revision(number)
        dropped = {k: Part(v.schema, {}) for k, v in now.parts.items() if k not in old.parts}
        return self.commit(now, {**dropped, **old.parts}, {**old.details, "rolled_back_to": number})


def replaced(old: Part | None, new: Part, targets: Sequence[str] = ()) -> Part:
    """A table after a change of partitions: the new ones' folders in place of the old ones'. Target partitions without
    new rows are gone; all others stay. Columns that only one side has are kept, and null in the other's rows."""
    if old is None:
        return new
    fields = {f.name: f for f in T.StructType.fromJson(json.loads(old.schema)).fields}
    for f in T.StructType.fromJson(json.loads(new.schema)).fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"the type of {f.name} changes from {fields[f.name].dataType.simpleString()} to {f.dataType.simpleString()}")
        fields.setdefault(f.name, f)
    by = [k.partition("=")[0] for k in next(iter([*new.folders, *old.folders]), "").split("/") if k]
    ordered = [f for n, f in fields.items() if n not in by] + [f for n, f in fields.items() if n in by]
    kept = {k: v for k, v in old.folders.items() if k not in set(targets)}
    return Part(T.StructType(ordered).json(), {**kept, **new.folders})
