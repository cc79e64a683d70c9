"""Small files of a table's own log: listed, read whole, and created only where they don't exist yet."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the session's Hadoop configuration."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries; none where it doesn't exist."""
    fs, p = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call created the file: it appears whole, and only one of several callers is told so.

    The text is written under a name of its own and then given its place, by a link on local file systems and by a
    rename that refuses an existing name elsewhere (atomic on HDFS and on object stores with a hierarchy; plain object
    stores need a lock of the caller's).
    """
    folder, _, name = path.rpartition("/")
    fs, p = _hadoop(spark, path)
    fs, own = _hadoop(spark, f"{folder}/_{name}.{uuid.uuid4().hex}")
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            place = lambda x: unquote(urlparse(x.toString()).path)
            os.link(place(own), place(p))
            return True
        jvm, none = spark._jvm, spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(own, p, none)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
    except FileExistsError:
        return False
    finally:
        fs.delete(own, False)


def decoded_path(uri: Column) -> Column:
    """A file's path as the listing gives it, from the URI in a row's metadata."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def listing(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(file, name, size, modified) of all files below the paths, empty ones (without a time) too: a listing only, no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(paths)
    every = spark.createDataFrame([(u,) for u in files.inputFiles()], "uri string").select(decoded_path(F.col("uri")).alias("file"))
    found = files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = every.join(found, "file", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    return out.select("file", F.element_at(F.split("file", "/"), -1).alias("name"), "size", "modified")
