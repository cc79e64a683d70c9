"""Session settings that the operators rely on."""

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Text partitions stay text, times are UTC, and legacy code pages can be read.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(builder: SparkSession.Builder | None = None) -> SparkSession:
    return (builder or SparkSession.builder).config(map=SETTINGS).getOrCreate()


def hash_joins(spark: SparkSession) -> None:
    """From now on a join of shuffled rows builds a hash table of a side whose partitions are all within Spark's advisory
    size, and the other side isn't sorted; other joins sort both, as all did, and spill. A setting of the session's own stays."""
    limit = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(limit) in ("0", "0b"):
        spark.conf.set(limit, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names, which all machines share; temporary only where unset."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def as_dealt(spark: SparkSession, buckets: int) -> Iterator[None]:
    """Within it, rows that are dealt into so many buckets stay so: a join takes sides that are dealt alike by one of its keys
    as they are, and deals others like them; sorted rows are summed a group at a time, and written without another sort."""
    wanted = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.maxConcurrentOutputFileWriters": "2",
        # with more partitions than buckets, joins would deal the rows anew, and each task would write a file for every bucket
        "spark.sql.shuffle.partitions": str(buckets), "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(buckets),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written_dealt(df: DataFrame, path: str, column: str, buckets: int, order: Sequence[str] = ()) -> DataFrame:
    """The rows, written to a new folder in so many buckets of a column, sorted within if an order is given, and read again:
    what joins or sums them by the column and others needs no shuffle. Rows that are dealt like that already stay where they are."""
    import uuid

    name = f"dealt_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column)
    (writer.sortBy(*order) if order else writer).saveAsTable(name)
    out = df.sparkSession.table(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay
    return out


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: cuts lineage, and is worked out once."""
    path = scratch_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
