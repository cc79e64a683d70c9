"""The period load as a stream of landed files: each micro-batch replaces the periods that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.functions.dates import normalize_period
from tallyforge.operators.periods import replace_periods
from tallyforge.sources.revisions import Revisions


def stream_period_files(spark: SparkSession, landing: str, schema, target: str, checkpoint: str, period: str = "period"):
    """Load all files that are new since the last call into the store in `target`, once, and end.

    A batch becomes one revision, which names it: a batch that is run again, as its query died before it noted the end,
    finds itself loaded and changes nothing.
    """
    store = Revisions(spark, target)

    def load(batch: DataFrame, number: int) -> None:
        done = store.current().details
        if done.get("stream") == checkpoint and number <= done.get("batch", -1):
            return
        rows = batch.withColumn(period, normalize_period(batch[period])).where(f"{period} IS NOT NULL")
        replace_periods(store, rows, (), period, {"stream": checkpoint, "batch": number})

    source = spark.readStream.schema(schema).option("header", True).option("escape", '"').csv(landing)
    return source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
