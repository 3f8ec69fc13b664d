"""Incremental work: finished chapters arrive as a stream and are kept once, so an interrupted run can go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

KEYS = ("slug", "version", "number")


def append_new(batch: DataFrame, store: str, keys: tuple[str, ...] = KEYS) -> None:
    """Append the rows of ``batch`` whose keys aren't in ``store``; of several rows of a key any one.  Repeating a batch
    changes nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(list(keys))
    try:
        fresh = fresh.join(spark.read.parquet(store).select(*keys), list(keys), "left_anti")
    except Exception as e:  # noqa: BLE001 - the store is made by the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(store)


def follow(spark: SparkSession, source: str, schema: str, store: str, state: str, keys: tuple[str, ...] = KEYS) -> StreamingQuery:
    """Keep ``store`` up to date with the Parquet files that appear in ``source``; returns when all present ones are in."""
    stream = spark.readStream.schema(schema).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, _: append_new(df, store, keys))
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
