"""New documents as a stream: bodies seen before dropped, only new keys classified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_bodies(spark: SparkSession, folder: str, schema: str, text: str, time: str, delay: str = "1 day") -> DataFrame:
    """A stream of parquet files in a folder, without bodies that came before within the delay."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("body_hash", F.sha2(text, 256))
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["body_hash"])


def remember(stream: DataFrame, cache: str, checkpoint: str, classify: Callable[[DataFrame], DataFrame], key: str = "body_hash") -> StreamingQuery:
    """Classifies keys that the cache table (parquet) lacks and appends them; a repeated batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        rows = df.dropDuplicates([key])
        spark = df.sparkSession
        try:
            rows = rows.join(spark.read.parquet(cache).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        classify(rows).write.mode("append").parquet(cache)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
