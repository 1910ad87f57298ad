"""Incremental ingest as a stream of files or rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import passage_key
from lectern.operators.ingest import merge_index


def ingest_available(spark: SparkSession, incoming: DataFrame, target: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> None:
    """Take what a streaming ``incoming`` has now into the Parquet index at ``target``: rows whose
    passage is in the index already, or earlier in the batch, are left out. A batch is
    written under its number, so a batch that is repeated after a failure replaces itself."""

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        keyed = batch.withColumn("_key", passage_key(F.col(text)))
        first = keyed.groupBy("_key").agg(F.min(key).alias(key))
        fresh = keyed.join(first, ["_key", key], "left_semi").dropDuplicates(["_key"])
        try:
            seen = own.read.parquet(target).where(F.col("batch") != number).select("_key")
            fresh = fresh.join(seen, "_key", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = incoming.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def refresh(old: DataFrame, new: DataFrame, key: str = "book") -> DataFrame:
    """Rows of books that came again replace the old ones."""
    return merge_index(old, new, key)
