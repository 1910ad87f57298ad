"""Bring a library of passages up to date with a table of documents that grows.

    python -m jobs.library_refresh --documents PATH --library PATH --checkpoint PATH [--config FILE]

Takes the files that are new since the last run, as a stream that ends once it has them. The library holds

- ``catalog``: what content each path has had, one row a change;
- ``texts/batch=``: contents seen for the first time;
- ``reports/batch=``: the quality verdict of each of them;
- ``passages/batch=/shelf=``: the lines and headings of those that are fit to read.

A document is a path (its source and id); one that comes again with another text replaces itself, one
that comes unchanged or under another path is not made into passages again, one whose text is null
leaves the library. A batch that is repeated after a failure overwrites its own partitions.
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions.text import token_count
from lectern.operators import ingest
from lectern.sources.scratch import read_or_empty
from lectern.streaming import refresh

LOG = logging.getLogger("jobs.library_refresh")
SETTINGS = Path(__file__).with_suffix(".json")
DOCUMENT = "doc_id long, source string, text string"
TEXT = "sha string, text string, batch long"
REPORT = "sha string, n_lines long, median_len int, fragment_share double, chars_per_page double, verdict string, batch long"
PASSAGE = "sha string, line_no int, text string, level int, tokens int, batch long, shelf int"


def incoming(spark: SparkSession, documents: str, files_per_batch: int | None) -> DataFrame:
    """The documents as a stream of (path, sha, text, at). Written as a pattern, the path may be one
    file as well as a folder of them."""
    pattern = f"{documents[:-1]}[{documents[-1]}]"
    source = spark.readStream.schema(DOCUMENT)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return source.parquet(pattern).select(path.alias("path"), F.sha2("text", 256).alias("sha"), "text", F.col("_metadata.file_modification_time").alias("at"))


def _ended(query) -> int:
    """Rows that a stream has read until it had all there is."""
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def _make_passages(library: str, settings: Config):
    """Of a batch of contents: their texts first, and from those, reports and passages."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        into = lambda rows, name, *keys: rows.withColumn("batch", F.lit(number).cast("long")).write.partitionBy("batch", *keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{library}/{name}")
        into(batch.select("sha", "text"), "texts")
        texts = spark.read.schema(TEXT).parquet(f"{library}/texts").where(F.col("batch") == number).drop("batch")
        # a text is whole in its row, so its report needs no shuffle, and unfit ones go before their lines are made
        quality = ingest.whole_text_quality(F.col("text"))
        into(texts.select("sha", F.inline(F.array_compact(F.array(quality)))), "reports")
        if settings.get("skip_fragmented", True):
            texts = texts.where(quality["verdict"] == "ok")
        blocks = ingest.text_blocks(texts, "sha").select("sha", "line_no", "text", "level", token_count(F.col("text")).alias("tokens"))
        shelf = F.pmod(F.conv(F.substring("sha", 1, 6), 16, 10).cast("int"), F.lit(settings.get("shelves", 16)))
        into(blocks.withColumn("shelf", shelf), "passages", "shelf")

    return write


def run(spark: SparkSession, documents: str, library: str, checkpoint: str, settings: Config | None = None) -> DataFrame:
    """Take what is new; the passages of the library as it stands then."""
    settings = settings or Config.load(str(SETTINGS))
    files = incoming(spark, documents, settings.get("files_per_batch"))
    with refresh.with_state(spark):
        changes = refresh.versions(files).writeStream.format("parquet").option("path", f"{library}/catalog")
        read = _ended(changes.option("checkpointLocation", f"{checkpoint}/catalog").trigger(availableNow=True).start())
        made = refresh.contents(files).writeStream.foreachBatch(_make_passages(library, settings))
        _ended(made.option("checkpointLocation", f"{checkpoint}/contents").trigger(availableNow=True).start())
    LOG.info("read %d new documents from %s", read, documents)
    verdicts = read_or_empty(spark, f"{library}/reports", REPORT).groupBy("verdict").count().collect()
    LOG.info("library %s: %d changes, %d contents in force, verdicts %s", library, catalog(spark, library).count(), contents(spark, library).count(), dict(map(tuple, verdicts)))
    return passages(spark, library)


def catalog(spark: SparkSession, library: str) -> DataFrame:
    return read_or_empty(spark, f"{library}/catalog", refresh.CATALOG)


def contents(spark: SparkSession, library: str) -> DataFrame:
    return refresh.current(catalog(spark, library))


def passages(spark: SparkSession, library: str) -> DataFrame:
    """path, sha, n_paths, line_no, text, level, tokens of the contents in force."""
    made = read_or_empty(spark, f"{library}/passages", PASSAGE).drop("batch", "shelf")
    return contents(spark, library).join(made, "sha").select("path", "sha", "n_paths", "line_no", "text", "level", "tokens")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="library_refresh", description=__doc__.splitlines()[0])
    for name in ("documents", "library", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(SETTINGS))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("library_refresh").getOrCreate()
    try:
        run(spark, a.documents, a.library, a.checkpoint, Config.load(a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
