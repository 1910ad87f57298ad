"""Chunks of books that were made before, so that a build which was stopped goes on where it was.

A commit is two writes: the chunks of some books, then an entry for each of them, which makes them count.
Chunks without an entry, as a stopped build leaves them, are not seen. A book's key is a digest of its
content, the settings that decide its chunks, and a version, so a changed file or setting is a new book.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.scratch import read_or_empty

#: Raised when what is made of a book changes.
VERSION = 1
ENTRY = "key string, path string, became string, n_lines long, n_chunks long, part string"


def cache_key(sha: Column, settings: dict, version: int = VERSION) -> Column:
    said = json.dumps(settings, sort_keys=True)
    return F.substring(F.sha1(F.concat(F.lit(f"[{version}, "), F.to_json(F.struct(sha.alias("sha"))), F.lit(f", {said}]"))), 1, 24)


class BookCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> DataFrame:
        """Complete entries, one for each key: those whose chunks are as many as they say."""
        said = read_or_empty(self.spark, f"{self.root}/entries", ENTRY)
        books = said.where("n_chunks > 0").select("part").limit(1).isEmpty()
        if books:
            return said.where("n_chunks = 0").dropDuplicates(["key"])
        there = self._stored().groupBy("part", "key").agg(F.count("*").alias("there"))
        whole = said.join(there, ["part", "key"], "left").where(F.coalesce("there", F.lit(0)) == F.col("n_chunks")).drop("there")
        # a book that two builds made at once has two entries, which say the same
        return whole.groupBy("key").agg(F.max(F.struct("part", "path", "became", "n_lines", "n_chunks")).alias("e")).select("key", "e.path", "e.became", "e.n_lines", "e.n_chunks", "e.part")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/chunks")

    def missing(self, books: DataFrame) -> DataFrame:
        """Books (key, ...) without a complete entry."""
        return books.join(self.entries().select("key"), "key", "left_anti")

    def add(self, chunks: DataFrame, books: DataFrame) -> None:
        """Commit chunks (key, ...) of some books (key, path, became, n_lines)."""
        part = uuid.uuid4().hex
        chunks.write.parquet(f"{self.root}/chunks/part={part}")
        counts = self.spark.read.parquet(f"{self.root}/chunks/part={part}").groupBy("key").agg(F.count("*").alias("n_chunks"))
        rows = books.join(counts, "key", "left").select("key", "path", "became", "n_lines", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), F.lit(part).alias("part"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/entries")

    def chunks(self, books: DataFrame) -> DataFrame:
        """All chunks of the books (key), as they were added."""
        entries = self.entries().join(books.select("key").distinct(), "key", "left_semi").select("key", "part")
        return self._stored().join(entries, ["key", "part"]).drop("part")
