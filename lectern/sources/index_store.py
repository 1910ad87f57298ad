"""The index on disk: immutable generations of Parquet and a pointer to the current one.

A save writes a whole new generation and then moves the pointer, so readers see either the
old index or the new. The folder may be in any store that Hadoop opens.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IndexBusy(RuntimeError):
    """Another writer holds the index."""


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def _write(self, name: str, text: str, replace: bool) -> None:
        out = self._fs.create(self._at(name), replace)
        out.write(text.encode())
        out.close()

    def current(self) -> str | None:
        if not self._fs.exists(self._at("CURRENT")):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def exists(self) -> bool:
        return self.current() is not None

    def lock(self) -> None:
        """Creation of a file fails if it is there, which makes it a lock."""
        try:
            self._write("LOCK", uuid.uuid4().hex, False)
        except Exception as e:
            raise IndexBusy(self.root) from e

    def unlock(self) -> None:
        self._fs.delete(self._at("LOCK"), False)

    def save(self, chunks: DataFrame, manifest: dict) -> str:
        """Write a generation and make it the current one; older ones but ``keep`` are removed."""
        self.lock()
        try:
            name = f"gen={time.time_ns():020d}"
            chunks.write.parquet(f"{self.root}/{name}/chunks")
            n = self.spark.read.parquet(f"{self.root}/{name}/chunks").count()
            self._write(f"{name}/manifest.json", json.dumps(manifest | {"n_chunks": n}), True)
            self._write("CURRENT.new", name, True)
            self._fs.delete(self._at("CURRENT"), False)
            if not self._fs.rename(self._at("CURRENT.new"), self._at("CURRENT")):
                raise OSError(f"{self.root}: the pointer could not be moved")
            found = sorted(str(s.getPath().getName()) for s in self._fs.listStatus(self._path(self.root)) if str(s.getPath().getName()).startswith("gen="))
            for old in found[: -self.keep]:
                self._fs.delete(self._at(old), True)
            return name
        finally:
            self.unlock()

    def load(self, embedding_model: str | None = None) -> tuple[DataFrame, dict]:
        """Chunks and manifest of the current generation; the number of chunks must be right, and
        so must the embedding model if one is named."""
        name = self.current()
        if name is None:
            raise FileNotFoundError(self.root)
        manifest = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}/manifest.json").collect()))
        if embedding_model is not None and manifest.get("embedding_model") != embedding_model:
            raise ValueError(f"index has vectors of {manifest.get('embedding_model')}, not of {embedding_model}")
        chunks = self.spark.read.parquet(f"{self.root}/{name}/chunks")
        if chunks.count() != manifest["n_chunks"]:
            raise ValueError(f"{name}: {manifest['n_chunks']} chunks expected")
        return chunks, manifest


def books_of(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("book").agg(F.count("*").alias("n_chunks"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


def chapters_of(chunks: DataFrame) -> DataFrame:
    """Chapters of each book in order of first sight."""
    first = chunks.where("chapter <> ''").groupBy("book", "chapter").agg(F.min("ordinal").alias("at"))
    return first.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("at", "chapter"))).alias("x")).select("book", F.transform("x", lambda r: r["chapter"]).alias("chapters"))


def matching_books(books: DataFrame, name: str) -> DataFrame:
    """Books (book, title) whose id or title holds the name, case aside."""
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(name)))
    return books.where(holds(F.col("book")) | holds(F.col("title")))
