"""Command line: ``python -m lectern.cli ingest | books | ask``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lectern import engine, plugins
from lectern.config import Config, parse_overrides
from lectern.sources.book_cache import BookCache
from lectern.sources.index_store import IndexStore, books_of, chapters_of

#: The stand-in for an encoder, under its name in the index.
ENCODER, ENCODER_NAME = plugins.hash_encoder(256), "words-256"


def ask(spark: SparkSession, store: IndexStore, question: str, cfg: Config):
    """The context that an answer to the question may cite."""
    chunks, _ = store.load(ENCODER_NAME)
    return engine.retrieve(spark.createDataFrame([(0, question)], "query_id long, text string"), chunks, cfg, ENCODER)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--index", default="index")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("ingest").add_argument("folder")
    sub.add_parser("books")
    sub.add_parser("ask").add_argument("question")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    cfg, store = Config().with_overrides(parse_overrides(a.set)), IndexStore(spark, a.index)
    if a.what == "ingest":
        chunks, report = engine.build_in_steps(spark, a.folder, cfg, BookCache(spark, f"{a.index}/cache"), ENCODER, ENCODER_NAME)
        report.select("path", "became", "n_lines").show(100, truncate=False)
        print(store.save(chunks, {"embedding_model": ENCODER_NAME}))
    elif a.what == "books":
        chunks, _ = store.load()
        books_of(chunks).join(chapters_of(chunks), "book", "left").show(truncate=False)
    else:
        row = ask(spark, store, a.question, cfg).first()
        print(row["context"] if row and row["answered"] else "Nothing on this in the index.")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
