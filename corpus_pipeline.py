"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its
result is written as Parquet and read again as the next stage's ``docs``. All stages but the
last return the columns of ``documents``, and no others.

Defined cases. Null, empty or letterless text: rejected by the first stage. Null ids, repeated
rows, empty tables and long texts: as the operators say. A document that its cuts leave
without text goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, language_id, minhash, packing, suffix_dedup
from lectern.llm.common import documents, fold, parts_for, staged, tuned

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language compression can tell."""
    tuned(spark)
    model = language_id.fit(docs.where(fold(F.col("doc_id")) != 0))
    return docs.withColumn("_judged", language_id.judge(F.col("text"), model)).where(~F.col("_judged.rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates (five-word
    shingles, similarity 0.8); of rows with the same id and text, one.
    Rows without an id cannot be told apart here: they stay if one of them does."""
    tuned(spark)
    kept = minhash.near_duplicates(docs, minhash.Settings(words=5)).where("kept").select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "_kept"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings of 200 bytes or more that recur; a character cut in two is dropped.
    Documents of which nothing but white space is left go."""
    tuned(spark)
    cut = suffix_dedup.remove_repeats(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(_whole_characters(F.col("kept")))
    return cut.withColumn("text", text).where(F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _whole_characters(kept: Column) -> Column:
    """Text of the remaining bytes without the halves of characters that a cut went through (nor
    replacement characters, of which those halves become some)."""
    return F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("�"), F.lit(""))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    found = decontamination.found_items(F.col("text"), tuned(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), decontamination.Settings(edits=True))
    return docs.withColumn("_found", found).where(F.size("_found") == 0).select(*COLUMNS)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left."""
    tuned(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", leaks),
    ("packing", bins),
]
#: Compression, MinHash and packing have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name, parts_for(docs))
    return STAGES[-1][1](spark, docs, sf_dir)
