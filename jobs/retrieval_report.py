"""How well questions find the documents that answer them.

    python -m jobs.retrieval_report --documents PATH --questions PATH --out PATH [--config FILE]

Every question is searched in all documents by BM25, its candidates are scored anew by the share of its terms
that they hold, and those below the floor are dropped; a question that keeps none is refused. A candidate
answers a question if its text contains the question's, white space and case aside. Writes

- ``hits/run=/outcome=``: the candidates of each question, answered and refused ones apart;
- ``metrics/run=``: hit rates, mean reciprocal rank and refusal rate, as JSON.

A run replaces what the run of that name wrote before, so it may be repeated; other runs stay beside it.
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions.text import terms
from lectern.operators import evaluation, fusion, lexical

LOG = logging.getLogger("jobs.retrieval_report")
SETTINGS = Path(__file__).with_suffix(".json")
HIT = "query_id long, doc_id long, source string, rank long, score double, overlap double, relevance_rank long, answers boolean, run string, outcome string"
METRICS = "n long, hit_at_1 double, hit_at_3 double, hit_at_k double, mrr double, refusal_rate double"


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hits(questions: DataFrame, docs: DataFrame, settings: Config) -> DataFrame:
    """Candidates of questions (query_id, text) among documents (doc_id, source, text)."""
    questions, docs = (t.withColumn("text", F.coalesce("text", F.lit(""))) for t in (questions, docs))
    found = lexical.search(questions, docs, settings.get("candidates", 12))
    asked = questions.select("query_id", terms(F.col("text")).alias("q"), plain(F.col("text")).alias("wanted"))
    held = docs.select("doc_id", "source", terms(F.col("text")).alias("t"), plain(F.col("text")).alias("whole"))
    rows = found.join(held, "doc_id").join(asked, "query_id")
    answers = (F.col("wanted") != "") & F.contains("whole", F.col("wanted"))
    rows = rows.select("query_id", "doc_id", "source", "rank", "score", F.round(fusion.overlap_score(F.col("q"), F.col("t")), 6).alias("overlap"), answers.alias("answers"))
    kept = fusion.rerank(rows, F.col("overlap"), settings.get("top_k", 8), settings.get("floor", 0.3)).select("query_id", "doc_id", "relevance_rank")
    outcome = F.when(F.count("relevance_rank").over(W.partitionBy("query_id")) > 0, "answered").otherwise("refused")
    return rows.join(kept, ["query_id", "doc_id"], "left").withColumn("outcome", outcome)


def run(spark: SparkSession, documents: str, questions: str, out: str, settings: Config | None = None) -> DataFrame:
    """Search, judge, write; the hits of all runs as they stand then."""
    settings = settings or Config.load(str(SETTINGS))
    name = settings.get("run", "bm25")
    docs = spark.read.parquet(documents).select("doc_id", "source", "text")
    asked = spark.read.parquet(questions).select(F.col("item_id").alias("query_id"), "text")
    hits(asked, docs, settings).write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/hits/run={name}")
    written = spark.read.schema(HIT).parquet(f"{out}/hits")
    own = written.where(F.col("run") == name)
    cases = own.groupBy("query_id").agg(F.min(F.when(F.col("answers"), F.col("relevance_rank"))).alias("rank"), F.first("outcome").alias("outcome"))
    # a question without any candidate, as where there are no documents, is refused
    cases = asked.select("query_id").join(cases, "query_id", "left").withColumn("refused", F.coalesce(F.col("outcome") == "refused", F.lit(True)))
    evaluation.retrieval_metrics(cases, settings.get("top_k", 8)).write.mode("overwrite").json(f"{out}/metrics/run={name}")
    LOG.info("read %d questions and %d documents", asked.count(), docs.count())
    LOG.info("wrote %d hits to %s; %s", own.count(), f"{out}/hits/run={name}", spark.read.schema(METRICS).json(f"{out}/metrics/run={name}").first().asDict())
    return written


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="retrieval_report", description=__doc__.splitlines()[0])
    for name in ("documents", "questions", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(SETTINGS))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("retrieval_report").getOrCreate()
    try:
        run(spark, a.documents, a.questions, a.out, Config.load(a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
