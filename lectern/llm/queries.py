"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import collocations, curriculum, decontamination, language_id, licenses, lm_scoring, minhash, packing, quality, sharding, suffix_dedup, warc
from lectern.llm.common import compact, documents, fold, tuned


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(tuned(spark).read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return compact(suffix_dedup.digest(suffix_dedup.remove_repeats(docs)), docs)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), decontamination.Settings(edits=True))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = minhash.near_duplicates(docs, minhash.Settings(words=2))
    return compact(found.select("doc_id", "n_shingles", "component_id", "kept"), docs)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.ledger(documents(spark, sf_dir)))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does, over all documents."""
    return quality.ablations(quality.ledger(documents(spark, sf_dir)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(fold(F.col("doc_id")) != 0))
    judged = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), language_id.judge(F.col("text"), model).alias("r"))
    return judged.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.rejected")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return compact(lm_scoring.score(docs, theme="lang"), docs)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training order, summed for each document again."""
    docs = documents(spark, sf_dir)
    out = curriculum.mix(docs).groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return compact(out.drop("row"), docs)


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
r as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as first from q)
select page_id, payload_bytes, payload_digest,
       case when first <> page_id then 'revisit' else 'response' end as record_type,
       case when first <> page_id then first end as refers_to
from r
"""

QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_licenses": op6_licenses,
    "op7_minhash": op7_minhash,
    "op8_quality": op8_quality,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_curriculum": op12_curriculum,
    "quality_ablations": quality_ablations,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op6_licenses": licenses.oracle(), "op7_minhash": minhash.ORACLE, "op8_quality": quality.oracle(), "op11_collocations": collocations.ORACLE, "op12_curriculum": curriculum.ORACLE, "quality_ablations": quality.ablations_oracle()}
