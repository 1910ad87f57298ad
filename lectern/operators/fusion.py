"""Reciprocal rank fusion, rerank floor, and the order of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
# Weights of the original query's lists, then those of each rewrite.
DENSE, LEXICAL, REWRITE = 1.0, 0.8, 0.7


def list_weight(retriever: Column, variant: Column) -> Column:
    own = F.when(retriever == "dense", DENSE).otherwise(LEXICAL)
    return F.when(variant == 0, own).otherwise(own * REWRITE)


def fuse(ranked: DataFrame, limit: int, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Ranked lists (query, key, variant, retriever, rank) to (query, key, score, dense_rank,
    bm25_rank, rank). Ties go to the earlier list, then the better rank in it."""
    number = F.col("variant") * 2 + F.when(F.col("retriever") == "dense", 0).otherwise(1)
    best = lambda name: F.min(F.when(F.col("retriever") == name, F.col("rank")))
    fused = ranked.groupBy(query, key).agg(
        F.round(F.sum(list_weight(F.col("retriever"), F.col("variant")) / (RRF_K + F.col("rank"))), 9).alias("score"),
        best("dense").alias("dense_rank"),
        best("bm25").alias("bm25_rank"),
        F.min(F.struct(number.alias("list"), F.col("rank").alias("at"))).alias("tie"),
    )
    w = W.partitionBy(query).orderBy(F.desc("score"), "tie.list", "tie.at")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long")).drop("tie")


def rerank(candidates: DataFrame, score: Column, top_k: int = 8, floor: float = 0.02, query: str = "query_id") -> DataFrame:
    """Order by the reranker's score, stable on the fused order; below the floor nothing is kept.
    A score of exactly zero counts as none."""
    # the score is named before it is used, and the floor is asked of ranked rows, whose order it does not change: a filter
    # below the window would have every passage scored again for it
    rows = candidates.withColumn("rerank_score", score)
    rows = rows.withColumn("rerank_score", F.when(F.col("rerank_score").isNull() | (F.col("rerank_score") == 0), float("-inf")).otherwise(F.col("rerank_score")))
    w = W.partitionBy(query).orderBy(F.desc("rerank_score"), "rank")
    ranked = rows.withColumn("relevance_rank", F.row_number().over(w)).where((F.col("relevance_rank") <= top_k) & (F.col("rerank_score") >= floor))
    return ranked.withColumn("relevance_rank", F.col("relevance_rank").cast("long"))


def overlap_score(query_terms: Column, passage_terms: Column) -> Column:
    """The stand-in for a cross-encoder in tests: share of the query's distinct terms found."""
    q = F.array_distinct(query_terms)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, passage_terms)) / F.size(q))
