"""Metrics of retrieval, faithfulness and gold cases. Without rows a metric is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.nfkc import nfkc
from lectern.functions.text import plain_math


def retrieval_metrics(ranks: DataFrame, k: int) -> DataFrame:
    """Cases (rank or null, refused) to hit rates, mean reciprocal rank and refusal rate."""
    hit = lambda n: F.avg(F.coalesce((F.col("rank") <= n).cast("int"), F.lit(0)))
    return ranks.agg(F.count("*").alias("n"), hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), hit(k).alias("hit_at_k"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.col("refused").cast("int")).alias("refusal_rate"))


def faithfulness(claims: DataFrame, most: int = 40) -> DataFrame:
    """Claims (case, position, supported, refused, scored): supported over all claims of the cases
    that were answered and scored, the first ``most`` of each."""
    rows = claims.where(~F.col("refused") & F.col("scored"))
    counted = F.col("position") <= most
    total = F.count(F.when(counted, 1))
    return rows.agg(total.alias("claims"), F.count(F.when(counted & F.col("supported"), 1)).alias("supported"), F.count(F.when(~counted, 1)).alias("truncated"), F.round(F.count(F.when(counted & F.col("supported"), 1)) / F.nullif(total, F.lit(0)), 6).alias("faithfulness"))


def match_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims (case, i, claim) with verdicts (case, i, claim, supported): by normal text, of which
    the last counts; or by place where a case has as many of either."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    by_text = verdicts.groupBy("case", norm(F.col("claim")).alias("k")).agg(F.max_by("supported", "i").alias("by_text"))
    equal = claims.groupBy("case").agg(F.count("*").alias("n")).join(verdicts.groupBy("case").agg(F.count("*").alias("m")), "case").where("n = m").select("case")
    by_place = verdicts.join(equal, "case", "left_semi").select("case", "i", F.col("supported").alias("by_place"))
    rows = claims.withColumn("k", norm(F.col("claim"))).join(by_text, ["case", "k"], "left").join(by_place, ["case", "i"], "left")
    return rows.select("case", "i", "claim", F.coalesce("by_text", "by_place").alias("supported"))


def upper_quantile(groups: DataFrame, value: str, share: float, by: str) -> DataFrame:
    """The value at index int(share * n), at most the last, of each group's sorted values, by
    ranking within the group."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by)
    rows = groups.where(F.col(value).isNotNull()).withColumns({"i": F.row_number().over(w.orderBy(value)) - 1, "n": F.count("*").over(w)})
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(share)))
    return rows.where(F.col("i") == at).select(by, "n", F.col(value).alias("quantile"))


def keyword_present(keyword: Column, answer: Column) -> Column:
    """Whether an answer names a keyword, formulas and compatibility forms aside: a short one as a
    word, a longer one anywhere."""
    norm = lambda c: F.lower(nfkc(plain_math(c)))
    compact = lambda c: F.regexp_replace(c, r"(?U)[\W_]+", "")
    said, k = norm(answer), compact(norm(keyword))
    whole = F.array_contains(F.transform(F.split(said, r"\s+"), compact), k)
    return F.when(k == "", False).when(F.length(k) < 3, whole).otherwise(F.contains(compact(said), k))


def gold_summary(cases: DataFrame) -> DataFrame:
    """Gold cases (answerable, answered, error, reviewed, cited_hit, context_hit, keyword_recall)."""
    ok = ~F.col("error")
    rate = lambda cond, value: F.round(F.avg(F.when(ok & cond, value.cast("double"))), 6)
    a = F.col("answerable")
    return cases.agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("error"), 1)).alias("errors"),
        F.count(F.when(~F.col("reviewed"), 1)).alias("unreviewed"),
        rate(a, F.col("answered")).alias("answer_rate"),
        rate(a, F.col("cited_hit")).alias("cited_page_hit"),
        rate(a, F.col("context_hit")).alias("context_page_hit"),
        rate(a, F.col("keyword_recall")).alias("keyword_recall"),
        rate(~a, ~F.col("answered")).alias("correct_refusal_rate"),
    )


def pages_overlap(start: Column, end: Column, pages: Column) -> Column:
    return F.exists(pages, lambda p: (p >= start) & (p <= end))


def with_substance(chunks: DataFrame, least: int = 150, or_all: bool = True) -> DataFrame:
    """Chunks of at least so many tokens; if there are none, all of them, unless ``or_all`` is off."""
    long = F.col("token_count") >= least
    if not or_all:
        return chunks.where(long)
    any_long = chunks.agg(F.coalesce(F.max(long), F.lit(False)).alias("_any"))
    return chunks.crossJoin(F.broadcast(any_long)).where(long | ~F.col("_any")).drop("_any")  # one row


def round_robin(rows: DataFrame, n: int, seed: int = 7, book: str = "book", key: str = "id") -> DataFrame:
    """``n`` rows drawn from the books in turn, in an order within each that a hash of seed and key gives."""
    from pyspark.sql import Window as W

    w = W.partitionBy(book).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", book).limit(n)
