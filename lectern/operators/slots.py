"""Generation of questions slot by slot, vectorised by round.

Each round takes all open slots at once: retrieve, generate, clean, check against what is
accepted, verify. Slots that fail go into the next round with the reason as feedback, for at
most ``retries`` more; a slot without grounded context is closed at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import strip_sources
from lectern.operators.paper import question_classes, similar_classes

ATTEMPT = "slot bigint, round int, text string, reason string"


def fill(slots: DataFrame, generate: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """Accepted questions (slot, text) and the log of attempts. ``generate`` adds ``text`` (null:
    not grounded) to slots with ``feedback``; ``verify`` adds ``problem`` (empty: none). The
    plans of rounds build on each other, so each round's log is checkpointed."""
    spark = slots.sparkSession
    log = spark.createDataFrame([], ATTEMPT)
    open_ = slots.withColumn("feedback", F.lit(""))
    for k in range(retries + 1):
        made = generate(open_)
        asked = made.where("text is not null").withColumn("text", strip_sources(F.col("text")))
        accepted = log.where("reason = ''").select(F.col("slot").alias("qid"), "text", F.lit(0).alias("age"))
        pool = accepted.unionByName(asked.select(F.col("slot").alias("qid"), "text", F.lit(1).alias("age")))
        # a question is one too many if what was accepted, or asked for an earlier slot, is like it
        classes = question_classes(pool.select("qid", "text"))
        first = pool.join(classes, "qid").groupBy("class_id").agg(F.min(F.struct("age", "qid")).alias("first"))
        pairs = similar_classes(classes)
        links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = links.join(first, links["b"] == first["class_id"]).groupBy("a").agg(F.min("first").alias("near"))
        like = asked.select("slot").join(classes, F.col("slot") == F.col("qid")).join(first, "class_id").join(near, F.col("class_id") == F.col("a"), "left")
        own = F.struct(F.lit(1).alias("age"), F.col("slot").alias("qid"))
        twice = like.where((F.col("first") < own) | (F.col("near") < own)).select("slot", F.lit(True).alias("dup"))
        judged = verify(asked.join(twice, "slot", "left"))
        reason = F.when(F.col("dup"), "duplicate").otherwise(F.coalesce("problem", F.lit("no verdict")))
        attempt = judged.select("slot", F.lit(k).alias("round"), "text", reason.alias("reason")).unionByName(made.where("text is null").select("slot", F.lit(k).alias("round"), "text", F.lit("not grounded").alias("reason")))
        log = log.unionByName(attempt).checkpoint()
        latest = log.withColumn("n", F.row_number().over(W.partitionBy("slot").orderBy(F.desc("round")))).where("n = 1")
        open_ = slots.join(latest.where("reason not in ('', 'not grounded')").select("slot", F.col("reason").alias("feedback")), "slot")
        if open_.isEmpty():
            break
    return log.where("reason = ''").select("slot", "text"), log


def report(slots: DataFrame, log: DataFrame) -> DataFrame:
    """requested, accepted, duplicates, rejected, ungrounded, acceptance_rate (0 without requests)."""
    asked = slots.agg(F.count("*").alias("requested"))
    count = lambda cond: F.count(F.when(cond, 1))
    r = F.col("reason")
    seen = log.agg(count(r == "").alias("accepted"), count(r == "duplicate").alias("duplicates"), count(r == "not grounded").alias("ungrounded"), count(~r.isin("", "duplicate", "not grounded")).alias("rejected"))
    return asked.crossJoin(seen).withColumn("acceptance_rate", F.when(F.col("requested") > 0, F.col("accepted") / F.col("requested")).otherwise(0.0))  # two rows of one
