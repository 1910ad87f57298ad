"""Plug points for models: embedder, reranker, language model. The doubles here need none."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.replies import reply_json
from lectern.functions.text import terms
from lectern.operators.fusion import overlap_score
from lectern.sources.scratch import stored


def embedder(encode: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A column function from a batch encoder; vectors come out with unit length."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            v = np.asarray(encode(batch.fillna("").tolist()), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(norm > 0, norm, 1)))

    return run


def hash_encoder(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in: signed counts of hashed words."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h & 1 << 20 else -1
        return out

    return encode


def overlap_reranker(query: Column, passage: Column) -> Column:
    """A deterministic stand-in for a cross-encoder."""
    return overlap_score(terms(query), terms(passage))


def replies(prompts: DataFrame, table: DataFrame) -> DataFrame:
    """A language model whose replies are a table (prompt_id, reply)."""
    return prompts.join(table, "prompt_id", "left")


def complete(prompts: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Replies of a client that each task makes once; failures are a column, not an exception."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for pdf in batches:
            said, failed = [], []
            for p in pdf["prompt"]:
                try:
                    said.append(ask(p))
                    failed.append(None)
                except Exception as e:
                    said.append(None)
                    failed.append(f"{type(e).__name__}: {e}"[:200])
            yield pdf[["prompt_id"]].assign(reply=said, problem=failed)

    return prompts.select("prompt_id", "prompt").mapInPandas(run, "prompt_id bigint, reply string, problem string")


#: What is added to a prompt whose reply was no JSON.
AGAIN = "\n\nThe reply before was not valid JSON:\n{}\nReply with valid JSON only."


def complete_json(prompts: DataFrame, client: Callable[[], Callable[[str], str]], retries: int = 2) -> DataFrame:
    """(prompt_id, json, problem): replies as JSON texts. Prompts without one are asked again, with
    what was said, in rounds over those that are left; each round is stored."""
    done, left = None, prompts.select("prompt_id", "prompt")
    for attempt in range(retries + 1):
        said = stored(complete(left, client).withColumn("json", reply_json(F.col("reply"))))
        last = attempt == retries
        found = (said if last else said.where("json is not null")).select("prompt_id", "json", F.when(F.col("json").isNull(), F.coalesce("problem", F.lit("no JSON"))).alias("problem"))
        done = found if done is None else done.unionByName(found)
        if last or said.where("json is null").isEmpty():
            return done
        more = F.concat("prompt", F.replace(F.lit(AGAIN), F.lit("{}"), F.coalesce(F.substring("reply", 1, 500), F.lit(""))))
        left = left.join(said.where("json is null").select("prompt_id", "reply"), "prompt_id").select("prompt_id", more.alias("prompt"))
    return done


@contextmanager
def cancellable(spark: SparkSession, name: str, should_stop: Callable[[], bool], every: float = 0.5) -> Iterator[None]:
    """Jobs of the block form a group, which is cancelled once ``should_stop`` says so."""
    group, over = f"{name}-{uuid.uuid4().hex}", threading.Event()
    spark.sparkContext.setJobGroup(group, name, True)

    def watch() -> None:
        while not over.wait(every):
            if should_stop():
                spark.sparkContext.cancelJobGroup(group)
                return

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@contextmanager
def tracked(spark: SparkSession, name: str) -> Iterator[Callable[[], list[tuple[int, str, int, int]]]]:
    """Jobs of the block form a group; what is yielded says how far their stages are: (stage, name, tasks done,
    tasks), of all that Spark still knows. Another thread may ask while the block runs."""
    group, tracker = f"{name}-{uuid.uuid4().hex}", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, name)

    def stages() -> list[tuple[int, str, int, int]]:
        jobs = (tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group))
        found = (tracker.getStageInfo(s) for s in sorted({s for job in jobs if job for s in job.stageIds}))
        return [(s.stageId, s.name, s.numCompletedTasks, s.numTasks) for s in found if s]

    try:
        yield stages
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
