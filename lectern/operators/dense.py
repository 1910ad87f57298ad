"""Exact nearest neighbours by dot product, block against block.

Vectors are stored in blocks of a few thousand that lie near one of some pivots, each with its
centre and radius; queries are put into blocks the same way. No query has a larger product with any
vector of a block than with its centre plus its own length times the radius. So each query
first looks into the block that promises most, which gives a floor for its k-th best score, and then only
blocks that may still reach some floor are multiplied: what is skipped cannot matter. Each pair of
blocks gives the best k of every query in it, which are merged by rank.

Blocks meet by joins on their numbers: a table of block heads, in parts, is sent past the query
blocks to choose pairs, and only chosen pairs carry vectors. No row of vectors meets a row of queries on its own.

Defined cases. Null vector: neither found nor searched for. Repeated rows: each is found. Ties, after
rounding to six places: the smaller key. Fewer vectors than k: all of them. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.lexical import top_k
from lectern.sources.scratch import stored

#: Vectors and queries of a block, heads of a part, and pivots at most.
BLOCK_ROWS, QUERY_ROWS, HEADS, PIVOTS = 4096, 1024, 1024, 256
#: Products are rounded to six places; a bound is missed only if it is below the floor by more.
MARGIN = 2e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class Index:
    """``blocks`` (block, ids, data) and ``heads`` (part, blocks, centers, radii) are stored tables."""

    key: str
    blocks: DataFrame
    heads: DataFrame
    parts: int
    pivots: np.ndarray


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1)


def _assign(pivots: np.ndarray):
    """Number of the nearest pivot of each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (pivots**2).sum(axis=-1) / 2
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                near = (v @ pivots.T - half).argmax(axis=1) if pivots.size else 0
                yield pdf.assign(pivot=np.int32(near))

    return run


def _together(key: str):
    """One row of a block's vectors."""

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        center = v.mean(axis=0)
        radius = float(np.sqrt(((v - center) ** 2).sum(axis=1).max()))
        return pd.DataFrame({"block": [group[0]], "ids": [pdf[key].tolist()], "data": [v.tobytes()], "center": [center.tobytes()], "radius": [radius]})

    return run


def _blocks(vectors: DataFrame, key: str, pivots: np.ndarray, size: int) -> DataFrame:
    """(block, ids, data, center, radius): what is near a pivot, in slices of about ``size``."""
    kinds = dict(vectors.dtypes)
    near = stored(vectors.mapInPandas(_assign(pivots), f"`{key}` {kinds[key]}, embedding {kinds['embedding']}, pivot int"))
    slices = {r["pivot"]: math.ceil(r["count"] / size) for r in near.groupBy("pivot").count().collect()}  # a row a pivot
    many = F.get(F.array(*[F.lit(slices.get(p, 1)) for p in range(max(1, len(pivots)))]), F.col("pivot"))
    block = F.col("pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64(key, F.lit("slice")), many)
    return near.withColumn("block", block).groupBy("block").applyInPandas(_together(key), f"block long, ids array<{kinds[key]}>, data binary, center binary, radius double")


def build(vectors: DataFrame, key: str = "vec_id") -> Index:
    """An index of (key, embedding). The driver sees a bounded number of vectors, the pivots, drawn by a hash
    of their keys: they decide how near the vectors of a block are, not what is found."""
    rows = vectors.select(key, "embedding").where("embedding is not null")
    if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64(key), key).limit(min(PIVOTS, max(1, math.ceil(n / BLOCK_ROWS)))).select("embedding").collect()
    pivots = np.array([r[0] for r in drawn], np.float64)
    blocks = stored(_blocks(rows, key, pivots, BLOCK_ROWS))
    parts = max(1, math.ceil(blocks.count() / HEADS))
    listed = F.array_sort(F.collect_list(F.struct("block", "radius", "center")))
    heads = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part")).agg(listed.alias("x"))
    heads = stored(heads.select("part", F.transform("x", lambda h: h["block"]).alias("blocks"), F.transform("x", lambda h: h["radius"]).alias("radii"), F.transform("x", lambda h: h["center"]).alias("centers")))
    return Index(key, blocks.select("block", "ids", "data"), heads, parts, pivots)


def _chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (query block, block): of queries without floors, the block of each part that promises
    most to each of them; else those where some query may still reach its floor."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            q = _matrix(r.qdata, len(r.qids))
            bound = q @ np.stack([np.frombuffer(c, np.float64) for c in r.centers]).T + np.sqrt((q**2).sum(axis=1))[:, None] * np.asarray(r.radii)
            if r.floors is None:
                hit = np.unique(bound.argmax(axis=1))
            else:
                hit = np.flatnonzero((bound >= (np.asarray(r.floors) - MARGIN)[:, None]).any(axis=0))
            rows += [(r.qblock, r.blocks[i]) for i in hit]
        yield pd.DataFrame(rows, columns=["qblock", "block"])


def _products(k: int, key: str, query: str):
    """The best k of each query in a pair of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.asarray(r.ids)
                score = np.round(_matrix(r.qdata, len(r.qids)) @ _matrix(r.data, len(ids)).T, 6) + 0.0
                out = []
                for s in score:
                    # all that tie with the k-th stay until keys decide
                    some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    out.append(some[np.lexsort((ids[some], -s[some]))][:k])
                at = np.concatenate(out)
                who = np.repeat(np.arange(len(out)), [len(x) for x in out])
                yield pd.DataFrame({"qblock": r.qblock, query: np.asarray(r.qids)[who], key: ids[at], "score": score[who, at]})

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int, only: Column | None = None, key: str = "vec_id", query: str = "query_id", index: Index | None = None) -> DataFrame:
    """(query, key, score, rank) of the best k of ``vectors``, or of those that ``only`` allows."""
    index = index or build(vectors if only is None else vectors.where(only), key)
    kinds = dict(queries.dtypes) | {key: dict(index.blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")}
    asked = _blocks(queries.select(query, "embedding").where("embedding is not null"), query, index.pivots, QUERY_ROWS)
    asked = stored(asked.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("data").alias("qdata")))

    def pairs(rows: DataFrame) -> DataFrame:
        past = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1)))).join(index.heads, "part")
        return past.select("qblock", "qids", "qdata", "floors", "blocks", "radii", "centers").mapInPandas(_chosen, "qblock long, block long")

    def multiplied(chosen: DataFrame) -> DataFrame:
        rows = chosen.join(asked, "qblock").join(index.blocks, "block").select("qblock", "qids", "qdata", "ids", "data")
        return rows.mapInPandas(_products(k, key, query), f"qblock long, `{query}` {kinds[query]}, `{key}` {kinds[key]}, score double")

    first = stored(pairs(asked.withColumn("floors", F.lit(None).cast("array<double>"))))
    found = stored(top_k(multiplied(first), k, key, query).drop("rank"))
    # a query that has not seen k vectors has no floor yet
    floor = found.groupBy("qblock", query).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    floors = floor.groupBy("qblock").agg(F.map_from_entries(F.collect_list(F.struct(query, "floor"))).alias("of"))
    known = asked.join(floors, "qblock", "left").withColumn("floors", F.transform("qids", lambda q: F.coalesce(F.try_element_at("of", q), F.lit(float("-inf"))))).drop("of")
    rest = pairs(known).join(first, ["qblock", "block"], "left_anti")
    return top_k(found.unionByName(multiplied(rest)).drop("qblock"), k, key, query)
