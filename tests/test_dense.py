"""Block search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import dense


def plain(q, v, k):
    out = set()
    for i, x in q:
        scored = sorted((-round(float(np.dot(np.float64(x), np.float64(y))), 6) + 0.0, j) for j, y in v)
        out |= {(i, j, -s + 0.0, r) for r, (s, j) in enumerate(scored[:k], 1)}
    return out


def rows(n, seed, clusters):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, 8))
    v = centers[r.integers(0, clusters, n)] + r.normal(size=(n, 8)) * 0.05
    return [(i, x.tolist()) for i, x in enumerate((v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32))]


@pytest.fixture
def small(monkeypatch):
    for name, n in (("BLOCK_ROWS", 40), ("QUERY_ROWS", 7), ("HEADS", 5), ("PIVOTS", 6)):
        monkeypatch.setattr(dense, name, n)


@pytest.mark.parametrize(("clusters", "k"), [(5, 3), (200, 10), (1, 60)])
def test_blocks_equal_all_products(spark, small, clusters, k):
    v, q = rows(600, 1, clusters), rows(40, 2, clusters)
    v += [(1000 + i, v[3][1]) for i in range(90)]  # ties beyond a block
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    asked = spark.createDataFrame([*q, (99, None)], "query_id long, embedding array<float>")
    got = {tuple(r) for r in dense.search(asked, df.unionByName(spark.createDataFrame([(5000, None, "x")], df.schema)), k).select("query_id", "vec_id", "score", "rank").collect()}
    assert got == plain(q, v, k)


def test_keys_may_be_strings_and_vectors_double(spark, small):
    v = [(f"c{i:03d}", [float(x) for x in e]) for i, e in rows(120, 3, 4)]
    q = rows(5, 4, 4)
    got = dense.search(spark.createDataFrame(q, "query_id long, embedding array<double>"), spark.createDataFrame(v, "id string, embedding array<double>"), 4, key="id")
    assert {tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()} == plain(q, v, 4)


def test_far_blocks_are_skipped(spark, small, monkeypatch):
    """In tight clusters, most pairs of blocks need no product."""
    v, q = rows(1200, 5, 6), rows(30, 5, 6)
    seen = []
    frame = type(spark.range(0))
    whole = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema, **k: (seen.append(self) if "ids" in self.columns and "data" in self.columns else None) or whole(self, f, schema, **k))
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    index = dense.build(df)
    got = dense.search(spark.createDataFrame(q, "query_id long, embedding array<float>"), df, 5, index=index)
    assert {tuple(r) for r in got.select("query_id", "vec_id", "score", "rank").collect()} == plain(q, v, 5)
    made, possible = sum(s.count() for s in seen), index.blocks.count() * seen[0].select("qblock").distinct().count()
    assert len(seen) == 2 and made < possible / 2
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_empty_tables(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert dense.search(q, v, 3).count() == 0
    assert dense.search(q.limit(0), q.withColumnRenamed("query_id", "vec_id"), 3).count() == 0
