"""Memory of tables and tasks with large rows: row groups, waiting segments, rounds of queries."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lectern import plugins
from lectern.operators import fusion, lexical


def texts(spark, n, words):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.substring(F.md5((F.col("id") * 7919 + i * i).cast("string")), 1, 8)), " ").alias("text"))


def test_segments_stand_in_small_row_groups(spark):
    """A reader's batch never crosses a row group, so no task holds all segments of its file at once."""
    index = lexical.build(texts(spark, 12_000, 300))
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.segments.inputFiles()]
    groups = [m.row_group(i) for m in metas for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 12_000 // 64
    assert max(g.num_rows for g in groups) <= 24 and len(groups) > len(metas)


def test_waiting_segments_are_bounded(monkeypatch):
    """With many queries a few segments fill what may wait."""
    monkeypatch.setattr(lexical, "HELD_BYTES", 100_000)
    n = 1000
    scorer = lexical._Scorer(n, pa.array(["a"]), np.array([0, n]), np.arange(n), np.ones(n), 2.0, 3)
    row = {"terms": pa.array(["a"]), "dl": np.array([2, 3]), "df": np.array([2]), "most": np.array([1]), "shortest": np.array([2]), "docs": np.array([0, 1]), "counts": np.array([1, 1])}
    most = 0
    for i in range(50):
        scorer.add(np.array([2 * i, 2 * i + 1]), np.ones(2, bool), row)
        most = max(most, len(scorer.held))
    scorer.take()
    assert 0 < most <= 4 and scorer.best[n - 1][0].tolist() == [0, 2, 4]


def test_rounds_of_queries_equal_one(spark, monkeypatch):
    docs = texts(spark, 300, 6).withColumn("text", F.concat("text", F.lit(" common"), (F.col("doc_id") % 9).cast("string")))
    queries = docs.where("doc_id < 40").select(F.col("doc_id").alias("query_id"), "text")
    index = lexical.build(docs)
    one = sorted(map(tuple, lexical.search(queries, docs, 5, index=index).collect()))
    monkeypatch.setattr(lexical, "MOST_TERMS", 60)
    monkeypatch.setattr(lexical, "scores", None)  # the join over all postings is not used
    assert sorted(map(tuple, lexical.search(queries, docs, 5, index=index).collect())) == one and len(one) == 200


def test_many_queries_are_added_up_by_blocks(spark, monkeypatch):
    """the same as the join over all postings, whatever the blocks, with and without a filter, with ties and frequent terms."""
    common = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("common"), F.pmod(F.xxhash64("doc_id", i), F.lit(7)).cast("string"))), " ")
    docs = texts(spark, 700, 5).withColumn("text", F.concat_ws(" ", F.when(F.col("doc_id") % 3 > 0, F.col("text")), common)).repartition(3)
    queries = docs.where("doc_id < 90").select(F.col("doc_id").alias("query_id"), F.concat("text", F.lit(" common1 common1 nowhere")).alias("text"))
    index = lexical.build(docs)
    for only in (None, F.col("doc_id") % 5 == 0):
        found = []
        for many, most, size, rows in ((1, 500_000, 6_000_000, 128), (1, 500_000, 1000, 2), (1, 700, 200, 0), (1, 0, 1, 1), (10_000, 500_000, 1, 1)):
            for name, value in (("MANY_QUERIES", many), ("MOST_TERMS", most), ("BLOCK_POSTINGS", size), ("FULL_ROWS", rows)):
                monkeypatch.setattr(lexical, name, value)
            found.append(sorted(map(tuple, lexical.search(queries, docs, 7, only, index=index).select("query_id", "rank", "doc_id", F.round("score", 5)).collect())))
        assert all(x == found[0] for x in found) and len(found[0]) == 630


def test_a_block_that_cannot_reach_the_best_is_left_out(monkeypatch):
    """of the second block no document reaches what the first has given."""
    scorer = lexical._Blocks(pa.array(["a", "b"]), np.array([0, 2]), np.arange(2), np.array([3.0, 1.0]), 9.0, 2)
    row = {"terms": pa.array(["a", "b"]), "dl": np.full(4, 9, np.int32), "df": np.array([3, 2]), "docs": np.array([0, 1, 2, 2, 3]), "counts": np.ones(5, np.int32)}
    scorer.add(np.arange(4), np.array([True, True, False, True]), row)
    scorer.take()
    assert [x.tolist() for x in scorer.best[0]] == [[0, 1], [3.0, 3.0]] and scorer.floor[0] == 3.0
    monkeypatch.setattr(lexical.np, "bincount", lambda *x, f=np.bincount, **y: None if len(x) > 1 else f(*x, **y))
    scorer.add(np.arange(4, 8), np.ones(4, bool), row | {"terms": pa.array(["b", "z"])})
    scorer.take()
    assert scorer.best[0][0].tolist() == [0, 1]


def test_a_passage_is_scored_once(spark):
    """neither the floor nor the test for zero has the reranker go over a passage again."""
    rows = [(1, 1, 1, "red car", "a red bus"), (1, 2, 2, "red car", "red car"), (1, 3, 3, "red car", "none"), (1, 4, 4, "red car", "car"), (2, 1, 1, "", "red")]
    df = spark.createDataFrame(rows, "query_id long, id long, rank long, question string, text string")
    kept = fusion.rerank(df, plugins.overlap_reranker(F.col("question"), F.col("text")), 2, 0.4)
    assert kept.select("query_id", "id")._jdf.queryExecution().executedPlan().toString().count("array_intersect") == 1
    assert sorted((r.query_id, r.id, r.rerank_score, r.relevance_rank) for r in kept.collect()) == [(1, 1, 0.5, 2), (1, 2, 1.0, 1)]
    assert fusion.rerank(df, F.when(F.col("id") == 2, 0.9), 3, 0.02).count() == 1
