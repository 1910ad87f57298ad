"""Byte-pair counts against public tokenizers."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import context, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_counts_equal_the_public_encoder(spark, data, name):
    ranks = tokens.read_ranks(spark, f"file://{public_tokenizers.path(name)}")
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    odd = ["", None, " ", "\n\n  x", "it's we'll I'M", "naïve Ünïcode 日本語 123٣4", "a b c  ", "😀😀 family 👨‍👩‍👧", "x" * 500, "<|endoftext|>", "tab\t\tend "]
    odd += ["".join(r.choice("ab 'sé\n\t1.") for _ in range(60)) for _ in range(40)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60).collect()] + list(enumerate(odd, 10**6))
    got = dict(map(tuple, tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), ranks).collect()))
    assert got == {i: len(encoder.encode_ordinary(t or "")) for i, t in rows}


def test_bytes_without_a_rank_stand_alone():
    assert tokens.merged(b"abcab", {b"ab": 1, b"abc": 0, b"bc": 2}) == [b"abc", b"ab"]
    assert tokens.merged(b"", {}) == [] and tokens.merged(b"zz", {}) == [b"z", b"z"]


def test_budgets_take_counts(spark):
    """A budget in tokens of the caller's own counting."""
    rows = spark.createDataFrame([(1, i, False, 1.0 / i, "word " * 40, "c", 7) for i in range(1, 5)], "query_id long, position long, is_neighbor boolean, score double, text string, citation string, tokens long")
    assert context.select_within(rows, 30).count() == 1
    assert context.select_within(rows.drop("tokens"), 30, cost=F.lit(7)).count() == 2


def test_empty(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), {}).count() == 0
