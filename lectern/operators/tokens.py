"""Token counts by byte-pair merging, over a table of ranks that the caller names.

A text is split into words by a pattern; a word's bytes are merged pair by pair, the pair of least rank
first, until no pair has one. Words repeat, so each distinct word of the corpus is merged once, and its count
joined back to the words of each text, which are counted first.

Defined cases. Null or empty text: no tokens. A byte that the table has no rank for is a token of its own. Empty
table: empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern by which the public byte-level vocabularies split a text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A table of ranks goes to all tasks, so its size is checked.
MOST_RANKS = 1_000_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A table of lines of a base64 token and its rank."""
    rows = spark.read.text(path).where("value <> ''").limit(MOST_RANKS + 1).collect()
    if len(rows) > MOST_RANKS:
        raise ValueError(f"{path}: more than {MOST_RANKS} ranks")
    return {base64.b64decode(token): int(rank) for token, rank in (r["value"].split() for r in rows)}


def merged(word: bytes, ranks: Mapping[bytes, int]) -> list[bytes]:
    """The tokens of a word."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        pairs = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        least = min(((r, i) for r, i in pairs if r is not None), default=None)
        if least is None:
            break
        i = least[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def token_counts(texts: DataFrame, ranks: Mapping[bytes, int], key: str = "doc_id", text: str = "text", pattern: str = WORDS) -> DataFrame:
    """(key, tokens) for each row of ``texts``; keys should differ."""

    @F.pandas_udf("int")
    def count(words: pd.Series) -> pd.Series:
        return words.map(lambda w: len(merged(w.encode(), ranks)))

    words = F.regexp_extract_all(F.col(text), F.lit(f"(?U){pattern}"), F.lit(0))
    rows = texts.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("times"))
    sizes = rows.select("word").distinct().withColumn("size", count("word"))
    sums = rows.join(sizes, "word").groupBy(key).agg(F.sum(F.col("times") * F.col("size")).alias("tokens"))
    return texts.select(key).join(sums, key, "left").select(key, F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))
