"""Language ID: a plain compressor says the same, long texts stay, letter noise goes."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from lectern.llm import language_id, queries
from lectern.llm.common import fold


@pytest.fixture(scope="module")
def labelled(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def model(labelled):
    return language_id.fit(labelled.where(fold(F.col("doc_id")) != 0))


def plain(text, model):
    """The language of fewest bytes, by one new compressor for every segment."""
    if not text or not any(map(str.isalpha, text)):
        return "und"
    sizes = []
    for _, content in model:
        total = 0
        for i in range(0, len(text.lower()), 8192):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z = zstandard.ZstdCompressor(dict_data=d, level=6, write_content_size=False, write_dict_id=False, write_checksum=False)
            total += len(z.compress(text.lower()[i : i + 8192].encode()))
        sizes.append(total)
    return model[sizes.index(min(sizes))][0]


def test_query_equals_a_plain_compressor(spark, data, labelled, model):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, data).collect()}
    rows = labelled.select("doc_id", "text", "lang", (fold(F.col("doc_id")) == 0).alias("h")).collect()
    assert len(got) == len(rows)
    for r in rows:
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (r.h, plain(r.text, model)) and 0 <= got[r.doc_id].score <= 1
    held = [r for r in rows if r.h and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_long_texts_are_kept(labelled, model):
    judge = language_id.Classifier(model, language_id.Settings())
    for lang, _ in model:
        text = "\n".join(r.text for r in labelled.where(F.col("lang") == lang).collect())
        found = judge(text * (8_000_000 // len(text) + 1))
        assert found[0] == lang and not found[3]


def test_letter_noise_is_rejected_and_labelled_rows_stay(labelled, model):
    r = random.Random(12)
    judge = language_id.Classifier(model, language_id.Settings())
    for length, most in ((500, 0.35), (1500, 0.15), (3000, 0.05)):
        noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(length)) for _ in range(100)]
        assert sum(not judge(t)[3] for t in noise) <= 100 * most
    rows = labelled.where("lang is not null and length(text) > 100").collect()
    assert sum(judge(x.text)[3] for x in rows) <= 0.02 * len(rows)


def test_empty_table(spark, labelled, model):
    assert labelled.limit(0).select(language_id.judge(F.col("text"), model)).count() == 0
    assert language_id.fit(labelled.limit(0)) == []
