"""Query variants and source lists that models give in odd shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import needs_condensing


def variants(query: Column, rewrites: Column, passage: Column, most: int = 3) -> Column:
    """The query, at most ``most`` rewrites that differ from it, and a hypothetical passage if any."""
    more = F.slice(F.filter(rewrites, lambda r: (F.trim(r) != "") & (r != query)), 1, most)
    return F.concat(F.array(query), F.coalesce(more, F.array().cast("array<string>")), F.when(F.coalesce(passage, F.lit("")) != "", F.array(passage)).otherwise(F.array().cast("array<string>")))


def source_numbers(reply: Column, n: Column) -> Column:
    """Passage numbers in a reply's source list (a JSON list, a number or text), each once, within
    1 to ``n``; if there are none, the first three."""
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), r"\b(true|false|null)\b", "")
    listed = F.when(F.trim(reply).startswith("{"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(bare, F.lit(r"\d+"), F.lit(0)))
    valid = F.array_distinct(F.filter(F.transform(listed, lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x >= 1) & (x <= n)))
    first = F.when(n > 0, F.sequence(F.lit(1), F.least(F.lit(3), n))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(valid) > 0, valid).otherwise(first)


def condensed(question: Column, rewrite: Column, has_history: Column) -> Column:
    """The rewrite of a question, if there is a history and the rewrite is of a plausible length."""
    return F.when(has_history & (F.length(F.trim(rewrite)) > 3) & (F.length(rewrite) < 400), F.trim(rewrite)).otherwise(question)


def asked(questions: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, variant, text): what is searched for each question (query_id, text). A question that leans on
    what was said before is taken in its ``condensed`` form if it has a ``history``; variant 0 is that, then its
    ``rewrites``, then a hypothetical ``passage``. All of these columns may be missing or null."""
    known = dict(questions.dtypes)
    given = lambda name, kind: F.col(name) if name in known else F.lit(None).cast(kind)
    leans = needs_condensing(F.col("text")) & F.coalesce(given("history", "boolean"), F.lit(False))
    own = F.coalesce(condensed(F.col("text"), F.coalesce(given("condensed", "string"), F.lit("")), leans), F.lit(""))
    rows = questions.select("query_id", own.alias("own"), F.coalesce(given("rewrites", "array<string>"), F.array().cast("array<string>")).alias("rewrites"), given("passage", "string").alias("passage"))
    return rows.select("query_id", F.posexplode(variants(F.col("own"), F.col("rewrites"), F.col("passage"), most)).alias("variant", "text"))


def keyed(rows: DataFrame) -> DataFrame:
    """With one key for a question and a variant, by which they are searched all at once."""
    return rows.withColumn("asked", F.concat_ws(":", F.col("variant").cast("string"), F.col("query_id").cast("string")))


def unkeyed(rows: DataFrame, kind: str) -> DataFrame:
    """The question, of its type, and the variant again."""
    at = F.instr("asked", ":")
    return rows.withColumns({"variant": F.substring("asked", F.lit(1), at - 1).cast("int"), "query_id": F.substring("asked", at + 1, F.length("asked")).cast(kind)}).drop("asked")
