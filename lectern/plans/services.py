"""Queries of sources, streams, blueprints and reply shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import passage_key
from lectern.operators import evaluation, ingest, variants
from lectern.plans.tables import table
from lectern.sources.scratch import scratch_folder
from lectern.sources.index_store import IndexStore, books_of, chapters_of
from lectern.streaming.ingest import ingest_available


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown: every fifth begins with a heading of a level that follows its id."""
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" Title\n"), "text")).otherwise(F.col("text"))
    made = ingest.text_blocks(table(spark, d, "documents").select(F.col("doc_id").alias("path"), t.alias("text")))
    return made.groupBy("path").agg(F.count("*").alias("blocks"), F.max("level").alias("level"), F.sum(F.length("text")).alias("chars"), F.max("size").alias("size"))


def chapters_per_book(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("lang").alias("chapter"), F.col("doc_id").alias("ordinal"))
    return chapters_of(rows).select("book", F.array_join("chapters", ", ").alias("chapters"))


def index_generations(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of an index saved; the books of the one in force."""
    store = IndexStore(spark, scratch_folder(spark))
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").cast("int").alias("page_start"), F.col("doc_id").cast("int").alias("page_end"))
    store.save(docs.where(F.col("book") == "src0"), {"embedding_model": "none"})
    store.save(docs, {"embedding_model": "none"})
    return books_of(store.load("none")[0])


def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Two books come again, with their even documents only, and replace the old ones."""
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), "doc_id")
    again = docs.where(F.col("book").isin("src2", "src5")).where("doc_id % 2 = 0")
    return ingest.merge_index(docs, again).groupBy("book").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All documents through the stream in three parts: the passages that the index has then."""
    root, docs = scratch_folder(spark), table(spark, d, "documents").select("doc_id", "text")
    for k in range(3):
        docs.where(F.pmod("doc_id", F.lit(3)) == k).write.mode("append").parquet(f"{root}/in")
        ingest_available(spark, spark.readStream.schema("doc_id bigint, text string").parquet(f"{root}/in"), f"{root}/index", f"{root}/state")
    return spark.read.parquet(f"{root}/index").select(passage_key(F.col("text")).alias("passage"))


def page_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of pages against the pages that a gold case names."""
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 90).alias("a"), (F.col("doc_id") % 90 + F.col("doc_id") % 7).alias("b"))
    return rows.select("doc_id", evaluation.pages_overlap(F.col("a"), F.col("b"), F.array(F.lit(3), F.lit(40), F.lit(41))).alias("hit"))


def gold_round_robin(spark: SparkSession, d: str) -> DataFrame:
    drawn = evaluation.round_robin(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book")), 45)
    return drawn.select("id", "book", F.col("turn").cast("long").alias("turn"))


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as queries; rewrites are cut from the item, one equal to it, one blank."""
    t = F.col("text")
    rewrites = F.array(t, F.concat(F.lit("say "), t), F.lit(" "), F.lower(t), F.concat(t, F.lit("?")), F.lit("more"))
    made = variants.variants(t, rewrites, F.when(F.col("item_id") % 2 == 0, F.lit("a passage")), 3)
    return table(spark, d, "benchmark").select("item_id", F.size(made).alias("n"), F.element_at(made, 2).alias("second"), F.element_at(made, -1).alias("last"))


QUERIES = {f.__name__: f for f in (text_blocks, chapters_per_book, index_generations, index_refresh, incremental_ingest, page_overlap, gold_round_robin, query_variants)}
ORACLE_SQL = {
    "gold_round_robin": "select doc_id as id, source as book, row_number() over (partition by source order by md5('7:' || doc_id), doc_id) as turn from documents order by turn, book limit 45",
    "text_blocks": r"""
with d as (select doc_id as path, case when doc_id % 5 = 0 then repeat('#', (doc_id % 4 + 1)::int) || ' Title' || chr(10) || text else text end as t from documents),
l as (select path, unnest(string_split(t, chr(10))) as line from d),
b as (select path, length(regexp_extract(line, '^(#{1,4})\s+', 1)) as n, trim(regexp_replace(line, '^#{1,4}\s+', ''), ' ') as text from l where trim(line, ' ') <> '')
select path, count(*) as blocks, max(case when n > 0 then n end)::int as level, sum(length(text))::bigint as chars, max(case when n > 0 then 20.0 - 2 * (n - 1) else 11.0 end)::double as size from b group by 1""",
    "chapters_per_book": "with c as (select source as book, lang, min(doc_id) as f from documents group by 1, 2) select book, string_agg(lang, ', ' order by f) as chapters from c group by 1",
    "index_generations": "select source as book, count(*) as n_chunks, min(doc_id)::int as first_page, max(doc_id)::int as last_page from documents group by 1",
    "index_refresh": "select source as book, count(*) as n, sum(doc_id)::bigint as ids from documents where source not in (select source from documents where source in ('src2', 'src5') and doc_id % 2 = 0) or doc_id % 2 = 0 group by 1",
    "incremental_ingest": "select distinct sha1(trim(regexp_replace(lower(text), '[\\s\\x{00A0}]+', ' ', 'g'))) as passage from documents",
    "page_overlap": "select doc_id, len(list_filter([3, 40, 41], lambda p: p between doc_id % 90 and doc_id % 90 + doc_id % 7)) > 0 as hit from documents",
    "query_variants": """with r as (select item_id, text, [x for x in ['say ' || text, lower(text), text || '?', 'more'] if x <> text][1:3] as r from benchmark)
select item_id, (1 + len(r) + (item_id % 2 = 0)::int)::int as n, r[1] as second, case when item_id % 2 = 0 then 'a passage' else r[-1] end as last from r""",
}
