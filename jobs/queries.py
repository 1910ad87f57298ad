"""The jobs as registered queries: each is run twice over the whole tables into a new folder, and what stands
there after the second run is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import library_refresh, retrieval_report
from lectern.plans.search import bm25_sql
from lectern.sources.scratch import scratch_folder


def job1_library_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    for _ in range(2):
        out = library_refresh.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/library", f"{folder}/checkpoint")
    return out


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    for _ in range(2):
        out = retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return out


JOB1_SQL = r"""
with d as (select coalesce(source, '') || '/' || coalesce(doc_id::varchar, '') as path, sha256(text) as sha, text from documents where text is not null),
l as (select path, max(sha) as sha, any_value(text) as text from d group by path),
f as (select sha, min(path) as path, count(*) as n_paths, any_value(text) as text from l group by sha),
n as (select sha, length(trim(unnest(string_split(text, chr(10))), ' ')) as n from f),
q as (select sha, list_sort(list(n))[count(*) // 2 + 1] as median_len, avg((n <= 3)::int) as fragments, sum(n) as chars from n where n > 0 group by 1),
b as (select sha, path, n_paths, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from f
      where sha in (select sha from q where chars >= 100 and median_len >= 12 and fragments <= 0.35)),
h as (select *, nullif(length(regexp_extract(line, '^(#{1,4})\s+', 1)), 0) as level, trim(regexp_replace(line, '^#{1,4}\s+', ''), ' ') as text from b where trim(line, ' ') <> '')
select path, sha, n_paths, line_no::int as line_no, text, level::int as level, greatest(1, length(text) // 4)::int as tokens from h
"""
JOB2_SQL = rf"""
with {bm25_sql(12)},
s as (select query_id, top.doc_id, source, rank, score,
             round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), regexp_extract_all(lower(d.text), '[a-z0-9]+')))::double
                   / greatest(1, len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')))), 6) as overlap,
             trim(b.text) <> '' and contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g'))) as answers
      from top join benchmark b on b.item_id = query_id join documents d on d.doc_id = top.doc_id),
k as (select query_id, doc_id, row_number() over (partition by query_id order by overlap desc, rank) as relevance_rank from s where overlap >= 0.3 qualify relevance_rank <= 8)
select s.*, relevance_rank, 'bm25' as run, case when count(relevance_rank) over (partition by s.query_id) > 0 then 'answered' else 'refused' end as outcome
from s left join k using (query_id, doc_id)
"""
QUERIES = {"job1_library_refresh": job1_library_refresh, "job2_retrieval_report": job2_retrieval_report}
ORACLE_SQL = {"job1_library_refresh": JOB1_SQL, "job2_retrieval_report": JOB2_SQL}
