"""Queries of exam papers, past-paper profiles and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import attempt_from_instructions, furniture_form, safe_stem, section_label
from lectern.operators import evaluation, paper
from lectern.plans.tables import table

LEVELS = paper.BLOOM_LEVELS


def bloom_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Languages as papers: their documents by source number make the weights of the levels. Each
    source is a paper too, of which the odd ones name no level that is known."""
    names = F.array(*map(F.lit, (*LEVELS, "unknown")))
    mix = table(spark, d, "documents").groupBy(F.col("lang").alias("paper"), F.pmod(F.substring("source", 4, 9).cast("int"), F.lit(7)).alias("seq")).agg(F.count("*").alias("weight")).select("paper", F.get(names, "seq").alias("level"), "weight", "seq", F.lit(17).alias("slots"))
    own = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("weight")).select(F.col("source").alias("paper"), F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "apply").otherwise("recall").alias("level"), "weight", F.lit(0).alias("seq"), F.lit(9).alias("slots"))
    return paper.allocate_levels(mix.unionByName(own))


def marks_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions: the last digit of the id makes the marks."""
    mix = F.explode(paper.mix_for_marks(F.col("doc_id") % 10)).alias("level", "share")
    return table(spark, d, "documents").select("doc_id", mix)


def past_profile(spark: SparkSession, d: str) -> DataFrame:
    """Languages as past papers, documents as their questions: how often what occurs."""
    rows = paper.profile(_by_language(spark, d))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("profile", *[text(c).alias(c) for c in ("topics", "verbs", "marks", "levels")])


def priority_topics(spark: SparkSession, d: str) -> DataFrame:
    return paper.priority_topics(_by_language(spark, d), 5)


def _by_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    level = F.get(F.array(*map(F.lit, LEVELS)), F.col("n_chars") % 6)
    return docs.select(F.col("lang").alias("profile"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("topic"), F.when(F.col("doc_id") % 2 == 0, "Explain").otherwise("explain").alias("verb"), (F.col("doc_id") % 4).alias("marks"), level.alias("bloom"))


def topic_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("chapter"), F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.col("lang")).alias("section"), F.lit("").alias("title"), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).alias("token_count"), F.col("doc_id").alias("pos"))
    return paper.topic_weights(rows, 12)


def topic_pool(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.groupBy(F.upper("lang").alias("topic")).agg(F.min("doc_id").alias("seq"))
    chapters = docs.groupBy("lang").agg(F.min("doc_id").alias("seq")).select(F.col("lang").alias("topic"), "seq").unionByName(docs.groupBy(F.col("source").alias("topic")).agg(F.min("doc_id").alias("seq")).select("topic", "seq"))
    return paper.topic_pool(asked, chapters)


def topic_pick(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pool = docs.groupBy(F.col("lang").alias("paper"), F.col("source").alias("topic")).agg(F.min("doc_id").alias("seq")).withColumn("part", F.lit(0))
    slots = docs.select(F.col("lang").alias("paper"), F.col("doc_id").alias("slot"))
    return paper.pick_topics(slots, pool)


def section_marks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q = li.select(F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("section"), F.col("l_linenumber").alias("number"), F.col("l_quantity").cast("long").alias("marks"))
    sections = q.select("paper", "section").distinct().withColumn("attempt", attempt_from_instructions(F.when(F.col("section") == "A", "Answer ANY TWO.").when(F.col("section") == "R", "Attempt any 1 question").otherwise("Write all.")))
    return paper.section_marks(q, sections)


def question_dedup(spark: SparkSession, d: str) -> DataFrame:
    """All documents as questions: among them are copies and near copies."""
    return paper.near_duplicate_questions(table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text"))


def _past(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 12).alias("paper"), (F.col("o_custkey") % 3).alias("profile"), (F.col("o_orderkey") % 4 + 1).alias("marks"), F.col("o_orderstatus").alias("type"), F.lower("o_orderpriority").alias("verb"), F.col("o_orderkey").alias("seq"))


def pyq_profile(spark: SparkSession, d: str) -> DataFrame:
    return paper.frequencies(_past(spark, d), "verb")


def pyq_bands(spark: SparkSession, d: str) -> DataFrame:
    return paper.bands(_past(spark, d))


def merge_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _past(spark, d).select(F.concat(F.lit("S"), (F.col("seq") % 23).cast("string")).alias("name"), F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("verb")).alias("instructions"), "type", (F.col("seq") % 4).alias("count"), F.when(F.col("seq") % 23 == 7, 0).otherwise(F.col("marks")).alias("marks"), "seq")
    return paper.merge_sections(rows)


def pyq_exemplars(spark: SparkSession, d: str) -> DataFrame:
    rows = _past(spark, d)
    return paper.exemplars(rows, "P", 9).select("seq", "type", "marks", "tier")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items and the place of the first document, by BM25, that contains them."""
    from lectern.plans.search import bm25_topk

    bench, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    hit = bm25_topk(spark, d).join(docs, "doc_id").join(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("item")), "query_id").where(F.contains("text", "item"))
    rank = hit.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return bench.select(F.col("item_id").alias("query_id")).join(rank, "query_id", "left")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.retrieval_metrics(_gold(spark, d).withColumn("refused", F.col("rank").isNull()), 10)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "hit_at_k", "mrr", "refusal_rate")])


def gold_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = _gold(spark, d)
    k = F.col("query_id")
    cases = g.select((k % 5 != 0).alias("answerable"), F.col("rank").isNotNull().alias("answered"), (k % 13 == 0).alias("error"), (k % 2 == 0).alias("reviewed"), (F.col("rank") == 1).alias("cited_hit"), F.col("rank").isNotNull().alias("context_hit"), F.when(k % 3 != 0, (k % 7) / 7).alias("keyword_recall"))
    return evaluation.gold_summary(cases)


def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Labels as claims of the case that is their document's hundred."""
    w = W.partitionBy(F.floor(F.col("doc_id") / 100)).orderBy("doc_id")
    rows = table(spark, d, "labels").select(F.row_number().over(w).alias("position"), (F.col("quality") == 1).alias("supported"), (F.floor(F.col("doc_id") / 100) % 7 == 3).alias("refused"), (F.floor(F.col("doc_id") / 100) % 5 != 4).alias("scored"))
    return evaluation.faithfulness(rows, 30)


def verdict_match(spark: SparkSession, d: str) -> DataFrame:
    """Labels twice, as claims and as verdicts: some renamed, some left out."""
    rows = table(spark, d, "labels").select(F.floor(F.col("doc_id") / 50).alias("case"), F.col("doc_id").alias("i"), F.concat(F.lit("Claim  "), F.col("doc_id").cast("string")).alias("claim"), "quality")
    made = rows.where("i % 9 <> 0 or case % 2 = 0").select("case", "i", F.when(F.col("i") % 4 == 0, F.lit("other")).otherwise(F.lower("claim")).alias("claim"), (F.col("quality") == 1).alias("supported"))
    return evaluation.match_verdicts(rows.select("case", "i", "claim"), made).where("claim is not null")


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.upper_quantile(table(spark, d, "events"), "value", 0.95, "event_type")


def labels_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sections = F.split(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat_ws("|", "lang", "source", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))), r"\|")
    return docs.select("doc_id", section_label(sections).alias("label"), safe_stem(F.concat(F.lit("."), "text")).alias("stem"), furniture_form(F.concat("source", F.lit(" P"), F.col("doc_id").cast("string"))).alias("form"))


PAST = "p as (select o_custkey % 12 as paper, o_custkey % 3 as profile, o_orderkey % 4 + 1 as marks, o_orderstatus as type, lower(o_orderpriority) as verb, o_orderkey as seq from orders)"
WORDS = ", ".join(f"'{w}'" for w in paper.STOP_VERBS)


def _gold_sql() -> str:
    from lectern.plans.search import bm25_sql

    return bm25_sql(10) + """,
h as (select query_id, min(rank) as rank from top join documents d on d.doc_id = top.doc_id join benchmark b on b.item_id = query_id where contains(d.text, b.text) group by 1),
g as (select item_id as query_id, rank from benchmark left join h on query_id = item_id)"""


QUERIES = {f.__name__: f for f in (bloom_allocation, marks_mix, past_profile, priority_topics, topic_weights, topic_pool, topic_pick, section_marks, question_dedup, pyq_profile, pyq_bands, merge_sections, pyq_exemplars, retrieval_metrics, gold_metrics, faithfulness, verdict_match, latency_p95, labels_text)}
ORACLE_SQL = {
    "bloom_allocation": f"""
with m as (select lang as paper, [{', '.join(f"'{x}'" for x in (*LEVELS, 'unknown'))}][substring(source, 4)::int % 7 + 1] as level, count(*) as weight, substring(source, 4)::int % 7 as seq from documents group by 1, 2, 4),
e as (select *, round(17 * weight::double / sum(weight) over (partition by paper), 9) as exact from m where level <> 'unknown'),
f as (select *, floor(exact) as whole, 17 - sum(floor(exact)) over (partition by paper) as rest, row_number() over (partition by paper order by exact - floor(exact) desc, seq) as place from e)
select paper, level, (whole + (place <= rest)::int)::bigint as n from f union all select distinct source, case when substring(source, 4)::int % 2 = 0 then 'apply' else 'understand' end, 9 from documents""",
    "marks_mix": """with m(low, high, level, share) as (values (0, 2, 'remember', 0.5), (0, 2, 'understand', 0.5), (3, 5, 'understand', 0.4), (3, 5, 'apply', 0.4), (3, 5, 'analyze', 0.2),
(6, 9, 'apply', 0.3), (6, 9, 'analyze', 0.4), (6, 9, 'evaluate', 0.2), (6, 9, 'create', 0.1)) select doc_id, level, share::double as share from documents join m on doc_id % 10 between low and high""",
    "past_profile": f"""with q as (select lang as profile, case when doc_id % 9 <> 0 then source end as topic, 'explain' as verb, doc_id % 4 as marks, [{', '.join(f"'{x}'" for x in LEVELS)}][n_chars % 6 + 1] as bloom from documents),
t as (select profile, topic as k, count(*) as n from q where topic is not null group by 1, 2), m as (select profile, marks::varchar as k, count(*) as n from q where marks <> 0 group by 1, 2),
b as (select profile, bloom as k, round(count(*) / sum(count(*)) over (partition by profile), 3) as n from q group by 1, 2), j as (select profile, count(*) as c from q group by 1)
select profile, (select string_agg(k || '=' || n, ',' order by k) from t where t.profile = j.profile) as topics, 'explain=' || c as verbs,
       (select string_agg(k || '=' || n, ',' order by k) from m where m.profile = j.profile) as marks, (select string_agg(k || '=' || n, ',' order by k) from b where b.profile = j.profile) as levels from j""",
    "priority_topics": """with t as (select lang as profile, source as topic, count(*) as n, min(doc_id) as f from documents where doc_id % 9 <> 0 group by 1, 2)
select profile, row_number() over (partition by profile order by n desc, f)::int as rank, topic, n from t qualify rank <= 5""",
    "topic_weights": """with t as (select coalesce(nullif(case when doc_id % 4 = 0 then '' else source end, ''), nullif(case when doc_id % 8 = 0 then '' else lang end, ''), '') as topic, greatest(1, n_chars // 4) as n, doc_id from documents),
s as (select topic, sum(n)::bigint as tokens, min(doc_id) as first from t group by 1 order by tokens desc, first limit 12) select topic, tokens from s where topic <> ''""",
    "topic_pool": """with a as (select upper(lang) as topic, min(doc_id) as seq from documents group by 1),
c as (select lang as topic, min(doc_id) as seq from documents group by 1 union all select source, min(doc_id) from documents group by 1)
select topic, seq, 0 as part from a union all select topic, seq, 1 from c where lower(topic) not in (select lower(topic) from a)""",
    "topic_pick": """with p as (select lang as paper, source as topic, min(doc_id) as seq from documents group by 1, 2),
n as (select *, row_number() over (partition by paper order by seq) - 1 as i, count(*) over (partition by paper) as size from p)
select n.paper, doc_id as slot, topic from documents join n on n.paper = lang and i = doc_id % size""",
    "section_marks": """with q as (select l_orderkey as paper, l_returnflag as section, l_linenumber as number, l_quantity::bigint as marks from lineitem),
r as (select *, row_number() over (partition by paper, section order by marks desc, number) as place from q)
select paper, section, sum(case when section = 'N' or place <= case section when 'A' then 2 else 1 end then marks end)::bigint as marks, count(*) as questions from r group by 1, 2""",
    "question_dedup": f"""with q as (select doc_id as qid, text as t from documents),
w as (select qid, t, list_distinct(list_filter(regexp_extract_all(lower(t), '[a-z]{{4,}}'), lambda x: x not in ({WORDS}))) as long, list_distinct(list_filter(regexp_extract_all(lower(t), '[a-z0-9]{{2,}}'), lambda x: x not in ({WORDS}))) as short from q),
k as (select qid, case when len(long) > 0 then long else short end as w, array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+'), ' ') as n from w),
g as (select qid, w, case when len(w) > 0 then array_to_string(list_sort(w), ' ') when n <> '' then '=' || n else '#' || qid end as key from k),
c as (select qid, w, min(qid) over (partition by key) as class_id from g),
r as (select qid, w from c where qid = class_id and len(w) > 0),
p as (select a.qid as a, b.qid as b from r a join r b on a.qid < b.qid and len(a.w) >= {paper.JACCARD} * len(b.w) and len(b.w) >= {paper.JACCARD} * len(a.w)
      where len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= {paper.JACCARD}),
l as (select x, count(*) as n from (select a as x from p union all select b from p) group by 1)
select qid, class_id, coalesce(n, 0) as n_links from c left join l on class_id = x""",
    "pyq_profile": f"with {PAST} select profile, verb, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by profile), 3) as share from p group by 1, 2",
    "pyq_bands": f"with {PAST}, n as (select paper, marks, type, count(*) as n from p group by 1, 2, 3) select marks, type, list_sort(list(n))[count(*) // 2 + 1] as count, count(*) as papers from n group by 1, 2",
    "merge_sections": f"""with {PAST}, s as (select 'S' || seq % 23 as name, case when seq % 5 = 0 then '' else verb end as instructions, type, seq % 4 as count, case when seq % 23 = 7 then 0 else marks end as marks, seq from p),
c as (select name, count from (select name, count, count(*) as c, min(seq) as s from s where count > 0 group by 1, 2) qualify row_number() over (partition by name order by c desc, s) = 1),
m as (select name, marks from (select name, marks, count(*) as c, min(seq) as s from s where marks > 0 group by 1, 2) qualify row_number() over (partition by name order by c desc, s) = 1),
h as (select name, arg_min(instructions, case when instructions <> '' then seq end) as instructions, arg_min(type, seq) as type from s group by 1)
select h.name, instructions, type, coalesce(count, 5)::bigint as count, coalesce(marks, 2)::bigint as marks from h left join c using (name) left join m using (name)""",
    "pyq_exemplars": f"with {PAST}, t as (select seq, type, marks, case when type = 'P' and marks = 9 then 1 when type = 'P' then 2 else 3 end as tier from p) select * from t where tier = (select min(tier) from t) order by seq limit 4",
    "retrieval_metrics": f"""with {_gold_sql()} select count(*) as n, round(avg(coalesce((rank <= 1)::int, 0)), 6) as hit_at_1, round(avg(coalesce((rank <= 3)::int, 0)), 6) as hit_at_3, round(avg(coalesce((rank <= 10)::int, 0)), 6) as hit_at_k,
round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr, round(avg((rank is null)::int), 6) as refusal_rate from g""",
    "gold_metrics": f"""with {_gold_sql()}, c as (select query_id % 5 <> 0 as a, rank is not null as answered, query_id % 13 = 0 as e, query_id % 2 = 0 as reviewed, rank = 1 as cited, case when query_id % 3 <> 0 then (query_id % 7) / 7.0::double end as kr from g)
select count(*) as n, count(case when e then 1 end) as errors, count(case when not reviewed then 1 end) as unreviewed, round(avg(case when not e and a then answered::int end), 6) as answer_rate, round(avg(case when not e and a then cited::int end), 6) as cited_page_hit,
round(avg(case when not e and a then answered::int end), 6) as context_page_hit, round(avg(case when not e and a then kr end), 6) as keyword_recall, round(avg(case when not e and not a then (not answered)::int end), 6) as correct_refusal_rate from c""",
    "faithfulness": """with c as (select row_number() over (partition by doc_id // 100 order by doc_id) as p, quality = 1 as s from labels qualify doc_id // 100 % 7 <> 3 and doc_id // 100 % 5 <> 4)
select count(case when p <= 30 then 1 end) as claims, count(case when p <= 30 and s then 1 end) as supported, count(case when p > 30 then 1 end) as truncated, round(count(case when p <= 30 and s then 1 end)::double / nullif(count(case when p <= 30 then 1 end), 0), 6) as faithfulness from c""",
    "verdict_match": """with c as (select doc_id // 50 as "case", doc_id as i, 'Claim  ' || doc_id as claim, quality from labels),
v as (select "case", i, case when i % 4 = 0 then 'other' else 'claim ' || i end as k, quality = 1 as s from c where i % 9 <> 0 or "case" % 2 = 0),
t as (select "case", k, arg_max(s, i) as s from v group by 1, 2), e as (select "case" from c group by 1 having count(*) = (select count(*) from v where v."case" = c."case"))
select c."case", c.i, c.claim, coalesce(t.s, case when c."case" in (select "case" from e) then v.s end) as supported from c left join t on t."case" = c."case" and t.k = 'claim ' || c.i left join v on v."case" = c."case" and v.i = c.i""",
    "latency_p95": "with e as (select event_type, list_sort(list(value)) as v, count(*) as n from events where value is not null group by 1) select event_type, n, v[least(n - 1, floor(n * 0.95)::bigint) + 1] as quantile from e",
    "labels_text": """with d as (select doc_id, text, source, list_distinct(list_filter(case when doc_id % 3 = 0 then [] when doc_id % 2 = 0 then [lang, source, lang] else [lang, source] end, lambda x: x <> '')) as s0, case when doc_id % 3 = 0 then '' else lang || ' – ' || source end as label from documents)
select doc_id, label, regexp_replace(regexp_replace('.' || text, '[^\\p{L}\\p{M}\\p{N}_.\\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as stem, lower(regexp_replace(source || ' P' || doc_id, '[0-9]', '#', 'g')) as form from d""",
}
