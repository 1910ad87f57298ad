"""Queries of answer checks, JSON repair and question clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answer
from lectern.plans.tables import table


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant messages as answers, with markers put in by rule so that every rung of the
    ladder is met, and a reply that only looks like a refusal; three passages are on offer, two of
    them with the same label."""
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    key = (F.col("conv_id") * 100 + F.col("turn")).alias("answer_id")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8))
    body = F.col("text")
    raw = (
        F.when(k == 0, F.concat(body, F.lit(" [1]. And more [2, 3].")))
        .when(k == 1, F.concat(F.lit("NOT_IN_SOURCE: "), body))
        .when(k == 2, F.concat(body, F.lit(" [1; 9].")))
        .when(k == 3, body)
        .when(k == 4, F.concat(body, F.lit(" [2].\n\nA plain second part without any marker at all.")))
        .when(k == 5, F.concat(F.lit("It is given by:\n\n$x$\n\nso "), body, F.lit(" [3].")))
        .when(k == 6, F.concat(F.lit("NOT IN SOURCE is what others say of it.\n- Or this:\n"), body, F.lit("\n[1]")))
        .otherwise(F.concat(body, F.lit(" [2][1]")))
    )
    return rows.select(key, k.alias("k"), raw.alias("raw"), F.array(F.lit("A, p.1"), F.lit("B, p.2"), F.lit("A, p.1")).alias("citations"))


RAW = r"""
a as (select conv_id * 100 + turn as answer_id, (conv_id + turn) % 8 as k, text as body from conversations where role = 'assistant'),
r as (select answer_id, k, case k when 0 then body || ' [1]. And more [2, 3].' when 1 then 'NOT_IN_SOURCE: ' || body when 2 then body || ' [1; 9].' when 3 then body
      when 4 then body || ' [2].' || chr(10) || chr(10) || 'A plain second part without any marker at all.'
      when 5 then 'It is given by:' || chr(10) || chr(10) || '$x$' || chr(10) || chr(10) || 'so ' || body || ' [3].'
      when 6 then 'NOT IN SOURCE is what others say of it.' || chr(10) || '- Or this:' || chr(10) || body || chr(10) || '[1]' else body || ' [2][1]' end as raw from a),
n as (select answer_id, k, raw, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(raw, '\[\d+(?:\s*[,;]\s*\d+)*\]'), lambda g: list_transform(regexp_extract_all(g, '\d+'), lambda x: x::int))))) as cited from r)"""


def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)
    return rows.select("answer_id", F.array_join(F.transform(T.cited_numbers(F.col("raw")), lambda n: n.cast("string")), ",").alias("cited"), F.size(T.uncited_sentences(F.col("raw"))).alias("uncited"))


def cited_passages(spark: SparkSession, d: str) -> DataFrame:
    return answer.cited_labels(_answers(spark, d))


def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    return answer.sources(_answers(spark, d))


def answer_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).withColumn("claims_ok", F.col("answer_id") % 3 != 0)
    return rows.select("answer_id", answer.verdict(F.col("raw"), F.lit(3), F.col("claims_ok")).alias("verdict"))


def answer_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents as retrieval results: the id makes the score, blank contexts and misses."""
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5 != 0).alias("grounded"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("text")).alias("context"), F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 20) / 100).alias("score"))
    return rows.select("doc_id", answer.gate(F.col("grounded"), F.col("context"), F.col("score")).alias("answered"))


def statement_cover(spark: SparkSession, d: str) -> DataFrame:
    made = answer.statements(_answers(spark, d))
    return made.select("answer_id", "id", "statement", F.array_join(F.transform("cites", lambda n: n.cast("string")), ",").alias("cites"))


def claim_check(spark: SparkSession, d: str) -> DataFrame:
    """Statements are the turns of a conversation; verdicts are missing, doubled or odd by rule."""
    conv = table(spark, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("id"))
    k = F.pmod(F.col("answer_id") * 7 + F.col("id") * 3, F.lit(41))
    says = F.when(k == 0, F.array(F.lit("true"), F.lit("false"))).when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("yes"))).when(k == 3, F.array(F.lit(" TRUE "))).when(k == 4, F.array(F.lit("true"), F.lit("true"))).otherwise(F.array(F.lit("true")))
    return answer.claims_supported(conv, conv.select("answer_id", "id", F.explode(says).alias("supported")))


def needs_condense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.needs_condensing(F.col("text")).alias("needs_condensing"))


def history_window(spark: SparkSession, d: str) -> DataFrame:
    return answer.history(table(spark, d, "conversations")).select("conv_id", "turn", "history")


QUERIES = {f.__name__: f for f in (citation_parse, cited_passages, answer_sources, answer_verdict, answer_gate, statement_cover, claim_check, needs_condense, history_window)}
ORACLE_SQL = {
    "citation_parse": rf"""with {RAW},
s as (select answer_id, unnest(string_split(regexp_replace(regexp_replace(raw, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))) as s from n),
b as (select answer_id, trim(regexp_replace(trim(s), '^[-*\x{{2022}} ]+', '')) as s from s),
u as (select answer_id, count(*) as c from b where len(regexp_split_to_array(s, '\s+')) >= 6 and not regexp_matches(s, ':$|^#') and not regexp_matches(s, '\[\d+(?:\s*[,;]\s*\d+)*\]') group by 1)
select answer_id, array_to_string(cited, ',') as cited, coalesce(c, 0)::int as uncited from n left join u using (answer_id)""",
    "cited_passages": f"with {RAW}, c as (select answer_id, unnest(cited) as n from n) select answer_id, n, ['A, p.1', 'B, p.2', 'A, p.1'][n] as label from c where n between 1 and 3",
    "answer_sources": f"""with {RAW}, c as (select answer_id, unnest(case when len(list_filter(cited, lambda x: x between 1 and 3)) > 0 then list_filter(cited, lambda x: x between 1 and 3) else [1, 2, 3] end) as n from n),
l as (select answer_id, ['A, p.1', 'B, p.2', 'A, p.1'][n] as label, string_agg('[' || n || ']', '' order by n) as m, min(n) as f from c group by 1, 2)
select answer_id, string_agg(m || ' ' || label, chr(10) order by f) as sources from l group by 1""",
    "answer_verdict": f"""with {RAW} select answer_id, case when regexp_matches(raw, '(?i)^\\s*NOT_IN_SOURCE') then 'not_in_source'
when len(list_filter(cited, lambda x: x < 1 or x > 3)) > 0 then 'invalid_citation' when len(cited) = 0 then 'no_citation' when answer_id % 3 = 0 then 'failed_claim' else 'accepted' end as verdict from n""",
    "statement_cover": rf"""with {RAW},
p as (select answer_id, unnest(l) as p, generate_subscripts(l, 1) as par from (select answer_id, regexp_split_to_array(trim(raw, ' ' || chr(10)), '\n\s*\n') as l from n)),
q as (select answer_id, par, unnest(l) as q, generate_subscripts(l, 1) as nth from (select answer_id, par, string_split(regexp_replace(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) as l from p)),
c as (select *, nullif(list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(q, '\[\d+(?:\s*[,;]\s*\d+)*\]'), lambda g: regexp_extract_all(g, '\d+'))), lambda x: x::int))), []) as own,
      trim(regexp_replace(trim(regexp_replace(regexp_replace(q, '\[\d+(?:\s*[,;]\s*\d+)*\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g')), '^[-*\x{{2022}}#> ]+', '')) as body from q),
l as (select *, own is null and body like '%:' as lead from c),
g as (select *, count(case when body <> '' and not lead then 1 end) over (partition by answer_id order by par, nth rows between unbounded preceding and 1 preceding) as g from l),
w as (select *, string_agg(case when lead then body end, ' ') over (partition by answer_id, g order by par, nth rows between unbounded preceding and 1 preceding) as leads,
      coalesce(first_value(own ignore nulls) over (partition by answer_id, par order by nth rows between current row and unbounded following), last_value(own ignore nulls) over (partition by answer_id, par order by nth rows unbounded preceding),
               first_value(own ignore nulls) over (partition by answer_id order by par, nth rows between current row and unbounded following), last_value(own ignore nulls) over (partition by answer_id order by par, nth rows unbounded preceding), []) as cites from g),
s as (select answer_id, par, nth, own, cites, concat_ws(' ', leads, body) as statement from w where body <> '' and not lead)
select answer_id, row_number() over (partition by answer_id order by par, nth)::int as id, statement, array_to_string(cites, ',') as cites from s
where case when own is not null then regexp_matches(statement, '[\p{{L}}\p{{N}}]') else contains(statement, '$') or contains(statement, chr(92)) or len(regexp_split_to_array(statement, '\s+')) >= 4 end""",
    "answer_gate": "select doc_id, doc_id % 5 <> 0 and trim(case when doc_id % 7 = 0 then ' ' else text end) <> '' and coalesce(case when doc_id % 11 <> 0 then (doc_id % 20) / 100.0 end, -1e9)::double >= 0.05 as answered from documents",
    "claim_check": """with s as (select conv_id as answer_id, (conv_id * 7 + turn * 3) % 41 as k from conversations)
select answer_id, bool_and(k not in (0, 1, 2)) as claims_ok, count(case when k in (0, 1, 2) then 1 end) as n_failed from s group by 1""",
    "needs_condense": rf"""select conv_id, turn, len(regexp_extract_all(trim(text), '\S+')) <= 3 or regexp_matches(trim(text), '{T.NEEDS_HISTORY.replace("'", "''")}') as needs_condensing from conversations where role = 'user'""",
    "history_window": """with h as (select conv_id, turn, role, string_agg(role || ': ' || substring(text, 1, 400), chr(10)) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding) as history from conversations)
select conv_id, turn, coalesce(history, '') as history from h where role = 'user'""",
}
