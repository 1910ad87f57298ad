"""The whole path of an answer, over the turns of conversations: condensing, search, context, gate, reply, checks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import engine
from lectern.config import Config
from lectern.functions import text as T
from lectern.functions.text import citation
from lectern.operators import answer
from lectern.plans.search import BUDGET, CHUNKS, NEAR, bm25_sql
from lectern.plans.tables import table

#: How prompts to condense, and to judge claims, begin. Texts rather than modules, as the model goes to the tasks.
REWRITE, JUDGE = engine.CONDENSE[:20], answer.CLAIMS[:20]
SETTINGS = {"retrieve.max_context_tokens": 1500, "rerank.min_score": 0.2, "grounding.answer_threshold": 0.62}


def _model():
    """A stand-in for a model: it condenses by the first words of the talk, and says what the length of a question
    decides, so that each rung of the checks is met."""

    def say(prompt: str) -> str:
        talk, _, question = prompt.rpartition("\n\nQUESTION\n")
        if prompt.startswith(REWRITE):
            return " ".join([*talk.partition("CONVERSATION\n")[2].split()[:5], question])
        if prompt.startswith(JUDGE):
            said = prompt.rpartition("\n\nSTATEMENTS\n")[2]
            return json.dumps({"verdicts": [{"id": int(n), "supported": "nobody" not in rest} for n, rest in re.findall(r"^(\d+)\. (.*)$", said, re.MULTILINE)]})
        return ("It is so, as the passage says [1].", "NOT_IN_SOURCE", "It is so [99].", "Nothing is cited here at all.", "Something that nobody supports [1].")[len(question) % 5]

    return say


def conversation_answers(spark: SparkSession, d: str) -> DataFrame:
    """All turns of users, answered from the documents."""
    turns = answer.history(table(spark, d, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", "history")
    docs = table(spark, d, "documents")
    ordinal = F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("book_id"), ordinal.alias("ordinal"), "text")
    chunks = chunks.withColumn("citation", citation(F.col("book_id"), F.lit(""), F.lit(""), F.col("ordinal"), F.col("ordinal")))
    out = engine.ask(turns, chunks, Config().with_overrides(SETTINGS), _model)
    return out.select("query_id", F.md5("searched").alias("searched_md5"), "outcome", "answer", "sources")


TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
SQL = rf"""
with talk as (select conv_id * 1000 + turn as query_id, role, text, coalesce(string_agg(role || ': ' || substring(text, 1, 400), chr(10)) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding), '') as history from conversations),
lean as (select *, history <> '' and (len(regexp_extract_all(trim(text), '\S+')) <= 3 or regexp_matches(trim(text), '{T.NEEDS_HISTORY.replace("'", "''")}')) as leans,
                array_to_string(regexp_split_to_array(trim(history), '\s+')[1:5], ' ') || ' ' || text as reply from talk where role = 'user'),
said as (select query_id, text, case when leans and length(trim(reply)) > 3 and length(reply) < 400 then trim(reply) else text end as searched from lean),
qs as (select query_id as item_id, searched as text from said),
{bm25_sql(40).replace("benchmark", "qs")},
scored as (select query_id, top.doc_id, rank, len(list_intersect({TERMS.format("qs.text")}, {TERMS.format("d.text")}))::double / nullif(len({TERMS.format("qs.text")}), 0) as overlap
           from top join qs on qs.item_id = query_id join documents d on d.doc_id = top.doc_id where rank <= 12),
placed as (select query_id, doc_id, overlap as score, row_number() over (partition by query_id order by overlap desc, rank) as place from scored where overlap >= 0.2 and overlap > 0),
best as (select query_id, doc_id, score, place as rank from placed where place <= 8),
{CHUNKS}, {NEAR.replace("from top join", "from best join").replace("top.doc_id", "best.doc_id")}, {BUDGET},
good as (select query_id, max(score) >= 0.62 as enough from best group by 1),
kept as (select distinct h.query_id from h join s on s.query_id = h.query_id and s.id = h.id),
named as (select query_id, citation from s where number = 1),
fin as (select said.*, coalesce(enough, false) and kept.query_id is not null as answered, length(said.text) % 5 as rule, citation from said left join good using (query_id) left join kept using (query_id) left join named using (query_id))
select query_id, md5(searched) as searched_md5,
       case when not answered then 'refused' when rule = 0 then 'accepted' when rule = 1 then 'not_in_source' when rule = 2 then 'invalid_citation' when rule = 3 then 'no_citation' else 'failed_claim' end as outcome,
       case when answered and rule = 0 then 'It is so, as the passage says [1].' end as answer, case when answered and rule = 0 then '[1] ' || citation end as sources
from fin
"""
QUERIES = {"conversation_answers": conversation_answers}
ORACLE_SQL = {"conversation_answers": SQL}
