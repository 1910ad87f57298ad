"""Queries of odd shapes: formulas, questions, replies, options, verdicts and blueprints, made of the
rows of the tables by templates whose results are known; the SQL says what each template gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import render
from lectern.functions import text as T
from lectern.functions.replies import question_items as items_of
from lectern.functions.replies import reply_json
from lectern.operators import blueprint, evaluation, paper, variants
from lectern.plans.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with two of their words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    word = lambda n, other: F.coalesce(F.get(words, F.lit(n)), F.lit(other))
    return table(spark, d, "documents").select("doc_id", "lang", word(0, "heat").alias("u"), word(1, "work").alias("v"))


DOCS = "d as (select doc_id, lang, coalesce(regexp_extract_all(lower(text), '[a-z]{3,}')[1], 'heat') as u, coalesce(regexp_extract_all(lower(text), '[a-z]{3,}')[2], 'work') as v from documents)"


def _filled(template: str) -> Column:
    """The template with @u and @v filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("@u"), F.col("u")), F.lit("@v"), F.col("v"))


def _pick(templates: list, of: Column, make=_filled) -> Column:
    out = make(templates[-1])
    for k, t in enumerate(templates[:-1]):
        out = F.when(of % len(templates) == k, make(t)).otherwise(out)
    return out


def _sql(templates: list, of: str = "doc_id") -> str:
    """The same choice, for results."""
    quoted = lambda t: "null" if t is None else "replace(replace('" + t.replace("'", "''") + "', '@u', u), '@v', v)"
    return f"case {of} % {len(templates)} " + " ".join(f"when {k} then {quoted(t)}" for k, t in enumerate(templates)) + " end"


FORMULAS = {
    r"$\frac{T_{\text{@u}}}{T_{\text{@v}}}$": "(T_@u)/(T_@v)",
    r"$$E = @u_{@v} P^{+}$$": "E = @u_@v P^+",
    r"\left( @u \cdot @v \right) \times \Delta": "( @u * @v ) * Delta",
    "@u  plain \t  @v": "@u plain @v",
    r"\mathrm{d}@u = \dfrac{\mathrm{d}Q_{rev}}{@v}": "d@u = (dQ_rev)/(@v)",
    r"\text{\mathrm{\text{@u}}} @v": "@u @v",
}


def plain_math(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.plain_math(_pick(list(FORMULAS), F.col("doc_id"))).alias("plain"))


QUESTIONS = {
    "State the law of @u, as described in the passage.": ("State the law of @u.", True),
    "According to the text, what is @u?": ("What is @u?", True),
    "Create an expression for @v.": ("Derive an expression for @v.", False),
    "Remember the definition of @u.": ("State @u.", False),
    "Explain the cycle of @u discussed in Chapter 4.": ("Explain the cycle of @u.", False),
    "what is  @u of @v ?": ("What is @u of @v?", False),
}


def strip_sources(spark: SparkSession, d: str) -> DataFrame:
    asked = _pick(list(QUESTIONS), F.col("doc_id"))
    return _docs(spark, d).select("doc_id", T.strip_sources(asked).alias("clean"), T.refers_to_source(asked).alias("refers"))


REPLIES = {
    '{"a": "@u"}': "@u",
    '{"a": "$\\frac{@u}{2}$"}': "$\\frac{@u}{2}$",
    '```json\n{"a": "@u \\"@v\\""}\n```': '@u "@v"',
    '<think>no {"a": 1}</think> {"a": "\\\\eta @u"}': "\\eta @u",
    'text before {"a": "@v"} after': "@v",
    "nothing here of @u": None,
    'The list: [{"a": "@u"}, {"a": "@v"}] as asked': "@u",
    '{"a": "\\u00e9 \\alpha @u"}': "é \\alpha @u",
}


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """The value of ``a`` in replies: fenced, thought about, inside other text, in a list, badly escaped."""
    found = reply_json(_pick(list(REPLIES), F.col("doc_id")))
    return _docs(spark, d).select("doc_id", F.coalesce(F.get_json_object(found, "$.a"), F.get_json_object(found, "$[0].a")).alias("a"))


#: Replies, and what the items in them are: text, options, topic, level.
ITEMS = {
    '{"questions": [{"text": "What is @u?", "options": [" x ", "", "y"], "correct_option": "x"}, "bare", null, {"text": " "}]}': "What is @u?|x;y|@l|understand",
    '{"questions": {"text": "Define @v, as stated in the text.", "topic": "@v"}}': "Define @v.||@v|understand",
    '[{"text": "Why @u?", "bloom": "APPLY"}, {"text": "And @v?"}, {"text": "More?"}]': "Why @u?||@l|apply#And @v?||@l|understand",
    "no JSON of @u": "",
}


def question_items(spark: SparkSession, d: str) -> DataFrame:
    items = items_of(_pick(list(ITEMS), F.col("doc_id")), F.lit(2), F.col("lang"), F.lit("understand"))
    shown = F.transform(items, lambda q: F.concat_ws("|", q["text"], F.array_join(q["options"], ";"), q["topic"], q["bloom"]))
    return _docs(spark, d).withColumn("lang", F.coalesce("lang", F.lit("none"))).select("doc_id", F.array_join(shown, "#").alias("items"))


KEYWORDS = {
    ("GSM @u", "The (GSM) @u works."): True,
    ("P", "Pressure of @u rises"): False,
    ("P", "the P value of @u"): True,
    ("@u_@v / 2", r"$\frac{@u_{\text{@v}}}{2}$"): True,
    ("", "anything of @u"): False,
    ("zz9zz", "no such @u"): False,
    ("ﬁeld @u", "a FIELD @u"): True,
}


def keyword_present(spark: SparkSession, d: str) -> DataFrame:
    keyword, answer = (_pick([k[i] for k in KEYWORDS], F.col("doc_id")) for i in (0, 1))
    return _docs(spark, d).select("doc_id", evaluation.keyword_present(keyword, answer).alias("present"))


STATUS = (400, 503, None, 429, 408, None, 404, 500, 200)


def failover(spark: SparkSession, d: str) -> DataFrame:
    """Orders as failed calls."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("http", "connect", "reply", "timeout"))), (k % 4 + 1).cast("int"))
    status = F.get(F.array(*[F.lit(s).cast("int") for s in STATUS]), (k % len(STATUS)).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(T.should_fail_over(kind, status), F.lit(False)).alias("second_model"))


OPTIONS = {
    ("@u = @v_x / T", "@u = @v / T", "T = 1", "0", "key A"): "qualifier_dropped",
    ("@u", "@v-2", "third", "fourth", "key third"): "",
    ("@u", "@v-2", "third", "fourth", "key (b)"): "",
    ("@u", "@v-2", "third", "fourth", "key 4"): "",
    ("@u", "@v-2", "third", "key third"): "too_few_options",
    ("@u 1", "@u1.", "x", "y", "key x"): "duplicate_options",
    ("@u", "@v-2", "third", "fourth", "key E"): "key_unresolved",
    ("@u", "", "third", "fourth", "key third"): "too_few_options",
    ("T_{@u}/R_{@v}", "T_{@v}/R_{@u}", "1", "2", "key T_{@u}/R_{@v}"): None,
}


def mcq_shape(spark: SparkSession, d: str) -> DataFrame:
    options = _pick([k[:-1] for k in OPTIONS], F.col("doc_id"), lambda t: F.array(*map(_filled, t)))
    key = _pick([k[-1].removeprefix("key ") for k in OPTIONS], F.col("doc_id"))
    return _docs(spark, d).select("doc_id", paper.mcq_problem(options, key).alias("problem"))


JUDGED = {((0, 1, 2, 3), ("true", "false", "false", "false")): ("", 0), ((0, 1, 2), ("true", "false", "false")): ("malformed", None), ((3, 2, 1, 0), ("false", "TRUE", "no", "false")): ("", 2), ((0, 1, 1, 3), ("true", "false", "false", "false")): ("malformed", None), ((0, 1, 2, 3), ("true", "true", "false", "false")): ("not_one_true", None)}


def mcq_flags(spark: SparkSession, d: str) -> DataFrame:
    """Judgements of four options, and the option that they set the key to."""
    listed = lambda values: F.array(*map(F.lit, values))
    indices, flags = (_pick([k[i] for k in JUDGED], F.col("doc_id"), listed) for i in (0, 1))
    options = F.array(F.col("u"), F.col("v"), F.lit("third"), F.lit("fourth"))
    return _docs(spark, d).select("doc_id", paper.mcq_flags_problem(indices, flags, F.lit(4)).alias("problem"), paper.mcq_true_option(options, indices, flags).alias("answer"))


SAID = {("true", "0.9"): True, ("false", "0.9"): False, ("true", "0.69"): False, ("True ", "0.7"): True, ("true", "95"): False, ("true", "nan"): False, ("true", "true"): False, ("yes", "1"): False, (None, "0.8"): False, ("true", None): False}


def verdict_gate(spark: SparkSession, d: str) -> DataFrame:
    plain = lambda t: F.lit(t).cast("string")
    answerable, confidence = (_pick([k[i] for k in SAID], F.col("doc_id"), plain) for i in (0, 1))
    return _docs(spark, d).select("doc_id", paper.accepted(answerable, confidence).alias("accepted"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Parts as sections, five a paper, of which some repeat a name or have none."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "A").when(k % 5 == 1, " a ").when(k % 5 == 2, "").otherwise(F.concat(F.lit("S"), (k % 5).cast("string")))
    return table(spark, d, "part").select(F.floor(k / 5).alias("paper"), (k % 5).alias("seq"), name.alias("name"), F.col("p_type").alias("type"), (F.col("p_size") % 4).alias("count"), (k % 3).alias("marks_each"), F.lit("").alias("instructions"), (k % 6 - 1).alias("attempt"))


SECTIONS = "s as (select p_partkey // 5 as paper, p_partkey % 5 as seq, case p_partkey % 5 when 0 then 'A' when 1 then 'a' when 2 then '' else 'S' || p_partkey % 5 end as name, p_size % 4 as n, p_partkey % 3 as marks, p_partkey % 6 - 1 as attempt from part)"


def blueprint_problems(spark: SparkSession, d: str) -> DataFrame:
    return blueprint.section_problems(_sections(spark, d)).select("paper", "seq", F.array_join("problems", "; ").alias("problems"))


def blueprint_marks(spark: SparkSession, d: str) -> DataFrame:
    return blueprint.paper_marks(_sections(spark, d))


SOURCES = {"[2]": "[2]", "[3, 1, 3]": "[3, 1]", "sources 4 and 2": "[4, 2]", '{"x": 1}': "[]", "none": "[]", "[true, 1]": "[1]", "3": "[3]"}


def source_ids(spark: SparkSession, d: str) -> DataFrame:
    reply = _pick(list(SOURCES), F.col("doc_id"), F.lit)
    return _docs(spark, d).select("doc_id", F.array_join(variants.source_numbers(reply, (F.col("doc_id") % 5).cast("int")).cast("array<string>"), ",").alias("numbers"))


def visitor_address(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a request: from this machine or elsewhere, with the headers that its number gives."""
    k = F.col("event_id")
    header = lambda n, name, value: F.when(k % n == 0, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    address = lambda net: F.concat(F.lit(net), F.col("user_id").cast("string"))
    headers = F.map_concat(header(2, "x-forwarded-for", F.concat(F.lit("6.6.6.6, "), address("10.0.0."), F.lit(" "))), header(3, "x-real-ip", address("10.1.0.")), header(5, "cf-connecting-ip", F.when(k % 10 == 0, "").otherwise(address("10.2.0."))))
    peer = F.when(k % 4 < 3, "127.0.0.1").otherwise(address("192.0.2."))
    return table(spark, d, "events").select("event_id", T.visitor_address(peer, headers).alias("visitor"))


def filled_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", render.filled("{{{lang}}} {id}: {text}\n{lang}", lang=F.col("lang"), id=F.col("doc_id"), text=F.col("text")).alias("prompt"))


def _cases(values: list, of: str = "doc_id") -> str:
    lit = lambda x: "null" if x is None else str(x).lower() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    return f"case {of} % {len(values)} " + " ".join(f"when {k} then {lit(x)}" for k, x in enumerate(values)) + " end"


QUERIES = {f.__name__: f for f in (plain_math, strip_sources, json_repair, question_items, keyword_present, failover, mcq_shape, mcq_flags, verdict_gate, blueprint_problems, blueprint_marks, source_ids, visitor_address, filled_prompts)}
ORACLE_SQL = {
    "plain_math": f"with {DOCS} select doc_id, {_sql(list(FORMULAS.values()))} as plain from d",
    "strip_sources": f"with {DOCS} select doc_id, {_sql([c for c, _ in QUESTIONS.values()])} as clean, {_cases([r for _, r in QUESTIONS.values()])} as refers from d",
    "json_repair": f"with {DOCS} select doc_id, {_sql(list(REPLIES.values()))} as a from d",
    "question_items": f"with {DOCS} select doc_id, replace({_sql(list(ITEMS.values()))}, '@l', coalesce(lang, 'none')) as items from d",
    "keyword_present": f"with {DOCS} select doc_id, {_cases(list(KEYWORDS.values()))} as present from d",
    "failover": f"""select o_orderkey, o_orderkey % 4 in (1, 3) or coalesce(status in (408, 429) or status between 500 and 599, false) as second_model from (select o_orderkey, {_cases(list(STATUS), 'o_orderkey')} as status from orders)""",
    # exchanged indices are two options only where the words differ
    "mcq_shape": f"with {DOCS} select doc_id, coalesce({_cases(list(OPTIONS.values()))}, case when u = v then 'duplicate_options' else '' end) as problem from d",
    "mcq_flags": f"with {DOCS} select doc_id, {_cases([p for p, _ in JUDGED.values()])} as problem, [u, v, 'third', 'fourth'][{_cases([None if i is None else i + 1 for _, i in JUDGED.values()])}] as answer from d",
    "verdict_gate": f"select doc_id, {_cases(list(SAID.values()))} as accepted from documents",
    "blueprint_problems": f"""with {SECTIONS}, r as (select *, row_number() over (partition by paper, lower(name) order by seq) as again from s)
select paper, seq, concat_ws('; ', case when name = '' then 'blank name' end, case when again > 1 and name <> '' then 'name used twice' end, case when n < 1 then 'no questions' end, case when marks < 1 then 'no marks' end, case when attempt < 0 or attempt > n then 'cannot attempt so many' end) as problems from r""",
    "blueprint_marks": f"with {SECTIONS} select paper, sum(case when attempt > 0 then attempt else n end * marks)::bigint as marks, sum(n)::bigint as questions from s group by paper",
    "visitor_address": """select event_id, case when event_id % 4 = 3 then '192.0.2.' || user_id when event_id % 5 = 0 and event_id % 2 = 1 then '10.2.0.' || user_id when event_id % 3 = 0 then '10.1.0.' || user_id when event_id % 2 = 0 then '10.0.0.' || user_id else '127.0.0.1' end as visitor from events""",
    "filled_prompts": "select doc_id, concat('{', coalesce(lang, ''), '} ', doc_id, ': ', coalesce(text, ''), chr(10), coalesce(lang, '')) as prompt from documents",
    "source_ids": f"""with n as (select doc_id, doc_id % 5 as n, case doc_id % {len(SOURCES)} {' '.join(f'when {k} then {x}' for k, x in enumerate(SOURCES.values()))} end as l from documents)
select doc_id, array_to_string(case when len(list_filter(l, lambda x: x <= n)) > 0 then list_filter(l, lambda x: x <= n) else range(1, least(3, n) + 1) end, ',') as numbers from n""",
}
