"""The engine as a whole, readers, replies, connectors and paper files."""

import http.server
import io
import json
import threading
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern import connectors, engine, plugins
from lectern.config import Config
from lectern.functions import markup, models, render, text
from lectern.functions.replies import question_items, reply_json, without_thinking
from lectern.operators import answer, evaluation, ingest, lexical, paper
from lectern.plans import ingest as plans
from lectern.sources import books, export, papers
from lectern.sources.index_store import matching_books


def test_nested_and_unclosed_markup():
    assert markup.blocks("<ul><li>a<p>b &amp; c</p></li></ul><h2>T</h2>") == [("li", "a b & c"), ("p", "b & c"), ("h2", "T")]
    # a paragraph that is never closed goes on to the end of its parent
    assert markup.blocks("<div><p>one<br>two<p>three</div><p> </p>after") == [("p", "one two three"), ("p", "three")]
    assert markup.blocks("<p>x<script>var t='</p>';</script><style>p{}</style><!-- no -->y</p><h5>no</h5>") == [("p", "x y")]
    assert markup.blocks("") == [] and markup.blocks("<p") == []


def test_html_blocks_of_pages(spark):
    df = spark.createDataFrame([(1, "<h1>Heat</h1><li>a<p>b</p></li>"), (2, None), (3, "plain")], "page_id long, html string")
    got = [(r.page_id, r.line_no, r.tag, r.text, r.size, r.level) for r in ingest.html_blocks(df).orderBy("page_id", "line_no").collect()]
    assert got == [(1, 0, "h1", "Heat", 20.0, 1), (1, 1, "li", "a b", 11.0, None), (1, 2, "p", "b", 11.0, None)]
    # no batch of ten thousand pages and all their blocks in a task
    assert "ArrowEvalPython" not in ingest.html_blocks(df)._jdf.queryExecution().executedPlan().toString()


def test_references_end_with_a_semicolon(spark, tmp_path):
    """a title cut within a reference, as in pages of check_l; and what the SQL says of each."""
    cases = ["say &quot;x&quot; &quot", "&copy; &copy 1 &copyright &middot;&middot", "a &amp b &amp;c &amper &am &a &", "&amp;quot; &ampquot; &ampamp;", "&lt;p&gt; &lt &gt 1&nbsp;2&nbsp3", "no &notit; &unknown;"]
    pages = spark.createDataFrame([(i, f"<h1>{c}</h1><p>y") for i, c in enumerate(cases)], "page_id long, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in ingest.html_blocks(pages).orderBy("page_id", "line_no").collect()]
    assert got[0][3] == 'say "x" &quot' and got[4][3] == "a & b &c &er &am &a &"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == con.execute(plans.HTML + " order by page_id, line_no").fetchall()
    # others are read as ever
    assert markup.blocks("<p>caf&eacute; &#233;&#xE9; &hellip;</p>") == [("p", "caf\xe9 \xe9\xe9 \u2026")]


def docx(body):
    out, w = io.BytesIO(), "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_tables_and_heading_sizes():
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('5')}{cell('5')}</w:tr><w:tr>{cell('wide', '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}</w:tr><w:tr>{cell('top', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('r1')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('r2')}</w:tr></w:tbl>"
    [rows] = books.read_docx(docx(p("T", "Title") + p("A", "Heading1") + p("B", "Heading2") + p("C", "Heading3") + p("text") + table))
    assert [(t, s, n) for t, s, _, n in rows] == [("T", 18.0, 1), ("A", 18.0, 1), ("B", 16.0, 2), ("C", 14.0, 3), ("text", 11.0, None), ("5 | 5", 11.0, None), ("wide", 11.0, None), ("top | r1", 11.0, None), ("top | r2", 11.0, None)]


def test_contents_say_what_a_page_begins_in(spark):
    lines = [("b", p, 10 * p + i, t, 11.0, False, None) for p in (1, 2, 3) for i, t in enumerate(["Chapter 7" if p == 3 else "words of a page", "more words"])]
    blocks = spark.createDataFrame(lines, "book string, page int, line_no long, text string, size double, bold boolean, level int")
    toc = spark.createDataFrame([("b", 0, 1, "One", 2), ("b", 1, 2, "One point one", 2), ("b", 2, 1, "Two", 3), ("b", 3, None, None, None)], "book string, seq int, level int, entry string, page int")
    got = [(r.page, r.chapter, r.section) for r in ingest.annotate(blocks, contents=toc).orderBy("line_no").collect()]
    assert got == [(1, "", ""), (1, "", ""), (2, "One", "One point one"), (2, "One", "One point one"), (3, "Two", ""), (3, "Two", "")]
    assert ingest.annotate(blocks).count() == 6


def test_ingest_and_retrieval(spark, tmp_path):
    body = lambda about: "\n\n".join(f"The {about} of a body number {i} is described in this sentence of some length." for i in range(30))
    (tmp_path / "heat.md").write_text("# Heat\n\n" + body("entropy"))
    (tmp_path / "copy.md").write_text("# Heat\n\n" + body("entropy"))
    (tmp_path / "law.txt").write_text("Chapter 1\n" + body("voltage"))
    (tmp_path / "poor.txt").write_text("\n".join("ab" for _ in range(100)))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    encode = plugins.hash_encoder(64)
    chunks, report = engine.build(spark, str(tmp_path), Config(), encode)
    became = {r.path.rsplit("/", 1)[1]: r.became for r in report.collect()}
    assert became["law.txt"] == "ok" and became["bad.epub"] == "not a zip archive" and became["poor.txt"] in ("no usable text layer", "fragmented")
    assert sorted([became["heat.md"], became["copy.md"]]) == ["ok", "same content as another or known"]
    chunks = chunks.cache()
    assert {r.title for r in chunks.select("title").distinct().collect()} <= {"heat", "copy", "law"} and chunks.where("size(embedding) = 64").count() == chunks.count() > 1
    assert all(r.citation.endswith(", p.1") for r in chunks.collect())
    q = spark.createDataFrame([(0, "What is the entropy of a body?"), (1, "zzz qqq")], "query_id long, text string")
    got = {r.query_id: r for r in engine.retrieve(q, chunks, Config(), encode).collect()}
    assert got[0].answered and got[0].grounded and "entropy" in got[0].context and got[0].citations
    assert not got[1].answered and not got[1].grounded
    again = engine.build(spark, str(tmp_path), Config(), known=report.select("sha"))
    assert again[0].count() == 0


def test_json_of_replies(spark):
    said = ['{"a": 1}', "```json\n[1, 2]\n```", "```\nno\n```", "null", 'x [1] {"b": "\\eta"} y', "<think>{}</think>[3]", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, s string").orderBy("i").select(reply_json(F.col("s"))).collect()]
    assert got == ['{"a": 1}', "[1, 2]", None, None, '{"b": "\\\\eta"}', "[3]", None, None]
    items = spark.createDataFrame([('[{"text": "Why?", "source_ids": [2, "3"]}, 5, {"topic": "x"}]',)], "s string").select(question_items(F.col("s"), F.lit(5), F.lit("t"), F.lit("apply"))).first()[0]
    assert [(q.text, q.topic, q.bloom, q.source_ids, q.options) for q in items] == [("Why?", "t", "apply", ["2", "3"], [])]


def test_thoughts_are_cut_from_a_stream():
    text = "a<think>hidden < b</think>c <thi d"
    for size in range(1, 12):
        pieces = [text[i : i + size] for i in range(0, len(text), size)]
        assert "".join(without_thinking(pieces)) == "ac <thi d", size
    assert "".join(without_thinking(["x<think>never closed"])) == "x"


class Server(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self._say(json.dumps({"models": [{"name": "m"}], "data": [{"id": "m"}]}))

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        asked = body["messages"][-1]["content"]
        if asked.isdigit():
            self.send_response(int(asked))
            self.end_headers()
        elif "completions" not in self.path:
            self._say("\n".join(json.dumps({"message": {"content": c}}) for c in ["<think>x</think>", "he", "llo"]) if body["stream"] else json.dumps({"message": {"content": f"<think>x</think> {asked.upper()} "}}))
        elif body["stream"]:
            self._say("\n".join([*("data: " + json.dumps({"choices": [{"delta": {"content": c}}]}) for c in ("he", "llo")), "data: [DONE]"]))
        else:
            self._say(json.dumps({"choices": [{"message": {"content": asked.upper()}}]}) if asked != "odd" else "[]")

    def _say(self, text):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_connectors(server):
    say = lambda t: [{"role": "user", "content": t}]
    for dialect in ("chat", "completions"):
        m = connectors.Model(server, "m", dialect)
        assert m.chat(say("hi")) == "HI" and "".join(m.stream(say("hi"))) == "hello" and m.names() == ["m"]
        dead = connectors.Model("http://127.0.0.1:9", "m", dialect, timeout=2)
        pair = connectors.Pair(dead, m)
        assert pair.chat(say("hi")) == "HI" and "".join(pair.stream(say("x"))) == "hello"
        with pytest.raises(connectors.CallFailed, match="; then "):
            connectors.Pair(dead, dead).chat(say("hi"))
        for status, second in ((400, False), (404, False), (408, True), (429, True), (500, True)):
            with pytest.raises(connectors.CallFailed) as e:
                m.chat(say(str(status)))
            assert e.value.second is second
    with pytest.raises(connectors.CallFailed) as e:
        connectors.Pair(connectors.Model(server, "m", "completions"), connectors.Model(server, "m")).chat(say("odd"))
    assert not e.value.second


def test_json_is_asked_for_again(spark):
    def client():
        return lambda p: '{"ok": 1}' if "good" in p or ("slow" in p and "not valid JSON" in p) else "no"

    prompts = spark.createDataFrame([(1, "good"), (2, "slow"), (3, "never")], "prompt_id long, prompt string")
    got = {r.prompt_id: (r.json, r.problem) for r in plugins.complete_json(prompts, client, 1).collect()}
    assert got == {1: ('{"ok": 1}', None), 2: ('{"ok": 1}', None), 3: (None, "no JSON")}


def test_a_group_of_jobs_is_cancelled(spark):
    stop = threading.Event()
    threading.Timer(1.0, stop.set).start()
    slow = spark.range(4, numPartitions=4).select(F.udf(lambda x: __import__("time").sleep(60) or x, "long")("id"))
    with pytest.raises(Exception, match="(?i)cancel"), plugins.cancellable(spark, "slow", stop.is_set, 0.1):
        slow.collect()
    assert spark.range(3).count() == 3


def test_blueprints_and_profiles(spark, tmp_path):
    (tmp_path / "mid.json").write_text(json.dumps({"title": "Mid", "sections": [{"name": "A", "type": "mcq", "count": 10, "marks_each": 1}, {"count": 3, "attempt": None}], "bloom_mix": {"apply": 1}}))
    head, sections = papers.load_blueprint(spark, str(tmp_path / "mid.json"))
    assert (head.first().title, head.first().total_marks, head.first().bloom_mix) == ("Mid", 70, {"apply": 1.0})
    assert [(r.name, r.type, r.count if isinstance(r.count, int) else r["count"], r.marks_each, r.attempt) for r in sections.orderBy("seq").collect()] == [("A", "mcq", 10, 1, 0), ("Section 2", "short", 3, 2, 0)]
    papers.save_blueprint(head, sections, str(tmp_path / "again.json"))
    h2, s2 = papers.load_blueprint(spark, str(tmp_path / "again.json"))
    assert h2.drop("paper").collect() == head.drop("paper").collect() and s2.drop("paper").collect() == sections.drop("paper").collect()
    cfg = Config({"paper": {"title": "End", "sections": [{"name": "X"}]}})
    assert papers.blueprint_of(spark, cfg)[1].first().name == "X"
    q = spark.createDataFrame([("p", 1, "t1", "Explain", 5, "apply"), ("p", 2, "t2", "explain", 0, "apply"), ("p", 3, "t2", "State", 2, "remember"), ("p", 4, "t3", "", None, None)], "profile string, seq long, topic string, verb string, marks int, bloom string")
    prof = paper.profile(q)
    r = prof.first()
    assert (r.topics, r.verbs, r.marks, r.levels) == ({"t1": 1, "t2": 2, "t3": 1}, {"explain": 2, "state": 1}, {"2": 1, "5": 1}, {"apply": 0.667, "remember": 0.333})
    papers.save_profile(prof, str(tmp_path / "prof"))
    assert papers.load_profile(spark, str(tmp_path / "prof"), prof.schema.simpleString()[7:-1].replace(":", " ", 1) if False else "profile string, topics map<string,bigint>, verbs map<string,bigint>, marks map<string,bigint>, levels map<string,double>").first().topics == r.topics
    assert [x.topic for x in paper.priority_topics(q, 2).orderBy("rank").collect()] == ["t2", "t1"]


def test_levels_of_papers_and_marks(spark):
    mix = spark.createDataFrame([("p", 10, "apply", 0.7, 0), ("p", 10, "create", 0.3, 1), ("q", 4, "recall", 1.0, 0), ("r", 0, "x", 1.0, 0)], "paper string, slots int, level string, weight double, seq int")
    assert sorted(tuple(r) for r in paper.allocate_levels(mix).collect()) == [("p", "apply", 7), ("p", "create", 3), ("q", "understand", 4)]
    mixes = [r[0] for r in spark.createDataFrame([(2,), (5,), (6,)], "m int").select(paper.mix_for_marks(F.col("m"))).collect()]
    assert mixes == [{"remember": 0.5, "understand": 0.5}, {"understand": 0.4, "apply": 0.4, "analyze": 0.2}, {"apply": 0.3, "analyze": 0.4, "evaluate": 0.2, "create": 0.1}]


def test_small_filters(spark):
    c = spark.createDataFrame([(1, 100), (2, 200)], "id long, token_count int")
    assert [r.id for r in evaluation.with_substance(c).collect()] == [2]
    assert evaluation.with_substance(c, 900).count() == 2 and evaluation.with_substance(c, 900, False).count() == 0 and evaluation.with_substance(c.limit(0)).count() == 0
    b = spark.createDataFrame([("heat-1", "Warmth"), ("law-2", None), ("x", "Big HEAT")], "book string, title string")
    assert {r.book for r in matching_books(b, "Heat").collect()} == {"heat-1", "x"} and matching_books(b, "none").count() == 0
    ranked = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "query_id long, id string")
    ctx = spark.createDataFrame([(0, "text"), (1, " \n"), (2, "text"), (3, "text")], "query_id long, context string")
    assert {r.query_id: r.grounded for r in answer.grounded(ranked, ranked.where("id <> 'c'"), ctx).collect()} == {0: True, 1: False, 2: False, 3: False}
    turns = spark.createDataFrame([("s", k, "user", f"t{k}", k == 3) for k in range(1, 5)], "conv_id string, turn int, role string, text string, reset boolean")
    got = {r.turn: r.history for r in answer.history(turns, reset=F.col("reset")).collect()}
    assert got == {1: "", 2: "user: t1", 3: "", 4: "user: t3"}
    note = spark.range(1).select(render.style_note(F.lit("Do."), F.lit(" "), F.array(F.lit("Q1"), F.lit("Q2")), F.lit("again")), render.row_json("id")).first()
    assert note[0] == "Do.\n\nExamples of the style:\n- Q1\n- Q2\n\nagain" and note[1] == '{"id":0}'


def test_visitors_behind_a_proxy(spark):
    cases = [
        ("9.9.9.9", {"x-real-ip": "1.1.1.1"}, "9.9.9.9"),
        ("127.0.0.1", {"x-forwarded-for": "6.6.6.6, 2.2.2.2 "}, "2.2.2.2"),
        ("::1", {"x-real-ip": "1.1.1.1", "x-forwarded-for": "2.2.2.2"}, "1.1.1.1"),
        ("localhost", {"cf-connecting-ip": "3.3.3.3", "x-real-ip": "1.1.1.1"}, "3.3.3.3"),
        ("127.0.0.1", {"cf-connecting-ip": "", "x-forwarded-for": "2.2.2.2, "}, "127.0.0.1"),
        ("127.0.0.1", {}, "127.0.0.1"),
        ("127.0.0.1", None, "127.0.0.1"),
        (None, {"x-real-ip": "1.1.1.1"}, None),
    ]
    rows = spark.createDataFrame(cases, "peer string, headers map<string,string>, expected string")
    assert all(r.got == r.expected for r in rows.withColumn("got", text.visitor_address(F.col("peer"), F.col("headers"))).collect())


def test_templates_are_filled(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "q string, n int")
    got = [r[0] for r in rows.select(render.filled("{n}: {q} {{x}}{n}", q=F.col("q"), n=F.col("n"))).collect()]
    assert got == ["1: a {x}1", "2:  {x}2"] and rows.select(render.filled("")).first()[0] == ""
    with pytest.raises(KeyError):
        render.filled("{missing}", q=F.col("q"))


def test_zeros_rank_above_negative_scores(spark):
    """Terms in most of the documents have negative weights, and so do scores where the mean is."""
    docs = spark.createDataFrame([(i, "a b c" if i < 90 else "x") for i in range(100)], "doc_id long, text string")
    index = lexical.build(docs)
    assert index.mean < 0
    got = [(r.doc_id, r.score) for r in lexical.search(spark.createDataFrame([(0, "a")], "query_id long, text string"), docs, 12, index=index).orderBy("rank").collect()]
    assert [k for k, _ in got] == [*range(90, 100), 0, 1] and got[-1][1] < 0 == got[0][1]


def test_claims_are_checked_in_batches_by_two_models(spark):
    raw = {1: " ".join(f"Statement number {k} says a thing [1]." for k in range(15)), 2: "Only this one is said here [2].", 3: "This one is doubtful to all [1].", 4: "It says $x^{2}$ without a marker."}
    answers = spark.createDataFrame(list(raw.items()), "answer_id long, raw string")
    passages = spark.createDataFrame([(a, n, f"B, p.{n}", f"passage {n} of {a}") for a in raw for n in (1, 2)], "answer_id long, n int, citation string, text string")
    prompts = {(r.answer_id, r.batch): r.prompt for r in answer.claim_prompts(answer.statements(answers), passages).collect()}
    assert sorted(prompts) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)]
    assert "passage 1 of 1" in prompts[1, 0] and "passage 2 of 1" not in prompts[1, 0] and "12. Statement" in prompts[1, 0] and "13. Statement" in prompts[1, 1]
    assert "passage 1 of 4" in prompts[4, 0] and "passage 2 of 4" in prompts[4, 0] and "It says x^2 without a marker. (cites none)" in prompts[4, 0]

    def judge(trusts):
        def make():
            def say(prompt):
                import json
                import re

                if not trusts and "of 2" in prompt:
                    return "no JSON"
                ids = re.findall(r"(?m)^(\d+)\. ", prompt.partition("STATEMENTS")[2])
                return json.dumps({"verdicts": [{"id": int(i), "supported": "doubtful" not in prompt} for i in ids] + ["odd"]})

            return say

        return make

    got = {r.answer_id: (r.claims_ok, r.n_failed) for r in engine.check_claims(answers, passages, judge(False), judge(True)).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 1), 4: (True, 0)}
    assert {r.answer_id: r.claims_ok for r in engine.check_claims(answers, passages, judge(False)).collect()}[2] is False


def test_files_made_of_papers_and_uploads(spark, tmp_path):
    q = spark.createDataFrame([("p", "A", 1, "Pick & choose", 2, ["x", "y"], None, "y", "n")], "paper string, section string, number int, text string, marks int, options array<string>, answer string, correct_option string, verify_notes string")
    [rows] = books.read_docx(bytes(export.to_docx(q).first().docx))
    assert [(t, n) for t, _, _, n in rows] == [("A", 2), ("1. Pick & choose [2]", None), ("A) x", None), ("B) y", None), ("Answer: y", None)]
    assert "Answer" not in str(books.read_docx(bytes(export.to_docx(q, False).first().docx)))
    export.save_report(spark.createDataFrame([(3, None)], "n int, mrr double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().n == 3 and '"mrr":null' in spark.read.text(str(tmp_path / "report")).first()[0]
    say = lambda name, data: export.save_upload(str(tmp_path), name, data)
    assert [say("a.txt", b"1"), say("a.txt", b"1"), say("a.txt", b"2"), say("b.exe", b"1"), say("../c.MD", b"1")] == ["saved", "same", "another file of that name", "unknown suffix", "saved"]
    assert (tmp_path / "c.MD").exists() and not list(tmp_path.glob(".*.part"))


def test_a_program_that_reads_scans(spark):
    files = spark.createDataFrame([("x/a.pdf", "pdf", b"scan"), ("x/b.txt", "txt", b"text")], "path string, suffix string, content binary")
    assert [(r.path, bytes(r.content), r.problem) for r in books.ocr(files, ("cp",)).collect()] == [("x/a.pdf", b"scan", None)]
    assert books.ocr(files, ("false",)).first().problem.startswith("CalledProcessError") and books.ocr(files, ("no-such-program",)).first().problem.startswith("FileNotFoundError")
    assert books.ocr(files, ("sleep", "9", "#"), 0.2).first().problem is not None


def test_catalogue(spark):
    rows = spark.createDataFrame([("small", "4B"), ("bge-m3", "567M"), ("large", "8.2B"), ("odd", None)], "name string, size string")
    assert [(r.name, r.billions, r.speed) for r in models.catalogue(rows).collect()] == [("large", 8.2, 9.8), ("small", 4.0, 20.1), ("odd", None, None), ("bge-m3", 0.567, 141.7)]


def test_both_ways_to_score_say_the_same(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(9001, "", "src1"), (9002, None, "src1"), (9003, "the the the of", "src1")], "doc_id long, text string, source string")
    docs = docs.unionByName(extra)
    q = spark.createDataFrame([(0, "the of the und"), (1, "zz9 qq8"), (2, ""), (3, docs.first().text)], "query_id long, text string")
    index = lexical.build(docs)
    assert index.segments.where("size(terms) <> size(array_distinct(terms)) or aggregate(dl, 0, (a, x) -> a + x) <> aggregate(counts, 0, (a, x) -> a + x)").count() == 0
    for only in (None, F.col("source") == "src1"):
        found = []
        for most, block in ((500_000, 1 << 21), (500_000, 2), (0, 1024)):
            monkeypatch.setattr(lexical, "MOST_TERMS", most)
            monkeypatch.setattr(lexical, "CELLS", block)
            rows = lexical.search(q, docs, 7, only, index=index).collect()
            found.append(sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in rows))
        assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == {0, 1, 2, 3}


def test_bounds_count_segments_out(spark):
    """A rare term's few documents leave most segments of common terms unscored."""
    rows = [(i, "common words here " * (1 + i % 5) + ("rare " * 3 if i % 200 == 1 else "") + f"w{i % 50}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame([(0, "rare common"), (1, "w7 words")], "query_id long, text string")
    index = lexical.build(docs)
    seen = lexical.pruning(q.where("query_id = 0"), index, 1).first()
    assert 0 < seen.scored < seen.possible / 2
    got = lexical.search(q, docs, 3, index=index).orderBy("query_id", "rank").collect()
    want = lexical.top_k(lexical.scores(lexical.query_terms(q, index), index), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(r.query_id, r.doc_id, r.score) for r in want]


def test_terms_next_to_letters_of_other_scripts(spark):
    docs = spark.createDataFrame([(1, "Été K9 naïve日本x"), (2, None), (3, "")], "doc_id int, text string")
    index = lexical.build(docs)
    assert {r.term for r in index.weights.collect()} == {"t", "k9", "na", "ve", "x"}
    assert index.avgdl == 5 / 3
    got = lexical.search(spark.createDataFrame([(0, "x")], "query_id long, text string"), docs, 3, index=index).collect()
    assert sorted((r.doc_id, r.score > 0) for r in got) == [(1, True), (2, False), (3, False)]


def test_variants_go_through_one_search(spark, monkeypatch):
    """A rewrite finds what the question does not, a condensed question is searched in its place."""
    rows = [(f"b{i}", "b", 2 * i, t, "b, p.1") for i, t in enumerate(["entropy of a gas rises", "voltage drives a current", "enthalpy and pressure", "cats sleep all day", "dogs bark at night", "rain falls on hills", "trains run on rails"])]
    chunks = spark.createDataFrame(rows, "id string, book_id string, ordinal int, text string, citation string")
    ask = "query_id string, text string, history boolean, condensed string, rewrites array<string>, passage string"
    q = spark.createDataFrame([("q:1", "voltage", None, None, None, None), ("q2", "tell me about it please", True, "entropy of a gas", ["enthalpy pressure"], "voltage current"), ("q3", "what about it", False, "entropy", None, None), ("q4", None, None, None, None, "")], ask)
    searched, whole = [], lexical.search
    monkeypatch.setattr(lexical, "search", lambda asked, *a, **k: (searched.append(asked.count()), whole(asked, *a, **k))[1])
    got = {r.query_id: r.context or "" for r in engine.retrieve(q, chunks, Config()).collect()}
    assert searched == [6]
    assert "voltage" in got["q:1"] and "entropy" in got["q2"] and "entropy" not in got["q3"]
    from lectern.operators import variants

    assert [(r.variant, r.text) for r in variants.asked(q.where("query_id = 'q2'")).orderBy("variant").collect()] == [(0, "entropy of a gas"), (1, "enthalpy pressure"), (2, "voltage current")]
    back = variants.unkeyed(variants.keyed(variants.asked(q)), "string").select("query_id", "variant").collect()
    assert sorted(map(tuple, back)) == [("q2", 0), ("q2", 1), ("q2", 2), ("q3", 0), ("q4", 0), ("q:1", 0)]


def test_answers_pass_every_check_or_are_not_given(spark):
    """Condensed by the model, refused without passages, failed without a reply."""
    rows = [(f"b{i}", "b", i, t, f"b, p.{i}") for i, t in enumerate(["entropy of a gas rises", "voltage drives a current", "cats sleep all day", "dogs bark at night", "rain falls on hills", "trains run on rails"])]
    chunks = spark.createDataFrame(rows, "id string, book_id string, ordinal int, text string, citation string")

    def client():
        def say(prompt):
            if prompt.startswith("Rewrite"):
                assert "user: what is entropy" in prompt
                return "entropy of a gas"
            if prompt.startswith("You judge"):
                return '{"verdicts": [{"id": 1, "supported": ' + ("true" if "It rises" in prompt else "false") + "}]}"
            if "voltage" in prompt.rpartition("QUESTION")[2]:
                raise TimeoutError("no model")
            return "It rises in the gas [1]." if "entropy of a gas rises" in prompt and "and what about it" in prompt else "It falls asleep at noon [1]."

        return say

    turns = spark.createDataFrame([(1, "and what about it", "user: what is entropy"), (2, "voltage current", ""), (3, "cats sleep all day", ""), (4, "quasar", ""), (5, None, None)], "query_id int, text string, history string")
    got = {r.query_id: r for r in engine.ask(turns, chunks, Config(), client).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "accepted", 2: "failed", 3: "failed_claim", 4: "refused", 5: "refused"}
    assert got[1].searched == "entropy of a gas" and got[1].answer == "It rises in the gas [1]." and got[1].sources.startswith("[1] b, p.")
    assert all(got[k].answer is None and got[k].sources is None for k in (2, 3, 4, 5))


def test_a_context_is_chosen_without_texts(spark, monkeypatch):
    """texts of neighbours and hits that do not fit never go to the question; those that do are cut to what is shown."""
    from lectern.operators import context

    rows = [(f"b{i}", "b", i, f"voltage {i} " + "current flows on " * 40, "b, p.1") for i in range(6)]
    chunks = spark.createDataFrame(rows, "id string, book_id string, ordinal int, text string, citation string")
    q = spark.createDataFrame([(1, "voltage 3")], "query_id long, text string")
    seen, select, render = [], context.select_within, context.render
    monkeypatch.setattr(context, "select_within", lambda df, *a, **k: seen.append(df.columns) or select(df, *a, **k))
    monkeypatch.setattr(context, "render", lambda df, *a, **k: seen.append(df.agg(F.max(F.length("text"))).first()[0]) or render(df, *a, **k))
    got = engine.retrieve(q, chunks, Config().with_overrides({"retrieve.max_context_tokens": 100})).first()
    assert "text" not in seen[0] and seen[1] < len(rows[0][3]) and got.context.startswith("[1] b, p.1\nvoltage 3 current") and len(got.context) <= 403
