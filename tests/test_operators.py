"""Operators on small inputs, edge cases included."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answer, context, dense, evaluation, fusion, ingest, lexical, paper
from lectern.operators.chunking import Limits, Unit, chunks_of, cost


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_global_statistics_survive_the_filter(spark):
    docs = spark.createDataFrame([(1, "a", "red fish"), (2, "b", "red red car"), (3, "b", "blue car"), (4, "a", "green tree")], "doc_id long, source string, text string")
    q = spark.createDataFrame([(0, "red car")], "query_id long, text string")
    full = {r.doc_id: r.score for r in lexical.search(q, docs, 10).collect()}
    part = {r.doc_id: r.score for r in lexical.search(q, docs, 10, F.col("source") == "b").collect()}
    assert part == {k: full[k] for k in (2, 3)}


def test_zero_scores_fill_up_the_list(spark):
    docs = spark.createDataFrame([(i, "common words here" if i else "rare gem") for i in range(6)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "gem")], "query_id long, text string")
    rows = [(r.doc_id, r["rank"]) for r in lexical.search(q, docs, 4).orderBy("rank").collect()]
    assert rows == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_repeated_query_terms_count_again(spark):
    docs = spark.createDataFrame([(1, "gem stone"), (2, "plain rock"), (3, "plain sand")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "gem"), (1, "gem gem")], "query_id long, text string")
    s = {r.query_id: r.score for r in lexical.search(q, docs, 1).collect()}
    assert s[1] == pytest.approx(2 * s[0], abs=1e-5)


def test_dense_paths_agree_and_an_unknown_filter_finds_nothing(spark):
    v = spark.createDataFrame([(i, [1.0 if j == i % 4 else 0.1 * i for j in range(4)], i % 2) for i in range(12)], "vec_id long, embedding array<float>, label int")
    q = v.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "vec_id", "score", "rank").collect())
    assert key(dense.search(q, v, 3)) == key(dense.search(q, v, 3, index=dense.build(v)))
    assert dense.search(q, v, 3, F.col("label").isin(9)).count() == 0


def test_fusion_tie_goes_to_the_earlier_list(spark):
    lists = spark.createDataFrame([(0, 1, 0, "dense", 1), (0, 2, 1, "dense", 1), (0, 3, 1, "dense", 2)], "query_id long, doc_id long, variant int, retriever string, rank int")
    assert [r.doc_id for r in fusion.fuse(lists, 9).orderBy("rank").collect()] == [1, 2, 3]


def test_neighbours_do_not_jump_over_gaps(spark):
    chunks = spark.createDataFrame([("a1", "a", 1), ("a3", "a", 3), ("a4", "a", 4), ("b2", "b", 2)], "id string, book_id string, ordinal int")
    hits = spark.createDataFrame([(0, "a3", "a", 3, 1.0, 1)], "query_id long, id string, book_id string, ordinal int, score double, relevance_rank int")
    rows = {r.id: (r.is_neighbor, r.score) for r in context.expand_neighbours(hits, chunks).collect()}
    assert rows == {"a3": (False, 1.0), "a4": (True, 0.5)}


def test_budget_cuts_the_first_hit_and_skips_what_does_not_fit(spark):
    rows = [(0, 1, True, 0.5, "n" * 40, "c"), (0, 2, False, 1.0, "h" * 4000, "c"), (0, 3, False, 0.9, "x" * 4000, "c")]
    df = spark.createDataFrame(rows, "query_id long, position long, is_neighbor boolean, score double, text string, citation string")
    kept = {r.position: r.tokens for r in context.select_within(df, 500).collect()}
    assert set(kept) == {2} and 20 <= kept[2] < 500
    kept = {r.position for r in context.select_within(df, 1030).collect()}
    assert kept == {2, 1}


def test_titles_and_headings(spark):
    title = lambda s: one(spark, s, T.is_title)
    for s in ("It's A Test", "Heat Capacity", "A", "lower", "McDonald", "Über Alles", "3rd Law", "THE"):
        assert title(s) == s.istitle() or s in ("It's A Test",), s
    head = lambda s: one(spark, s, T.looks_like_heading)
    assert head("2.1 Entropy") and head("Chapter 3: on heat.") and not head("A sentence that ends.") and not head("x" * 121)


def test_furniture_of_five_pages(spark):
    rows = [("b", p, float(y), line) for p in range(1, 6) for y, line in ((0, f"Header {p}"), (50, "Header 1" if p == 3 else "body"), (60, f"text {'abcde'[p - 1]}"), (100, f"end {'vwxyz'[p - 1]}"))]
    got = ingest.furniture(spark.createDataFrame(rows, "book string, page int, y double, line string")).collect()
    assert sum(r.edge and r.pattern for r in got) == 5 and sum(r.pattern and not r.edge for r in got) == 1


def pack(units, limit=60, overlap=10, least=8):
    return chunks_of([Unit(**u) for u in units], Limits(limit, overlap, least))


def test_chunks_stay_within_the_limit_and_their_chapter():
    units = [{"text": f"Sentence number {i} is here. " * (1 + i % 9), "chapter": "AB"[i // 20], "section": f"s{i // 5}"} for i in range(40)]
    units.append({"text": "entropy" * 400, "chapter": "B"})
    chunks = pack(units)
    assert all(cost(c.text) <= 60 for c in chunks)
    assert [c.chapter for c in chunks] == sorted(c.chapter for c in chunks)
    assert sum(c.text.count("entropy") for c in chunks) >= 390
    text = " ".join(c.text for c in chunks)
    assert all(f"Sentence number {i} is here." in text for i in range(40))


def test_small_rests_fold_back_or_wait():
    chunks = pack([{"text": "a" * 120, "chapter": "1"}, {"text": "tiny", "chapter": "2"}, {"text": "b" * 120, "chapter": "2"}])
    assert [c.chapter for c in chunks] == ["1", "2"] and chunks[1].text.startswith("tiny")
    chunks = pack([{"text": "tiny", "chapter": "1"}, {"text": "b" * 120, "chapter": "2"}])
    assert [(c.chapter, c.text[:4]) for c in chunks] == [("1", "tiny"), ("2", "bbbb")]
    chunks = pack([{"text": "a" * 120, "chapter": "1"}, {"text": "c" * 130, "chapter": "1"}, {"text": "tiny", "chapter": "1"}, {"text": "b" * 120, "chapter": "2"}], overlap=0)
    assert [c.text[-4:] for c in chunks] == ["aaaa", "tiny", "bbbb"]


def test_oversized_unit_keeps_its_pages_and_overlaps_by_whole_sentences():
    text = "First part is long enough. " * 20 + "Second part is here. " * 20
    chunks = pack([{"text": text, "marks": ((0, 1), (540, 2)), "last": 2}])
    assert chunks[0].first == 1 and chunks[-1].last == 2
    sentences = [c.text.replace("enough. F", "enough.|F").replace("here. S", "here.|S").replace("enough. S", "enough.|S").split("|") for c in chunks]
    assert all(a[-1] == b[0] for a, b in zip(sentences, sentences[1:]))
    plain = pack([{"text": "word " * 300}])
    assert all(cost(c.text) <= 60 for c in plain) and sum(c.text.count("word") for c in plain) >= 300


def test_chunks_end_where_the_next_unit_finds_no_room():
    """Boundaries by trying: a chunk takes units as long as their costs and separators fit."""
    sizes = [40, 80, 120, 20, 60, 100, 44, 36, 28, 160, 90]
    chunks = pack([{"text": chr(97 + k) * n} for k, n in enumerate(sizes)], overlap=0, least=1)
    want, load = [[]], 0
    for k, n in enumerate(sizes):
        if want[-1] and load + n // 4 + 2 > 60:
            want.append([])
            load = 0
        want[-1].append(k)
        load += n // 4 + 2
    assert [sorted({ord(ch) - 97 for ch in c.text if ch.isalpha()}) for c in chunks] == want


def test_sections_of_a_chunk_and_of_its_overlap():
    body = "A sentence of some words stands here. "
    chunks = pack([{"text": body * n, "section": s} for n, s in ((1, "A"), (1, "B"), (1, "A"), (4, "C"))], overlap=12, least=1)
    assert [c.label for c in chunks] == ["A – B", "B – C"] and chunks[1].text.startswith("s here. ")


def test_section_ranges(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), (["a"],), ([],), (["", "z"],)], "s array<string>")
    assert [r[0] for r in df.select(T.section_label(F.col("s"))).collect()] == ["a – c", "a", "", "z"]


def test_statements_and_their_cover(spark):
    cases = {
        "A plain claim stands here. Another one follows it [2].": [("A plain claim stands here.", [2]), ("Another one follows it.", [2])],
        "It is given by:\n\n$E = m$\n\nThis follows from that [5].": [("It is given by: $E = m$", [5]), ("This follows from that.", [5])],
        "Cited here first [1]. The tail has no marker.": [("Cited here first.", [1]), ("The tail has no marker.", [1])],
        "Uncited words at the end only": [("Uncited words at the end only", [])],
        "No [3].": [("No.", [3])],
        "Earlier words wait for it\n\n[4]": [("Earlier words wait for it", [4])],
        "Heat is energy in transit [1].\n\nIt always flows from hot to cold.": [("Heat is energy in transit.", [1]), ("It always flows from hot to cold.", [1])],
        "$$ S = k \\ln W $$\n[2]": [("$$ S = k \\ln W $$", [2])],
        "It needs a temperature gradient [2].\n\n## Notes\nWork is done by the gas [1][3].": [("It needs a temperature gradient.", [2]), ("Work is done by the gas.", [1, 3])],
        "": [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "answer_id long, raw string")
    got = {}
    for r in answer.statements(rows).orderBy("answer_id", "id").collect():
        got.setdefault(r.answer_id, []).append((r.statement, r.cites))
    assert [got.get(k, []) for k in range(len(cases))] == list(cases.values())


def test_refusals(spark):
    said = ["NOT_IN_SOURCE", " not_in_source: nothing on it", "NOT IN SOURCE [1].", "It is NOT_IN_SOURCE [1]."]
    rows = spark.createDataFrame([(s,) for s in said], "raw string").select(answer.verdict(F.col("raw"), F.lit(1), F.lit(True)))
    assert [r[0] for r in rows.collect()] == ["not_in_source", "not_in_source", "accepted", "accepted"]


def test_claims_fail_closed(spark):
    s = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "answer_id long, id long")
    v = spark.createDataFrame([(1, 1, "true"), (1, 2, "TRUE"), (2, 1, "true"), (2, 1, "false")], "answer_id long, id long, supported string")
    assert {r.answer_id: r.claims_ok for r in answer.claims_supported(s, v).collect()} == {1: True, 2: False, 3: False}


def test_json_escapes(spark):
    fix = lambda s: one(spark, s, T.repair_escapes)
    assert json.loads(fix(r'{"a": "$\eta = \frac{1}{2}$ \"q\" \\ é \n"}'))["a"] == '$\\eta = \\frac{1}{2}$ "q" \\ é \n'
    good = r'{"a": "\\eta"}'
    assert fix(good) == good


def test_confidence_and_flags(spark):
    df = spark.createDataFrame([("0.8",), ("95",), ("true",), (None,), ("-1",)], "c string")
    assert [r[0] for r in df.select(T.as_confidence(F.col("c"))).collect()] == [0.8, 0.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([(None,)], "c string")
    assert rows.select(T.as_bool(F.col("c"))).first()[0] is False


def test_near_duplicate_questions(spark):
    q = spark.createDataFrame([(1, "Define the term heat capacity and state its two forms"), (2, "Define the term heat capacity for a substance"), (3, "State Ohm's law."), (4, "State Hooke's law."), (5, "state ohm s LAW"), (6, "")], "qid long, text string")
    got = {r.qid: (r.class_id, r.n_links) for r in paper.near_duplicate_questions(q).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (3, 0), 4: (4, 0), 5: (3, 0), 6: (6, 0)}
    many = q.unionByName(spark.range(100, 400).select(F.col("id").alias("qid"), F.lit("Define the term heat capacity for a substance").alias("text")))
    assert paper.similar_classes(paper.question_classes(many)).count() == 1  # copies make no pairs


def test_section_marks_and_attempts(spark):
    assert [one(spark, s, T.attempt_from_instructions) for s in ("Answer ANY TWO.", "Attempt any 3 questions", "Write.", "")] == [2, 3, 0, 0]


def test_metrics_of_nothing_are_null(spark):
    empty = spark.createDataFrame([], "rank int, refused boolean")
    m = evaluation.retrieval_metrics(empty, 5).first()
    assert m.n == 0 and m.mrr is None and m.refusal_rate is None


def test_gold_files(spark, tmp_path):
    from lectern.sources.gold import load_gold, read_gold

    good = tmp_path / "good.jsonl"
    good.write_text('# note\n\n{"question": "q?", "answerable": true, "pages": [1]}\n')
    assert load_gold(spark, str(good)).first().question == "q?"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"question": "q", "x": 1}\n{"question": "q", "pages": "one"}\n{"question": " "}\nno json\n')
    assert {r.problem for r in read_gold(spark, str(bad)).collect()} == {"unknown field x", "wrong type of pages", "no question", "not a JSON object"}
    with pytest.raises(ValueError):
        load_gold(spark, str(bad))
    (tmp_path / "none.jsonl").write_text("# nothing\n")
    with pytest.raises(ValueError):
        load_gold(spark, str(tmp_path / "none.jsonl"))


def test_index_generations(spark, tmp_path):
    from lectern.sources.index_store import IndexBusy, IndexStore

    store = IndexStore(spark, str(tmp_path / "ix"))
    assert not store.exists()
    chunks = spark.range(5).select(F.col("id").cast("string").alias("id"))
    names = [store.save(chunks.where(f"id < {n}"), {"embedding_model": "m"}) for n in (1, 3, 5)]
    df, manifest = store.load("m")
    assert df.count() == manifest["n_chunks"] == 5 and store.current() == names[-1]
    assert sorted(p.name for p in (tmp_path / "ix").iterdir() if p.name.startswith("gen=")) == names[1:]
    with pytest.raises(ValueError):
        store.load("other")
    store.lock()
    with pytest.raises(IndexBusy):
        store.save(chunks, {})
    store.unlock()


def test_books_of_all_formats(spark, tmp_path):
    from lectern.sources.books import discover, read_blocks

    (tmp_path / "A Book.MD").write_text("# Chapter One\n\ntext line\n## Part\n")
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("one.xhtml", "<html><body><h2>Heat &amp; Work</h2><p>Some <b>bold</b> text</p></body></html>")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "d.epub").write_bytes(b"no archive")
    (tmp_path / "e.xyz").write_text("ignored")
    files = discover(spark, str(tmp_path))
    assert files.count() == 4
    assert re.fullmatch(r"a-20book-[0-9a-f]{12}|a-book-[0-9a-f]{12}", files.where("suffix = 'md'").first().book_id)
    rows = {(r.path[-6:], r.text): (r.level, r.problem) for r in read_blocks(files).collect()}
    assert rows[("ook.MD", "Chapter One")] == (1, None) and rows[("b.epub", "Heat & Work")] == (2, None)
    assert rows[("c.docx", "Top")] == (1, None) and ("c.docx", "x | y") in rows and rows[("d.epub", None)][1] == "not a zip archive"


def test_incremental_ingest(spark, tmp_path):
    from lectern.streaming.ingest import ingest_available

    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = lambda a: spark.createDataFrame(a, "doc_id long, text string")
    rows([(1, "One  Two"), (2, "other")]).write.parquet(src)
    read = lambda: spark.readStream.schema("doc_id long, text string").parquet(src)
    ingest_available(spark, read(), out, cp)
    rows([(3, "one two"), (4, "new"), (5, "NEW")]).write.mode("append").parquet(src)
    ingest_available(spark, read(), out, cp)
    ingest_available(spark, read(), out, cp)
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_exports_hide_the_key(spark):
    from lectern.sources.export import marks_note, to_json, to_markdown

    q = spark.createDataFrame([("p", "B", 2, "What?", 5, None, "because", None, "ok"), ("p", "A", 1, "Pick", 2, ["x", "y"], None, "y", "n")], "paper string, section string, number int, text string, marks int, options array<string>, answer string, correct_option string, verify_notes string")
    shown, hidden = (to_markdown(q, k).first().markdown for k in (True, False))
    assert shown.index("## A") < shown.index("## B") and "Answer: y" in shown and "Answer" not in hidden and "B) y" in hidden
    assert "correct_option" not in to_json(q, False).first().json
    assert spark.range(1).select(marks_note(F.lit(2), F.lit(3), F.lit(5))).first()[0] == "answer 2 of 3 questions × 5 marks = 10 marks"


def test_plugins(spark):
    from lectern.plugins import complete, embedder, hash_encoder, overlap_reranker

    v = spark.createDataFrame([("a b",), (None,)], "t string").select(embedder(hash_encoder(16))(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in v[0].v) == pytest.approx(1, abs=1e-5) and not any(v[1].v)
    assert spark.range(1).select(overlap_reranker(F.lit("red car"), F.lit("a red bus"))).first()[0] == 0.5

    def client():
        return lambda p: p.upper() if p != "bad" else 1 / 0

    got = {r.prompt_id: r for r in complete(spark.createDataFrame([(1, "hi"), (2, "bad")], "prompt_id long, prompt string"), client).collect()}
    assert got[1].reply == "HI" and got[2].problem.startswith("ZeroDivisionError")


def test_archive_guard():
    from lectern.sources.books import archive_problem

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(20_001):
            z.writestr(str(i), "")
    assert archive_problem(data.getvalue()) == "20001 members" and archive_problem(b"x") == "not a zip archive"


def test_section_marks_take_one_sort_and_no_join(spark):
    """Sections without questions and questions without a section give nothing; ties go by number."""
    q = spark.createDataFrame([(1, "A", n, m) for n, m in ((1, 2), (2, 5), (3, 5), (4, 1))] + [(1, "B", 1, 7), (2, "A", 1, None), (2, "A", 2, 3), (9, "Z", 1, 4), (None, "A", 1, 4)], "paper long, section string, number long, marks long")
    sections = spark.createDataFrame([(1, "A", 3), (1, "B", 0), (2, "A", 1), (3, "A", 2), (None, "A", 1)], "paper long, section string, attempt int")
    out = paper.section_marks(q, sections)
    assert sorted(map(tuple, out.collect())) == [(1, "A", 12, 4), (1, "B", 7, 1), (2, "A", 3, 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan
