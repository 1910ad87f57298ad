"""The jobs: two runs over input that grows, repeats that change nothing, command lines."""

import hashlib
import json
import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import library_refresh, queries, retrieval_report
from lectern.config import Config
from lectern.streaming import refresh

DOC = "doc_id long, source string, text string, lang string"
GOOD = "# Heat\nHeat flows from the warmer body to the colder body.\nA second line says enough to be read as a sentence.\nAnd a third one, so that the text is long enough."


def put(spark, folder, rows):
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(folder)


def listed(df):
    return sorted((r.path, r.line_no, r.text, r.level, r.n_paths) for r in df.collect())


def expected(files):
    """Passages of a library of {path: text}, by hand."""
    first = {}
    for path in sorted(p for p, t in files.items() if t is not None):
        first.setdefault(files[path], []).append(path)
    out = []
    for text, paths in first.items():
        lines = text.split("\n")
        sizes = sorted(len(x.strip(" ")) for x in lines if x.strip(" "))
        if not sizes or sum(sizes) < 100 or sizes[len(sizes) // 2] < 12 or sum(n <= 3 for n in sizes) / len(sizes) > 0.35:
            continue
        for i, line in enumerate(lines):
            if line.strip():
                marks = re.match(r"(#{1,4})\s+", line)
                out.append((paths[0], i, re.sub(r"^#{1,4}\s+", "", line).strip(), len(marks[1]) if marks else None, len(paths)))
    return sorted(out)


def test_library_follows_its_files(spark, tmp_path):
    folder, library, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "library", "state"))
    run = lambda: listed(library_refresh.run(spark, folder, library, checkpoint))
    files = {"s/1": GOOD, "s/2": GOOD + "\nMore of it.", "s/3": "short", "s/4": GOOD, "t/5": "a\nb\nc\n" * 60, "/6": GOOD + "\nWithout a source."}
    put(spark, folder, [(int(p.split("/")[1]), p.split("/")[0] or None, t, "en") for p, t in files.items()])
    assert run() == expected(files)
    assert run() == expected(files)  # nothing new
    kept = spark.read.parquet(f"{library}/passages").count()
    # one changes, one moves, one repeats, one leaves, one is new and unfit
    put(spark, folder, [(2, "s", GOOD + "\nChanged.", "en"), (9, "a", GOOD, "en"), (1, "s", GOOD, "en"), (6, None, None, "en"), (7, "s", "tiny", "en")])
    files |= {"s/2": GOOD + "\nChanged.", "a/9": GOOD, "/6": None, "s/7": "tiny"}
    assert run() == expected(files)
    catalog = library_refresh.catalog(spark, library)
    assert catalog.where("path = 's/1'").count() == 1 and catalog.where("path = 's/2'").agg(F.max("version")).first()[0] == 2
    assert spark.read.parquet(f"{library}/passages").count() == kept + 5  # only the changed text was made anew
    # a text that comes back is taken from what is there
    put(spark, folder, [(2, "s", GOOD + "\nMore of it.", "en"), (6, None, GOOD + "\nWithout a source.", "en")])
    files |= {"s/2": GOOD + "\nMore of it.", "/6": GOOD + "\nWithout a source."}
    assert run() == expected(files) and run() == expected(files)
    assert spark.read.parquet(f"{library}/passages").count() == kept + 5
    assert spark.conf.get(refresh.PROVIDER, "unset") != refresh.ROCKSDB


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    library = f"file://{tmp_path}/library"
    batch = spark.createDataFrame([(hashlib.sha256(GOOD.encode()).hexdigest(), GOOD)], "sha string, text string")
    for _ in range(2):
        library_refresh._make_passages(library, Config({}))(batch, 4)
    assert spark.read.parquet(f"{library}/passages").count() == 4 and spark.read.parquet(f"{library}/texts").count() == 1


def test_files_in_small_batches(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    for i in range(3):
        put(spark, folder, [(i, "s", GOOD + str(i), "en"), (10 + i, "s", GOOD, "en")])
    out = library_refresh.run(spark, folder, f"file://{tmp_path}/library", f"file://{tmp_path}/state", Config({"files_per_batch": 1, "shelves": 2}))
    assert listed(out) == expected({**{f"s/{i}": GOOD + str(i) for i in range(3)}, **{f"s/{10 + i}": GOOD for i in range(3)}})
    made = spark.read.parquet(f"file://{tmp_path}/library/passages")
    assert made.select("batch").distinct().count() == 3 and made.where("shelf > 1").count() == 0


def test_unfit_texts_can_be_kept(spark, tmp_path):
    put(spark, f"file://{tmp_path}/in", [(1, "s", "tiny", "en")])
    out = library_refresh.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/l", f"file://{tmp_path}/s", Config({"skip_fragmented": False}))
    assert [r.text for r in out.collect()] == ["tiny"]


def test_empty_input(spark, tmp_path):
    put(spark, f"file://{tmp_path}/in", [])
    for _ in range(2):
        assert library_refresh.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/l", f"file://{tmp_path}/s").count() == 0


@pytest.fixture
def tables(spark, tmp_path):
    docs = [(1, "a", "the quick brown fox jumps over the lazy dog near the river", "en"), (2, "a", "nothing in common with anything", "en"), (3, "b", "THE QUICK\n brown fox", "en"), (4, "b", None, "en"), (5, None, "an entirely different river of words", "en")]
    spark.createDataFrame(docs, DOC).write.parquet(f"file://{tmp_path}/docs")
    spark.createDataFrame([(1, "quick brown fox"), (2, "zebra"), (3, ""), (4, "river"), (5, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/asked")
    return f"file://{tmp_path}/docs", f"file://{tmp_path}/asked", f"file://{tmp_path}/out"


def test_retrieval_report(spark, tables):
    runs = [sorted(map(str, retrieval_report.run(spark, *tables).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    rows = {(r.query_id, r.doc_id): r for r in spark.read.parquet(f"{tables[2]}/hits").collect()}
    assert rows[1, 3].answers and rows[1, 1].answers and not rows[1, 2].answers and rows[1, 3].overlap == 1.0
    assert rows[1, 2].relevance_rank is None and {rows[1, 1].relevance_rank, rows[1, 3].relevance_rank} == {1, 2}
    assert {q: r.outcome for (q, _), r in rows.items()} == {1: "answered", 2: "refused", 3: "refused", 4: "answered", 5: "refused"}
    m = spark.read.json(f"{tables[2]}/metrics/run=bm25").first()
    assert (m.n, m.hit_at_1, m.refusal_rate) == (5, 0.4, 0.6)


def test_runs_stay_beside_each_other(spark, tables):
    retrieval_report.run(spark, *tables)
    out = retrieval_report.run(spark, *tables, Config({"run": "7", "floor": 2.0}))
    assert {(r.run, r.outcome) for r in out.select("run", "outcome").distinct().collect()} == {("bm25", "answered"), ("bm25", "refused"), ("7", "refused")}
    # an outcome that a repeated run no longer has goes
    out = retrieval_report.run(spark, *tables, Config({"run": "bm25", "floor": 2.0}))
    assert {r.outcome for r in out.select("outcome").distinct().collect()} == {"refused"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_duckdb(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    df = queries.QUERIES[name](spark, data)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = sorted(map(repr, con.sql(queries.ORACLE_SQL[name]).project(columns).fetchall()))
    assert sorted(repr(tuple(r)) for r in df.collect()) == want and want


def test_command_lines(tmp_path, tables):
    """In processes of their own, as they stop the session they make."""
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"run": "small", "candidates": 3, "top_k": 2, "floor": 0.1}))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for module, args in (("retrieval_report", ["--documents", tables[0], "--questions", tables[1], "--out", tables[2], "--config", str(config)]), ("library_refresh", ["--documents", tables[0], "--library", f"file://{tmp_path}/l", "--checkpoint", f"file://{tmp_path}/s"])):
        done = subprocess.run([sys.executable, "-m", f"jobs.{module}", *args], cwd=root, env=env, capture_output=True, text=True, timeout=240)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"jobs.{module} read" in done.stderr


def test_a_run_that_fails_is_made_good_by_the_next(spark, tmp_path, monkeypatch):
    """The paths' stream is through, the contents' is not: the same batch comes again, with the same number."""
    folder, library, state = (f"file://{tmp_path}/{x}" for x in ("in", "library", "state"))
    put(spark, folder, [(1, "s", GOOD, "en"), (2, "s", GOOD + "\nMore.", "en")])
    whole = library_refresh.ingest.text_blocks

    def broken(*args):
        raise RuntimeError("no room")

    monkeypatch.setattr(library_refresh.ingest, "text_blocks", broken)
    with pytest.raises(Exception, match="no room"):
        library_refresh.run(spark, folder, library, state)
    assert spark.conf.get(refresh.PROVIDER, "unset") != refresh.ROCKSDB
    assert library_refresh.catalog(spark, library).count() == 2 and library_refresh.passages(spark, library).count() == 0
    monkeypatch.setattr(library_refresh.ingest, "text_blocks", whole)
    assert listed(library_refresh.run(spark, folder, library, state)) == expected({"s/1": GOOD, "s/2": GOOD + "\nMore."})
    assert [r.batch for r in spark.read.parquet(f"{library}/texts").select("batch").distinct().collect()] == [0]


def test_odd_documents(spark, tmp_path):
    """Null ids and sources, other columns with the names of the job's own, one path twice in a batch."""
    rows = [(None, None, GOOD + "\nno id", "en"), (1, None, GOOD + "\n1", "en"), (1, None, GOOD + "\n2", "en"), (2, "s", "", "en"), (3, "s", " \n ", "en")]
    df = spark.createDataFrame(rows, DOC).withColumns({"sha": F.lit("clash"), "path": F.lit("p"), "batch": F.lit(7), "at": F.lit(1)})
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    out = library_refresh.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/l", f"file://{tmp_path}/s")
    last = max((GOOD + "\n1", GOOD + "\n2"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert listed(out) == expected({"/": GOOD + "\nno id", "/1": last, "s/2": "", "s/3": " \n "})


def test_report_without_documents_or_questions(spark, tables, tmp_path):
    docs, asked, out = tables
    spark.createDataFrame([], DOC).write.parquet(f"file://{tmp_path}/none")
    assert retrieval_report.run(spark, f"file://{tmp_path}/none", asked, out).count() == 0
    m = spark.read.json(f"{out}/metrics/run=bm25").first()
    assert (m.n, m.mrr, m.refusal_rate) == (5, 0.0, 1.0)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/no_questions")
    assert retrieval_report.run(spark, docs, f"file://{tmp_path}/no_questions", f"{out}2").count() == 0
    assert spark.read.schema(retrieval_report.METRICS).json(f"{out}2/metrics/run=bm25").first().n == 0


def moved(spark, since=-1):
    """(bytes that stages after ``since`` have shuffled, the last stage)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    stages = [found.apply(i) for i in range(found.size())]
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() > since), max((s.stageId() for s in stages), default=-1)


def test_texts_move_once_to_their_state_and_once_to_their_paths(spark, tmp_path):
    """As for large tables, where no side of a join is broadcast."""
    lines = lambda i: "\n".join(hashlib.sha512(f"{i} {k}".encode()).hexdigest() for k in range(160))
    rows = [(i, "s", lines(i), "en") for i in range(60)] + [(100 + i, "s", lines(0), "en") for i in range(60)]
    put(spark, f"file://{tmp_path}/in", rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, last = moved(spark)
        out = library_refresh.run(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/l", f"file://{tmp_path}/s")
        out.write.format("noop").mode("overwrite").save()
        assert moved(spark, last)[0] < 2.5 * sum(len(lines(i)) for i in range(60))
        assert listed(out) == expected({f"s/{i}": t for i, _, t, _ in rows})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_go_where_they_are_read(spark, monkeypatch):
    """Also if a task has forgotten that it had them."""
    import pandas as pd

    first = lambda *batches: [list(x) for x in refresh._first_here(pd.Series(list(b), dtype=object) for b in batches)]
    assert first("aba", "", "bca") == [[True, True, False], [], [False, True, False]]
    monkeypatch.setattr(refresh, "REMEMBERED", 1)
    assert first("aba", "b") == [[True, True, False], [True]]
    files = spark.createDataFrame([("p", None, None), *((f"p{i}", f"s{i % 3}", f"t{i % 3}") for i in range(300))], "path string, sha string, text string")
    assert sorted(map(tuple, refresh.contents(files).collect())) == [(f"s{i}", f"t{i}") for i in range(3)]


def test_quality_of_whole_texts_is_that_of_their_lines(spark):
    texts = ["", " \n ", "\t\n", "a", "ab\nabcd\nabcde", GOOD, GOOD + "\r\n\x0b" + "x" * 50, "a\nb\nc\n" * 60, "é\U0001f600\n" * 40, "line of twelve\n" * 9 + "abc\n" * 5, "\n\n" + "y" * 99, "y" * 100, None]
    df = spark.createDataFrame(list(enumerate(texts)), "book int, text string")
    ingest = library_refresh.ingest
    want = ingest.text_quality(df.select("book", F.explode(F.split("text", "\n")).alias("line")))
    got = df.select("book", F.inline(F.array_compact(F.array(ingest.whole_text_quality(F.col("text"))))))
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {r.verdict for r in got.collect()} == {"ok", "fragmented", "no usable text layer"}
