"""Settings, blueprints, slots, variants, command line."""

import pytest
from pyspark.sql import functions as F

from lectern.config import Config, load_env, parse_overrides
from lectern.operators import blueprint, slots, variants


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("A_PORT", "8080")
    monkeypatch.delenv("A_NAME", raising=False)
    cfg = Config({"port": "${A_PORT}", "name": "${A_NAME:-x}-y", "on": "${A_ON:-true}", "deep": {"n": 1}})
    assert (cfg.get("port"), cfg.get("name"), cfg.get("on"), cfg.get("deep.n"), cfg.get("deep.m", 7)) == (8080, "x-y", True, 1, 7)
    other = cfg.with_overrides(parse_overrides(["deep.n=2", "new.key=[1, 2]"]))
    assert (other.get("deep.n"), other.get("new.key"), cfg.get("deep.n")) == (2, [1, 2], 1)
    with pytest.raises(ValueError):
        parse_overrides(["no value"])
    (tmp_path / ".env").write_text("A_PORT=1\nexport A_NAME='z'\n# note\n")
    load_env(str(tmp_path / ".env"))
    assert Config({"p": "${A_PORT}", "n": "${A_NAME}"}).tree == {"p": 8080, "n": "z"}
    assert Config().get("rerank.candidates") == 12


def test_blueprint(spark):
    rows = [("p", 1, "A", "mcq", 10, 2, "", 0), ("p", 2, "a ", "short", 5, 6, "", 3), ("p", 3, "", "x", 0, 0, "", 4)]
    s = spark.createDataFrame(rows, blueprint.SECTION)
    got = {r.seq: set(r.problems) for r in blueprint.section_problems(s).collect()}
    assert got == {1: set(), 2: {"name used twice"}, 3: {"blank name", "no questions", "no marks", "cannot attempt so many"}}
    assert blueprint.paper_marks(s.where("seq < 3")).first().marks == 38


def test_slots_retry_with_feedback(spark):
    def generate(open_):
        text = F.when(F.col("slot") == 1, "Define heat capacity of a gas").when(F.col("slot") == 2, F.when(F.col("feedback") == "", "State the heat capacity of a gas").otherwise("Explain entropy production")).when(F.col("slot") == 3, "Discuss engines")
        return open_.withColumn("text", text)

    def verify(asked):
        return asked.withColumn("problem", F.when(F.col("slot") == 3, "unsupported").otherwise(""))

    s = spark.createDataFrame([(1,), (2,), (3,), (4,)], "slot long")
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    done, log = slots.fill(s, generate, verify, 1)
    assert {r.slot: r.text for r in done.collect()} == {1: "Define heat capacity of a gas", 2: "Explain entropy production"}
    r = slots.report(s, log).first()
    assert (r.requested, r.accepted, r.duplicates, r.ungrounded, r.rejected, r.acceptance_rate) == (4, 2, 1, 1, 2, 0.5)


def test_variants_and_sources(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    arr = F.array(F.lit("q"), F.lit("r1"), F.lit(""), F.lit("r2"), F.lit("r3"), F.lit("r4"))
    assert one(variants.variants(F.lit("q"), arr, F.lit("doc"))) == ["q", "r1", "r2", "r3", "doc"]
    numbers = lambda t, n=5: one(variants.source_numbers(F.lit(t), F.lit(n)))
    assert [numbers(t) for t in ("2", '"1, 3"', '{"x":1}', '[true,null,"4",9,4]', None)] == [[2], [1, 3], [1, 2, 3], [4], [1, 2, 3]]
    assert numbers("7", 2) == [1, 2] and numbers("7", 0) == []
    assert one(variants.condensed(F.lit("it?"), F.lit(" what is heat "), F.lit(True))) == "what is heat"
    assert one(variants.condensed(F.lit("it?"), F.lit("x"), F.lit(True))) == "it?"


def test_ingest_and_ask(spark, tmp_path):
    from lectern import engine
    from lectern.cli import ENCODER, ENCODER_NAME, ask
    from lectern.sources.index_store import IndexStore, chapters_of

    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "one.md").write_text("# Heat\n\n" + "Heat is energy in transit between bodies. " * 30 + "\n# Work\n\n" + "A piston moves and work is done on it. " * 30)
    (tmp_path / "b" / "two.txt").write_text("Gardens need water and light in spring. " * 30)
    store = IndexStore(spark, str(tmp_path / "ix"))
    store.save(engine.build(spark, str(tmp_path / "b"), Config(), ENCODER)[0], {"embedding_model": ENCODER_NAME})
    chunks, _ = store.load()
    assert [r.chapters for r in chapters_of(chunks).collect()] == [["Heat", "Work"]]
    assert "energy in transit" in ask(spark, store, "what is heat energy", Config()).first().context


def test_renderings(spark):
    from lectern.functions import render

    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(render.retrieval_summary(lit(4), lit(0.25), lit(0.5), lit(1.0), lit(0.583), lit(0.0))) == "n=4  Hit@1=25.0%  Hit@3=50.0%  Hit@k=100.0%  MRR=0.583  refusals=0.0%"
    assert one(render.retrieval_summary(lit(0), *[lit(None).cast("double")] * 5)).startswith("n=0")
    none = lit(None).cast("double")
    row = {"n": lit(2), "errors": lit(0), "unreviewed": lit(1), "answer_rate": lit(1.0), "cited_page_hit": none, "context_page_hit": none, "keyword_recall": none, "correct_refusal_rate": none}
    text = one(render.gold_summary(row))
    assert "answered 100%, right page cited n/a" in text and text.endswith("provisional")
    options = F.array(lit("x"), lit("y"))
    assert one(render.full_question(lit("Q?"), options, lit("y"))) == "Q?\n  A) x\n  B) y\nStated correct answer: y"
    assert one(render.full_question(lit("Q?"), lit(None).cast("array<string>"), lit(None).cast("string"))) == "Q?"
    words = F.array(*map(lit, [" Heat", "heat", "work", "", "Gas", "none", "law", "cold"]))
    assert one(render.gold_keywords(words, lit("HEAT and work of gas by law in cold"))) == ["Heat", "work", "Gas", "law"]
    assert one(render.split_for_context(lit("aa\nbb\ncccccccc\nd"), 6)) == ["aa\nbb\n", "cccccccc\n", "d"]
    assert one(render.split_for_context(lit(""), 6)) == []
    md = "see [a](http://b) <http://c>\n[d]: e\n```\n[a](b)\n```\n- [x](y)"
    assert one(render.safe_markdown(lit(md))) == "see [a] (http://b) \\<http://c>\n\\[d]: e\n```\n[a](b)\n```\n- \\[x] (y)"
