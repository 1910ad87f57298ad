"""The engine put together: books to an index, and questions to contexts that answers may cite."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import plugins
from lectern.config import Config
from lectern.functions.text import citation, embed_text, needs_condensing, token_count
from lectern.operators import answer, chunking, context, dense, fusion, ingest, lexical, variants
from lectern.sources.book_cache import BookCache, cache_key
from lectern.sources.books import discover, read_blocks, read_contents
from lectern.sources.scratch import stored

Encoder = Callable[[list[str]], np.ndarray]


def book_chunks(read: DataFrame, cfg: Config, encode: Encoder | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of each of the files (path, suffix, book_id, content), with vectors if there is an encoder, and (path,
    became, n_lines). A book of poor text is left out. Running headers and footers go from PDFs, whose contents,
    if they have any, say what chapter a page begins in."""
    blocks = stored(read_blocks(read).join(read.select("path", "suffix"), "path"))
    entries = read_contents(read)
    text = blocks.where("text is not null").withColumnRenamed("path", "book")
    quality = ingest.text_quality(text, line="text", pages=F.col("page"))
    good = quality.where("verdict = 'ok'").select("book") if cfg.get("ingest.skip_fragmented", True) else quality.select("book")
    pdf = F.col("suffix") == "pdf"
    marks = ingest.furniture(text.where(pdf).withColumnRenamed("text", "line")).where("edge and pattern").select("book", "line_no")
    kept = text.join(good, "book", "left_semi").join(marks, ["book", "line_no"], "left_anti")
    annotated = ingest.annotate(kept, cfg.get("chunk.heading_ratio", 1.15), contents=entries.withColumnRenamed("path", "book"))
    units = ingest.paragraph_units(annotated)
    chunks = chunking.pack_chunks(units, cfg.get("chunk.tokens", 700), cfg.get("chunk.overlap", 120), cfg.get("chunk.min_tokens", 60))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    named = read.join(entries.select("path", "title").distinct(), "path", "left").select("path", "book_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), stem).alias("title"))
    chunks = chunks.join(named.select(F.col("path").alias("book"), "book_id", "title"), "book")
    chunks = chunks.withColumn("citation", citation(F.col("title"), F.col("chapter"), F.col("section"), F.col("page_start"), F.col("page_end")))
    if encode is not None:
        chunks = chunks.withColumn("embedding", plugins.embedder(encode)(embed_text(F.col("title"), F.col("chapter"), F.col("section"), F.col("text"))))
    problems = blocks.where("problem is not null").select("path", "problem")
    report = read.select("path").join(quality.select(F.col("book").alias("path"), "verdict", "n_lines"), "path", "left").join(problems, "path", "left")
    return stored(chunks), report.select("path", F.coalesce("problem", "verdict").alias("became"), "n_lines")


SAME = "same content as another or known"


def build(spark: SparkSession, folder: str, cfg: Config, encode: Encoder | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of the books of a folder, and a report with a row for each file: what became of it. Files of equal
    content are read once, those that are ``known`` (sha) not at all."""
    files = discover(spark, folder)
    fresh = ingest.new_files(files.select("path", "sha"), known.select("sha") if known is not None else files.select("sha").limit(0))
    read = files.join(fresh.select("path"), "path", "left_semi")
    chunks, became = book_chunks(read, cfg, encode)
    report = files.select("path", "sha", "book_id").join(fresh.select("path", F.lit(True).alias("fresh")), "path", "left").join(became, "path", "left")
    became = F.when(F.col("fresh").isNull(), SAME).otherwise(F.col("became"))
    return ingest.dedup_passages(chunks), report.select("path", "sha", "book_id", became.alias("became"), "n_lines")


#: Settings that decide what a book's chunks are.
CHUNK_SETTINGS = ("chunk.tokens", "chunk.overlap", "chunk.min_tokens", "chunk.heading_ratio", "ingest.skip_fragmented")


def build_in_steps(spark: SparkSession, folder: str, cfg: Config, cache: BookCache, encode: Encoder | None = None, model: str = "none", books_per_commit: int = 256) -> tuple[DataFrame, DataFrame]:
    """What ``build`` makes, of books in the cache and of those that are missing, which go there some at a
    time. If it is stopped, the next call reads only the rest. Vectors of another ``model`` are not taken."""
    files = discover(spark, folder)
    settings = {name: cfg.get(name) for name in CHUNK_SETTINGS} | {"model": model}
    fresh = ingest.new_files(files.select("path", "sha"), files.select("sha").limit(0))
    books = stored(fresh.select("path", "sha").withColumn("key", cache_key(F.col("sha"), settings)))
    left = stored(cache.missing(books))
    steps = math.ceil(left.count() / books_per_commit)
    for step in range(steps):
        some = left.where(F.pmod(F.xxhash64("key"), F.lit(steps)) == step)
        chunks, became = book_chunks(files.join(some.select("path"), "path", "left_semi"), cfg, encode)
        cache.add(chunks.join(some.select(F.col("path").alias("book"), "key"), "book"), became.join(some, "path"))
    made = cache.entries()
    # a book keeps the chunks that it had under another path, and takes its own path for them
    chunks = cache.chunks(books).drop("book").join(books.select("key", F.col("path").alias("book")), "key").drop("key")
    named = books.join(made.select("key", "became", "n_lines"), "key", "left").select("path", "became", "n_lines", F.lit(True).alias("fresh"))
    report = files.select("path", "sha", "book_id").join(named, "path", "left")
    became = F.when(F.col("fresh").isNull(), SAME).otherwise(F.col("became"))
    return ingest.dedup_passages(chunks), report.select("path", "sha", "book_id", became.alias("became"), "n_lines")


def retrieve(questions: DataFrame, chunks: DataFrame, cfg: Config, encode: Encoder | None = None, rerank: Callable[[Column, Column], Column] = plugins.overlap_reranker, only: Column | None = None, index: lexical.Index | None = None) -> DataFrame:
    """(query_id, context, citations, passages, top_score, grounded, answered) for questions (query_id, text), which may have
    ``history`` and ``condensed``, ``rewrites`` and ``passage``.

    All variants of all questions go through one search of each index. Dense and lexical lists are fused, the best
    candidates scored anew, and those that reach the floor go with their neighbours into a context within the budget."""
    kind = dict(questions.dtypes)["query_id"]
    asked = stored(variants.keyed(variants.asked(questions, cfg.get("retrieve.n_queries", 3))))
    index = index or lexical.build(chunks, "id")
    words = lexical.search(asked, chunks, cfg.get("retrieve.bm25_top_k", 40), only, key="id", query="asked", index=index)
    lists = words.select("asked", "id", F.lit("bm25").alias("retriever"), "rank")
    if encode is not None:
        meant = asked.select("asked", plugins.embedder(encode)(F.col("text")).alias("embedding"))
        near = dense.search(meant, chunks, cfg.get("retrieve.dense_top_k", 40), only, key="id", query="asked")
        lists = lists.unionByName(near.select("asked", "id", F.lit("dense").alias("retriever"), "rank"))
    fused = fusion.fuse(variants.unkeyed(lists, kind), cfg.get("rerank.candidates", 12), key="id")
    questions = asked.where("variant = 0").select("query_id", "text")
    # the question goes to the passage, as it is the shorter; what is scored leaves its text where it was
    rows = fused.join(questions.select("query_id", F.col("text").alias("question")), "query_id").join(chunks.select("id", "book_id", "ordinal", "text"), "id")
    hits = stored(fusion.rerank(rows, rerank(F.col("question"), F.col("text")), cfg.get("rerank.top_k", 8), cfg.get("rerank.min_score", 0.02)).select("query_id", "id", "book_id", "ordinal", F.col("rerank_score").alias("score"), "relevance_rank"))
    near = context.reading_order(context.expand_neighbours(hits, chunks, cfg.get("retrieve.neighbor_window", 1)))
    # what fits is found by lengths, and only texts that are kept go to their question, cut to what is shown of them
    sizes = near.join(chunks.select("id", "citation", token_count(F.col("text")).alias("cost")), "id")
    kept = stored(context.select_within(sizes, cfg.get("retrieve.max_context_tokens", 4500), cost=F.col("cost")).drop("cost"))
    texts = kept.join(chunks.select("id", "text"), "id").withColumn("text", context.shown(F.col("text"), F.col("tokens")))
    made = context.render(texts)
    sound = answer.grounded(hits, kept, made)
    best = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    out = questions.select("query_id").join(made, "query_id", "left").join(best, "query_id", "left").join(sound, "query_id", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    return out.withColumn("answered", answer.gate(F.col("grounded"), F.col("context"), F.col("top_score"), cfg.get("grounding.answer_threshold", 0.05)))


Client = Callable[[], Callable[[str], str]]


def check_claims(answers: DataFrame, passages: DataFrame, fast: Client, primary: Client | None = None, retries: int = 0) -> DataFrame:
    """(answer_id, claims_ok, n_failed) of answers (answer_id, raw) with statements, judged against
    the passages they cite; where the fast model gives no JSON, the primary one is asked. What
    no verdict supports has failed."""
    said = stored(answer.statements(answers))
    prompts = answer.claim_prompts(said, passages).withColumn("prompt_id", F.xxhash64("answer_id", "batch"))
    prompts = stored(prompts)
    replies = plugins.complete_json(prompts, fast, retries)
    if primary is not None:
        rest = prompts.join(replies.where("json is null").select("prompt_id"), "prompt_id", "left_semi")
        replies = replies.where("json is not null").unionByName(plugins.complete_json(rest, primary, retries))
    verdicts = answer.claim_verdicts(prompts.select("prompt_id", "answer_id").join(replies, "prompt_id"))
    return answer.claims_supported(said, verdicts)


CONDENSE = "Rewrite the question so that it can be understood without the conversation. Reply with the question alone.\n\nCONVERSATION\n{}\n\nQUESTION\n{}"
ANSWER = "Answer from the passages alone, with the number of a passage after each statement, as in [1]. If they do not say, reply NOT_IN_SOURCE.\n\nPASSAGES\n{}\n\nCONVERSATION\n{}\n\nQUESTION\n{}"


def _prompt(template: str, *parts: Column) -> Column:
    """The template's places filled in order, none of them looked at again."""
    said = template.split("{}")
    return F.concat(F.lit(said[0]), *[c for part, rest in zip(parts, said[1:], strict=True) for c in (F.coalesce(part, F.lit("")), F.lit(rest))])


def ask(turns: DataFrame, chunks: DataFrame, cfg: Config, client: Client, fast: Client | None = None, encode: Encoder | None = None, **search) -> DataFrame:
    """(query_id, searched, outcome, answer, sources) for turns (query_id long, text, history), where history is what
    was said before, or empty.

    A turn that leans on its history is rewritten by the model and searched in that form. Without passages that
    reach the threshold the model is not asked, and the outcome is ``refused``; else it is that of the checks,
    ``accepted`` if they all pass, ``failed`` if no reply came. Only an accepted answer is given, with its sources."""
    turns = stored(turns.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("history", F.lit("")).alias("history")))
    leans = turns.where((F.col("history") != "") & needs_condensing(F.col("text")))
    rewritten = plugins.complete(leans.select(F.col("query_id").alias("prompt_id"), _prompt(CONDENSE, F.col("history"), F.col("text")).alias("prompt")), client)
    asked = turns.join(rewritten.select(F.col("prompt_id").alias("query_id"), F.col("reply").alias("condensed")), "query_id", "left")
    asked = stored(asked.withColumn("has", F.col("history") != ""))
    questions = asked.select("query_id", "text", F.col("has").alias("history"), "condensed")
    found = stored(retrieve(questions, chunks, cfg, encode, **search))
    rows = found.where("answered").join(asked.select("query_id", "text", F.col("history").alias("said")), "query_id")
    prompts = rows.select(F.col("query_id").alias("prompt_id"), _prompt(ANSWER, F.col("context"), F.col("said"), F.col("text")).alias("prompt"))
    replied = stored(plugins.complete(prompts, client).select(F.col("prompt_id").alias("answer_id"), F.col("reply").alias("raw")))
    answers = replied.where("raw is not null").join(found.select(F.col("query_id").alias("answer_id"), "citations", "passages"), "answer_id")
    checked = answers.select("answer_id").withColumns({"claims_ok": F.lit(True)})
    if cfg.get("grounding.verify_answer_claims", True):
        passages = answers.select("answer_id", F.explode("passages").alias("p")).select("answer_id", "p.n", "p.citation", "p.text")
        checked = check_claims(answers.select("answer_id", "raw"), passages, fast or client, client if fast else None).select("answer_id", "claims_ok")
    outcome = answer.verdict(F.col("raw"), F.size("citations"), F.coalesce("claims_ok", F.lit(False)), cfg.get("grounding.require_sentence_citations", False))
    judged = stored(answers.join(checked, "answer_id", "left").select("answer_id", "raw", "citations", outcome.alias("outcome")))
    accepted = judged.where("outcome = 'accepted'")
    said = judged.select("answer_id", "outcome").join(accepted.select("answer_id", F.col("raw").alias("answer")), "answer_id", "left").join(answer.sources(accepted), "answer_id", "left")
    searched = variants.asked(questions).where("variant = 0").select("query_id", F.col("text").alias("searched"))
    none = F.when(F.coalesce("answered", F.lit(False)), "failed").otherwise("refused")
    out = searched.join(found.select("query_id", "answered"), "query_id", "left").join(said.withColumnRenamed("answer_id", "query_id"), "query_id", "left")
    return out.select("query_id", "searched", F.coalesce("outcome", none).alias("outcome"), "answer", "sources")
