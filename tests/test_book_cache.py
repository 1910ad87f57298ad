"""Builds that are stopped go on where they were; progress while one runs."""

import threading

import pytest
from pyspark.sql import functions as F

from lectern import engine, plugins
from lectern.config import Config
from lectern.sources.book_cache import BookCache, cache_key


def body(about):
    return "\n\n".join(f"The {about} of a body number {i} is described in this sentence of some length." for i in range(12))


@pytest.fixture
def folder(tmp_path):
    books = tmp_path / "books"
    books.mkdir()
    for k in range(6):
        (books / f"b{k}.md").write_text(f"# Book {k}\n\n" + body(f"quantity {k}"))
    (books / "copy.md").write_text((books / "b1.md").read_text())
    (books / "poor.txt").write_text("\n".join("ab" for _ in range(100)))
    return books


def rows(chunks):
    return sorted(map(str, chunks.select("book", "ordinal", "text", "citation").collect()))


def test_a_stopped_build_reads_only_the_rest(spark, folder, tmp_path, monkeypatch):
    want, report = engine.build(spark, str(folder), Config())
    want, report = rows(want), sorted(map(str, report.collect()))
    read, whole, add = [], engine.book_chunks, BookCache.add
    monkeypatch.setattr(engine, "book_chunks", lambda files, *a: (read.append({r.path.rsplit("/", 1)[1] for r in files.select("path").collect()}), whole(files, *a))[1])

    def stopped(self, chunks, books):
        if len(read) == 2:  # the chunks are there, the entries are not
            chunks.write.parquet(f"{self.root}/chunks/part=broken")
            raise KeyboardInterrupt
        add(self, chunks, books)

    cache = BookCache(spark, f"file://{tmp_path}/cache")
    monkeypatch.setattr(BookCache, "add", stopped)
    with pytest.raises(KeyboardInterrupt):
        engine.build_in_steps(spark, str(folder), Config(), cache, books_per_commit=2)
    monkeypatch.setattr(BookCache, "add", add)
    done = {r.path.rsplit("/", 1)[1] for r in cache.entries().collect()}
    assert done == read[0] and 0 < len(done) < 7
    read.clear()
    chunks, said = engine.build_in_steps(spark, str(folder), Config(), cache, books_per_commit=100)
    assert rows(chunks) == want and sorted(map(str, said.collect())) == report
    assert len(read) == 1 and not read[0] & done
    # again: nothing is read; a changed file, and only that, is
    read.clear()
    assert rows(engine.build_in_steps(spark, str(folder), Config(), cache)[0]) == want and read == []
    (folder / "b2.md").write_text("# Book 2\n\n" + body("other quantity"))
    engine.build_in_steps(spark, str(folder), Config(), cache)
    assert read == [{"b2.md"}]


def test_another_setting_is_another_book(spark, folder, tmp_path):
    cache = BookCache(spark, f"file://{tmp_path}/cache")
    engine.build_in_steps(spark, str(folder), Config(), cache)
    small = Config().with_overrides({"chunk.tokens": 130, "chunk.overlap": 0, "chunk.min_tokens": 5})
    chunks, _ = engine.build_in_steps(spark, str(folder), small, cache)
    assert chunks.agg(F.max("token_count")).first()[0] <= 130 and cache.entries().count() == 14


def test_an_entry_without_its_chunks_does_not_count(spark, tmp_path):
    cache = BookCache(spark, f"file://{tmp_path}/cache")
    books = spark.createDataFrame([("k1", "p1", "ok", 3), ("k2", "p2", "fragmented", 1)], "key string, path string, became string, n_lines long")
    cache.add(spark.createDataFrame([("k1", "text")], "key string, text string"), books)
    assert {r.key for r in cache.entries().collect()} == {"k1", "k2"}
    spark.createDataFrame([("k3", "p3", "ok", 1, 5, "lost")], "key string, path string, became string, n_lines long, n_chunks long, part string").write.mode("append").parquet(f"{cache.root}/entries")
    assert {r.key for r in cache.entries().collect()} == {"k1", "k2"}
    assert [r.text for r in cache.chunks(books).collect()] == ["text"]


def test_keys(spark):
    key = lambda sha, settings, version=1: spark.range(1).select(cache_key(F.lit(sha), settings, version)).first()[0]
    assert len({key("a", {}), key("b", {}), key("a", {"x": 1}), key("a", {}, 2)}) == 4 and key("a", {"x": 1, "y": 2}) == key("a", {"y": 2, "x": 1}) and len(key("a", {})) == 24


def test_progress_grows_while_a_job_runs(spark):
    seen, over = [], threading.Event()
    with plugins.tracked(spark, "count") as stages:

        def watch():
            while not over.wait(0.1):
                seen.append(sum(done for *_, done, _ in stages()))

        watcher = threading.Thread(target=watch)
        watcher.start()
        slow = lambda batches: (__import__("time").sleep(0.4) or b for b in batches)
        spark.range(0, 12, 1, 12).mapInArrow(slow, "id long").count()
        over.set()
        watcher.join()
        assert sum(done for *_, done, _ in stages()) >= 12 and all(n >= done for *_, done, n in stages())
    assert seen == sorted(seen) and len(set(seen)) > 1
