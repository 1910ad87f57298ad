"""Corpus operators against brute force on small tables, with nulls, empties and repeats."""

import gzip
import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import decontamination, language_id, licenses, lm_scoring, minhash, packing, queries, quality, sharding, suffix_dedup, warc
from lectern.llm.common import fold

WORD = r"[^\x20\x09-\x0D]+"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of one small vocabulary with copies, near copies, edge cases and clashing columns."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdéñ") for _ in range(r.randint(2, 6))) for _ in range(120)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(30, 90))] for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 9])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w) + r.choice(["", ".", "\nEnd line\nEnd line"]), r.choice(["en", "fr"]), f"src{i % 3}", 1))
    rows += [(200, None, "en", "src0", None), (201, "", None, None, 0), (202, " \n\t ", "en", "src1", 3), (203, "Word", "en", "src1", 4), (204, "word", "fr", "src2", 4), (205, "Two Words", None, "src0", 9)]
    rows += [(206, "x " * 3000, "en", "src0", 6000), rows[3], rows[3], (None, rows[4][1], "en", "src0", 1), (None, None, None, None, None), (207, "!!! ### 123", "fr", "src0", 11)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({"v": F.lit("clash"), "c": F.lit(1), "block": F.lit("b"), "class": F.lit(2.0)}).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize(("words", "block"), [(2, 250_000), (2, 100), (5, 100)])
def test_near_duplicates_equal_brute_force(docs, rows, words, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    got = defaultdict(set)
    for r in minhash.near_duplicates(docs, minhash.Settings(words=words)).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, ascii_lower(t or ""))
        sets[i, t] = frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([k for k in sets if k[0] is not None], 2):
        x, y = sets[a, s], sets[b, t]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    for i, t in rows:
        if i is not None:
            assert got[i] == {(len(sets[i, t]), find(i), find(i) == i)}, i
        else:  # a row without an id is with its class, if that has an id
            same = [find(j) for (j, u), x in sets.items() if j is not None and x and x == sets[i, t]]
            assert (len(sets[i, t]), min(same, default=None), not same) in got[i]


def test_links_left_by_stars_are_found(spark):
    """A bucket whose centre is far from a pair that is near."""
    words = [f"w{k}" for k in range(400)]
    chain = [(k, " ".join(words[12 * k : 12 * k + 200])) for k in range(12)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), minhash.Settings(words=2)).collect()}
    assert set(got.values()) == {0}


def repeats(texts, length):
    at = defaultdict(list)
    bodies = [(t or "").encode() for _, t in texts]
    for k, b in enumerate(bodies):
        for p in range(len(b) - length + 1):
            at[b[p : p + length]].append((k, p))
    gone = [bytearray(len(b)) for b in bodies]
    for places in at.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + length] = b"\1" * length
    out = []
    for (i, _), b, g in zip(texts, bodies, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        out.append((i, len(b), sum(g), sum(k for k, _ in itertools.groupby(g)), hashlib.sha256(kept).hexdigest()))
    return out


def keyed(found):
    return sorted(found, key=repr)


def test_repeats_equal_brute_force(docs, rows, spark):
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()
    assert keyed(tuple(r) for r in got) == keyed(repeats(rows, 200))
    r = random.Random(3)
    base = ["".join(r.choice("abé \n") for _ in range(600)) for _ in range(4)]
    texts = [(k, "".join(b[a : a + r.randint(90, 400)] for b, a in ((r.choice(base), r.randint(0, 400)) for _ in range(3)))) for k in range(60)]
    texts += [(100, "a" * 500), (101, "ab" * 200), (102, "q" * 199), (103, "q" * 199), (104, "z" * 200)]
    for pairwise in (24, 1):  # both ways to resolve a group
        got = suffix_dedup.digest(suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), suffix_dedup.Settings(pairwise=pairwise))).collect()
        assert keyed(tuple(r) for r in got) == keyed(repeats(texts, 200))


def test_repeats_merged_in_rounds_equal_brute_force(docs, rows, spark):
    """Blocks of a few documents, joined three at a time."""
    rounds = suffix_dedup.Settings(block_bytes=200, range_bytes=3000, fan_in=3)
    assert suffix_dedup.block_count(docs, rounds.block_bytes) > 27
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, rounds)).collect()
    assert keyed(tuple(r) for r in got) == keyed(repeats(rows, 200))


def test_loser_tree_merges_with_prefixes():
    r = random.Random(1)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 30))) for _ in range(7)]

    def run(strings):
        before = b""
        for s in strings:
            yield s, suffix_dedup.common(before, s)
            before = s

    out = list(suffix_dedup.merge([run(x) for x in runs]))
    assert [s for s, _, _ in out] == sorted(itertools.chain(*runs))
    assert all(k == suffix_dedup.common(a, b) for (a, _, _), (b, k, _) in itertools.pairwise(out))
    blob = suffix_dedup.pack_run(runs[0], [True] * len(runs[0]))
    assert [s for s, _ in suffix_dedup.unpack_run(blob)[1]] == runs[0]


def test_shards_are_even_and_slots_gapless(docs, rows, spark):
    got = sharding.shard_by_size(docs).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + (t is not None or 1), zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), F.repeat(F.lit("y"), (F.col("id") % 40).cast("int")), F.col("id").cast("string"))).alias("text"))
    found = sharding.shard_by_size(many, range_rows=256).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("s"), F.max("slot").alias("m")).collect()
    sizes = [r.b for r in found]
    assert len(found) == 16 and max(sizes) - min(sizes) < 200 and all(r.n == r.s == r.m + 1 for r in found)
    assert sum(r.n for r in found) == 20000


def test_warc_round_trip(spark, tmp_path):
    body = "é" * 600
    pages = [(1, "http://a/1", body), (2, "http://a/2\nx", body), (5, None, body), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", body), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (9, "u", "y" * 1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    want = [(1, 1200, "revisit", 5), (2, 1200, "revisit", 5), (5, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (6, 0, "response", None), (None, 1200, "revisit", 5), (7, 999, "response", None), (8, 999, "response", None), (9, 1000, "response", None), (9, 1000, "response", None)]
    assert got == sorted(want, key=repr)
    root = "file://" + str(tmp_path / "w")
    index = warc.write_archives(df, root)
    r = index.where("page_id = 1").first()
    raw = (tmp_path / "w" / r.file).read_bytes()[r.offset : r.offset + r.length]
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and b"Content-Length: 1200" in gzip.decompress(raw)
    one = warc.read_records(index.where("page_id = 9"), root).collect()
    assert [x.payload_digest for x in one] == [hashlib.sha1(b"y" * 1000).hexdigest()] * 2
    # reads are dealt by bytes of the archives, not by the size of the index
    assert warc.read_records(index, root, task_bytes=200).rdd.getNumPartitions() > 8
    clash = df.withColumns({"digest": F.lit("x"), "d": F.lit(1), "first": F.lit(2), "file": F.lit("f")})
    assert sorted((tuple(r) for r in warc.round_trip(clash).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr) == got
    assert warc.round_trip(df.limit(0)).count() == 0


def test_ranges_are_coalesced():
    got = list(warc.coalesce_ranges([(0, 10), (10, 5), (100, 5), (120, 5), (1000, 900)], 20, 500))
    assert [(a, b) for a, b, _ in got] == [(0, 15), (100, 125), (1000, 1900)] and got[1][2] == [(100, 5), (120, 5)]


def brute_quality(t):
    t = t or ""
    w = re.findall(WORD, t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    n = len(w)
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_quality_equals_brute_force(docs, rows, empty):
    judged = quality.ledger(docs)
    got = sorted((tuple(r) for r in judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=repr)
    assert got == sorted(((i, *brute_quality(t)) for i, t in rows), key=repr)
    assert not judged.where("base_failed and kept").count()
    masks = [r.failures for r in judged.collect()]
    a = {(r.policy, r.rule): r for r in quality.ablations(judged).collect()}
    assert len(a) == sum(map(len, quality.POLICIES.values()))
    for (policy, rule), r in a.items():
        bit, rest = quality.mask((rule,)), quality.mask(tuple(x for x in quality.POLICIES[policy] if x != rule))
        assert r.failing == sum(m & bit > 0 for m in masks) and r.kept_without == sum(m & rest == 0 for m in masks)
        assert r.regained_without == sum(m & bit > 0 and m & rest == 0 for m in masks)
    assert all((r.failures & quality.mask(quality.POLICIES["v3"]) == 0) == r.kept_v3 for r in quality.verdicts(judged).collect())
    assert quality.ledger(empty).count() == 0


def test_language_identification(spark, docs, empty):
    r = random.Random(4)
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(80)] for k, a in (("aa", "abcdeg"), ("bb", "klmnou"))}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(40)), k) for i, k in ((i, r.choice(["aa", "bb"])) for i in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where(fold(F.col("doc_id")) != 0))
    got = df.where(fold(F.col("doc_id")) == 0).select("lang", language_id.judge(F.col("text"), model).alias("r")).collect()
    assert len(got) > 30 and sum(x.lang == x.r.lang_pred for x in got) == len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!")], "doc_id long, text string").select(language_id.judge(F.col("text"), model).alias("r")).collect()
    assert all(x.r.lang_pred == "und" and x.r.score == 0 and x.r.rejected for x in odd)
    assert language_id.fit(empty) == []
    nothing = docs.select(language_id.judge(F.col("text"), []).alias("r")).collect()
    assert {x.r.lang_pred for x in nothing} == {"und"}


def test_decontamination_equals_brute_force(spark, docs):
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(900)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(6, 70)))) for k in range(60)] + [(100, None), (101, ""), (102, "Alone")]
    texts = []
    for k in range(200):
        w = [r.choice(words) for _ in range(r.randint(0, 400))]
        if k % 3 == 0:
            item = r.choice(items[:60])[1].split()
            if k % 2:
                item[r.randrange(len(item))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() if k % 5 == 0 else x for x in item]
        texts.append((k, " ".join(w)))
    texts += [(300, None), (301, ""), (302, "alone")]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(df, bench).collect()}

    def has(t, item):
        a, b = decontamination.words(t or ""), decontamination.words(item or "")
        if not b:
            return False
        cut = decontamination.parts(len(b), 0.25)
        for part in (b[:cut], b[cut:]):
            want = decontamination.shingle_set(part, 5)
            if want:
                k = len(next(iter(want)))
                seen = {tuple(a[i : i + k]) for i in range(len(a) - k + 1)}
                if len(want & seen) < 0.8 * len(want):
                    return False
        return True

    whole = {(i, k) for i, t in texts for k, b in items if b and f" {b.lower()} " in f" {(t or '').lower()} "}
    brute = {(i, k) for i, t in texts for k, b in items if has(t, b)}
    assert whole <= got <= brute and len(whole) > 20
    row = lambda x: (x.doc_id, x.item_id, round(x.score, 9), x.question_overlap, x.answer_overlap)
    for edits in (False, True):  # one index or many say the same
        one, many = (sorted(map(row, decontamination.contaminated(df, bench, decontamination.Settings(edits=edits, index_bytes=n)).collect())) for n in (8 << 20, 500))
        assert one == many and {x[:2] for x in one} >= whole
    twice = decontamination.contaminated(df.unionByName(df), bench).collect()  # repeated rows each get their finds
    assert Counter((x.doc_id, x.item_id) for x in twice) == Counter({k: 2 for k in got})
    assert decontamination.contaminated(df.limit(0), bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0


def test_items_with_one_changed_word_are_found():
    r = random.Random(16)
    words = [f"w{k}" for k in range(800)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate([*range(9, 64, 6), 90])]
    indexes = decontamination.build(items, decontamination.Settings(edits=True))
    for k, text in items:
        texts = []
        for at in range(len(text.split())):
            for new in (["changed"], [], [text.split()[at], "more"]):
                w, around = text.split(), [r.choice(words) for _ in range(60)]
                w[at : at + 1] = new
                texts.append(" ".join(around[:30] + w + around[30:]))
        assert all([f["item_id"] for f in found] == [k] for found in decontamination.scan(texts, indexes)), k
    # the question alone, or with another answer, is no find
    other = [" ".join(t.split()[: decontamination.parts(len(t.split()), 0.25)] + [f"x{i}" for i in range(30)]) for _, t in items]
    assert not any(decontamination.scan(other, indexes))


def test_packing_keeps_every_byte_and_every_conflict(docs, rows, empty):
    got = packing.pack(docs, capacity=512).collect()
    size = Counter()
    for r in got:
        size[r.doc_id] += r.n_bytes
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").encode())
    assert size == want
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_group, r.bin].append(r)
    for part in bins.values():
        assert sum(r.n_bytes for r in part) <= 512 and all(r.n_docs == len(part) for r in part)
        named = [source[r.doc_id] for r in part if r.doc_id is not None and source[r.doc_id] is not None]
        assert len(named) == len(set(named))
        at = 0
        for r in sorted(part, key=lambda r: (r.offset, r.n_bytes)):
            assert r.offset == at
            at += r.n_bytes
    assert packing.pack(empty).count() == 0


def test_bins_do_not_depend_on_the_stored_size(docs, tmp_path, spark):
    found = []
    for codec in ("zstd", "none"):
        docs.write.option("compression", codec).parquet(str(tmp_path / codec))
        got = packing.pack(spark.read.parquet(str(tmp_path / codec)), capacity=512, group_rows=16).collect()
        assert len({r.bin_group for r in got}) > 4
        found.append(sorted(map(repr, got)))
    assert found[0] == found[1]


def test_best_fit_takes_the_tightest_compatible_bin():
    r = random.Random(9)
    pieces = sorted(((r.randint(0, 100), r.choice("abcd"), r.choice([None, 1, 2, 3])) for _ in range(300)), key=lambda p: -p[0])
    bins, want = [], []
    for n, s, c in pieces:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and s not in b["s"] and (c is None or c not in b["c"])]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": 100, "s": set(), "c": set()})
        want.append((k, 100 - bins[k]["left"]))
        bins[k]["left"] -= n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
    assert packing.best_fit(pieces, 100) == want


def test_license_texts(spark, empty):
    mit = next(t for k, t in licenses.KNOWN if k == "MIT")
    texts = [(1, "Copyright (c) 2020 Jane\n\n" + mit.upper().replace(",", " ,")), (2, "some words\nReleased under the MIT Licence\nmore"), (3, "Released under the MIT License, mostly."), (4, None), (5, ""), (6, "(c) 2020"), (7, "Licensed under CC BY-NC 4.0."), (2, "Released under the MIT License.\nx\nreleased under the mit license")]
    got = sorted((r.doc_id, r.license, r.unit, r.n_units) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", "document", 1), (2, "MIT", "line", 3), (7, "CC-BY-NC-4.0", "document", 1)]
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_duckdb(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    df = queries.QUERIES[name](spark, data)
    names = sorted(df.columns)
    norm = lambda r: repr(tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r))
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    got = sorted(norm(r) for r in df.select(*names).collect())
    assert got and got == sorted(norm(r) for r in want.project(", ".join(f'"{c}"' for c in names)).fetchall())


@pytest.mark.parametrize("make", [lambda d: minhash.near_duplicates(d), lambda d: suffix_dedup.remove_repeats(d), lambda d: sharding.shard_by_size(d), lambda d: lm_scoring.score(d)])
def test_empty_tables(empty, make):
    assert make(empty).count() == 0


def test_zip_of_bytes():  # the writer's members stand alone
    raw = warc.record_bytes(1, "u", b"abc", "d", None)
    assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().endswith(b"abc\r\n\r\n")


def test_small_groups_of_copies_share_a_shard(spark):
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 3).cast("string"), F.repeat(F.lit("z"), (F.floor(F.col("id") / 3) % 30).cast("int"))).alias("text"))
    found = sharding.shard_by_size(rows, range_rows=512)
    assert found.groupBy("text_hash").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    sizes = [r.b for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 400


def test_groups_under_the_limit_are_never_cut(spark):
    """Groups of 150 copies, each below a fiftieth of a shard, with splitters drawn often."""
    rows = spark.range(150 * 1067).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 150).cast("string"), F.repeat(F.lit("z"), (F.floor(F.col("id") / 150) % 12).cast("int"))).alias("text"))
    found = sharding.shard_by_size(rows, range_rows=512)
    assert found.groupBy("text_hash").agg(F.countDistinct("shard").alias("n"), F.sum("size").alias("b")).where(f"n > 1 and b <= {0.02 / 16} * {found.agg(F.sum('size')).first()[0]}").count() == 0
    sizes = [r.b for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 3200


def test_license_lines_and_long_texts(spark):
    texts = [
        (1, "Copyright 2020 J. Smith. Released under the MIT License."),
        (2, "© 2020 X Inc. All rights reserved."),
        (3, dict(licenses._FILES)["Apache-2.0"].upper()),
        (4, "Copyright (c) 1999 Y.\n\n" + dict(licenses._FILES)["GPL-3.0"].replace("\n\n", "\n").replace("license", "licence")),
        (5, "SPDX-License-Identifier: MIT and more\rSPDX-License-Identifier: MIT"),
        (None, "Released under the MIT License."),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"license": F.lit("clash"), "digest": F.lit("x"), "unit": F.lit(1)})
    got = sorted(((r.doc_id, r.license, r.unit, r.n_units) for r in licenses.scan(df).collect()), key=repr)
    assert got == sorted([(1, "MIT", "document", 1), (3, "Apache-2.0", "document", 1), (4, "GPL-3.0", "document", 1), (None, "MIT", "document", 1)], key=repr)
    # a list of more lengths than a plan can hold finds the same
    known = licenses.known_digests(spark, [*licenses.KNOWN, *((f"x{k}", "y" * k) for k in range(1, 1200))])
    assert sorted(((r.doc_id, r.license, r.unit, r.n_units) for r in licenses.scan(df, known).collect()), key=repr) == got


def test_null_ids_and_columns_of_other_names(spark):
    """Rows without an id are sharded and compared like others, beside columns that clash."""
    rows = [(None, None), (None, "a text"), (None, "a text"), (1, "a text"), (2, None), (2, ""), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit("clash") for k in ("size", "h", "r", "shard", "v", "u", "c", "n", "key", "class", "i", "t", "part", "w", "term")})
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in sharding.shard_by_size(df).collect())
    assert got == Counter((i, len((t or "").encode()) + (t is not None or 1), zlib.crc32((t or "").encode())) for i, t in rows)
    near = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, minhash.Settings(words=2)).collect())
    assert near == Counter([(None, 0, None, True), (None, 1, 1, False), (None, 1, 1, False), (1, 1, 1, True), (2, 0, 2, True), (2, 0, 2, True), (2, 0, 2, True)])
    bench = spark.createDataFrame([(7, "a text"), (None, "a text")], "item_id long, text string").withColumn("doc_id", F.lit(3))
    found = Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect())
    assert found == Counter({(None, 7): 2, (None, None): 2, (1, 7): 1, (1, None): 1})
    assert packing.pack(df.withColumn("source", F.lit(None).cast("string"))).count() == len(rows)
    judged = quality.ledger(df).collect()
    assert len(judged) == len(rows) and all(r.failures == 1 for r in judged)


def test_very_long_texts(spark):
    """Texts that cross every block of the operators."""
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    long = [" ".join(r.choice(words) for _ in range(60_000)) for _ in range(3)]
    shared = " ".join(r.choice(words) for _ in range(80))
    at = [0, 65_536 - 100, 200_000]
    long = [t[:k] + shared + t[k:] for t, k in zip(long, at, strict=True)]
    texts = [*enumerate(long), (3, shared), (4, long[0])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()
    assert keyed(tuple(x) for x in got) == keyed(repeats(texts, 200))
    item = " ".join(r.choice(words) for _ in range(40))
    leaked = [(k, t[:cut] + " " + item + " " + t[cut:]) for (k, t), cut in zip(texts, (5, 300_000, len(texts[2][1]), 40, 100), strict=True)]
    index = decontamination.build([(1, item)])
    found = decontamination.scan([t for _, t in leaked] + [t for _, t in texts], index, batch_chars=50_000)
    assert [len(f) for f in found] == [1] * 5 + [0] * 5
    comps = {x.doc_id: x.component_id for x in minhash.near_duplicates(df, minhash.Settings(words=2)).collect()}
    assert comps == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    lengths = [x.n_words for x in quality.ledger(df).orderBy("doc_id").collect()]
    assert lengths == [len(t.split()) for _, t in texts]
    packed = packing.pack(df.withColumn("source", F.lit("s"))).groupBy("doc_id").agg(F.sum("n_bytes").alias("n")).collect()
    assert {x.doc_id: x.n for x in packed} == {k: len(t) for k, t in texts}


def test_shards_equal_brute_force(docs, rows, spark):
    """Places in the whole order of keys, summed up one by one."""
    many = [(k, f"text {k // 4} " + "z" * (k % 90)) for k in range(3000)] + [(5000 + k, "one hot text") for k in range(1500)] + [(9000 + k, None if k % 2 else "") for k in range(300)]
    for table, found in ((rows, docs), (many, spark.createDataFrame(many, "doc_id long, text string").repartition(5))):
        got = sharding.shard_by_size(found, range_rows=256).select("doc_id", "size", "shard", "slot").collect()
        keys = sorted(((xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63), i is not None, i or 0, len((t or "").encode()) + 1) for i, t in table)
        total, at = sum(k[3] for k in keys), 0
        middle, groups = [], defaultdict(list)
        for n, (h, _, _, size) in enumerate(keys):
            at += size
            middle.append(at - -(-size // 2))
            groups[h].append(n)
        shard = [0] * len(keys)
        for members in groups.values():
            whole = sum(keys[n][3] for n in members) <= 0.02 * total / 16 and len(members) <= 256
            for n in members:
                shard[n] = min(15, middle[members[0] if whole else n] * 16 // total)
        seen = Counter()
        want = []
        for (_, named, i, size), s in zip(keys, shard, strict=True):
            want.append((i if named else None, size, s, seen[s]))
            seen[s] += 1
        # rows alike in text and id are interchangeable
        key = lambda x: (x[0], x[1], x[2])
        assert Counter(key(x) for x in want) == Counter(key((r.doc_id, r.size, r.shard, r.slot)) for r in got)
        assert Counter((x[2], x[3]) for x in want) == Counter((r.shard, r.slot) for r in got)
