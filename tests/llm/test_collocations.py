"""Phrases against brute force, and the parts of the tries' exchange."""

import random
import re
from collections import Counter

import pytest

from lectern.llm import collocations
from lectern.llm.collocations import Settings, Trie, cut, merged, packed, places, runs, unpacked, walk, windows_of

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, s):
    """(lang, rank, phrase, a, l, r, n, score, cut) by counting all phrases in a dictionary."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, 6):
                    if i + m <= len(words):
                        f[lang, tuple(words[i : i + m])] += 1
    many = {k: a for k, a in f.items() if a >= s.least and len(k[1]) > 1}
    inside = {}
    for (lang, words), a in many.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    key = lang, words[i:j]
                    inside[key] = max(inside.get(key, 0), a)
    out = {}
    for (lang, words), a in many.items():
        if 100 * inside.get((lang, words), 0) >= s.cover * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), k, f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -score, k) for lang, found in out.items() for i, (score, a, p, k, x, y) in enumerate(sorted(found)[: s.top], 1)}


@pytest.fixture(scope="module")
def rows():
    """A small vocabulary with fixed phrases, a word that fills texts, and odd rows."""
    r = random.Random(5)
    vocabulary = ["the", "Of", "été", "b c", "x-y", "zz", "日本", "İ", "(a)", "q"]
    fixed = ["new york city", "the the the", "of course not at all", "été x-y zz"]
    out = []
    for i in range(160):
        words = [r.choice(fixed) if r.random() < 0.2 else r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        out.append((r.choice(["en", "en", "en", "fr", None]), r.choice([" ", "  ", "\t"]).join(words).replace("zz", r.choice(["zz", "zz.", "zz\n", "ZZ,"]))))
    out += [("en", None), (None, ""), ("fr", " .,;\n"), ("en", "the " * 3000), ("und", "new york city"), ("", "alone"), *[("en", "of course not at all")] * 30]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None if i % 50 == 7 else i, t, lang, "s", 1) for i, (lang, t) in enumerate(rows)], DOC)
    return df.withColumns({"phrase": F.lit("clash"), "a": F.lit(1), "m": F.lit(2.0), "n": F.lit("n")}).repartition(5)


@pytest.mark.parametrize(
    "s",
    [
        Settings(least=5),
        Settings(least=1, top=50, shard_bytes=300, range_bytes=200, fan=3),
        Settings(least=4, cover=60, shard_bytes=500, range_bytes=900, fan=2, draws=3),
        Settings(least=2, top=3, shard_bytes=64, range_bytes=500, fan=4, draws=500),
    ],
)
def test_collocations_equal_brute_force(docs, rows, s):
    """Also in several rounds of merging, with splitters inside hot prefixes."""
    got = [tuple(r) for r in collocations.collocations(docs, s).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, s)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOC)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, "en", "s", 1), (2, "?!", None, None, None)], DOC)).count() == 0


def test_scores_beyond_64_bits(spark):
    """The counts are planted below the arithmetic: 1000 * a * n and l * r pass 64 bits."""
    from decimal import Decimal

    a, n, x, y = 4 * 10**12 + 7, 9 * 10**12 + 5, 8 * 10**12 + 1, 7 * 10**12 + 3
    row = spark.createDataFrame([(a, n, x, y)], "a long, n long, l long, r long").withColumns({"over": collocations.product("a", "n", 1000), "under": collocations.product("l", "r")}).selectExpr("over", "over div under as score").first()
    assert row["over"] == Decimal(1000 * a * n) and row["score"] == 1000 * a * n // (x * y)


def test_tries_survive_packing_and_cuts():
    r = random.Random(2)
    texts = [(b"en", " ".join(r.choice("abcd") * r.randint(1, 3) for _ in range(60)).encode(), 10**9) for _ in range(20)] + [(b"fr", b"a b. c", 6)]
    trie = windows_of(texts)

    def listed(t: Trie):
        return [(tuple(t.words[w - 1].as_py() if w else None for w in row), c) for row, c in zip(t.windows.tolist(), t.counts.tolist(), strict=True)]

    whole = listed(trie)
    assert [k for k, _ in whole] == sorted((k for k, _ in whole), key=lambda k: [w or b"" for w in k])
    assert listed(unpacked(packed(trie))) == whole
    keys = sorted({k for k, _ in r.sample(whole, 7)} | {(b"en", b"bx", None, None, None, None), (b"zz",) + (None,) * 5}, key=lambda k: [w or b"" for w in k])
    assert places(trie, keys) == [sum([w or b"" for w in x] < [w or b"" for w in k] for x, _ in whole) for k in keys]
    parts = [t for _, t in cut(trie, keys)]
    assert [x for t in parts for x in listed(unpacked(packed(t)))] == whole
    assert listed(merged(parts[::-1])) == whole
    assert listed(merged([trie, trie])) == [(k, 2 * c) for k, c in whole]


def test_walk_marks_the_ends_of_a_range():
    trie = windows_of([(b"en", b"a b. a c. a b. d", 99)])
    rows = {r["phrase"]: r for r in walk(trie, 2).to_pylist() if r["lang"] == b"en"}
    assert rows[b"a"]["a"] == 3 and rows[b"a"]["open"] and rows[b"a b"]["lefts"] == [3] and rows[b"a b"]["open_lefts"] == 1
    assert rows[b"d"]["a"] == 1 and rows[b"d"]["open"]  # may go on in the next range
    assert rows[b""]["a"] == 7
    assert b"c" not in rows and b"b" in rows


@pytest.mark.parametrize("most", [1, 7, 40])
def test_runs_lose_and_repeat_no_window(most):
    text = b"  aa bb,cc  dd. ee ff gg\thh ii jj; kk" * 3 + b" " + b"w" * 100 + b" end "
    whole, parts = windows_of([(b"en", text, len(text))]), merged(windows_of([r]) for r in runs(b"en", text, most))
    assert whole.words.to_pylist() == parts.words.to_pylist()
    assert whole.windows.tolist() == parts.windows.tolist() and whole.counts.tolist() == parts.counts.tolist()
