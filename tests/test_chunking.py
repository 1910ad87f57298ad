"""Chunks over ranges of units against the walk through a whole book."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking
from lectern.operators.chunking import Limits, Shelf, Unit, chunks_of, pack_chunks, shelve

UNITS = "book string, unit long, chapter string, section string, page_start int, page_end int, text string, page_marks array<struct<off:int,page:int>>"
WORDS = ["heat", "Entropy", "flows", "from", "a", "warm", "body", "to", "the", "colder.", "It", "rises!", "Why?", "(see", "9)"]


def book(r, name, n, chapters, size):
    chapter, out = "c0", []
    for k in range(n):
        if r.random() < chapters:
            chapter = f"c{r.randint(0, 3)}"
        words = [r.choice(WORDS) for _ in range(size(r))]
        text = " ".join(words)
        page = 1 + k // 5
        out.append((name, 10 * k, chapter if r.random() < 0.98 else None, r.choice(["", f"s{k // 7}"]), page, page + 1, text, [(0, page), (len(text) // 2, page + 1)]))
    return out


def expected(rows, limits):
    out = []
    for name in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        units = [Unit(t or "", c or "", s or "", a, b, tuple(m)) for _, _, c, s, a, b, t, m in own]
        out += [(name, k, f"{name}::{k:05d}", c.chapter, c.label, c.first, c.last, chunking.cost(c.text), c.text) for k, c in enumerate(chunks_of(units, limits), 1)]
    return sorted(out, key=repr)


def sizes(*pairs):
    """Sizes in words with their odds."""
    return lambda r: r.choices([p[0] for p in pairs], [p[1] for p in pairs])[0] + r.randint(0, 3)


@pytest.mark.parametrize(
    ("limits", "range_units", "size"),
    [
        (Limits(60, 12, 10), 22, sizes((3, 5), (12, 3), (60, 1))),
        (Limits(60, 12, 10), 30, lambda r: 9),  # cuts that never meet if they begin apart
        (Limits(60, 25, 25), 22, sizes((1, 2), (40, 3))),  # small ones between large ones
        (Limits(40, 0, 1), 22, sizes((2, 1), (30, 1), (90, 1))),
        (Limits(60, 40, 10), 25, sizes((0, 1), (5, 3), (40, 2))),
    ],
)
def test_ranges_equal_the_walk(spark, limits, range_units, size):
    r = random.Random(3)
    rows = book(r, "long", 260, 0.01, size) + book(r, "short", 9, 0.3, size) + book(r, "one", 1, 0, size) + book(r, "mixed", 80, 0.1, size)
    df = spark.createDataFrame(rows, UNITS).withColumns({"range": F.lit("clash"), "i": F.lit(1)}).repartition(3)
    got = pack_chunks(df, limits.most, limits.overlap, limits.least, range_units)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, limits)


def test_small_drafts_between_large_ones_settle_across_ranges(spark):
    """Every other unit is small and fits in neither neighbour but by what the one before it did."""
    rows = [("b", k, "c", "", 1, 1, ("x" * 8 if k % 2 else "y" * (4 * (59 if k % 4 else 58))), [(0, 1)]) for k in range(120)]
    got = pack_chunks(spark.createDataFrame(rows, UNITS), 60, 0, 10, 22)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, Limits(60, 0, 10))


def test_texts_move_few_times(spark, monkeypatch):
    """what looks for the entries of ranges sees thin texts, and numbers are found without any."""
    r, kept, stored = random.Random(5), [], chunking.stored
    monkeypatch.setattr(chunking, "stored", lambda df, *a: kept.append(stored(df, *a)) or kept[-1])
    rows = book(r, "b", 200, 0, sizes((12, 3), (60, 1)))
    got = pack_chunks(spark.createDataFrame(rows, UNITS), 60, 12, 10, 22, ready=True)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, Limits(60, 12, 10))
    whole = [df for df in kept if "text" in df.columns and df.where(F.regexp_replace("text", "[x\\s.!?()]", "") != "").groupBy().agg(F.max(F.length(F.regexp_replace(F.col("text"), "^x+", "")))).first()[0] > 200]
    assert len(whole) == 2  # units in their order, and drafts


def test_thin_texts_lead_the_same_way(spark):
    r, limits = random.Random(6), Limits(60, 12, 10)
    pieces = ["a", "b9", " ", "  ", "\u00a0", ". ", "! A", "\n", "\t", "é", "\U0001f600", "word "]
    texts = ["".join(r.choice(pieces) for _ in range(r.choice([0, 3, 20, 60, 90, 130]))) for _ in range(120)]
    thin = [t for (t,) in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(chunking._thin(F.col("t"), limits)).collect()]
    assert any(a != b for a, b in zip(texts, thin, strict=True))
    one, two = ([Unit(t, "c", f"s{k // 5}", k, k) for k, t in enumerate(of)] for of in (texts, thin))
    one, two = chunking.Run(one, limits), chunking.Run(two, limits)
    for at in range(120):
        now = (at, None)
        while now[0] < 120:
            assert one.step(*now)[:2] == two.step(*now)[:2]
            now = one.step(*now)[:2]


def test_empty_table(spark):
    assert pack_chunks(spark.createDataFrame([], UNITS)).count() == 0


def test_a_small_draft_joins_a_neighbour():
    limits = Limits(10, 0, 4)
    key = lambda k: (k, 0)
    heads, after = shelve([(key(0), 20, False, True), (key(1), 8, False, True), (key(2), 8, False, True), (key(3), 39, False, True), (key(4), 4, False, True)], Shelf(), limits)
    assert heads == [key(0), key(0), key(0), key(3), key(4)] and after == Shelf(key(3), 39, key(4), 4)
    assert shelve([(key(5), 30, False, True)], after, limits)[0] == [key(4)]
    assert shelve([(key(5), 30, True, False)], after, limits)[0] == [key(5)]
    with pytest.raises(ValueError):
        Limits(10, 0, 5)
