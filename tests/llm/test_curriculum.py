"""The mix against brute force: targets, passes, turns."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lectern.llm import curriculum
from lectern.llm.curriculum import Settings, integral, whole_weights

DOC = "doc_id long, text string, lang string, source string, n_chars long"
STEPS = Settings(schedules=(((0, 1), (1, 1)), ((0, 0), (Fraction(1, 2), 2), (1, 0)), ((0, Fraction(1, 3)), (Fraction(1, 4), 5), (1, 5))), repeats=2, slice_rows=4)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (i * 7 % 23), "en", f"src{i % 7 if i % 3 else 0}", 1) for i in range(150)]
    rows += [(200, None, "en", "src1", None), (201, "", None, None, 0), (202, " \n\t ", "en", "empty", 3), (203, "a\x0bb\x0cc\rd", "en", None, 4), (204, "é日 x", "fr", "Ä", 4), (205, "z " * 9000, "fr", "src2", 4)]
    rows += [rows[3], rows[3], rows[3], (None, "no id here", "en", "src0", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).withColumns({"size": F.lit("clash"), "row": F.lit(1), "target": F.lit(2.0), "h": F.lit("x")}).repartition(3)


def shares(sizes, weights, repeats):
    """Exact targets, shared again and again until no source is above its cap."""
    total, capped = Fraction(sum(sizes.values())), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in capped)
        v = sum(w for s, w in weights.items() if s not in capped)
        above = {s for s in sizes if s not in capped and weights[s] * rest / v > repeats * sizes[s]} if v else set()
        if not above:
            return {s: Fraction(repeats * sizes[s]) if s in capped else weights[s] * rest / v for s in sizes}
        capped |= above


@pytest.mark.parametrize("s", [Settings(), STEPS, Settings(slice_rows=3)])
def test_mix_equals_brute_force(docs, s):
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.collect()]
    sizes = Counter()
    for _, n, source in rows:
        sizes[source] += n
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weights = dict(zip(names, (w for _ in names for w in whole_weights(s.schedules)), strict=False))
    want = shares(sizes, weights, s.repeats)
    taken = Counter()
    for source in names:
        left = int(want[source])
        order = sorted(((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), n, i) for i, n, x in rows if x == source), key=lambda x: x[:2])
        given = [0] * len(order)
        while left:
            for k, (_, n, _) in enumerate(order):
                given[k] += min(left, n)
                left -= min(left, n)
        taken.update((i, n, source, g) for (_, n, i), g in zip(order, given, strict=True))
    got = curriculum.mix(docs, s)
    summed = got.groupBy("row", "doc_id", "size", "source", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert Counter((r.doc_id, r["size"], r.source, r.taken) for r in summed) == taken
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12) for r in summed)
    assert all(r.taken <= s.repeats * r["size"] for r in summed)
    # the order of training: positions rise along the files, and turns follow the schedule
    listed = got.withColumn("file", F.input_file_name()).where("position is not null").collect()
    ends = defaultdict(list)
    for r in listed:
        ends[r.file].append(r.position)
    spans = sorted((min(x), max(x), x) for x in ends.values())
    assert all(x == sorted(x) for *_, x in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for source in names:
        knots = s.schedules[names.index(source) % len(s.schedules)]
        own = sorted((r.position, r["pass"], r.taken, r["size"]) for r in listed if r.source == source)
        upto = 0
        for position, _, words, _ in own:
            assert 0 <= position <= 1
            assert asked(knots, position) * int(want[source]) == pytest.approx(float(integral(knots)) * upto, abs=1e-6 * max(1, upto))
            upto += words
        assert upto == int(want[source])


def asked(knots, u):
    """Integral of the schedule from 0 to u."""
    out = 0.0
    for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
        d = min(max(u - float(a), 0.0), float(b - a))
        out += float(x) * d + (float(y) - float(x)) / float(b - a) * d * d / 2
    return out


def test_reruns_agree(docs):
    runs = [sorted(map(str, curriculum.mix(d).drop("row").collect())) for d in (docs, docs.repartition(5), docs.coalesce(1))]
    assert runs[0] == runs[1] == runs[2]


def test_empty_tables(spark):
    assert curriculum.mix(spark.createDataFrame([], DOC)).count() == 0
    rows = curriculum.mix(spark.createDataFrame([(1, None, "en", "s", 1), (2, " ", None, None, None)], DOC)).collect()
    assert [(r.doc_id, r.taken, r.target, r.position) for r in sorted(rows)] == [(1, 0, 0.0, None), (2, 0, 0.0, None)]


def test_columns_are_carried(docs):
    assert curriculum.mix(docs, carry=("lang",)).where("doc_id = 204").select("lang").distinct().first()[0] == "fr"


def test_schedules_must_be_whole():
    assert whole_weights(STEPS.schedules) == [12, 12, 53]
    with pytest.raises(ValueError):
        whole_weights((((0, 0), (1, 0)),))
