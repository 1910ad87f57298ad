"""A mix of sources whose shares change while training goes on.

Every source has a weight schedule over training progress, 0 to 1: straight lines between
knots. Its integral is the source's weight, by which sources share a budget of words. A source gives
at most ``repeats`` times its own words; what is above that is shared again by weight among the
others, until none is above. The words of a source stand in one stream, its documents in the order of
a hash, pass after pass, cut where the source's target ends. How much of the stream is asked for
by a given progress is the integral of the schedule up to there; inverted, it says at what progress
a document's turn comes. Copies of documents are sorted by that position, in ranges.

A document's place in its source's stream needs the words before it. A source is cut into slices
of the hash, so that a source with a third of all rows is many slices; slices are summed first,
and only the rows of one slice stand in one window.

Defined cases. Null or empty text, or one without words: size 0, never taken, one row without a
position. Null source: a source of its own, after all others. Null id: an id like any other. Repeated
rows: each is a document; equal ones take their turns in any order. A source without words: target
0. Empty table: empty result. Very long texts count whole. Other columns are ignored unless ``carry``
names them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import discard, parts_for, staged
from lectern.operators.ordered import carried

Knots = tuple[tuple[Fraction | int, Fraction | int], ...]


@dataclass(frozen=True)
class Settings:
    """``schedules`` (progress, weight) go round the sources in order of their names: an even
    one, one that fades, one that grows. Their integrals are 1, 2 and 3."""

    schedules: tuple[Knots, ...] = (((0, 1), (1, 1)), ((0, 3), (1, 1)), ((0, 1), (1, 5)))
    repeats: int = 3
    slice_rows: int = 8192


def integral(knots: Knots) -> Fraction:
    return sum((Fraction(b - a) * (x + y) / 2 for (a, x), (b, y) in zip(knots, knots[1:], strict=False)), Fraction(0))


def whole_weights(schedules: tuple[Knots, ...]) -> list[int]:
    """The integrals as whole numbers in the same proportion."""
    found = [integral(k) for k in schedules]
    if any(w <= 0 for w in found) or any(k[0][0] != 0 or k[-1][0] != 1 for k in schedules):
        raise ValueError("a schedule goes from 0 to 1 and has a positive integral")
    times = math.lcm(*(w.denominator for w in found))
    return [int(w * times) for w in found]


def progress(share: Column, knots: Knots) -> Column:
    """The progress by which ``share`` of the schedule's integral is reached."""
    whole, upto, out = float(integral(knots)), 0.0, None
    for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
        width, rise = float(b) - float(a), (float(y) - float(x)) / (float(b) - float(a))
        before, left = upto, F.greatest(share * whole - upto, F.lit(0.0))
        # the root of rise/2 d^2 + x d = left, in the form that has no difference of near numbers
        below = F.lit(float(x)) + F.sqrt(F.greatest(F.lit(float(x) ** 2) + 2 * rise * left, F.lit(0.0)))
        at = F.least(float(a) + F.when(left > 0, 2 * left / below).otherwise(0.0), F.lit(float(b)))
        upto += width * (float(x) + float(y)) / 2
        out = at if out is None else F.when(share * whole <= before, out).otherwise(at)
    return out


def _wide(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(18,0)")


def targets(sizes: DataFrame, settings: Settings) -> DataFrame:
    """(source, class, target, words) for (source, source_size): the target as a number, and its
    whole words. Above the cap is what a weighted share of the rest exceeds; each
    pass over the sources caps what is above now, and shares the excess by weight."""
    weights = F.array(*[F.lit(w) for w in whole_weights(settings.schedules)])
    # null sources come last; a running count says which schedule is a source's
    keyed = sizes.withColumn("_null", F.col("source").isNull().cast("int"))
    numbered = carried(keyed, [], ["_null", "source"], sums={"nth": F.lit(1)})
    table = staged(numbered.withColumn("class", F.pmod(F.col("nth") - 1, F.lit(len(settings.schedules))).cast("int")).withColumns({"weight": F.get(weights, F.col("class")).cast("long"), "cap": F.col("source_size") * settings.repeats}), "mix-sources", small=True)
    total = table.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    capped, rest, weight = F.lit(False), total, None
    while True:
        sums = table.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("caps"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if weight == sums["weight"] or not sums["weight"]:
            break
        rest, weight = total - sums["caps"], sums["weight"]
        capped = _wide(F.col("cap")) * _wide(weight) < _wide(F.col("weight")) * _wide(rest)
    weight = max(1, weight or 1)
    share = F.when(capped, F.col("cap").cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(weight).cast("double"))
    words = F.when(capped, F.col("cap")).otherwise(F.expr(f"weight * {rest}L div {weight}L"))
    return table.select("source", "source_size", "class", share.alias("target"), words.cast("long").alias("words"))


def mix(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """position, pass, taken, row, doc_id, size, source_size, target: the copies of documents in
    training order. ``taken`` words are the first ones of a text; only where a target ends is that less
    than all of them."""
    s = settings or Settings()
    # an order that SQL knows: the digest of the id
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("h"),
        *carry,
    )
    rows = staged(rows, "mix-rows", parts_for(docs))
    sizes = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sizes", small=True)
    wanted = targets(sizes, s)
    known = wanted.join(sizes.select(F.col("source").alias("_s"), F.ceil(F.col("n") / s.slice_rows).alias("slices")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = staged(known.withColumnRenamed("source", "_source"), "mix-targets", small=True)
    at = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("slice", F.floor(at * F.col("slices") / float(1 << 32)).cast("long"))
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    earlier = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = staged(sums.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)).alias("before")), "mix-slices", small=True)
    inside = W.partitionBy("source", "slice").orderBy("h", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
    placed = placed.withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    # every pass takes what of the document lies before the end of the target
    passes = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr("(words - 1) div greatest(source_size, 1L)")))
    left = lambda p: F.col("words") - p * F.col("source_size") - F.col("start")
    copies = F.transform(passes, lambda p: F.struct(p.alias("pass"), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left(p))).alias("taken")))
    placed = placed.withColumn("copy", F.explode_outer(F.filter(copies, lambda c: c["taken"] > 0)))
    share = (F.col("copy.pass") * F.col("source_size") + F.col("start")).cast("double") / F.col("words").cast("double")
    turn = F.lit(None).cast("double")
    for k, knots in enumerate(s.schedules):
        turn = F.when(F.col("class") == k, progress(share, knots)).otherwise(turn)
    out = placed.select(F.when(F.col("copy").isNotNull(), turn).alias("position"), F.col("copy.pass").alias("pass"), F.coalesce("copy.taken", F.lit(0).cast("long")).alias("taken"), "row", "doc_id", "source", "size", "source_size", "target", *carry)
    order = ("position", "source", "doc_id", "row")
    done = staged(out.repartitionByRange(2 * parts_for(docs), *order).sortWithinPartitions(*order), "mix", 2 * parts_for(docs))
    discard(rows, sizes, known, sums)
    return done


ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as ss, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as w from d group by source),
r as (select *, sum(ss) over () as t, coalesce(sum(3 * ss) over p, 0) as c, sum(w) over () - coalesce(sum(w) over p, 0) as v from s
      window p as (order by ss * (6 // w), source nulls last rows between unbounded preceding and 1 preceding)),
f as (select t - c as rest, v from r where (t - c)::hugeint * w <= 3::hugeint * ss * v qualify row_number() over (order by ss * (6 // w), source nulls last) = 1),
g as (select source, ss, case when 3::hugeint * ss * v < rest::hugeint * w then 3.0 * ss else (w * rest)::double / v end as target,
             case when 3::hugeint * ss * v < rest::hugeint * w then 3 * ss else (w::hugeint * rest) // v end::bigint as words, w from s, f),
b as (select d.*, ss, target, words, w, (sum(size) over (partition by d.source order by h, size rows unbounded preceding) - size)::bigint as start from d join g on d.source is not distinct from g.source)
select doc_id, size, ss as source_size, target::double as target, (case when ss = 0 then 0 else words // ss * size + greatest(0, least(size, words % ss - start)) end)::bigint as taken
from b
"""
