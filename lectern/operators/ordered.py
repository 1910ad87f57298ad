"""Running values along an order, without a task for each group.

A window over a book puts the whole book into one task. Here rows are dealt into ranges of the
order (group, position), so a large group spans many ranges and a range holds many small groups. Where
ranges begin is found from the keys alone, so that each row finds its range where it stands. One
pass sums each range up, a row for each group in it; a window over those few rows says what each
range carries over from the ones before it; a second pass applies the carry inside each range, and is the only one
that moves whole rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.sources.scratch import stored

#: Rows of a range, which one task sorts.
RANGE_ROWS = 100_000


def _ranged(rows: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """``rows`` with their range: how many ranges begin at their key or before."""
    key = F.struct(*keys)
    first = rows.select(*keys).repartitionByRange(ranges, *keys).groupBy(F.spark_partition_id()).agg(F.min(key).alias("key"))
    begins = stored(first.agg(F.array_sort(F.collect_list("key")).alias("begins"))).scalar()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])

    def onward(at: Column, step: Column) -> Column:
        """By halves; beyond the last range there is none."""
        n = at["n"] + step
        return F.struct(at["begins"].alias("begins"), F.when(F.get(at["begins"], n - 1) <= key, n).otherwise(at["n"]).alias("n"))

    found = F.aggregate(steps, F.struct(F.col("_begins").alias("begins"), F.lit(0).alias("n")), onward, lambda at: at["n"])
    return rows.withColumn("_begins", begins).withColumn("_range", found).drop("_begins")


def carried(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    changes: Mapping[str, Column] | None = None,
    range_rows: int | None = None,
    ready: bool = False,
) -> DataFrame:
    """``rows`` with running values of each group in the given order.

    ``sums`` are sums of a number up to and with the row, ``lasts`` the last value that is not null up to
    and with the row, ``before`` those of the rows before it, ``changes`` how often a value was not that of
    the row before, the first row included. ``order`` should tell the rows of a
    group apart: rows that are equal in it stand in any order, in one range. Null keys are a group
    like any other; null positions come first. An empty table gives an empty one. Rows that are cheap to
    read again, like those of a stored table, are ``ready``.
    """
    kinds = {"_s": dict(sums or {}), "_l": dict(lasts or {}), "_b": dict(before or {}), "_d": dict(changes or {})}
    inner = {f"{k}{i}": c for k, given in kinds.items() for i, c in enumerate(given.values())}
    named = lambda *of: [n for n in inner if n[:2] in of]
    taken = rows.withColumns(inner)
    if not ready:  # what makes the rows is not computed again to count and to sample them
        taken = stored(taken)
    ranges = max(taken.sparkSession.sparkContext.defaultParallelism, math.ceil(taken.count() / (range_rows or RANGE_ROWS)))
    taken = _ranged(taken, [*group, *order], ranges)
    position = F.struct(*order)
    inside = W.partitionBy("_range", *group).orderBy(*order)
    upto, ahead = inside.rowsBetween(W.unboundedPreceding, 0), inside.rowsBetween(W.unboundedPreceding, -1)
    # in its range, a row differs from the one before it; of the first one there, its carry says
    turned = {f"t{n}": (F.row_number().over(inside) > 1) & ~F.col(n).eqNullSafe(F.lag(n).over(inside)) for n in named("_d")}
    own = [F.sum(n).alias(n) for n in named("_s")] + [F.max_by(F.col(n), F.when(F.col(n).isNotNull(), position)).alias(n) for n in named("_l", "_b")]
    for n in named("_d"):
        own += [F.count_if(F.col(f"t{n}")).alias(n), F.min_by(n, position).alias(f"f{n}"), F.max_by(n, position).alias(f"e{n}")]
    # a row for each group in a range, so the window sees a row for each range at most
    found = taken.withColumns(turned).groupBy("_range", *group).agg(F.count("*").alias("_n"), *own)
    by = W.partitionBy(*group).orderBy("_range")
    earlier = by.rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumns({f"o{n}": (F.lag("_n").over(by).isNull() | ~F.col(f"f{n}").eqNullSafe(F.lag(f"e{n}").over(by))).cast("long") for n in named("_d")})
    carry = [F.sum(n).over(earlier).alias(f"c{n}") for n in named("_s")] + [F.last(n, True).over(earlier).alias(f"c{n}") for n in named("_l", "_b")]
    carry += [(F.coalesce(F.sum(F.col(n) + F.col(f"o{n}")).over(earlier), F.lit(0)) + F.col(f"o{n}")).alias(f"c{n}") for n in named("_d")]
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    brought = stored(found.select(F.col("_range").alias("_at"), *keys, *carry))
    same = F.col("_range") == F.col("_at")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = taken.join(brought, same, "left").withColumns(turned)
    zero, out = F.lit(0), {}
    for (kind, given), make in zip(kinds.items(), (
        lambda n: F.coalesce(F.col(f"c{n}"), zero) + F.coalesce(F.sum(n).over(upto), zero),
        lambda n: F.coalesce(F.last(n, True).over(upto), F.col(f"c{n}")),
        lambda n: F.coalesce(F.last(n, True).over(ahead), F.col(f"c{n}")),
        lambda n: F.col(f"c{n}") + F.count_if(F.col(f"t{n}")).over(upto),
    ), strict=True):
        out |= {name: make(f"{kind}{i}") for i, name in enumerate(given)}
    return joined.select(*[c for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])
