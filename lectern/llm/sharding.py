"""Size-balanced sharding by sampled splitters.

The key order is (hash of the text, id), so equal texts lie side by side. A size-weighted
sample of keys gives quantile splitters, which cut the key order into many small ranges;
ranges that still hold too many rows are subdivided by further splitters drawn inside them.
Exact bytes and rows of each range, then a running sum inside each range, give every
document its place in the whole order, and thereby its shard: shard k takes the documents
whose middle byte lies in the k-th part of all bytes. A group of equal texts goes where its first
document goes, unless it is larger than ``whole`` of a shard's bytes or has more than
``range_rows`` rows; then it is cut at the boundary. No splitter falls inside a group that is not
larger: groups with a splitter inside are summed exactly first. Only DataFrame functions are used.

Defined cases. Null text: size 1, crc32 of the empty text, a hash like that of the empty
text. Null id: sorts first. Rows equal in text and id are interchangeable; all are kept. A
single document larger than a shard's share leaves the shards that it spans empty but one.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import discard, parts_for, staged

FIRST = -(1 << 63)
#: A range beyond this many times its share of rows is subdivided.
OVERFULL = 3


def _draw(keys: DataFrame, chance: Column) -> list[tuple[int, int | None]]:
    """Sorted keys of the rows whose hash falls below their chance; the hash is fixed, so a
    recomputed task draws the same rows."""
    unit = F.pmod(F.xxhash64("h", "doc_id", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    found = sorted({(r["h"], r["i"]) for r in keys.where(unit < chance).select("h", F.coalesce("doc_id", F.lit(FIRST)).alias("i")).collect()})
    seen = Counter(h for h, _ in found)
    # only a text drawn several times is worth a splitter inside its copies
    return sorted({(h, i if seen[h] > 2 else FIRST) for h, i in found})


def _outside_groups(keys: DataFrame, splitters: list[tuple[int, int]], most_bytes: float, most_rows: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The splitters but for those inside a group of equal texts that may not be cut; and the
    hashes of the groups that still have one."""
    inside = sorted({h for h, i in splitters if i != FIRST})
    if not inside:
        return splitters, []
    sums = keys.where(F.col("h").isin(inside)).groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    large = {x["h"] for x in sums if x["b"] > most_bytes or x["n"] > most_rows}
    return sorted({(h, i if h in large else FIRST) for h, i in splitters}), sorted(large)


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters not above the key, by two steps of about the root of their number."""
    if not splitters:
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    rows = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    key = F.struct(F.col("h").alias("h"), F.coalesce("doc_id", F.lit(FIRST)).alias("i"))

    def literal(pairs: list[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(i).cast("long").alias("i")) for h, i in pairs])

    below = lambda pairs: F.size(F.filter(pairs, lambda s: s <= key))
    coarse = below(literal([r[0] for r in rows]))
    fine = F.array(*[literal(r) for r in rows])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + below(F.get(fine, coarse - 1)))


def shard_by_size(docs: DataFrame, shards: int = 16, range_rows: int = 8192, most_ranges: int = 4096, draws: int = 16, whole: float = 0.02, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, text_hash.

    The driver sees ``draws`` sampled keys for each range and two sums of each range; there is
    a range for each ``range_rows`` rows, but at least 64 and at most ``most_ranges``: beyond that
    ranges grow, and each is sorted by one task, which may spill."""
    plain = F.coalesce(F.col(text), F.lit(""))
    keys = staged(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(plain.cast("binary")).alias("text_crc32"),
            F.xxhash64(plain).alias("h"),
        ),
        "shard-keys",
        parts_for(docs),
    )
    total = keys.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, total_bytes = total["n"], total["bytes"] or 0
    ranges = min(most_ranges, max(64, math.ceil(n / range_rows)))
    splitters: list[tuple[int, int]] = []
    if n > 4 * ranges:
        drawn = _draw(keys, F.col("size") * (draws * ranges / total_bytes))
        splitters = sorted({drawn[k * len(drawn) // ranges] for k in range(1, ranges)}) if len(drawn) >= ranges else drawn
    most_bytes = whole * total_bytes / shards
    splitters, cut = _outside_groups(keys, splitters, most_bytes, range_rows)
    most = max(OVERFULL * n / ranges, 1024)
    while True:
        ranged = keys.withColumn("r", _range_of(splitters).cast("int"))
        parts = {x["r"]: x for x in ranged.groupBy("r").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        over = {r: x["n"] for r, x in parts.items() if x["n"] > most}
        if not over:
            break
        chance = F.create_map([v for r, k in over.items() for v in (F.lit(r), F.lit(draws * math.ceil(2 * k / most) / k))])[F.col("r")]
        more, cut = _outside_groups(keys, sorted({*splitters, *_draw(ranged.where(F.col("r").isin(*over)), chance)}), most_bytes, range_rows)
        if len(more) == len(splitters):
            break  # a group that stays whole, or rows equal in text and id, which no key can part
        splitters = more
    rows_before, bytes_before, at_n, at_b = [], [], 0, 0
    for r in range(len(splitters) + 1):
        rows_before.append(F.lit(at_n).cast("long"))
        bytes_before.append(F.lit(at_b).cast("long"))
        at_n, at_b = at_n + (parts[r]["n"] if r in parts else 0), at_b + (parts[r]["bytes"] if r in parts else 0)
    inside = W.partitionBy("r").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged.withColumns({"upto": F.sum("size").over(inside), "nth": F.count("*").over(inside)})
    placed = placed.withColumns({"middle": F.get(F.array(*bytes_before), F.col("r")) + F.col("upto") - F.ceil(F.col("size") / 2), "rank": F.get(F.array(*rows_before), F.col("r")) + F.col("nth") - 1})
    group = W.partitionBy("r", "h")
    kept = (F.sum("size").over(group) <= most_bytes) & (F.count("*").over(group) <= range_rows) & ~F.col("h").isin(cut)
    placed = placed.withColumn("at", F.when(kept, F.min("middle").over(group)).otherwise(F.col("middle")))
    placed = staged(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("at") * shards / F.lit(max(1, total_bytes)))).cast("int")), "shard-places", parts_for(docs))
    discard(keys)
    first = {x["shard"]: x["first"] for x in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    start = F.get(F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(shards)]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("text_hash"))
