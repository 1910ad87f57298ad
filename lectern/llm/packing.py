"""Conflict-constrained best-fit packing.

Documents (or pieces of those longer than a bin) go into bins of ``capacity`` bytes. Bins
stand in the order of their residual room and carry two bitmaps, of the sources and of the
duplicate clusters they hold. For each piece, longest first, the successor search starts at
the smallest residual that fits and moves on until a bin shares neither source nor cluster:
the tightest compatible bin. If there is none, a new bin is opened.

The table is dealt by a hash of the piece, its source and its cluster into groups of about
``group_rows`` pieces, which are packed independently, so a hot source or a group of copies is
spread evenly and no task holds more than its groups. The pieces are counted, so the same rows
make the same bins however they are stored. Only ids, lengths and keys travel, never texts.

Defined cases. Null or empty text: a piece of length 0 that takes a place like any other.
Null source: conflicts with nothing. Null cluster: likewise. A document longer than a bin is
cut into full bins and one remainder, none of it dropped. Repeated rows are separate pieces
(equal in all that is dealt by, they share a group). Equal lengths are taken by id. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, piece bigint, bin_group bigint, bin bigint, offset bigint, n_bytes bigint, n_docs bigint"


class Bits(dict):
    """Numbers for keys, in order of first sight."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def best_fit(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (length, source, cluster) in the order given."""
    sources, clusters = Bits(), Bits()
    open_bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    held: list[tuple[int, int]] = []  # bitmaps of each bin
    placed = []
    for length, source, cluster in pieces:
        s = 0 if source is None else 1 << sources[source]
        c = 0 if cluster is None else 1 << clusters[cluster]
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            a, b = held[open_bins[at][1]]
            if not (a & s or b & c):
                break
            at += 1
        if at < len(open_bins):
            residual, k = open_bins.pop(at)
        else:
            residual, k = capacity, len(held)
            held.append((0, 0))
        placed.append((k, capacity - residual))
        held[k] = (held[k][0] | s, held[k][1] | c)
        insort(open_bins, (residual - length, k))
    return placed


def _pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["n_bytes", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")
    none = lambda x: None if pd.isna(x) else x
    shared = rows["cluster"].duplicated(keep=False)  # a cluster with one piece here conflicts with nothing
    keys = zip(rows["n_bytes"].tolist(), map(none, rows["source"]), (none(c) if d else None for c, d in zip(rows["cluster"], shared, strict=True)), strict=True)
    placed = best_fit(keys, capacity)
    out = rows[["doc_id", "piece", "bin_group", "n_bytes"]].assign(bin=[k for k, _ in placed], offset=[o for _, o in placed])
    out["n_docs"] = out.groupby("bin")["bin"].transform("size")
    return out[["doc_id", "piece", "bin_group", "bin", "offset", "n_bytes", "n_docs"]]


def pack(docs: DataFrame, capacity: int = 8192, group_rows: int = 4096, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None) -> DataFrame:
    """Pack the documents; ``cluster`` defaults to the digest of the text without case and
    white space, so that copies never share a bin."""
    plain = F.lower(F.regexp_replace(F.col(text), r"[ \t-\r]+", ""))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    count = docs.agg(F.sum(F.greatest(F.lit(1).cast("long"), F.ceil(size / capacity)))).first()[0] or 0
    groups = max(1, math.ceil(count / group_rows))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        (F.when(plain != "", F.xxhash64(plain)) if cluster is None else cluster).cast("string").alias("cluster"),
        size.alias("size"),
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("long")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "source", "cluster", "piece",
        F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("n_bytes"),
        F.pmod(F.xxhash64("doc_id", "piece", "size", "source", "cluster"), F.lit(groups)).alias("bin_group"),
    )
    return pieces.groupBy("bin_group").applyInPandas(lambda pdf: _pack_group(pdf, capacity), SCHEMA)
