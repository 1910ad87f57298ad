"""Removal of repeated byte strings by a sparse, distributed suffix array.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else
in the corpus, the same document included.

Which suffixes are sorted. Every window of ``length`` bytes is assigned the place, inside
it, of its 64-byte string of least hash (the leftmost of equals). Equal windows have their
anchor at the same offset, so only suffixes at anchors, about one in 70 bytes, are needed. An
anchor whose 64-byte string is met nowhere else cannot lie in a repeated window; a first
exchange of hashes alone leaves those out.

The merge sort. Each block of documents sorts the contexts of its anchors: ``length`` bytes
to the right, then the bytes to the left in reverse. The sorted run is front-coded (shared
prefix length and rest) and sent by ranges. Each range merges its runs with a loser tree whose
nodes remember the prefix shared with the last string put out, so no known prefix is compared
again, and the merge yields the array of common prefixes (LCP) as it goes. Equal contexts are
one entry with a count, within a block and in the merge. Where a range has runs of more than
``fan_in`` blocks, they are merged in rounds: so many neighbouring runs become one, in which a
passage shared by a third of all documents is one entry again, and what is found goes back the same
way. So no task holds more than ``fan_in`` entries of one context, however hot it is.

Within the entries that share their first 64 bytes, the LCPs to the right and those of the
left contexts tell, for each anchor, the farthest repeated window on either side; all bytes
between are covered. These extents go back to the blocks and are joined to spans.

Defined cases. Null text: no bytes, nothing kept or removed. Texts shorter than ``length``:
nothing removed. Repeated rows: copies of each other, so each loses its bytes. Null ids are
carried like others. Empty table: empty result. A text is held in memory whole, and is
hashed in segments. Columns named in ``carry`` are passed through; others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.common import block_count, discard, parts_for, staged, utf8

GRAM = 64
SEGMENT = 1 << 16
END = b"\xff"  # no byte of UTF-8
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Settings:
    length: int = 200
    block_bytes: int = 2 << 20
    range_bytes: int = 8 << 20
    fan_in: int = 256
    #: Groups of more distinct contexts are resolved by classes of each offset, smaller ones by pairs.
    pairwise: int = 24

    def __post_init__(self) -> None:
        if self.length <= GRAM:
            raise ValueError(f"length must exceed {GRAM}")


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the 64 bytes that start at each position."""
    n = len(data) - 7
    h = np.empty(max(0, n), np.uint64)
    for k in range(8):
        part = h[k::8]
        if len(part):
            part[:] = np.frombuffer(data, "<u8", len(part), k)
    width = 8
    while width < GRAM:
        m = max(0, len(h) - width)
        h = h[:m] * A + (h[width : width + m] ^ C) * B
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def anchors(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows that lie in one document; ``ends`` are
    the ends of the documents that make up ``data``."""
    valid = np.zeros(len(data) + 1, bool)
    start = 0
    for end in ends.tolist():
        if end - start >= length:
            valid[start : end - length + 1] = True
        start = end
    width, at, keys = length - GRAM + 1, [], []
    for s in range(0, len(data), SEGMENT):
        inside = valid[s : s + SEGMENT]
        if not inside.any():
            continue
        h = gram_hashes(data[s : s + SEGMENT + length])
        low = np.uint64((1 << 20) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        step, have = 1, 1
        while have * 2 <= width:
            m = np.minimum(m[:-step], m[step:])
            have, step = have * 2, step * 2
        if have < width:
            m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
        found = (m[: len(inside)][inside[: len(m)]] & low).astype(np.int64)
        found = found[np.r_[True, found[1:] != found[:-1]]]
        at.append(found + s)
        keys.append(h[found])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, keys = np.concatenate(at), np.concatenate(keys)
    fresh = np.r_[True, at[1:] != at[:-1]]
    # least hashes are small ones; mixed again, they spread over all ranges
    keys = (keys[fresh] ^ (keys[fresh] >> np.uint64(33))) * A
    return at[fresh], keys ^ (keys >> np.uint64(29))


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def pack_run(strings: list[bytes], many: list[bool]) -> bytes:
    """A front-coded sorted run."""
    lcps, tails, before = [], [], b""
    for s in strings:
        k = common(before, s)
        lcps.append(k)
        tails.append(s[k:])
        before = s
    head = np.array([len(strings)], "<u4").tobytes() + np.array(lcps, "<u2").tobytes() + np.array([len(t) for t in tails], "<u2").tobytes() + np.array(many, "u1").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(tails))


def unpack_run(blob: bytes) -> tuple[int, Iterator[tuple[bytes, int]], np.ndarray]:
    """Number of strings, the strings with the prefix each shares with the one before, and
    whether each stands for many places."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    lcps, sizes = np.frombuffer(data, "<u2", n, 4).tolist(), np.frombuffer(data, "<u2", n, 4 + 2 * n).tolist()
    many = np.frombuffer(data, "u1", n, 4 + 4 * n).astype(bool)

    def strings() -> Iterator[tuple[bytes, int]]:
        at, before = 4 + 5 * n, b""
        for k, size in zip(lcps, sizes, strict=True):
            before = before[:k] + data[at : at + size]
            at += size
            yield before, k

    return n, strings(), many


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Loser-tree merge of sorted runs: (string, prefix shared with the string before, run).

    ``loser[i]`` is the run that lost at node i, and ``share`` of a run the prefix its string
    shares with the last winner that passed the node; of two runs the one that shares more
    with the last output is the smaller, and only equals are compared, beyond that prefix."""
    k = len(runs)
    if not k:
        return
    size = 1 << max(0, (k - 1).bit_length())
    text: list[bytes | None] = [None] * size
    share = [-1] * size
    loser = [0] * size
    for i, run in enumerate(runs):
        first = next(run, None)
        if first is not None:
            text[i], share[i] = first[0], 0

    def less(a: int, b: int) -> bool:
        """Whether run a goes before run b; the loser's share becomes that with the winner."""
        ha, hb = share[a], share[b]
        if ha != hb:
            return ha > hb
        if ha < 0:
            return True
        x, y = text[a], text[b]
        both = common(x, y, ha)
        first = x[both : both + 1] <= y[both : both + 1]
        share[b if first else a] = both
        return first

    winners = list(range(size))
    level = size
    while level > 1:
        after = []
        for i in range(0, level, 2):
            a, b = winners[i], winners[i + 1]
            won = less(a, b)
            loser[(level + i) // 2] = b if won else a
            after.append(a if won else b)
        winners, level = after, level // 2
    top = winners[0]
    while share[top] >= 0:
        yield text[top], share[top], top
        following = next(runs[top], None)
        text[top], share[top] = following if following is not None else (None, -1)
        node, best = (size + top) // 2, top
        while node:
            other = loser[node]
            ha, hb = share[best], share[other]
            if ha < hb or ha == hb and not less(best, other):
                loser[node], best = best, other
            node //= 2
        top = best


def split_context(s: bytes, length: int) -> tuple[int, bytes]:
    """Length of the right context and the reversed left context."""
    cut = s.find(END, 0, length)
    if cut < 0:
        return length, s[length:].rstrip(END)
    return cut, s[cut + 1 :].rstrip(END)


def resolve(strings: list[bytes], lcps: list[int], many: list[bool], length: int, pairwise: int) -> list[tuple[int, int]]:
    """For distinct sorted contexts that share their first 64 bytes: how far repeated windows
    reach to the left and to the right of each anchor, (0, 0) if there are none."""
    cut = [split_context(s, length) for s in strings]
    extent = [(len(left), right) if dup else (0, 0) for (right, left), dup in zip(cut, many, strict=True)]
    n = len(strings)
    if n == 1 or all(many):
        return extent
    if n <= pairwise:
        for i in range(n):
            reach = length
            for j in range(i + 1, n):
                reach = min(reach, lcps[j])
                if many[i] and many[j]:
                    continue
                r = min(reach, cut[i][0], cut[j][0])
                x = common(cut[i][1], cut[j][1])
                if r + x >= length:
                    extent[i] = (max(extent[i][0], x), max(extent[i][1], r))
                    extent[j] = (max(extent[j][0], x), max(extent[j][1], r))
        return extent
    rights, lefts = np.array([r for r, _ in cut]), np.array([len(x) for _, x in cut])
    down = np.array(lcps)
    order = sorted(range(n), key=lambda i: cut[i][1])
    up = np.zeros(n, np.int64)
    for k in range(1, n):
        up[k] = common(cut[order[k - 1]][1], cut[order[k]][1])
    order = np.array(order)
    low, high = np.full(n, -1), np.full(n, -1)
    label = np.empty(n, np.int64)
    for d in range(length - GRAM + 1):
        label[order] = np.cumsum(up < d)
        pair = np.cumsum(down < length - d) * (n + 1) + label
        fits = np.flatnonzero((rights >= length - d) & (lefts >= d))
        _, where, count = np.unique(pair[fits], return_inverse=True, return_counts=True)
        hit = fits[count[where] > 1]
        low[hit[low[hit] < 0]] = d
        high[hit] = d
    return [e if dup else (int(h), length - int(a)) if h >= 0 else (0, 0) for e, dup, a, h in zip(extent, many, low, high, strict=True)]


def _buffer(docs: pa.Table) -> tuple[np.ndarray, list[bytes], bytes, np.ndarray]:
    """Rows of a block in an order that depends on their contents alone: row numbers, texts, all
    bytes, ends."""
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("body").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
    texts = [texts[k] for k in order]
    return np.array(order, np.int64), texts, b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)


HASHES = pa.schema([("range", pa.int64()), ("payload", pa.binary())])
KNOWN = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
RUNS = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])


def _hash_stage(settings: Settings, ranges: int):
    """Hashes of all anchors with the blocks they lie in, by ranges of the hash."""

    def flush(keys: list[np.ndarray], blocks: list[np.ndarray]) -> pa.RecordBatch:
        k, b = np.concatenate(keys), np.concatenate(blocks)
        order = np.lexsort((b, k))
        k, b = k[order], b[order]
        third = np.zeros(len(k), bool)  # two of a hash and block are as good as more
        third[2:] = (k[2:] == k[:-2]) & (b[2:] == b[:-2])
        k, b = k[~third], b[~third]
        r = ranges_of(k, ranges)
        cuts = np.r_[np.flatnonzero(np.r_[True, r[1:] != r[:-1]]), len(r)]
        rows = [(int(r[i]), np.array([j - i], "<u4").tobytes() + k[i:j].tobytes() + b[i:j].astype("<u4").tobytes()) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blocks, held = [], [], 0
        for batch in batches:
            of = np.array(batch.column(1).to_pylist(), np.int64)
            texts, at = batch.column(0), 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < 1 << 20:
                    part.append(texts[at].as_py())
                    size += len(part[-1])
                    at += 1
                ends = np.cumsum([len(t) for t in part], dtype=np.int64)
                places, found = anchors(b"".join(part), ends, settings.length)
                keys.append(found)
                blocks.append(of[at - len(part) : at][np.searchsorted(ends, places, "right")])
                held += len(found)
            if held > 300_000:
                yield flush(keys, blocks)
                keys, blocks, held = [], [], 0
        if held:
            yield flush(keys, blocks)

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Hashes met at two or more places, for each block that has them."""
    keys, blocks = [], []
    for blob in group.column("payload"):
        data = blob.as_py()
        n = int(np.frombuffer(data, "<u4", 1)[0])
        keys.append(np.frombuffer(data, "<u8", n, 4))
        blocks.append(np.frombuffer(data, "<u4", n, 4 + 8 * n))
    k, b = np.concatenate(keys), np.concatenate(blocks)
    order = np.lexsort((k, b))
    values, where, count = np.unique(k, return_inverse=True, return_counts=True)
    order = order[(count > 1)[where[order]]]
    k, b = k[order], b[order]
    fresh = np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])] if len(k) else np.empty(0, bool)
    k, b = k[fresh], b[fresh]
    cuts = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(b)] if len(b) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.table([pa.array([int(b[i]) for i, _ in spans], pa.int64()), pa.array([k[i:j].tobytes() for i, j in spans], pa.binary())], schema=KNOWN)


def _run_stage(settings: Settings, ranges: int):
    """Sorted runs of a block's contexts (by range), and the places of its entries (range -1)."""
    length, reach = settings.length, settings.length - GRAM

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        blobs = known.column("payload").to_pylist()
        if not blobs or not len(docs):
            return RUNS.empty_table()
        block = known.column("block")[0].as_py()
        repeated = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in blobs]))
        _, _, data, ends = _buffer(docs)
        at, keys = anchors(data, ends, length)
        spot = np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)
        wanted = repeated[spot] == keys
        at, keys = at[wanted], keys[wanted]
        if not len(at):
            return RUNS.empty_table()
        doc = np.searchsorted(ends, at, "right")
        start, end = np.r_[0, ends[:-1]][doc], ends[doc]
        entry: dict[bytes, int] = {}
        number, count, of = np.empty(len(at), np.int64), [], []
        for i, (a, s, e, r) in enumerate(zip(at.tolist(), start.tolist(), end.tolist(), ranges_of(keys, ranges).tolist(), strict=True)):
            context = data[a : a + length] if a + length <= e else data[a:e] + END
            context += data[a - reach : a][::-1] if a - reach >= s else data[s:a][::-1] + END
            k = entry.setdefault(context, len(entry))
            if k == len(count):
                count.append(0)
                of.append(r)
            count[k] += 1
            number[i] = k
        strings = list(entry)
        order = sorted(range(len(strings)), key=lambda k: (of[k], strings[k]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        out, i = [], 0
        while i < len(order):
            j = i
            while j < len(order) and of[order[j]] == of[order[i]]:
                j += 1
            out.append((of[order[i]], pack_run([strings[k] for k in order[i:j]], [count[k] > 1 for k in order[i:j]])))
            i = j
        places = zstandard.ZstdCompressor(level=3).compress(np.diff(at, prepend=0).astype("<u4").tobytes() + rank[number].astype("<u4").tobytes())
        out.append((-1, places))
        return pa.table([pa.array([r for r, _ in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], schema=RUNS)

    return run


def _merge_stage(settings: Settings):
    """Extents of all entries of a range, for each block: two bytes an entry."""

    def run(group: pa.Table) -> pa.Table:
        number = group.column("range")[0].as_py()
        sizes, streams, flags = zip(*(unpack_run(x.as_py()) for x in group.column("payload")), strict=True)
        extents = [np.zeros((n, 2), "u1") for n in sizes]
        seen = [0] * len(sizes)
        strings: list[bytes] = []
        lcps: list[int] = []
        many: list[bool] = []
        members: list[list[tuple[int, int]]] = []

        def close() -> None:
            if len(strings) > 1 or many and many[0]:
                for extent, places in zip(resolve(strings, lcps, many, settings.length, settings.pairwise), members, strict=True):
                    if extent[1]:
                        for run_, place in places:
                            extents[run_][place] = extent
            for x in (strings, lcps, many, members):
                x.clear()

        for s, k, r in merge(list(streams)):
            if k < GRAM:
                close()
            place, seen[r] = seen[r], seen[r] + 1
            if strings and k == len(s) == len(strings[-1]):
                many[-1] = True
                members[-1].append((r, place))
            else:
                strings.append(s)
                lcps.append(k)
                many.append(bool(flags[r][place]))
                members.append([(r, place)])
        close()
        return pa.table([pa.array([number] * len(sizes), pa.int64()), group.column("block").combine_chunks().cast(pa.int64()), pa.array([e.tobytes() for e in extents], pa.binary())], schema=RUNS)

    return run


MERGED = pa.schema([("kind", pa.int64()), ("range", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
RUN, ORIGIN = 0, 1


def _join_stage(group: pa.Table) -> pa.Table:
    """Neighbouring runs of a range as one: rows (RUN, range, number, run) and (ORIGIN, range, number,
    where the entries of each block's run have gone)."""
    number, joint = group.column("range")[0].as_py(), group.column("joint")[0].as_py()
    sizes, streams, flags = zip(*(unpack_run(x.as_py()) for x in group.column("payload")), strict=True)
    place = [np.zeros(n, "<u4") for n in sizes]
    seen = [0] * len(sizes)
    strings: list[bytes] = []
    many: list[bool] = []
    for s, k, r in merge(list(streams)):
        if strings and k == len(s) == len(strings[-1]):
            many[-1] = True
        else:
            strings.append(s)
            many.append(bool(flags[r][seen[r]]))
        place[r][seen[r]] = len(strings) - 1
        seen[r] += 1
    blocks = np.array(group.column("block").to_pylist(), "<i8")
    origin = np.array([len(sizes)], "<u4").tobytes() + blocks.tobytes() + np.array(sizes, "<u4").tobytes() + b"".join(p.tobytes() for p in place)
    rows = [(RUN, pack_run(strings, many)), (ORIGIN, zstandard.ZstdCompressor(level=3).compress(origin))]
    return pa.table([pa.array([k for k, _ in rows], pa.int64()), pa.array([number] * 2, pa.int64()), pa.array([joint] * 2, pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=MERGED)


def _spread_stage(origin: pa.Table, extents: pa.Table) -> pa.Table:
    """Extents of a joint run, for each of its blocks."""
    number = origin.column("range")[0].as_py()
    found = np.frombuffer(extents.column("payload")[0].as_py(), "u1").reshape(-1, 2)
    data = zstandard.ZstdDecompressor().decompress(origin.column("payload")[0].as_py())
    n = int(np.frombuffer(data, "<u4", 1)[0])
    blocks, sizes = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "<u4", n, 4 + 8 * n)
    place = np.frombuffer(data, "<u4", int(sizes.sum()), 4 + 12 * n)
    parts = np.split(found[place], np.cumsum(sizes)[:-1])
    return pa.table([pa.array([number] * n, pa.int64()), pa.array(blocks), pa.array([p.tobytes() for p in parts], pa.binary())], schema=RUNS)


def _extents(runs: DataFrame, blocks: int, settings: Settings, parts: int) -> DataFrame:
    """(range, block, extents of the run's entries) of runs (range, block, payload) numbered below ``blocks``."""
    kind = "range bigint, block bigint, payload binary"
    if blocks <= settings.fan_in:
        return runs.groupBy("range").applyInArrow(_merge_stage(settings), kind)
    joint = runs.withColumn("joint", F.floor(F.col("block") / settings.fan_in)).groupBy("range", "joint")
    joined = staged(joint.applyInArrow(_join_stage, "kind bigint, range bigint, block bigint, payload binary"), "joined", parts)
    upper = _extents(joined.where(F.col("kind") == RUN).drop("kind"), -(-blocks // settings.fan_in), settings, parts)
    origin = joined.where(F.col("kind") == ORIGIN).drop("kind")
    return origin.groupBy("range", "block").cogroup(upper.groupBy("range", "block")).applyInArrow(_spread_stage, kind)


def _cut_stage(names: list[str], schema: pa.Schema):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.empty_table()
        order, texts, data, ends = _buffer(docs)
        edge = np.zeros(len(data) + 1, np.int64)
        rows = sorted(zip(replies.column("range").to_pylist(), replies.column("payload").to_pylist(), strict=True))
        if rows:
            places = np.frombuffer(zstandard.ZstdDecompressor().decompress(rows[0][1]), "<u4").reshape(2, -1)
            extent = np.frombuffer(b"".join(x for _, x in rows[1:]), "u1").reshape(-1, 2)[places[1]].astype(np.int64)
            at = np.cumsum(places[0], dtype=np.int64)
            hit = extent[:, 1] > 0
            np.add.at(edge, at[hit] - extent[hit, 0], 1)
            np.add.at(edge, at[hit] + extent[hit, 1], -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw, kept, spans, start = np.frombuffer(data, np.uint8), [], [], 0
        for text, end in zip(texts, ends.tolist(), strict=True):
            own = gone[start:end]
            if own.any():
                flips = np.flatnonzero(np.diff(np.r_[False, own, False].view(np.int8))).reshape(-1, 2)
                spans.append([{"start": a, "stop": b} for a, b in flips.tolist()])
                kept.append(raw[start:end][~own].tobytes())
            else:
                spans.append([])
                kept.append(text)
            start = end
        rest = docs.take(pa.array(order)).select(names)
        return pa.table([*rest.columns, pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, schema.field("spans").type)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_bytes, kept (the remaining bytes), spans (removed runs of
    bytes, as offsets into the input)."""
    blocks, ranges = block_count(docs, settings.block_bytes), block_count(docs, settings.range_bytes)
    parts = parts_for(docs)
    id_ = F.col(doc_id).cast("long")
    body = utf8(F.col(text))
    block = F.pmod(F.xxhash64(id_, body), F.lit(blocks))
    hashes = docs.select(body.alias("body"), block.alias("block")).mapInArrow(_hash_stage(settings, ranges), "range bigint, payload binary")
    known = staged(hashes.groupBy("range").applyInArrow(_repeated, "block bigint, payload binary"), "repeated", parts)
    rows = docs.select(id_.alias("doc_id"), body.alias("body"), block.alias("block"), *[F.col(c).alias(f"c_{c}") for c in carry])
    by_block = rows.select("doc_id", "body", "block").groupBy("block").cogroup(known.groupBy("block"))
    runs = staged(by_block.applyInArrow(_run_stage(settings, ranges), "range bigint, block bigint, payload binary"), "runs", parts)
    discard(known)
    replies = staged(_extents(runs.where("range >= 0"), blocks, settings, parts), "extents", parts).unionByName(runs.where("range < 0"))
    names = ["doc_id", *[f"c_{c}" for c in carry]]
    out = rows.select(*names).schema.add("n_bytes", "long").add("kept", "binary").add("spans", T.ArrayType(T.StructType().add("start", "long").add("stop", "long")))
    cut = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_cut_stage(names, to_arrow_schema(out)), out)
    return cut.select("doc_id", *[F.col(f"c_{c}").alias(c) for c in carry], "n_bytes", "kept", "spans")


def digest(removed: DataFrame) -> DataFrame:
    """The digest columns of a result of ``remove_repeats``."""
    gone = F.col("n_bytes") - F.octet_length("kept")
    return removed.select("doc_id", "n_bytes", gone.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
