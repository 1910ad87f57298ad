"""Phrases that occur more often than their parts would have it.

Texts are lower-cased (A-Z only), cut into pieces at punctuation and line ends, and pieces into
words. Every word begins a window of five words of its piece, under its language. A shard
(2 MB of text) holds its windows as a count trie of that depth: distinct windows in order,
front-coded, with their counts, so a window that fills half a shard is one entry. The tries
are cut where sampled splitters lie, and the pieces of one prefix range are merged, at most 512 at a
time: with more shards than that, groups of shards are merged first, into ranges that get finer with
each round, so the number of messages follows the corpus. The last merge walks the trie of its
range level by level: a node's count is that of its phrase, the counts above it are those of its left
parts, and what is below a node of too few occurrences is not looked at. Nodes that a splitter
cuts in two are summed across ranges. Suffix links, a join of phrases with the ends of longer ones,
give the right parts.

The driver holds one splitter (five words) for each range of 6 MB of text, and the draws they come
from. Splitters decide who counts, never what is counted.

Defined cases. Null or empty text, or one of separators only: no words. Null language: ``und``, as is
a language of that name. Repeated rows and rows without an id count like any others. Very
long texts are cut into runs that share their border words, and nothing is lost. Empty table: empty
result. Equal scores: the more frequent phrase first, then the smaller by UTF-8 bytes. Other
columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import discard, parts_for, staged

#: Words of a phrase at most; a window is its language and so many words.
DEPTH = 5
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BREAKS)], KIND[list(BLANKS)] = 2, 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
NEXT_WORD = re.compile(rb"[ \t.,;:!?\n-\r]*[^ \t.,;:!?\n-\r]+")
TO_BORDER = re.compile(rb"[^ \t.,;:!?\n-\r]*")

Key = tuple[bytes | None, ...]


@dataclass(frozen=True)
class Settings:
    """``least`` occurrences of a phrase; ``cover`` percent of them inside one longer phrase drop it."""

    least: int = 100
    cover: int = 100
    top: int = 2000
    shard_bytes: int = 2 << 20
    range_bytes: int = 6 << 20
    fan: int = 512
    draws: int = 64


@dataclass(frozen=True)
class Trie:
    """Distinct windows in order, as numbers of their words (from 1; 0 is the end of a shorter
    window), with counts. ``words`` are sorted by bytes, so numbers sort as words do."""

    words: pa.Array
    windows: np.ndarray
    counts: np.ndarray


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in order, and the number of each of those given."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _distinct(windows: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows as one; as many words at a time as a 63-bit key holds."""
    node, room = np.zeros(len(windows), np.int64), 1
    for j in range(windows.shape[1]):
        if room > (1 << 62) // (size + 1):
            kinds, node = np.unique(node, return_inverse=True)
            room = len(kinds)
        node, room = node * (size + 1) + windows[:, j], room * (size + 1)
    _, first, node = np.unique(node, return_index=True, return_inverse=True)
    return windows[first], _sums(node, counts)


def _sums(node: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of counts by node; exact below 2^53."""
    return np.bincount(node, counts).astype(np.int64)


def windows_of(segments: list[tuple[bytes, bytes, int]]) -> Trie:
    """The trie of (language, text, own): windows that begin in the first ``own`` bytes of a text."""
    text = LOWER[np.frombuffer(b"\n".join(t for _, t, _ in segments), np.uint8)]
    kind = KIND[text]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    begin = np.cumsum([0, *(len(t) + 1 for _, t, _ in segments)])[:-1]
    owner = np.searchsorted(begin, starts, "right") - 1
    own = starts - begin[owner] < np.array([n for *_, n in segments])[owner]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])])
    words, rank = _ranked(pa.concat_arrays([found, pa.array([lang for lang, *_ in segments], pa.binary())]))
    number, lang = rank[: len(starts)], rank[len(starts) :]
    windows = np.zeros((len(starts), DEPTH + 1), np.int32)
    windows[:, 0], windows[:, 1] = lang[owner], number
    for d in range(1, DEPTH):
        windows[:-d, d + 1] = np.where(piece[d:] == piece[:-d], number[d:], 0)
    windows = windows[own]
    return Trie(words, *_distinct(windows, np.ones(len(windows), np.int64), len(words)))


def runs(lang: bytes, text: bytes, most: int) -> Iterator[tuple[bytes, bytes, int]]:
    """A text in runs of about ``most`` bytes, cut at the end of a word, each followed by the words that
    its last windows reach."""
    start = 0
    while len(text) - start > most:
        end = TO_BORDER.match(text, start + most).end()
        reach = end
        for _ in range(DEPTH - 1):
            word = NEXT_WORD.match(text, reach)
            reach = word.end() if word else reach
        yield lang, text[start:reach], end - start
        start = end
    yield lang, text[start:], len(text) - start


def _planes(numbers: np.ndarray) -> np.ndarray:
    """The lowest bytes of all numbers, then the next ones, and so on: those compress better."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)


def _numbers(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed(trie: Trie) -> bytes:
    """Front-coded: of each window the words from the first one that differs from the window before."""
    new = np.ones(trie.windows.shape, bool)
    new[1:] = np.logical_or.accumulate(trie.windows[1:] != trie.windows[:-1], axis=1)
    columns = [_planes(trie.windows[new[:, j], j]) for j in range(DEPTH + 1)]
    lengths = _planes(pc.binary_length(trie.words).to_numpy())
    return zstandard.compress(pickle.dumps((lengths, b"".join(trie.words.to_pylist()), new.sum(axis=1).astype(np.uint8), columns, _planes(trie.counts)), 5), 1)


def unpacked(payload: bytes) -> Trie:
    lengths, blob, fresh, columns, counts = pickle.loads(zstandard.decompress(payload))
    offsets = np.r_[0, np.cumsum(_numbers(lengths, np.int32))].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(blob)])
    windows = np.empty((len(fresh), DEPTH + 1), np.int32)
    for j, column in enumerate(columns):
        windows[:, j] = _numbers(column, np.int32)[np.cumsum(fresh > DEPTH - j) - 1]
    return Trie(words, windows, _numbers(counts, np.int64))


def places(trie: Trie, keys: list[Key]) -> list[int]:
    """How many windows are below each key."""
    words, out = trie.words.to_pylist(), []
    for key in keys:
        low, high = 0, len(trie.windows)
        for j, word in enumerate(key):
            at = 0 if word is None else bisect_left(words, word) + 1
            column = trie.windows[low:high, j]
            low, high = low + int(np.searchsorted(column, at)), low + int(np.searchsorted(column, at, "right"))
            if word is not None and (at > len(words) or words[at - 1] != word):
                break
        out.append(low)
    return out


def cut(trie: Trie, keys: list[Key]) -> Iterator[tuple[int, Trie]]:
    """(number of keys not above it, part) of each part between the keys that has windows."""
    ends = [0, *places(trie, keys), len(trie.windows)]
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        if a < b:
            used = np.zeros(len(trie.words) + 1, bool)
            used[trie.windows[a:b]] = True
            used[0] = True
            number = (np.cumsum(used) - 1).astype(np.int32)
            yield i, Trie(trie.words.take(np.flatnonzero(used)[1:] - 1), number[trie.windows[a:b]], trie.counts[a:b])


def together(tries: Iterable[Trie]) -> Trie:
    """All windows of several tries under common numbers, equal ones not yet summed."""
    tries = list(tries)
    words, rank = _ranked(pa.concat_arrays([t.words for t in tries]))
    ends = np.cumsum([0, *(len(t.words) for t in tries)])
    number = [np.r_[0, rank[a:b]].astype(np.int32)[t.windows] for t, a, b in zip(tries, ends, ends[1:], strict=False)]
    return Trie(words, np.concatenate(number), np.concatenate([t.counts for t in tries]))


def merged(tries: Iterable[Trie]) -> Trie:
    both = together(tries)
    return Trie(both.words, *_distinct(both.windows, both.counts, len(both.words)))


NODES = pa.schema([("lang", pa.binary()), ("phrase", pa.binary()), ("m", pa.int32()), ("a", pa.int64()), ("lefts", pa.list_(pa.int64())), ("open_lefts", pa.int32()), ("open", pa.bool_())])
NODES_DDL = "lang binary, phrase binary, m int, a bigint, lefts array<bigint>, open_lefts int, open boolean"


def walk(trie: Trie, least: int) -> pa.Table:
    """Nodes of a range with at least ``least`` occurrences, and the first and the last of each level
    whatever they have: those are ``open``, as ranges beside this one may hold more of them.
    ``open_lefts`` says how many of the left parts, from the shortest on, are such nodes."""
    windows, counts, size = trie.windows, trie.counts, len(trie.words)
    node, above, opened = np.zeros(len(windows), np.int64), [], np.zeros(len(windows), np.int32)
    tables = []
    for j in range(DEPTH + 1):
        live = windows[:, j] > 0
        windows, counts, node, opened, above = windows[live], counts[live], node[live], opened[live], [x[live] for x in above]
        if not len(windows):
            break
        _, first, node = np.unique(node * (size + 1) + windows[:, j], return_index=True, return_inverse=True)
        total = _sums(node, counts)
        edge = np.zeros(len(first), bool)
        edge[[0, -1]] = True
        kept = edge | (total >= least)
        at = first[kept]
        words = [trie.words.take(windows[at, i] - 1) for i in range(j + 1)]
        phrase = pc.binary_join_element_wise(*words[1:], b" ") if j else pa.array([b""] * len(at), pa.binary())
        lefts = np.stack([x[at] for x in above[1:]], axis=1) if j > 1 else np.zeros((len(at), 0), np.int64)
        lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * lefts.shape[1], lefts.ravel())
        columns = [words[0], phrase, pa.array(np.full(len(at), j, np.int32)), pa.array(total[kept]), lists, pa.array(np.maximum(opened[at] - 1, 0)), pa.array(edge[kept])]
        tables.append(pa.Table.from_arrays(columns, schema=NODES))
        rest = kept[node]
        above = [x[rest] for x in (*above, total[node])]
        opened = (opened + edge[node])[rest]
        windows, counts, node = windows[rest], counts[rest], node[rest]
    return pa.concat_tables(tables) if tables else NODES.empty_table()


def _segments(batches: Iterable[pa.RecordBatch], s: Settings) -> Iterator[list[tuple[bytes, bytes, int]]]:
    """Segments of a shard at a time."""
    held, n = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            for segment in runs(lang.as_py(), text.as_py(), s.shard_bytes):
                held.append(segment)
                n += segment[2]
                if n >= s.shard_bytes:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def _draw(docs: DataFrame, chance: float, step: int, s: Settings) -> list[Key]:
    """Every ``step``-th window of the documents drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phase = 0
        for held in _segments(batches, s):
            trie = windows_of(held)
            upto = np.cumsum(trie.counts)
            at = np.searchsorted(upto, np.arange(phase, upto[-1] if len(upto) else 0, step), "right")
            phase = (phase - int(trie.counts.sum())) % step
            columns = [[None if w == 0 else trie.words[w - 1].as_py() for w in trie.windows[at, j].tolist()] for j in range(DEPTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=[f"w{j}" for j in range(DEPTH + 1)])

    drawn = docs.sample(chance, seed=7).mapInArrow(run, ", ".join(f"w{j} binary" for j in range(DEPTH + 1))).toArrow()
    keys = list(zip(*(c.to_pylist() for c in drawn.columns), strict=True))
    return sorted(keys, key=lambda k: [w or b"" for w in k])


def splitters(docs: DataFrame, n_docs: int, n_bytes: int, ranges: int, s: Settings) -> list[Key]:
    """At most ``ranges`` - 1 windows that cut all of them into about even ranges."""
    if ranges < 2:
        return []
    chance = min(1.0, max(2000, 4 * ranges) / n_docs)
    drawn = _draw(docs, chance, max(1, int(chance * n_bytes / 6 / (s.draws * ranges))), s)
    found = [drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if drawn else []
    return [k for k, before in zip(found, [None, *found], strict=False) if k != before]


MESSAGE = "g long, r int, trie binary"


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"g": pa.array([x[0] for x in rows], pa.int64()), "r": pa.array([x[1] for x in rows], pa.int32()), "trie": pa.array([x[2] for x in rows], pa.binary())})


def _root(n: int, times: int) -> int:
    """The least number whose product with itself, so many times, is ``n`` or more."""
    root = max(1, int(n ** (1 / times)) - 1)
    while root**times < n:
        root += 1
    return root


def _merging(keys: list[Key], width: int, split: int):
    """What one group has of a range, merged and cut into finer ranges, for the group of groups."""

    def run(key, table):
        group, r = key[0].as_py(), key[1].as_py()
        parts = cut(merged(map(unpacked, table["trie"].to_pylist())), keys[r * split : (r + 1) * split - 1])
        return _messages([(group // width, r * split + i, packed(t)) for i, t in parts])

    return run


def nodes(docs: DataFrame, s: Settings) -> DataFrame:
    """Nodes of the trie of all documents (lang, text: binary), open ones once a range."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    spark, n_bytes = docs.sparkSession, size["bytes"] or 0
    # the shards that there can be: full ones, and a rest for each task
    shards = math.ceil(n_bytes / s.shard_bytes) + docs.rdd.getNumPartitions()
    keys = splitters(docs, size["n"] or 1, n_bytes, max(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / s.range_bytes)), s)
    rounds = max(1, math.ceil(math.log(max(shards, len(keys) + 1), s.fan) - 1e-9))
    width, split = _root(shards, rounds), _root(len(keys) + 1, rounds)

    def borders(level: int) -> list[Key]:
        return keys[split ** (rounds - 1 - level) - 1 :: split ** (rounds - 1 - level)]

    groups, coarse = math.ceil(shards / width), borders(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, held in enumerate(_segments(batches, s)):
            group = (part + k) % groups
            rows = [(group, r, packed(t)) for r, t in cut(windows_of(held), coarse)]
            yield from _messages(rows).to_batches()

    rows = docs.mapInArrow(count, MESSAGE)
    for level in range(1, rounds):
        rows = rows.groupBy("g", "r").applyInArrow(_merging(borders(level), width, split), MESSAGE)
    least = s.least
    return rows.groupBy("g", "r").applyInArrow(lambda key, table: walk(together(map(unpacked, table["trie"].to_pylist())), least), NODES_DDL)


def _first(phrase: Column) -> Column:
    """All words of a phrase but the last."""
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(1), F.size(F.split(phrase, " ")) - 1), " ")


def _rest(phrase: Column, k: Column) -> Column:
    """What is left of a phrase after its first k words."""
    return F.array_join(F.slice(F.split(phrase, " "), k + 1, F.lit(DEPTH)), " ")


def _with(array: str, n: int, value: Column) -> Column:
    """The array with its n-th item replaced, if there is a value for it."""
    return F.transform(array, lambda x, i: F.when(i == n - 1, F.coalesce(value, x)).otherwise(x))


def frequent(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a, lefts) of all phrases with at least ``least`` occurrences, and (lang, n)."""
    raw = staged(nodes(docs, s).withColumns({"lang": F.col("lang").cast("string"), "phrase": F.col("phrase").cast("string")}), "phrase-nodes", parts_for(docs, 4 << 20))
    whole = raw.where("open").groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a"), F.max("lefts").alias("lefts"), F.max("open_lefts").alias("open_lefts")).where((F.col("a") >= s.least) | (F.col("m") == 0))
    whole = staged(whole, "phrase-open", small=True)
    rows = raw.where("not open").drop("open").unionByName(whole)
    n = staged(rows.where("m = 0").select("lang", F.col("a").alias("n")), "phrase-languages", small=True)
    # left parts that a splitter cut in two have their sums in ``whole``
    cut_off, rows = rows.where("m > 1 and open_lefts > 0"), rows.where("m > 1 and open_lefts = 0 or m = 1")
    for j in range(1, DEPTH):
        sums = whole.where(F.col("m") == j).select("lang", F.col("phrase").alias("part"), F.col("a").alias("sum"))
        part = F.when(F.col("open_lefts") >= j, F.substring_index("phrase", " ", j))
        cut_off = cut_off.withColumn("part", part).join(sums, ["lang", "part"], "left").withColumn("lefts", _with("lefts", j, F.col("sum"))).drop("part", "sum")
    found = staged(rows.unionByName(cut_off).drop("open_lefts"), "phrases")
    discard(raw, whole)
    return found, n


def product(a: str, b: str, times: int = 1) -> Column:
    """Exact product of two counts of at most 10^17, as a decimal."""
    wide = lambda c: c.cast("decimal(17,0)")
    return wide(F.col(a)) * wide(F.col(b)) * F.lit(times).cast("decimal(4,0)")


def collocations(docs: DataFrame, settings: Settings | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: the first ``top`` phrases of each language."""
    s = settings or Settings()
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    found, n = frequent(plain, s)
    # a longer phrase that covers a shorter one passes through those of one word more, which cover it too
    longer = found.where("m > 2").select("lang", F.explode(F.array(_first(F.col("phrase")), _rest(F.col("phrase"), F.lit(1)))).alias("phrase"), "a")
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    cuts = found.where("m > 1").join(covered, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < s.cover * F.col("a")))
    cuts = cuts.select("lang", "phrase", "a", F.posexplode("lefts").alias("k", "l")).withColumn("end", _rest(F.col("phrase"), F.col("k") + 1))
    ends = found.select("lang", F.col("phrase").alias("end"), F.col("a").alias("r"))
    linked = cuts.join(ends, ["lang", "end"]).join(n, "lang").withColumns({"over": product("a", "n", 1000), "under": product("l", "r")})
    scored = linked.withColumn("score", F.expr("over div under"))
    least = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    out = least.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", (F.col("c.k") + 1).alias("cut"))
    w = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")


ORACLE = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^ \t]+') as w from d),
q as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
g as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m from q, (select unnest(range(1, 6)) as m) where i + m - 1 <= len(w)),
f as (select lang, phrase, m, count(*) as a from g group by all having count(*) >= 100),
n as (select lang, count(*) as n from q group by 1),
o as (select lang, part as phrase, max(a) as longest from (select lang, a, unnest([regexp_extract(phrase, '^(.*) [^ ]*$', 1), regexp_extract(phrase, '^[^ ]* (.*)$', 1)]) as part from f where m > 2) group by 1, 2),
c as (select f.*, unnest(range(1, m)) as k from f left join o using (lang, phrase) where m > 1 and (longest is null or longest < a)),
e as (select *, array_to_string(string_split(phrase, ' ')[:k], ' ') as lp, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as rp from c),
s as (select e.lang, e.phrase, e.a, e.k, x.a as l, y.a as r, n, ((1000::hugeint * e.a * n) // (x.a::hugeint * y.a))::bigint as score
      from e join f x on x.lang = e.lang and x.phrase = lp join f y on y.lang = e.lang and y.phrase = rp join n on n.lang = e.lang),
t as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score, k::int as cut from t qualify rank <= 2000
"""
