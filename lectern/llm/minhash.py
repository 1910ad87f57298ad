"""Near-duplicate detection by one-permutation MinHash.

Each text becomes its set of word shingles. One hash of every shingle serves all bins: the
hashes fall into bins by their high bits, the least of a bin is its slot, and empty bins
borrow from a filled one by a fixed random preference of each bin (optimal densification).
Bands of slots are bucket keys. Texts with equal sets are one class and are represented by
their smallest id. In a bucket the representatives form stars, never all pairs: each is
tested against the smallest one, on full sets. Those left out of the star, because their
similarity to its centre is too low, are tested against a few further centres of the
bucket's largest component, and those left then against all that component and all other members
of the bucket that are not yet connected with them; so no link between components is lost. Components follow from hooking and pointer jumping.

With 50 bands of 6 slots, a pair at exactly 0.8 shares no bucket with probability 2.5e-7,
one at 0.85 with 1e-10.

Defined cases. Null text, empty text or one without words: the empty set, linked with
nothing, its own component, kept. Fewer words than a shingle: the whole sequence is the one
shingle. Rows that share an id are one document: they share a component. A null id has no
component other than that of its class; ``kept`` is true for it only if its class has no
id at all. Repeated rows each give a row. Empty table: empty result. Very long texts are
taken whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, parts_for, staged

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    bands: int = 50
    slots: int = 6


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * M1
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    acc = np.full(n, np.uint64(k * int(M2) & (1 << 64) - 1))
    for i in range(k):
        acc = _mix(acc * M2 + h[i : i + n])
    return np.unique(_mix(acc))


class Sketch:
    """Band keys of a shingle set."""

    def __init__(self, settings: Settings):
        self.bands, self.slots = settings.bands, settings.slots
        self.bins = self.bands * self.slots
        rng = np.random.default_rng(20240607)
        # preference[j, b]: how late the empty bin j would borrow from bin b
        self.preference = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.int16)
        self.weights = rng.integers(1, 1 << 62, (self.bands, self.slots), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.salts = rng.integers(1, 1 << 62, self.bands, dtype=np.int64).astype(np.uint64)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # hashes are sorted, and so are bins
        filled = bins[first].astype(np.int64)
        slot = np.empty(self.bins, np.uint64)
        slot[filled] = hashes[first]
        empty = np.ones(self.bins, bool)
        empty[filled] = False
        if empty.any():
            at = np.flatnonzero(empty)
            slot[at] = hashes[first][self.preference[np.ix_(at, filled)].argmin(axis=1)]
        # the bin is part of a slot's meaning only through its place in the band
        return _mix((_mix(slot).reshape(self.bands, self.slots) * self.weights).sum(axis=1, dtype=np.uint64) + self.salts).view(np.int64)


def _features(settings: Settings):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, cache = Sketch(settings), WordHashes()
        for batch in batches:
            ids, sizes, classes, keys = batch.column(0).to_pylist(), [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), settings.words, cache)
                sizes.append(len(s))
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(sketch.keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


#: log2 of the bits of the filter that tells which texts need their sets; its size is fixed.
MARKS = 24


def _marks(wanted: DataFrame):
    """A one-hash Bloom filter of the ids, as bytes, broadcast: 2 MB whatever the input. With
    more ids than it can tell apart it lets more texts through, and the join after it is exact."""
    at = F.pmod(F.xxhash64("v"), F.lit(1 << MARKS))
    words = wanted.select(at.alias("at")).groupBy(F.expr("cast(at div 32 as int) as w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 as int))) as m")).toArrow()
    bits = np.zeros(1 << MARKS - 5, "<u4")
    bits[words.column("w").to_numpy()] = words.column("m").to_numpy().astype("<u4")
    return wanted.sparkSession.sparkContext.broadcast(bits.tobytes())


def _sets(settings: Settings, marks):
    schema = pa.schema([("v", pa.int64()), ("s", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = WordHashes(), np.frombuffer(marks.value, "<u4")
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = np.flatnonzero((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1)
            texts = batch.column(1)
            sets = [shingles(texts[k].as_py(), settings.words, cache).tobytes() for k in keep.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(sets, pa.binary())], schema=schema)

    return run


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sorted sets of hashes reach ``percent`` of Jaccard similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(a.as_py(), b.as_py(), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep))

    return run


def _confirmed(edges: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    a, b = sets.select(F.col("v").alias("u"), F.col("s").alias("su")), sets.select("v", F.col("s").alias("sv"))
    return edges.join(b, "v").join(a, "u").select("u", "v", "su", "sv").mapInArrow(_verify(settings.percent), "u bigint, v bigint")


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(v, c): the smallest vertex reachable from each vertex of the edges (u, v).

    Every round takes the least label among the neighbours and then follows labels once;
    its table is staged in the shared folder, and only a test for changes reaches the driver."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    labels, before = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")), None
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("n"))
        hooked = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        after = staged(hooked.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("up", "c")).alias("c")), "labels", parts, small=True)
        if before is not None:
            discard(before)
        labels, before = after.select("v", "c"), after
        if after.where("c <> old").isEmpty():
            return labels


def _mixed(members: DataFrame, comps: DataFrame, parts: int) -> DataFrame:
    """Members of the buckets that hold several components, with their component and the
    bucket's largest one, ``main``."""
    named = staged(members.join(comps, "v", "left").select("key", "v", "n", F.coalesce("c", "v").alias("c")), "named", parts, small=True)
    main = named.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    main = staged(main.select("key", F.col("m.c").alias("main")), "mixed", parts, small=True)
    rest = staged(named.join(main, "key"), "rest", parts, small=True)
    discard(named, main)
    return rest


def _near(percent: int) -> str:
    return f"c <> ac and 100 * least(n, an) >= {percent} * greatest(n, an)"


def _outsiders(rest: DataFrame) -> DataFrame:
    return rest.where("c <> main").select("key", F.col("v").alias("av"), F.col("n").alias("an"), F.col("c").alias("ac"))


def _more_centres(rest: DataFrame, percent: int, centres: int = 6) -> DataFrame:
    """Stars around a few further members of the largest component, drawn by hash for each
    bucket: pairs of them with the members outside that component."""
    drawn = rest.where("c = main").groupBy("key").agg(*[F.min_by(F.struct("v", "n", "c"), F.xxhash64("v", F.lit(t))).alias(f"p{t}") for t in range(centres)])
    drawn = drawn.select("key", F.explode(F.array_distinct(F.array(*[f"p{t}" for t in range(centres)]))).alias("p")).select("key", "p.*")
    return _outsiders(rest).join(drawn, "key").where(_near(percent)).select(F.least("v", "av").alias("u"), F.greatest("v", "av").alias("v")).distinct()


#: Shingles of a block, when members of a bucket are tested against all of the bucket's largest
#: component: a task holds a block of the component and one of those tested.
BLOCK_SHINGLES = 250_000


#: Parts of a component in joins by component, of which one may hold a third of all rows.
SALTS = 64


def _by_component(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (c, v, ...) with the columns of their component in ``table``, which has a row for each."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(table.withColumn("salt", parts), ["c", "salt"]).drop("salt")


def _against_component(rest: DataFrame, members: DataFrame, comps: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links of the members of a bucket outside its largest component, with that component and
    with each other.

    A component and the outsiders of its buckets are cut into blocks, by hash, and so are those
    outsiders as the ones who ask; each block of the ones meets each block of the others once: an
    inverted index of the block's shingles gives the intersections with all its members, so no
    pairs are made but links, and no task holds more than two blocks however hot a component is."""
    wanted = rest.where("c <> main").select(F.col("main").alias("c"), "v", "n").distinct()
    named = _by_component(members.select("v", "n").distinct().join(comps, "v", "left").select("v", "n", F.coalesce("c", "v").alias("c")), wanted.select("c").distinct())
    named = named.select("c", "v", "n").unionByName(wanted)
    blocks = named.groupBy("c").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    askers = wanted.groupBy("c").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("askers"))
    cut = blocks.join(askers, "c")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("v"), F.col(n))
    have = _by_component(named, cut).select("c", dealt("blocks").alias("block"), every("askers").alias("asker"), "v").join(sets, "v")
    ask = _by_component(wanted, cut).select("c", "v", dealt("askers").alias("asker"), every("blocks").alias("block")).join(sets, "v")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(own) or not len(asked):
            return schema.empty_table()
        parts = [np.frombuffer(x, np.uint64) for x in own.column("s").to_pylist()]
        size = np.array([len(p) for p in parts])
        flat, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
        order = np.argsort(flat, kind="stable")
        flat, of = flat[order], of[order]
        ids, found = np.array(own.column("v").to_pylist()), []
        for x, blob in zip(asked.column("ask_v").to_pylist(), asked.column("ask_s").to_pylist(), strict=True):
            h = np.frombuffer(blob, np.uint64)
            low, high = np.searchsorted(flat, h), np.searchsorted(flat, h, "right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(of[at], minlength=len(parts))
            found += [(min(x, y), max(x, y)) for y in ids[100 * both >= settings.percent * (size + len(h) - both)].tolist() if x != y]
        return pa.table([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], schema=schema)

    ask = ask.select(*[F.col(k).alias(f"ask_{k}") for k in ("c", "block", "asker", "v", "s")])
    return have.groupBy("c", "block", "asker").cogroup(ask.groupBy("ask_c", "ask_block", "ask_asker")).applyInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links (confirmed links of the document's class)."""
    parts = parts_for(docs)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = staged(rows.mapInArrow(_features(settings), "doc_id bigint, n_shingles bigint, class binary, keys array<bigint>"), "sketches", parts)
    classes = staged(found.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")), "classes", parts, small=True)
    heads = classes.where("v is not null").select("class", "v")
    placed = found.where("class is not null").select("class", F.col("doc_id").alias("v"), "n_shingles", "keys").join(heads, ["class", "v"], "left_semi")
    buckets = placed.select("v", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # only keys met more than once make buckets; staged, so that Spark can split a hot key in the join
    shared = staged(buckets.groupBy("key").agg(F.min("v").alias("u"), F.max("v").alias("last")).where("u <> last").select("key", "u"), "shared", parts, small=True)
    members = staged(buckets.join(shared, "key").select("key", "u", "v", "n"), "buckets", parts)
    discard(shared)
    star = staged(members.where("u <> v").select("u", "v").distinct(), "stars", parts, small=True)
    wanted = star.select("v").unionByName(star.select(F.col("u").alias("v"))).distinct()
    maybe = rows.where("doc_id is not null").select(F.col("doc_id").alias("v"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARKS)).alias("at")).mapInArrow(_sets(settings, _marks(wanted)), "v bigint, s binary")
    sets = staged(maybe.join(wanted, "v", "left_semi").dropDuplicates(), "sets", parts)
    links = staged(_confirmed(star, sets, settings), "confirmed", parts, small=True)
    comps = components(links, parts)
    rest = _mixed(members, comps, parts)
    pairs = _more_centres(rest, settings.percent).join(star, ["u", "v"], "left_anti")
    more = staged(_confirmed(pairs, sets, settings), "confirmed", parts, small=True)
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = components(links, parts)
        rest = _mixed(members, comps, parts)
    last = staged(_against_component(rest, members, comps, sets, settings).distinct(), "confirmed", parts, small=True)
    if not last.isEmpty():
        links = links.unionByName(last).distinct()
        comps = components(links, parts)
    degree = links.select("u").unionByName(links.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("n_links"))
    by_class = classes.join(comps, "v", "left").join(degree, classes["v"] == degree["u"], "left").select("class", F.coalesce("c", classes["v"]).alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = found.select("doc_id", "n_shingles", "class").join(by_class, "class", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: The result of ``near_duplicates`` over two-word shingles, from all pairs of different sets that share a shingle.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from w),
c as (select doc_id, len(s) as n, case when len(s) > 0 then min(doc_id) over (partition by md5(array_to_string(s, chr(10)))) else doc_id end as v, s from s),
x as (select v, n, unnest(s) as x from c where doc_id = v),
p as (select a.v as a, b.v as b from x a join x b on a.x = b.x and a.v < b.v and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.v, b.v, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r(v, c) as (select a, a from e union select r.v, e.b from r join e on e.a = r.c),
m as (select v, min(c) as c from r group by v)
select doc_id, n::bigint as n_shingles, coalesce(m.c, c.v) as component_id, coalesce(m.c, c.v) = doc_id as kept from c left join m on m.v = c.v
"""
