"""BM25 over an inverted index that is a DataFrame.

An index is made in one scan of the texts and stored, a row a segment of documents: their keys and
lengths, the terms that occur in them with the documents and counts, and for each term the largest
count and the shortest document. A search reads segments, never texts. From a segment's largest counts follows a
bound for what any of its documents can score for a query; a task keeps the best k of each query so far, and counts a
segment out for a query whose k-th best the bound does not reach. The statistics are those of the
whole corpus, whatever filter a query has; the filter applies to scores. The Okapi weights are
ours to state: idf = ln(N - n + 0.5) - ln(n + 0.5); a negative idf becomes a quarter of the mean
idf of the vocabulary; k1 = 1.5, b = 0.75.

A search sends the query terms to the segments, those of some queries at a time, and only the best of each task
are shuffled. Only where a mean idf is negative, and scored documents may rank below others, it is a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import terms
from lectern.sources.scratch import LARGE_ROWS, stored

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms (rows of some fifty bytes) that travel to the tasks at once; more queries are searched in rounds. With 0
#: every search is a join.
MOST_TERMS = 500_000
#: Documents of a segment, and bytes of texts that are counted at once.
SEGMENT_DOCS, BATCH_BYTES = 64, 4 << 20
#: Products of postings and queries that are added up at once; bytes of what segments that wait for their turn hold.
CELLS, HELD_BYTES = 1 << 21, 32 << 20
#: Queries whose best leave a task in one batch.
OUT_QUERIES = 256
#: From so many queries on, they are added up term by term over blocks of segments: so many postings and documents, and so many
#: of the most frequent terms as rows of all documents.
MANY_QUERIES, BLOCK_POSTINGS, BLOCK_DOCS, FULL_ROWS = 512, 6_000_000, 1 << 15, 128
#: The least number above nothing.
TINY = 5e-324
#: Scores are rounded to six places; a bound that is below the floor by more counts a segment out.
MARGIN = 2e-6

TOKEN = np.zeros(256, bool)
TOKEN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


@dataclass(frozen=True)
class Index:
    """``segments`` (segment, keys, dl, terms, df, most, shortest, docs, counts) and ``weights`` (term, idf) are
    stored tables. ``docs`` and ``counts`` hold the postings of all terms, ``df`` of each, one after another."""

    key: str
    segments: DataFrame
    weights: DataFrame
    avgdl: float
    #: The mean idf of the vocabulary.
    mean: float


_SEGMENT = [("dl", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("most", pa.list_(pa.int32())), ("shortest", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
_SEGMENT_DDL = "dl array<int>, terms array<string>, df array<int>, most array<int>, shortest array<int>, docs array<int>, counts array<int>"


def _counted(keys: pa.Array, texts: list[bytes]) -> Iterator[list]:
    """Segments of some documents with their lower-case texts."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = TOKEN[data]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(begin, starts, "right") - 1
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    size = max(1, len(coded.dictionary))
    length = np.bincount(owner, minlength=len(texts)).astype(np.int32)
    # sorted by segment, then term, then document
    cell = (owner // SEGMENT_DOCS * size + coded.indices.to_numpy()) * SEGMENT_DOCS + owner % SEGMENT_DOCS
    cell, counts = np.unique(cell, return_counts=True)
    doc, group = cell % SEGMENT_DOCS, cell // SEGMENT_DOCS
    for at in range(0, len(texts), SEGMENT_DOCS):
        low, high = np.searchsorted(group // size, [at // SEGMENT_DOCS, at // SEGMENT_DOCS + 1])
        dl = length[at : at + SEGMENT_DOCS]
        term, first = np.unique(group[low:high], return_index=True)
        df = np.diff(np.r_[first, high - low])
        most = np.maximum.reduceat(counts[low:high], first) if len(first) else first
        shortest = np.minimum.reduceat(dl[doc[low:high]], first) if len(first) else first
        yield [keys.slice(at, SEGMENT_DOCS), dl, coded.dictionary.take(term % size), df, most, shortest, doc[low:high], counts[low:high]]


def _segments(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: list, texts: list) -> pa.RecordBatch:
            rows = list(_counted(pa.array(keys, schema.field(0).type.value_type), texts))
            return pa.RecordBatch.from_arrays([pa.array([r[i] if i in (0, 2) else np.asarray(r[i], np.int32) for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        keys, texts, n = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                n += len(text)
                if n >= BATCH_BYTES and len(texts) % SEGMENT_DOCS == 0:
                    yield made(keys, texts)
                    keys, texts, n = [], [], 0
        if texts:
            yield made(keys, texts)

    return run


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    spark = docs.sparkSession
    rows = docs.select(key, F.encode(F.coalesce(F.lower(F.col(text)), F.lit("")), "utf-8").alias("text"))
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)  # a small file, which few tasks would read
    kind = dict(docs.dtypes)[key]
    schema = pa.schema([("keys", pa.list_(_ARROW[kind])), *_SEGMENT])
    made = rows.mapInArrow(_segments(schema), f"keys array<{kind}>, {_SEGMENT_DDL}")
    segments = stored(made.withColumn("segment", F.monotonically_increasing_id()), LARGE_ROWS)
    size = segments.agg(F.sum(F.size("keys")).alias("n"), F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    n = size["n"] or 0
    df = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.df").alias("df"))
    raw = stored(df.select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    weights = raw.select("term", F.when(F.col("raw") < 0, F.lit(mean * EPSILON)).otherwise(F.col("raw")).alias("idf"))
    return Index(key, segments, weights, (size["words"] or 0) / n if n else 0.0, mean)


def query_terms(queries: DataFrame, index: Index, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, term, qf, idf): a term repeated in the query counts again."""
    found = queries.select(query, F.explode_outer(terms(F.col(text))).alias("term")).where(F.col("term").isNotNull())
    return stored(found.groupBy(query, "term").agg(F.count("*").alias("qf")).join(index.weights, "term"))


def scores(wanted: DataFrame, index: Index, query: str = "query_id") -> DataFrame:
    """(query, key, score) of documents that share a term with the query, by a join."""
    each = F.flatten(F.transform(F.arrays_zip("terms", "df"), lambda p: F.array_repeat(p["terms"], p["df"])))
    rows = index.segments.select("keys", "dl", F.explode(F.arrays_zip(each.alias("term"), "docs", "counts")).alias("p"))
    postings = rows.select(F.get("keys", F.col("p.docs")).alias(index.key), F.get("dl", F.col("p.docs")).alias("dl"), F.col("p.term").alias("term"), F.col("p.counts").alias("f"))
    weight = F.col("qf") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl)))
    return postings.join(wanted, "term").groupBy(query, index.key).agg(F.round(F.sum(weight), 6).alias("score"))


def _saturated(f: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its count."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class _Scorer:
    """The best k of a task's documents for each query. ``owner`` and ``weight`` are the queries of each
    term, from ``start`` on, and what the term weighs there."""

    def __init__(self, n: int, names: pa.Array, start: np.ndarray, owner: np.ndarray, weight: np.ndarray, avgdl: float, k: int):
        self.names, self.start, self.owner, self.weight, self.avgdl, self.k = names, start, owner, weight, avgdl, k
        self.floor, self.best = np.full(n, -np.inf), [None] * n
        self.scored = self.possible = 0
        self.held, self.known, self.bytes = [], [], 0

    def bounds(self, row: dict) -> tuple:
        """Of a segment: its terms that are asked for, who asks for them at which of these places and weight, and
        what no document of it exceeds for each query; below anything where it shares no term."""
        found = pc.index_in(row["terms"], value_set=self.names)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        term = found.fill_null(0).to_numpy(zero_copy_only=False)[at]
        count = self.start[term + 1] - self.start[term]
        here = _spread(self.start[term], count)
        who, place, weight = self.owner[here], np.repeat(np.arange(len(at)), count), self.weight[here]
        bound = np.bincount(who, weight * _saturated(row["most"][at].astype(np.float64), row["shortest"][at], self.avgdl)[place], len(self.floor)).astype(np.float64)
        bound[np.bincount(who, minlength=len(bound)) == 0] = -np.inf
        return at, who, place, weight, bound

    def add(self, keys: np.ndarray, allowed: np.ndarray, row: dict) -> None:
        """A segment waits for others, as long as what is known of them is not too much."""
        known = self.bounds(row)
        self.held.append((keys, allowed, row))
        self.known.append(known)
        self.bytes += sum(x.nbytes for x in known)
        if self.bytes >= HELD_BYTES:
            self.take()

    def take(self) -> None:
        """Each query first meets the segment that promises it most, so that its floor is high for the others."""
        if not self.held:
            return
        segments, known = self.held, self.known
        self.held, self.known, self.bytes = [], [], 0
        bound = np.stack([x[-1] for x in known])
        first = bound.argmax(axis=0)
        for i in np.unique(first):
            self._score(*segments[i], *known[i][:4], np.flatnonzero((first == i) & (bound[i] > -np.inf)))
        for i, x in enumerate(known):
            alive = (bound[i] > -np.inf) & (first != i) & (bound[i] + MARGIN >= self.floor)
            self._score(*segments[i], *x[:4], np.flatnonzero(alive))
            self.possible += int((bound[i] > -np.inf).sum()) * len(segments[i][0])

    def _score(self, keys: np.ndarray, allowed: np.ndarray, row: dict, at: np.ndarray, who: np.ndarray, place: np.ndarray, weight: np.ndarray, alive: np.ndarray) -> None:
        self.scored += len(alive) * len(keys)
        # postings of each term found, times the queries that want it, some queries at a time
        df = row["df"][at]
        offset = (np.cumsum(row["df"]) - row["df"])[at]
        per = np.bincount(who, df[place], len(self.floor))[alive] + len(keys)
        for part in np.split(alive, np.flatnonzero(np.diff(np.cumsum(per) // CELLS)) + 1):
            if not len(part):
                continue
            slot = np.full(len(self.floor), -1)
            slot[part] = np.arange(len(part))
            own = slot[who] >= 0
            many = df[place[own]]
            posting = _spread(offset[place[own]], many)
            doc = row["docs"][posting]
            value = np.repeat(weight[own], many) * _saturated(row["counts"][posting].astype(np.float64), row["dl"][doc], self.avgdl)
            cell = np.repeat(slot[who[own]], many) * len(keys) + doc
            total = np.round(np.bincount(cell, value, len(part) * len(keys)).reshape(len(part), -1), 6)
            hit = (np.bincount(cell, minlength=len(part) * len(keys)).reshape(len(part), -1) > 0) & allowed
            hit &= total >= self.floor[part][:, None]
            for j in np.flatnonzero(hit.any(axis=1)).tolist():
                self._keep(part[j], keys[hit[j]], total[j, hit[j]])

    def _keep(self, q: int, keys: np.ndarray, score: np.ndarray) -> None:
        if self.best[q] is not None:
            keys, score = np.concatenate([self.best[q][0], keys]), np.concatenate([self.best[q][1], score])
        top = np.lexsort((keys, -score))[: self.k]
        self.best[q] = keys[top], score[top]
        if len(top) == self.k:
            self.floor[q] = score[top[-1]]


class _Blocks:
    """The same for many queries: ``begin`` says where the terms and weights of each query start.

    Segments become one block with the postings of each term, and those of a query's terms are added up at once, of the most
    frequent ones by rows of all documents."""

    def __init__(self, names: pa.Array, begin: np.ndarray, term: np.ndarray, weight: np.ndarray, avgdl: float, k: int):
        self.names, self.begin, self.term, self.weight, self.avgdl, self.k = names, begin, term, weight, avgdl, k
        self.floor, self.best = np.full(len(begin) - 1, -np.inf), [None] * (len(begin) - 1)
        self.held, self.postings, self.docs = [], 0, 0

    def add(self, keys: np.ndarray, allowed: np.ndarray, row: dict) -> None:
        self.held.append((keys, allowed, row))
        self.postings += len(row["docs"])
        self.docs += len(keys)
        if self.postings >= BLOCK_POSTINGS or self.docs >= BLOCK_DOCS:
            self.take()

    def _block(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of documents; where the postings of each term start, their documents and what these give for it."""
        keys, allowed = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        rows = [x[2] for x in self.held]
        first = np.cumsum([0, *(len(x[0]) for x in self.held)])
        found = pc.index_in(pa.concat_arrays([r["terms"] for r in rows]), value_set=self.names)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        term = found.fill_null(0).to_numpy(zero_copy_only=False)[at]
        order = np.argsort(term, kind="stable")
        at, term = at[order], term[order]
        df = np.concatenate([r["df"] for r in rows])
        offset, of = (np.cumsum(df) - df)[at], np.repeat(np.arange(len(rows)), [len(r["df"]) for r in rows])[at]
        df = df[at]
        posting = _spread(offset, df)
        doc = np.concatenate([r["docs"] for r in rows])[posting] + np.repeat(first[of], df)
        value = _saturated(np.concatenate([r["counts"] for r in rows])[posting].astype(np.float64), np.concatenate([r["dl"] for r in rows])[doc], self.avgdl)
        term = np.repeat(term, df)
        if not allowed.all():
            term, doc, value = term[allowed[doc]], doc[allowed[doc]], value[allowed[doc]]
        return keys, np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.names)))], doc, value

    def take(self) -> None:
        if not self.held:
            return
        keys, start, doc, value = self._block()
        self.held, self.postings, self.docs = [], 0, 0
        many, n = np.diff(start), len(keys)
        most = np.zeros(len(many))
        if len(value):
            most[many > 0] = np.maximum.reduceat(value, start[:-1][many > 0])
        often = np.argsort(-many, kind="stable")[:FULL_ROWS]
        often = often[many[often] > n // 4]
        place = np.full(len(many), -1)
        place[often] = np.arange(len(often))
        full, scaled = np.zeros((len(often), n)), np.empty(n)
        for i, t in enumerate(often.tolist()):
            full[i, doc[start[t] : start[t + 1]]] = value[start[t] : start[t + 1]]
        for q in range(len(self.floor)):
            term, weight = self.term[self.begin[q] : self.begin[q + 1]], self.weight[self.begin[q] : self.begin[q + 1]]
            # no document of the block reaches the k-th best of those before
            if not len(term) or (weight * most[term]).sum() + MARGIN < self.floor[q]:
                continue
            row = place[term]
            thin = row < 0
            rare = thin & (many[term] > 0)
            at, w = term[rare], weight[rare]
            parts = list(zip(start[at].tolist(), start[at + 1].tolist(), strict=True))
            if parts:
                given = np.concatenate([value[low:high] for low, high in parts])
                given *= np.repeat(w, many[at])
                total = np.bincount(np.concatenate([doc[low:high] for low, high in parts]), given, n)
            else:
                total = np.zeros(n)
            for i, w in zip(row[~thin].tolist(), weight[~thin].tolist(), strict=True):
                np.multiply(full[i], w, out=scaled)
                np.add(total, scaled, out=total)
            likely = np.flatnonzero(total >= max(self.floor[q] - MARGIN, TINY))
            score = total[likely]
            if len(likely) > 4 * self.k:
                good = score >= np.partition(score, len(score) - self.k)[len(score) - self.k] - MARGIN
                likely, score = likely[good], score[good]
            score = np.round(score, 6)
            good = (score >= self.floor[q]) & (score > 0)
            if good.any():
                _Scorer._keep(self, q, keys[likely[good]], score[good])


def _columns(batch: pa.RecordBatch) -> Iterator[dict]:
    """Each segment's lists; of keys and terms as they are, of numbers as arrays."""
    names = [n for n in batch.schema.names if n != "segment"]
    for row in range(batch.num_rows):
        lists = {n: batch.column(n)[row].values for n in names}
        yield {n: v if n in ("terms", "keys") else v.to_numpy(zero_copy_only=False) for n, v in lists.items()}


def _scan(queries: pa.Array, scorer: tuple, schema: pa.Schema, blocks: bool, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Blocks(*scorer) if blocks else _Scorer(len(queries), *scorer)
        for batch in batches:
            for row in _columns(batch):
                keys = row["keys"].to_numpy(zero_copy_only=False)
                s.add(keys, np.isin(keys, row["allowed"]) if "allowed" in row else np.ones(len(keys), bool), row)
            if not blocks:
                s.take()
        s.take()
        if counts_only:
            yield pa.RecordBatch.from_arrays([pa.array([s.scored]), pa.array([s.possible])], names=["scored", "possible"])
            return
        for low in range(0, len(s.best), OUT_QUERIES):
            kept = [(q, x) for q, x in enumerate(s.best[low : low + OUT_QUERIES], low) if x is not None]
            if kept:
                owner = np.repeat([q for q, _ in kept], [len(x[0]) for _, x in kept])
                keys, score = (np.concatenate([x[i] for _, x in kept]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(owner)), pa.array(keys, schema.field(1).type), pa.array(score)], schema=schema)

    return run


def best_scores(wanted: DataFrame, index: Index, k: int, only: DataFrame | None, query: str = "query_id", counts_only: bool = False) -> DataFrame:
    """(query, key, score): of each task the best k of each query, among the keys of ``only``; or, of each
    task, how many pairs of a query and a document that may share a term were scored."""
    segments = index.segments
    if only is not None:
        place = segments.select("segment", F.explode("keys").alias(index.key)).join(only.select(index.key), index.key, "left_semi")
        segments = segments.join(place.groupBy("segment").agg(F.collect_list(index.key).alias("allowed")), "segment")
    rows = wanted.select(query, "term", (F.col("qf") * F.col("idf")).alias("w")).toArrow()
    kinds = {query: dict(wanted.dtypes)[query], index.key: dict(index.segments.dtypes)["keys"].removeprefix("array<").removesuffix(">")}
    schema = pa.schema([(query, rows.schema.field(0).type), (index.key, _ARROW[kinds[index.key]]), ("score", pa.float64())])
    queries, names = pc.unique(rows.column(0)), pc.unique(rows.column(1))
    term, owner = pc.index_in(rows.column(1), value_set=names).to_numpy(), pc.index_in(rows.column(0), value_set=queries).to_numpy()
    blocks = len(queries) >= MANY_QUERIES and not counts_only
    by, size = (owner, len(queries)) if blocks else (term, len(names))
    order = np.argsort(by, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(by, minlength=size))].astype(np.int64)
    scorer = (names, start, (term if blocks else owner)[order].astype(np.int64), rows.column(2).to_numpy()[order], index.avgdl, k)
    ddl = "scored long, possible long" if counts_only else f"`{query}` {kinds[query]}, `{index.key}` {kinds[index.key]}, score double"
    return segments.mapInArrow(_scan(queries, scorer, schema, blocks, counts_only), ddl)


def pruning(queries: DataFrame, index: Index, k: int, query: str = "query_id", text: str = "text") -> DataFrame:
    """(scored, possible): pairs of a query and a document of a segment with a common term, and those of them
    that a search for the best k scores; the bounds count the rest out."""
    return best_scores(query_terms(queries, index, query, text), index, k, None, query, counts_only=True).agg(F.sum("scored").alias("scored"), F.sum("possible").alias("possible"))


def padded(scored: DataFrame, queries: DataFrame, docs: DataFrame, index: Index, k: int, query: str = "query_id") -> DataFrame:
    """With zero scores for documents without a common term, as far as a top k can need them. Where
    scores are positive, at most k - 1 documents are scored when there is room, so the first 2k
    documents suffice. Only with a negative mean idf can scored documents rank below others, and
    then all documents are candidates."""
    first = docs.select(index.key)
    if index.mean >= 0:
        first = first.orderBy(index.key).limit(2 * k)
    zero = queries.select(query).crossJoin(first).withColumn("score", F.lit(0.0))
    # a sum rather than an anti-join, for which the scores would be computed twice
    return scored.unionByName(zero).groupBy(query, index.key).agg(F.sum("score").alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "doc_id", query: str = "query_id", score: str = "score") -> DataFrame:
    """Ranks 1 to k of each query; ties go to the smaller key. Spark prunes groups before the shuffle."""
    w = W.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def search(queries: DataFrame, docs: DataFrame, k: int, only: Column | None = None, key: str = "doc_id", query: str = "query_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """BM25 top k; ``only`` filters the documents after scoring, under statistics of all."""
    index = index or build(docs, key, text)
    allowed, wanted = docs if only is None else docs.where(only), query_terms(queries, index, query, text)
    if index.mean >= 0 and MOST_TERMS:
        rounds = -(-wanted.count() // MOST_TERMS)
        best = lambda some: best_scores(some, index, k, None if only is None else allowed, query)
        if rounds <= 1:
            found = best(wanted)
        else:
            part = F.pmod(F.xxhash64(query), F.lit(rounds))
            found = reduce(DataFrame.unionByName, [stored(top_k(best(wanted.where(part == i)), k, key, query).drop("rank")) for i in range(rounds)])
    else:  # scores below those of documents without any
        found = scores(wanted, index, query)
        found = found if only is None else found.join(allowed.select(key), key, "left_semi").select(query, key, "score")
    return top_k(padded(found, queries, allowed, index, k, query), k, key, query)
