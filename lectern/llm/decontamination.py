"""Benchmark decontamination: BM25 search of test items by every training passage.

The test items form an inverted index whose posting lists are cut into blocks of items with
the largest weight of each block (block-max). Each document is cut into overlapping passages
of words, and each passage is a query. Weights are divided by the item's score against
itself, so that one threshold serves all items, and all items above it are retrieved: blocks
whose summed maxima stay below the threshold are skipped, and WAND walks what is left, moving
its cursors to the pivot item. Retrieved items are then verified: the share of the five-word
shingles of the question, and that of the answer, found in the passage must both reach
``overlap``. The answer is the last quarter of an item's words, the question the rest.
One changed word breaks up to five shingles, most of a short part. With ``edits`` (as in the
query and the pipeline) a part is also found if its best placement in the passage needs at
most ``1 - overlap`` of its words as word edits, or one edit if it has three words or more.

Passages have twice the words of the longest item of an index and start at every such
length, so each occurrence of an item lies whole in one passage. Items are indexed by length
class (64 words or a larger power of two). Document frequencies, item count and mean length are
those of all items, computed once, so scores do not depend on how the items are divided. The
items are dealt into parts of about ``index_bytes`` of text. The index of each part is a file in
the shared folder. A small benchmark makes one part, which each task loads once; of several, a
task holds one at a time and scans each batch with it, so what the driver and the tasks hold is
bounded however many parts there are.

Defined cases. Null or empty text, or one without words: nothing found. Items without words
are ignored; null item ids are reported as null. A part with fewer than five words counts
as one shingle. Repeated rows each get their finds; repeated items are each found. Empty
tables: nothing found. Very long texts are searched whole. Other columns are not touched.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import scratch_dir, staged

WORD = re.compile(r"\w+")
FOUND = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()),
    T.StructField("answer_overlap", T.DoubleType()),
]))


@dataclass(frozen=True)
class Settings:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6
    overlap: float = 0.8
    shingle: int = 5
    answer_share: float = 0.25
    #: Parts may also be found by aligning their words with the passage.
    edits: bool = False
    block_items: int = 8
    index_bytes: int = 8 << 20
    #: Terms in many items are left out of the first bound until their weights may add up to this.
    slack: float = 0.1


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts(n: int, share: float) -> int:
    """Where the answer of an item of ``n`` words begins."""
    return n - max(1, math.ceil(n * share)) if n > 1 else 0


def shingle_set(tokens: list, width: int) -> set[tuple]:
    k = min(width, len(tokens))
    return {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)} if tokens else set()


def word_edits(part: np.ndarray, tokens: np.ndarray) -> int:
    """Least number of words to change, leave out or put in, to make ``part`` a stretch of the tokens."""
    place = np.arange(len(tokens) + 1)
    row = np.zeros(len(tokens) + 1, np.int64)
    for i, w in enumerate(part, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (tokens != w))
        row = np.minimum.accumulate(np.r_[i, step] - place) + place
    return int(row.min())


def spared(n: int, overlap: float) -> int:
    """Word edits that a part of ``n`` words may have."""
    return max(int(n >= 3), math.floor((1 - overlap) * n + 1e-9))


@dataclass(frozen=True)
class Statistics:
    """Items with words, their mean length, and how many hold each term."""

    n: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[list[str]]) -> Statistics:
        df: dict[str, int] = defaultdict(int)
        for tokens in items:
            for w in set(tokens):
                df[w] += 1
        return cls(len(items), sum(map(len, items)) / max(1, len(items)), dict(df))


class Index:
    """Items of one length class, with normalised BM25 weights from the statistics of all items."""

    def __init__(self, items: list[tuple[int | None, list[str]]], length: int, settings: Settings, stats: Statistics):
        self.settings, self.stride, self.size = settings, length, 2 * length
        self.ids, self.n = [i for i, _ in items], len(items)
        tf = [defaultdict(int) for _ in items]
        for counts, (_, tokens) in zip(tf, items, strict=True):
            for w in tokens:
                counts[w] += 1
        df: dict[str, int] = defaultdict(int)
        for counts in tf:
            for w in counts:
                df[w] += 1
        self.vocabulary = {w: k for k, w in enumerate(df)}
        postings: list[list[tuple[int, float]]] = [[] for _ in df]
        for i, counts in enumerate(tf):
            norm = settings.k1 * (1 - settings.b + settings.b * len(items[i][1]) / stats.mean)
            weight = {w: math.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) * f * (settings.k1 + 1) / (f + norm) for w, f in counts.items()}
            whole = sum(weight.values())
            for w, x in weight.items():
                postings[self.vocabulary[w]].append((i, x / whole))
        self.postings = postings
        self.blocks = -(-self.n // settings.block_items)
        # block maxima of each term as a sparse row; very common terms give a constant instead
        common, self.base = set(), np.zeros(self.blocks)
        for w in sorted(df, key=lambda w: -df[w]):
            if df[w] < 0.2 * self.n or self.n < 20:
                break
            row = self._maxima(self.vocabulary[w])
            more = self.base.copy()
            more[list(row)] += list(row.values())
            if more.max() > settings.slack:
                break
            common.add(self.vocabulary[w])
            self.base = more
        rows = [{} if k in common else self._maxima(k) for k in range(len(postings))]
        self.row_start = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        self.row_block = np.fromiter((b for r in rows for b in r), np.int64)
        self.row_max = np.fromiter((x for r in rows for x in r.values()), np.float64)
        number = self.vocabulary
        cut = [parts(len(t), settings.answer_share) for _, t in items]
        self.parts = [(np.array([number[w] for w in t[:c]], np.int64), np.array([number[w] for w in t[c:]], np.int64)) for c, (_, t) in zip(cut, items, strict=True)]
        self.question = [shingle_set([number[w] for w in t[:c]], settings.shingle) for c, (_, t) in zip(cut, items, strict=True)]
        self.answer = [shingle_set([number[w] for w in t[c:]], settings.shingle) for c, (_, t) in zip(cut, items, strict=True)]

    def _maxima(self, term: int) -> dict[int, float]:
        row: dict[int, float] = {}
        for i, x in self.postings[term]:
            b = i // self.settings.block_items
            row[b] = max(row.get(b, 0.0), x)
        return row

    def wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Items of a block whose score reaches the threshold, and their scores."""
        low, high, floor = block * self.settings.block_items, (block + 1) * self.settings.block_items, self.settings.threshold
        cursors = []  # [item, position, list, bound]
        for t in terms:
            inside = [p for p in self.postings[t] if low <= p[0] < high]
            if inside:
                cursors.append([inside[0][0], 0, inside, max(x for _, x in inside)])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[3]
                if total >= floor - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                at = [c for c in cursors if c[0] == pivot]
                score = math.fsum(c[2][c[1]][1] for c in at)
                if score >= floor - 1e-9:
                    found.append((pivot, score))
                for c in at:
                    c[1] += 1
            for c in cursors:
                while c[1] < len(c[2]) and c[2][c[1]][0] < pivot:
                    c[1] += 1
                c[0] = c[2][c[1]][0] if c[1] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    @staticmethod
    def _found(part: set[tuple], tokens: list[int]) -> float:
        """Share of a part's shingles that are among the tokens' (1 for an empty part)."""
        if not part:
            return 1.0
        return len(part & shingle_set(tokens, len(next(iter(part))))) / len(part)

    def verify(self, item: int, tokens: list[int]) -> tuple[float, float] | None:
        """Overlaps of question and answer with a passage that holds them both, else None."""
        out = []
        for part, exact in zip(self.parts[item], (self.question[item], self.answer[item]), strict=True):
            share = self._found(exact, tokens)
            if share < self.settings.overlap:
                if not self.settings.edits:
                    return None
                d = word_edits(part, np.array(tokens, np.int64))
                if d > spared(len(part), self.settings.overlap):
                    return None
                share = max(share, 1 - d / len(part))
            out.append(share)
        return out[0], out[1]

    def search(self, ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) over the words of a batch of
        documents: ``ids`` are term numbers or -1, ``owner`` the documents in order."""
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lengths = np.diff(np.r_[starts, len(owner)])
        per_doc = np.maximum(1, -(-lengths // self.stride) - 1)
        first = np.cumsum(per_doc) - per_doc
        nth = (np.arange(len(owner)) - np.repeat(starts, lengths)) // self.stride
        base = np.repeat(first, lengths)
        known = ids >= 0
        here = np.minimum(nth, np.repeat(per_doc, lengths) - 1)
        before = np.maximum(nth - 1, 0)
        v = len(self.postings)
        inside = known & (before != here)
        keys = np.unique(np.r_[((base + here) * v + ids)[known], ((base + before) * v + ids)[inside]])
        window, term = keys // v, keys % v
        count = self.row_start[term + 1] - self.row_start[term]
        at = np.repeat(self.row_start[term] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        bound = np.bincount(np.repeat(window * self.blocks, count) + self.row_block[at], self.row_max[at], int(per_doc.sum()) * self.blocks).reshape(-1, self.blocks) + self.base
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        windows, blocks = np.nonzero(bound >= self.settings.threshold - 1e-6)
        if not len(windows):
            return []
        low = np.searchsorted(window, windows)
        high = np.searchsorted(window, windows, "right")
        for w, b, i, j in zip(windows.tolist(), blocks.tolist(), low.tolist(), high.tolist(), strict=True):
            for item, score in self.wand(term[i:j].tolist(), b):
                doc = int(np.searchsorted(first, w, "right")) - 1
                start = int(starts[doc]) + (w - int(first[doc])) * self.stride
                tokens = ids[start : min(start + self.size, int(starts[doc] + lengths[doc]))].tolist()
                found = self.verify(item, tokens)
                if found:
                    key = (int(owner[starts[doc]]), item)
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *found))
        return [(d, i, *x) for (d, i), x in best.items()]


def build(items: list[tuple[int | None, str | None]], settings: Settings = Settings(), stats: Statistics | None = None) -> list[Index]:
    """Indexes of the items by length class; ``stats`` are those of all items (by default, of these)."""
    if stats is None:
        stats = Statistics.of([w for w in (words(t or "") for _, t in items) if w])
    classes: dict[int, list] = defaultdict(list)
    for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        tokens = words(text or "")
        if tokens:
            classes[max(64, 1 << (len(tokens) - 1).bit_length())].append((i, tokens))
    return [Index(found, length, settings, stats) for length, found in sorted(classes.items())]


def scan(texts: list[str | None], indexes: list[Index], batch_chars: int = 1 << 20) -> list[list[dict]]:
    """Finds of each text."""
    out: list[list[dict]] = [[] for _ in texts]
    group: list[int] = []

    def flush() -> None:
        split = [words(texts[k]) for k in group]
        owner = np.repeat(np.array(group, np.int64), [len(w) for w in split])
        if not len(owner):
            return
        for index in indexes:
            get = index.vocabulary.get
            ids = np.fromiter((get(w, -1) for tokens in split for w in tokens), np.int64, len(owner))
            for doc, item, score, q, a in index.search(ids, owner):
                out[doc].append({"item_id": index.ids[item], "score": score, "question_overlap": q, "answer_overlap": a})

    chars = 0
    for k, text in enumerate(texts):
        if text:
            group.append(k)
            chars += len(text)
        if chars > batch_chars:
            flush()
            group, chars = [], 0
    flush()
    return out


def _scanner(files: list[str]):
    """A UDF over the indexes in the files; of several, one is held at a time."""

    def load(uri: str) -> list[Index]:
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            return pickle.loads(f.readall())

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only = load(files[0]) if len(files) == 1 else None
        for batch in batches:
            texts = batch.tolist()
            found = scan(texts, only or [])
            for uri in files if only is None else ():
                for own, more in zip(found, scan(texts, load(uri)), strict=True):
                    own += more
            yield pd.Series(found)

    return find


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(batch: pd.Series) -> pd.Series:
    return pd.Series([words(t or "") for t in batch])


def write_indexes(benchmark: DataFrame, settings: Settings, item_id: str = "item_id", item_text: str = "text") -> list[str]:
    """The indexes of all items as files in the shared folder. The driver holds the items and the
    term counts of one part at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(total / settings.index_bytes))
    items = items.select("i", "t", _words("t").alias("w"), F.pmod(F.xxhash64("i", "t"), F.lit(parts)).alias("part")).where(F.size("w") > 0)
    if parts > 1:
        items = staged(items, "items")
    size = items.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean")).first()
    terms = items.select("part", F.explode(F.array_distinct("w")).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    if parts > 1:
        df = staged(df, "terms")
    root, files = f"{scratch_dir(benchmark.sparkSession)}/lectern/items-{uuid.uuid4().hex}", []
    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    for k in range(parts):
        rows = [(r["i"], r["t"]) for r in items.where(F.col("part") == k).select("i", "t").collect()]
        known = df if parts == 1 else df.join(terms.where(F.col("part") == k), "term", "left_semi")
        stats = Statistics(size["n"], size["mean"] or 0.0, {r["term"]: r["df"] for r in known.collect()})
        with store.open_output_stream(f"{path}/{k}", compression=None) as f:
            f.write(cloudpickle.dumps(build(rows, settings, stats)))
        files.append(f"{root}/{k}")
    return files


def found_items(text: Column, benchmark: DataFrame, settings: Settings = Settings(), item_id: str = "item_id", item_text: str = "text") -> Column:
    """An array column of the benchmark items that ``text`` contains."""
    return _scanner(write_indexes(benchmark, settings, item_id, item_text))(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(found_items(F.col(text), benchmark, settings)).alias("f"))
    return rows.select("doc_id", "f.item_id", "f.score", "f.question_overlap", "f.answer_overlap")
