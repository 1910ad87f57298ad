"""Language-model scores by online logistic context mixing.

A text is its tokens (words in lower case) and one end, coded in order, bit by bit:

1. Does the token follow the two before it as it did in another training document? A flag
   says so, if that context is known at all; if yes, the token costs its share of what followed.
2. If not, it is a leaf of a Huffman tree: the end, a frequent word, a word met before in this
   text (then its share of those), a class of rarer words by count and kind (then its share of the
   class), or an unknown word.
3. An unknown word is spelled: its bytes and a terminator, each a path in a Huffman tree of bytes.

All these bits are predicted by online logistic mixing (``mixing``): counts of the training
tokens by node, and by node and kind of text; hashed orders one to five of the bytes, counted over
all training words; and cells of the text itself, hashed by the node, by the node and the leaf
before it, by the last outcomes. Gated weights mix them and move after every bit, and a table
refines what they say: both learn online, from all texts of a block step by step. The kind of a text
is, at each token, the one that its tokens so far speak for; kinds are the frequent values of a
column of the training documents, and that of a scored document is never read. The sum is the code
length, as log10 probability and as bits per byte of the text.

A training document is scored as if it had not been seen: its own occurrences are left out
of the counts of words, of what follows what, and of spellings. So documents in or out of the
training set are alike, and text that the corpus repeats costs little wherever it occurs. For
other documents the probabilities of all tokens sum to at most one; for training documents the
classes keep the totals of the whole corpus.

How it is spread. Documents are dealt into blocks by hash. A block sends its distinct words,
and hashes of its distinct contexts and continuations, with their training counts, by ranges of
the hash: each goes once however frequent, so no hot word gathers. Ranges add up and reply to the
blocks; what is sent grows with the corpus, and hashes have ``context_bits`` bits more than the
number of contexts needs. The driver gets frequent words (one in ``frequent`` tokens, so at most
that many), sums of classes, and the spelling tables, whose slots are fixed and which are added up in a
tree of fixed fan-in. Then each block codes its documents, with weights that begin alike and learn
from each training document of the block, but from no other, as it is coded.

Words are identified by 64-bit hashes in the exchanges.

Defined cases. Null or empty text: the end token alone, 0 bytes, bits per byte 0. No
training documents: the baseline has N = V = 0, and the model knows nothing. Null id: the fold
of the empty text. Repeated rows are scored alike (and are each other's other documents); rows
equal in id and text share a block. Empty table: empty result. Long texts and long words are taken
whole, in lanes of ``lane_bits`` bits (or ``lane_flags`` flags) that each begin with empty cells; a
task holds a block whole, at a few hundred bytes a token while it counts and some ten bytes a bit
while it codes. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import block_count, fold, parts_for, plan_bytes, staged, utf8
from lectern.llm.mixing import MATCH_GATES, ORDERS, P1, P3, SLOTS, SPELL_GATES, Mixer, Spelling, Tree, encode, looked_up, match_stream, mix64, run


@dataclass(frozen=True)
class Settings:
    block_bytes: int = 2 << 20
    range_bytes: int = 8 << 20
    #: A frequent word is one in so many training tokens, and has been met sixteen times.
    frequent: int = 8192
    context_bits: int = 10
    pages: int = 16
    fan_in: int = 32
    lane_bits: int = 1024
    lane_flags: int = 256
    rate: float = 0.16
    #: Kinds at most, the last of which stands for all other values.
    kinds: int = 5


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


ROWS = pa.schema([("kind", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("payload", pa.binary())])
ROWS_SQL = "kind bigint, a bigint, b bigint, payload binary"
WORDS, FOLLOWS, REPLY, FOUND, TOTALS, MASS, CLASS, FREQUENT, LETTER = range(9)
#: Numbers of the leaves that are not words: the classes follow, then the frequent words.
END, ESCAPE, AGAIN, CLASSES = range(4)
MOST_CLASSES = 40


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], [], []), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], schema=ROWS)


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Words are summed as polynomials of an odd number, modulo two to the 64th.
BASE = 0xD1342543DE82EF95
WINDOW = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def split(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of bytes that end in a space."""
    starts, ends, keys, at = [], [], [], 0
    powers = _powers(min(len(data), WINDOW + 4096) + 1)
    while at < len(data):
        stop = min((k + 1 for k in (data.find(c, at + WINDOW) for c in (b" ", b"\n")) if k >= 0), default=len(data))
        part = np.frombuffer(data, np.uint8, stop - at, at)
        if len(part) >= len(powers[0]):
            powers = _powers(len(part) + 1)
        bare = _SPACES[part]
        turn = np.flatnonzero(bare[1:] != bare[:-1]) + 1
        turn = np.r_[0, turn] if not bare[0] else turn
        first, last = turn[::2], turn[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * powers[0][: len(part)], out=total[1:])
        keys.append(mix64((total[last] - total[first]) * powers[1][first]))
        starts.append(first + at)
        ends.append(last + at)
        at = stop
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(starts, np.int64), join(ends, np.int64), join(keys, np.uint64)


def word_key(word: bytes) -> int:
    return int(split(word + b" ")[2][0])


class Text:
    """The tokens of a block's documents, as numbers of its distinct words in the order of their
    hashes, and one end each."""

    def __init__(self, bodies: list[bytes]):
        self.data = b" ".join(bodies).lower() + b" "
        first, last, keys = split(self.data)
        offsets = np.cumsum([0] + [len(b) + 1 for b in bodies])
        doc = np.searchsorted(offsets, first, "right") - 1
        order = np.argsort(keys)
        sorted_ = keys[order]
        fresh = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(keys) else np.zeros(0, bool)
        self.keys = sorted_[fresh]
        self.first, self.last = first[order[fresh]], last[order[fresh]]
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(fresh) - 1
        self.n = np.bincount(doc, minlength=len(bodies)).astype(np.int64)[: len(bodies)] + 1
        self.stop = np.cumsum(self.n)
        self.start = self.stop - self.n
        self.doc = np.repeat(np.arange(len(bodies)), self.n)
        self.token = np.full(int(self.n.sum()), len(self.keys), np.int64)
        inner = np.ones(len(self.token), bool)
        inner[self.stop - 1] = False
        self.token[inner] = number

    def words(self, numbers: np.ndarray) -> list[bytes]:
        return [self.data[i:j] for i, j in zip(self.first[numbers].tolist(), self.last[numbers].tolist(), strict=True)]

    def follows(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, of ``bits`` bits, of the two tokens before each token, and of all three."""
        h = np.r_[self.keys, np.uint64(1)][self.token]
        before = [np.zeros(len(h), np.uint64) for _ in range(2)]
        for k, b in enumerate(before, 1):
            b[k:] = h[:-k]
            for j in range(min(k, int(self.n.max(initial=0)))):
                b[(self.start + j)[self.n > j]] = 2
        context = mix64(before[1] * P3 + before[0])
        drop = np.uint64(64 - bits)
        return mix64(context ^ P1) >> drop, mix64(context + h * P3) >> drop


def _runs_stage(bits: int, ranges: int, kinds: int):
    """Rows (WORDS, range, block, ...) and (FOLLOWS, ranges + range, block, ...) of a block."""

    def run_(docs: pa.Table) -> pa.Table:
        block, kind = docs.column("block")[0].as_py(), np.array(docs.column("kind").to_pylist(), np.int64)
        text, out = Text([b.as_py() for b in docs.column("body")]), []
        keys, own = text.keys, kind[text.doc]
        n = np.zeros((len(keys), kinds), "<u4")
        for k in range(kinds):
            n[:, k] = np.bincount(text.token[own == k], minlength=len(keys) + 1)[:-1]
        for r, i, j in _cuts(keys, ranges, 64):
            out.append((WORDS, r, block, _pack(np.array([j - i], "<u4").tobytes(), keys[i:j].tobytes(), n[i:j].T.tobytes(), b" ".join(text.words(np.arange(i, j))))))
        # the lowest bit of a key says whether it is of a training document
        packed = np.sort(np.concatenate(text.follows(bits)) * np.uint64(2) + np.tile(own >= 0, 2).astype(np.uint64))
        keys, count = _distinct(packed >> np.uint64(1), (packed & np.uint64(1)).astype(np.int64))
        for r, i, j in _cuts(keys, ranges, bits):
            out.append((FOLLOWS, ranges + r, block, _pack(np.array([j - i], "<u4").tobytes(), _bytewise(np.diff(keys[i:j], prepend=np.uint64(0))), _bytewise(count[i:j]))))
        return _rows(out)

    return run_


def _distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed weights."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weight, first) if len(first) else weight


def _cuts(keys: np.ndarray, ranges: int, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys dealt by their high bits."""
    if not len(keys):
        return []
    r = ((keys >> np.uint64(max(0, bits - 32))) * np.uint64(ranges) >> np.uint64(min(32, bits))).astype(np.int64)
    ends = np.r_[np.flatnonzero(np.r_[True, r[1:] != r[:-1]]), len(r)]
    return [(int(r[i]), i, j) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _bytewise(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, which compresses well; the first byte says how
    many bytes a number has."""
    width = 1 if not len(x) or (top := int(x.max())) < 1 << 8 else 4 if top < 1 << 32 else 8
    return bytes([width]) + np.ascontiguousarray(x.astype(f"<u{width}").view("u1").reshape(-1, width).T).tobytes()


def _from_bytewise(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """The numbers, and where they end."""
    width = data[at]
    raw = np.frombuffer(data, "u1", width * n, at + 1).reshape(width, n)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").ravel().astype(np.uint64), at + 1 + width * n


def _range_stage(ranges: int, kinds: int):
    """Rows (REPLY, range, block, counts and kinds in the order of the run), and of words (FOUND,
    range, 0, training words), (TOTALS, tokens, words), (LETTER, byte, occurrences in them), (MASS, code, tokens), (CLASS, code, tokens)
    and (FREQUENT, count, 0, word and counts)."""

    def words(group: pa.Table) -> pa.Table:
        number, keys, counts, names = group.column("a")[0].as_py(), [], [], []
        for blob in group.column("payload"):
            data = _unpack(blob.as_py())
            n = int(np.frombuffer(data, "<u4", 1)[0])
            keys.append(np.frombuffer(data, "<u8", n, 4))
            counts.append(np.frombuffer(data, "<u4", kinds * n, 4 + 8 * n).reshape(kinds, n))
            names.append(data[4 + (8 + 4 * kinds) * n :].split(b" "))
        lengths = [len(k) for k in keys]
        _, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        by_kind = np.stack([np.bincount(where, np.concatenate([c[k] for c in counts]), len(first)) for k in range(kinds)], axis=1).astype(np.int64)
        flat = [w for run_ in names for w in run_]
        flat = [flat[i] for i in first.tolist()]
        total, main = by_kind.sum(1), by_kind.argmax(1).astype("u1")
        out, at = [(TOTALS, int(total.sum()), int((total > 0).sum()), b"")], 0
        for block, n in zip(group.column("b").to_pylist(), lengths, strict=True):
            own = where[at : at + n]
            out.append((REPLY, number, block, _pack(np.array([n], "<u4").tobytes(), _bytewise(total[own]), main[own].tobytes())))
            at += n
        known = np.flatnonzero(total)
        out.append((FOUND, number, 0, _pack(np.array([len(known)], "<u4").tobytes(), main[known].tobytes(), b" ".join([flat[k] for k in known.tolist()]))))
        out += [(LETTER, k, n, b"") for k, n in enumerate(np.bincount(np.frombuffer(b" ".join([flat[k] for k in known.tolist()] + [b""]), "u1")).tolist()) if n]
        size, rest = _octave(total), _octave(total - 1)  # a token of a training document finds one occurrence less
        for k in range(kinds):
            for code, n in _sums((size[known] * (MOST_CLASSES + 1) + rest[known] + 1) * kinds + main[known], by_kind[known, k]):
                out.append((MASS, code * kinds + k, n, b""))
        out += [(CLASS, code, n, b"") for code, n in _sums(size[known] * kinds + main[known], total[known])]
        out += [(FREQUENT, int(total[k]), 0, pickle.dumps((flat[k], by_kind[k].tolist()))) for k in np.flatnonzero(total >= 16).tolist()]
        return _rows(out)

    def follows(group: pa.Table) -> pa.Table:
        number, keys, counts = group.column("a")[0].as_py(), [], []
        for blob in group.column("payload"):
            data = _unpack(blob.as_py())
            n = int(np.frombuffer(data, "<u4", 1)[0])
            found, at = _from_bytewise(data, n, 4)
            keys.append(np.cumsum(found))
            counts.append(_from_bytewise(data, n, at)[0].astype(np.int64))
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        total, out, at = np.bincount(where, np.concatenate(counts)).astype(np.int64), [], 0
        for block, k in zip(group.column("b").to_pylist(), keys, strict=True):
            out.append((REPLY, number, block, _pack(np.array([len(k)], "<u4").tobytes(), _bytewise(total[where[at : at + len(k)]]))))
            at += len(k)
        return _rows(out)

    return lambda group: words(group) if group.column("a")[0].as_py() < ranges else follows(group)


def _octave(n: np.ndarray) -> np.ndarray:
    """Whole log2, -1 for nothing."""
    return np.where(n > 0, np.minimum(MOST_CLASSES - 1, np.log2(np.maximum(n, 1))), -1).astype(np.int64)


def _sums(code: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    found, where = np.unique(code, return_inverse=True)
    return [(int(c), int(s)) for c, s in zip(found, np.bincount(where, n, len(found)), strict=True) if s]


@dataclass
class Vocabulary:
    """What the driver knows of the training tokens: totals, and the leaves with their masses."""

    n_total: int
    distinct: int
    ends: int
    octaves: int
    mass: np.ndarray  # [leaves, kinds], tokens that reach the leaf
    classes: np.ndarray  # [leaves], occurrences of a class's words
    frequent: dict[bytes, int]
    speaks: np.ndarray = field(init=False)  # [leaves, kinds], log-likelihoods
    keys: np.ndarray = field(init=False)  # hashes of the frequent words
    leaves: np.ndarray = field(init=False)  # and their leaves

    def __post_init__(self) -> None:
        self.keys = np.fromiter(map(word_key, self.frequent), np.uint64, len(self.frequent))
        self.leaves = np.fromiter(self.frequent.values(), np.int64, len(self.frequent))
        share = (self.mass.sum(1, keepdims=True) + 0.5) / (self.mass.sum() + 0.5 * len(self.mass))
        self.speaks = np.log((self.mass + 2 * share) / (self.mass.sum(0) + 2)).astype(np.float32)
        self.speaks[AGAIN] = 0


def vocabulary(n_words: int, v: int, ends: list[int], mass: list[tuple[int, int]], classes: list[tuple[int, int]], frequent: list[tuple[int, bytes, list[int]]], octaves: int) -> Vocabulary:
    """From the summed rows; words of ``2 ** octaves`` occurrences or more are the frequent ones."""
    kinds = len(ends)
    first = CLASSES + octaves * kinds
    frequent = sorted(frequent, key=lambda x: (-x[0], x[1]))
    m, c = np.zeros((first + len(frequent), kinds)), np.zeros(first + len(frequent))
    m[END] = ends
    for code, n in mass:
        code, k = divmod(code, kinds)
        code, main = divmod(code, kinds)
        size, rest = divmod(code, MOST_CLASSES + 1)
        if size < octaves:
            m[ESCAPE if rest == 0 else CLASSES + (rest - 1) * kinds + main, k] += n
    for code, n in classes:
        size, main = divmod(code, kinds)
        if size < octaves:
            c[CLASSES + size * kinds + main] += n
    m[AGAIN] = m[ESCAPE:first].sum(0) / 4  # how often words return within a text is for the mixing to learn
    for k, (_, _, n) in enumerate(frequent):
        m[first + k] = n
    return Vocabulary(n_words + sum(ends), v + (sum(ends) > 0), sum(ends), octaves, m, c, {w: first + k for k, (_, w, _) in enumerate(frequent)})


def prepare(text: Text, train: np.ndarray, count: np.ndarray, main: np.ndarray, follows: np.ndarray, bits: int, know: Vocabulary) -> dict:
    """What is left to code of a block's documents: ``count`` and ``main`` are the training count
    and the kind of each distinct word, ``follows`` the training counts of the distinct hashes of
    contexts and continuations, in order."""
    n_words, kinds = len(text.keys), know.mass.shape[1]
    own_train = train[text.doc]
    by_word = np.r_[count, know.ends]
    c = by_word[text.token]
    base = np.log10((by_word + 0.5) / (know.n_total + 0.5 * (know.distinct + 1)))[text.token]
    # occurrences of the token in its document, before and in all
    place_bits = max(1, int(len(c)).bit_length())
    packed = np.sort((text.doc * (n_words + 1) + text.token).astype(np.uint64) << np.uint64(place_bits) | np.arange(len(c), dtype=np.uint64))
    order, packed = (packed & np.uint64((1 << place_bits) - 1)).astype(np.int64), packed >> np.uint64(place_bits)
    head = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(c) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(c)])
    before, inside = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
    before[order] = np.arange(len(c)) - np.repeat(head, size)
    inside[order] = np.repeat(size, size)
    rest = c - inside * own_train
    leaf = np.full(n_words + 1, -1)
    leaf[-1] = END
    if n_words:
        spot = np.minimum(np.searchsorted(text.keys, know.keys), n_words - 1)
        here = text.keys[spot] == know.keys
        leaf[spot[here]] = know.leaves[here]
    leaf = leaf[text.token]
    rare = leaf < 0
    octave = np.minimum(know.octaves - 1, _octave(rest))
    known = CLASSES + octave * kinds + np.r_[main, 0][text.token]
    plain = np.where(rare, np.where(rest > 0, known, ESCAPE), leaf)
    again = rare & (before > 0)
    so_far = np.cumsum(rare) - rare
    so_far = so_far - so_far[text.start][text.doc]
    share = np.zeros(len(c))
    share[again] = np.log2(before[again] / so_far[again])
    of_class = rare & ~again & (rest > 0)
    share[of_class] = np.log2(np.minimum(1, rest[of_class] / np.maximum(1, know.classes[plain[of_class]])))
    leaf = np.where(again, AGAIN, plain)
    # the kind that the tokens before speak for
    said = know.speaks[plain]
    said[again] = 0
    upto = np.cumsum(said, axis=0, dtype=np.float64)
    upto -= said
    upto -= (upto[text.start] - np.log(know.mass.sum(0) + 1))[text.doc]
    kind = upto.argmax(1).astype("u1")
    # what the two tokens before were followed by elsewhere
    here = np.concatenate(text.follows(bits))
    docs = np.tile(text.doc.astype(np.uint64), 2)
    doc_bits = max(1, int(len(text.n)).bit_length())
    if bits + doc_bits <= 64:
        packed = (here << np.uint64(doc_bits)) | docs
        order = np.argsort(packed)
        sorted_ = packed[order]
        new, fresh = sorted_[1:] >> np.uint64(doc_bits) != sorted_[:-1] >> np.uint64(doc_bits), sorted_[1:] != sorted_[:-1]
    else:
        order = np.lexsort((docs, here))
        new = here[order][1:] != here[order][:-1]
        fresh = new | (docs[order][1:] != docs[order][:-1])
    total, own = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    total[order] = follows[np.cumsum(np.r_[0, new])]
    group = np.cumsum(np.r_[0, fresh])
    own[order] = np.bincount(group)[group]
    left = np.maximum(0, total - own * np.tile(own_train, 2))
    around, both = left[: len(c)], left[len(c) :]
    hit = (both > 0) & (around > 0)
    coded = around > 0
    past = np.zeros(len(c), np.int64)
    for k in (1, 2, 3):
        last = np.zeros(len(c), np.int64)
        last[k:] = hit[:-k]
        last[np.arange(len(c)) - text.start[text.doc] < k] = 0
        past += last << (k - 1)
    state = 2 * (8 * np.searchsorted([2, 3, 5, 17], around, "right") + past) + hit
    share[hit] = np.log2(np.minimum(1, both[hit] / around[hit]))
    in_tree = ~hit
    spelled = in_tree & (leaf == ESCAPE)
    per = lambda x: np.add.reduceat(x.astype(np.int64), text.start) if len(text.start) else np.zeros(0, np.int64)
    total_of = lambda x: np.add.reduceat(x, text.start) if len(text.start) else np.zeros(0)
    return {
        "train": train, "n_tokens": text.n, "n_known": per(c > 0), "base": total_of(base), "share": total_of(share),
        "state": state[coded].astype("u1"), "n_state": per(coded),
        "leaf": leaf[in_tree], "kind": kind[in_tree], "n_leaf": per(in_tree),
        "words": text.words(text.token[spelled]), "word_kind": kind[spelled], "n_words": per(spelled),
    }


@dataclass
class Model:
    know: Vocabulary
    tree: Tree
    letters: Tree
    says: list[np.ndarray]
    #: Words spelled at a time.
    spell_bytes: int = 1 << 20

    @classmethod
    def new(cls, know: Vocabulary, letters: Tree, tables: list[np.ndarray]) -> Model:
        """``tables`` are coded counts, two bytes a slot."""
        return cls(know, Tree(know.mass), letters, looked_up(tables))

    def _streams(self, p: dict) -> Iterator[tuple[str, Callable]]:
        """The streams of a block, the spelling of its words in parts of bounded size."""
        yield "match", lambda: match_stream(p["state"], p["n_state"])
        yield "tree", lambda: self.tree.stream(p["leaf"], p["kind"], p["n_leaf"])
        words, text = p["words"], np.repeat(np.arange(len(p["train"])), p["n_words"])
        size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        part = size * (1 + int(size[-1]) // self.spell_bytes) // (int(size[-1]) + 1) if len(size) else size
        ends = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield "spell", lambda i=i, j=j: Spelling(words[i:j], p["word_kind"][i:j], self.letters).stream(self.says, p["train"][text[i:j]], text[i:j], len(p["train"]))

    def bits(self, p: dict, settings: Settings) -> np.ndarray:
        """What each prepared document costs. The mixers learn from the training documents on the way."""
        mixers = {"match": Mixer.new(0, MATCH_GATES), "tree": Mixer.new(2, Tree.GATES), "spell": Mixer.new(len(ORDERS), SPELL_GATES, 1.3)}
        cost = -p["share"]
        for name, stream in self._streams(p):
            cost = cost + run(mixers[name], stream(), p["train"], settings.rate, settings.lane_flags if name == "match" else settings.lane_bits)
        return cost


def _pack_page(used: np.ndarray, n: np.ndarray) -> bytes:
    return _pack(np.array([len(used)], "<u4").tobytes(), _bytewise(np.diff(used, prepend=0)), _bytewise(n))


def _unpack_page(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in use, and what they hold."""
    data = _unpack(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    used, at = _from_bytewise(data, n, 4)
    return np.cumsum(used).astype(np.int64), _from_bytewise(data, n, at)[0].astype(np.int64)


def _table_stage(letters: Tree, settings: Settings):
    """Rows (order, page, task, counts of slots) of the training words of a task's ranges."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << s, np.uint32) for s in SLOTS]
        for batch in batches:
            for blob in batch.column("payload"):
                data = _unpack(blob.as_py())
                n = int(np.frombuffer(data, "<u4", 1)[0])
                words, main = data[4 + n :].split(b" ") if n else [], np.frombuffer(data, "u1", n, 4)
                for i in range(0, n, 20_000):
                    Spelling(words[i : i + 20_000], main[i : i + 20_000], letters).count(tables)
        for k, table in enumerate(tables):
            for page, part in enumerate(table.reshape(settings.pages, -1)):
                used = np.flatnonzero(part)
                if len(used):
                    yield from _rows([(k, page, TaskContext.get().partitionId(), _pack_page(used, part[used]))]).to_batches()

    return run_


def _add_pages(settings: Settings):
    def run_(group: pa.Table) -> pa.Table:
        k, page, at = (group.column(c)[0].as_py() for c in ("kind", "a", "b"))
        total = np.zeros((2 << SLOTS[k]) // settings.pages, np.int64)
        for blob in group.column("payload"):
            used, n = _unpack_page(blob.as_py())
            total[used] += n
        used = np.flatnonzero(total)
        return _rows([(k, page, at, _pack_page(used, total[used]))])

    return run_


def _tree_sum(rows: DataFrame, numbers: int, add, fan_in: int) -> DataFrame:
    """Rows (kind, a, b, payload), b below ``numbers``, summed over b in rounds: no task holds more than
    ``fan_in`` payloads of one key."""
    while numbers > 1:
        numbers = -(-numbers // fan_in)
        rows = rows.withColumn("b", F.floor(F.col("b") / fan_in)).groupBy("kind", "a", "b").applyInArrow(add, ROWS_SQL)
    return rows


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())])


def _score_stage(shared, bits: int, ranges: int, settings: Settings):
    held: list[Model] = []  # by the task, for all its blocks

    def run_(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(docs):
            return RESULT_SCHEMA.empty_table()
        if not held:
            held.append(pickle.loads(shared.value))
        model = held[0]
        ids, kind, bodies = docs.column("doc_id").to_pylist(), docs.column("kind").to_pylist(), [b.as_py() for b in docs.column("body")]
        # an order that depends on the documents alone, as the weights learn from one after the other
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, bodies[k]))
        text, train = Text([bodies[k] for k in order]), np.array([kind[k] >= 0 for k in order])
        counts, main, follows = [np.zeros(0, np.int64)], [np.zeros(0, "u1")], [np.zeros(0, np.int64)]
        for a, blob in sorted(zip(replies.column("a").to_pylist(), replies.column("payload").to_pylist(), strict=True)):
            data = _unpack(blob)
            n = int(np.frombuffer(data, "<u4", 1)[0])
            found, at = _from_bytewise(data, n, 4)
            (counts if a < ranges else follows).append(found.astype(np.int64))
            if a < ranges:
                main.append(np.frombuffer(data, "u1", n, at))
        size = np.array([len(bodies[k]) for k in order], np.int64)
        p = prepare(text, train, np.concatenate(counts), np.concatenate(main).astype(np.int64), np.concatenate(follows), bits, model.know)
        del text, bodies, counts, main, follows
        cost = model.bits(p, settings)
        columns = [[ids[k] for k in order], ~train, p["n_tokens"], p["n_known"], np.full(len(size), model.know.n_total), p["base"], -cost * math.log10(2), size, np.where(size > 0, cost / np.maximum(size, 1), 0.0)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, RESULT_SCHEMA.types, strict=True)], schema=RESULT_SCHEMA)

    return run_


def score(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", theme: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``theme`` names the column whose frequent values are the kinds; by default there is one."""
    spark = docs.sparkSession
    size, parts = plan_bytes(docs), parts_for(docs)
    blocks, ranges = block_count(docs, settings.block_bytes), block_count(docs, settings.range_bytes)
    bits = min(60, settings.context_bits + max(20, math.ceil(math.log2(max(2, size)))))
    id_, body = F.col(doc_id), utf8(F.col(text))
    train = fold(id_) != 1
    values = [] if theme is None else [r[0] for r in docs.where(train & F.col(theme).isNotNull()).groupBy(theme).count().orderBy(F.desc("count"), theme).limit(settings.kinds - 1).collect()]
    kinds = len(values) + 1
    kind = F.lit(kinds - 1)
    for k, value in enumerate(values):
        kind = F.when(F.col(theme) == value, k).otherwise(kind)
    rows = docs.select(id_.cast("long").alias("doc_id"), body.alias("body"), F.when(train, kind).otherwise(-1).alias("kind"), F.pmod(F.xxhash64(id_, body), F.lit(blocks)).alias("block"))
    ends = Counter({r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()})
    runs = rows.select("body", "kind", "block").groupBy("block").applyInArrow(_runs_stage(bits, ranges, kinds), ROWS_SQL)
    merged = staged(runs.groupBy("a").applyInArrow(_range_stage(ranges, kinds), ROWS_SQL), "ranges", parts)
    of = lambda name: merged.where(F.col("kind") == name)
    totals = of(TOTALS).agg(F.sum("a").alias("n"), F.sum("b").alias("v")).first()
    sums = lambda name: [(r["a"], r["n"]) for r in of(name).groupBy("a").agg(F.sum("b").alias("n")).collect()]
    octaves = max(4, math.ceil(math.log2(max(1, (totals["n"] or 0) / settings.frequent))))
    frequent = [(r["a"], *pickle.loads(bytes(r["payload"]))) for r in of(FREQUENT).where(F.col("a") >= 1 << octaves).select("a", "payload").collect()]
    know = vocabulary(totals["n"] or 0, totals["v"] or 0, [ends[k] for k in range(kinds)], sums(MASS), sums(CLASS), frequent, octaves)
    mass = np.zeros((256, 1))
    for byte, n in sums(LETTER):
        mass[byte] = n
    letters = Tree(mass)
    tables = [np.zeros(2 << s, np.uint8) for s in SLOTS]
    found = of(FOUND)
    pages = _tree_sum(found.mapInArrow(_table_stage(letters, settings), ROWS_SQL), found.rdd.getNumPartitions(), _add_pages(settings), settings.fan_in)
    for r in pages.toLocalIterator():
        used, n = _unpack_page(bytes(r["payload"]))
        tables[r["kind"]].reshape(settings.pages, -1)[r["a"]][used] = encode(n)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(Model.new(know, letters, tables)))
    return rows.groupBy("block").cogroup(of(REPLY).groupBy("b")).applyInArrow(_score_stage(shared, bits, ranges, settings), RESULT)
