"""Online logistic mixing of bit predictors, for many texts side by side.

A stream of bits is cut into lanes, which are coded in step. For each bit the predictors speak
in the logistic domain: fixed ones that the caller looks up, and two whose cells, addressed by
hashed contexts, belong to the lane and learn from its own bits. A weight set, chosen by the
caller's gate and by how much those two cells have seen, mixes them, and a table refines what
they say (a bit's final probability is the mean of the mixed and the refined one). Then the cells
move on, and the weights and the table take the mean gradient step of the lanes that are learnt
from; the others are only coded. A bit is always coded before anything learns from it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: A cell is a byte: sixteen times the zeros it has seen, plus the ones; an opposite bit halves what is above two.
ZEROS, ONES = np.divmod(np.arange(256), 16)
CELL_STRETCH = np.log((ONES + 0.4) / (ZEROS + 0.4)).astype(np.float32)
#: Cells of a lane for each of its two contexts; a hash of ten bits says which.
CELLS = 1024
#: Entries of the refining table: half steps of the logistic domain, which is cut off at 14.
STEPS = 57
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _after(bit: int) -> np.ndarray:
    n = [ZEROS.copy(), ONES.copy()]
    n[bit] = np.minimum(15, n[bit] + 1)
    n[1 - bit] = np.where(n[1 - bit] > 2, n[1 - bit] // 2 + 1, n[1 - bit])
    return (16 * n[0] + n[1]).astype(np.uint8)


CELL_NEXT = np.concatenate([_after(0), _after(1)])
#: Weight sets of a gate: three steps of what the first cell has seen, two of the second.
SEEN = np.searchsorted([1, 3], ZEROS + ONES, "right") * 2, np.searchsorted([1], ZEROS + ONES, "right")
SETS = 6


def mix64(x: np.ndarray) -> np.ndarray:
    x = x * P1
    x = (x ^ (x >> np.uint64(29))) * P2
    return x ^ (x >> np.uint64(32))


@dataclass
class Mixer:
    """Weights [gates * SETS, fixed inputs + 3] and the refining table [STEPS]."""

    weights: np.ndarray
    refine: np.ndarray

    @classmethod
    def new(cls, fixed: int, gates: int, trust: float = 1.0) -> Mixer:
        weights = np.zeros((gates * SETS, fixed + 3), np.float32)
        weights[:, :fixed] = trust / max(1, fixed)
        weights[:, fixed : fixed + 2] = 0.15 if fixed else 0.5
        steps = 1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))
        return cls(weights, steps)

    def learn(self, counts: np.ndarray, chosen: np.ndarray, error: np.ndarray, x: np.ndarray, step: np.ndarray, wrong: np.ndarray, rate: float) -> None:
        """Mean steps of the sets and table entries that were met by the lanes that count (1, else 0),
        small ones if met by few."""
        sets, width = self.weights.shape
        pull = x * (error * counts)[:, None]
        change = np.empty((sets, width))
        for k in range(width):
            change[:, k] = np.bincount(chosen, pull[:, k], sets)
        met = np.bincount(chosen, counts, sets)
        self.weights += (change * (rate * np.minimum(1 / 16, 1 / np.maximum(1, met)))[:, None]).astype(np.float32)
        met = np.bincount(step, counts, STEPS)
        self.refine += np.bincount(step, wrong * counts, STEPS) * (0.05 * np.minimum(1 / 16, 1 / np.maximum(1, met)))


@dataclass
class Stream:
    """Bits of consecutive texts. ``feed`` gives, for places in the stream, the bits, the inputs
    (with three columns to spare), the two cells (the second past all of the first), and the gates
    (times ``SETS``). What it looks up lies in one number a bit, as lanes read far apart."""

    per_text: np.ndarray
    feed: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def lanes_of(per_text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of the lanes: each text's bits in runs of at most ``most``."""
    count = -(-per_text // most)
    text = np.repeat(np.arange(len(per_text)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(per_text) - per_text)[text] + nth * most
    return start, np.minimum(most, per_text[text] - nth * most), text


def run(mixer: Mixer, stream: Stream, learn: np.ndarray, rate: float, most: int, batch: int = 1 << 22) -> np.ndarray:
    """Bits that each text costs, in lanes of at most ``most`` bits, the longest first, some
    ``batch`` bits at a time; the mixer learns from the texts of ``learn``."""
    start, length, text = lanes_of(stream.per_text, most)
    cost = np.zeros(len(stream.per_text))
    order = np.argsort(-length, kind="stable")
    groups = np.cumsum(length[order]) // batch
    for g in np.unique(groups):
        pick = order[groups == g]
        np.add.at(cost, text[pick], _run_lanes(mixer, stream, start[pick], length[pick], learn[text[pick]].astype(np.float32), rate))
    return cost


def _run_lanes(mixer: Mixer, stream: Stream, start: np.ndarray, length: np.ndarray, counts: np.ndarray, rate: float) -> np.ndarray:
    """Bits that each lane costs; lanes come by length, the longest first."""
    n = len(start)
    live = np.searchsorted(-length, -np.arange(int(length[0])), "left")
    cells, base = np.zeros(2 * n * CELLS, np.uint8), np.arange(n) * (2 * CELLS)
    cost, likely = np.zeros(n), np.ones(n)
    for t, a in enumerate(live.tolist()):
        bit, x, one, two, chosen = stream.feed(start[:a] + t)
        at1 = base[:a] + one
        at2 = base[:a] + two
        cell1, cell2 = cells.take(at1), cells.take(at2)
        x[:, -3] = CELL_STRETCH.take(cell1)
        x[:, -2] = CELL_STRETCH.take(cell2)
        x[:, -1] = 0.3
        chosen += SEEN[0].take(cell1)
        chosen += SEEN[1].take(cell2)
        z = np.einsum("ij,ij->i", mixer.weights.take(chosen, 0), x)
        np.clip(z, -14, 14, out=z)
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        z *= 2
        z += STEPS / 2
        step = z.astype(np.int64)
        error, wrong = bit - p, bit - mixer.refine.take(step)
        # the final probability of the bit that came
        likely[:a] *= 1 - np.abs(error + wrong) / 2
        turn = bit << 8
        cells[at1] = CELL_NEXT.take(cell1 + turn)
        cells[at2] = CELL_NEXT.take(cell2 + turn)
        mixer.learn(counts[:a], chosen, error, x, step, wrong, rate / (1 + t / 400))
        if t % 32 == 31:
            cost -= np.log2(likely)
            likely[:] = 1
    return cost - np.log2(likely)


class Tree:
    """A Huffman tree over leaves, with the mass of each leaf by kind of text: the paths, and at
    each node what the masses predict, over all kinds (row 0) and for each."""

    def __init__(self, mass: np.ndarray):
        leaves = len(mass)
        smooth = mass.sum(1) + 0.5
        heap = [(float(m), k) for k, m in enumerate(smooth)]
        heapq.heapify(heap)
        parent, bit = np.zeros(2 * leaves - 1, np.int64), np.zeros(2 * leaves - 1, np.uint8)
        total = np.zeros((2 * leaves - 1, mass.shape[1]))
        total[:leaves] = mass
        for node in range(leaves, 2 * leaves - 1):
            (m0, a), (m1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b], bit[b] = node, node, 1
            total[node] = total[a] + total[b]
            heapq.heappush(heap, (m0 + m1, node))
        root = 2 * leaves - 2
        paths = []
        for leaf in range(leaves):
            path, k = [], leaf
            while k != root:
                path.append((root - parent[k], bit[k]))  # the root is node 0, heavy nodes come first
                k = parent[k]
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.node = np.array([x for p in paths for x, _ in p], np.int32)
        self.bit = np.array([y for p in paths for _, y in p], np.uint8)
        self.nodes = leaves - 1
        ones, whole = np.zeros((self.nodes, mass.shape[1])), total[root - np.arange(self.nodes)]
        side = np.flatnonzero(bit)
        ones[root - parent[side]] = total[side]
        share = (ones.sum(1) + 0.5) / (whole.sum(1) + 1)
        by_kind = (ones + 4 * share[:, None]) / (whole + 4)
        p = np.concatenate([share[None], by_kind.T])
        self.stretch = np.clip(np.log(p / (1 - p)), -10, 10).astype(np.float32)

    GATES = 4

    def places(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each leaf's path, and the places of all of them in the list of all paths."""
        length = self.length[leaf]
        ends = np.cumsum(length)
        return length, np.repeat(self.start[leaf] - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)

    def stream(self, leaf: np.ndarray, kind: np.ndarray, per_text: np.ndarray) -> Stream:
        """The bits of leaves, given in order with the kind that each text seemed to be of before.
        The lane's cells belong to the node, and to the node after the leaf before."""
        # bit, gate, second cell, first cell, and from 32 the place in the table of what is fixed
        depth = np.arange(len(self.node)) - np.repeat(self.start, self.length)
        gate = SETS * np.searchsorted([2, 4, 7], depth, "right")
        node = self.node.astype(np.int64)
        of_path = self.bit + (gate << 1) + (_ten_bits(node) << 9) + ((node & (CELLS - 1)) << 20) + (node << 32)
        before = np.r_[0, leaf[:-1]] + 1
        before[(np.cumsum(per_text) - per_text)[per_text > 0]] = 0
        length, place = self.places(leaf)
        of_leaf = (_ten_bits(before + self.nodes) << 9) + (kind.astype(np.int64) << 48)
        packed = of_path.take(place)
        packed ^= np.repeat(of_leaf, length)
        fixed = np.stack([np.tile(self.stretch[0], len(self.stretch) - 1), self.stretch[1:].ravel()], axis=1)
        ends = np.r_[0, np.cumsum(length)][np.cumsum(per_text)]

        def feed(at: np.ndarray):
            u = packed.take(at)
            x = np.empty((len(at), 5), np.float32)
            x[:, :2] = fixed.take((u >> 48) * self.nodes + (u >> 32 & 65535), 0)
            return u & 1, x, u >> 20 & (CELLS - 1), (u >> 9 & (CELLS - 1)) + CELLS, u >> 1 & 255

        return Stream(np.diff(ends, prepend=0), feed)


def _ten_bits(x: np.ndarray) -> np.ndarray:
    """A hash that says which of a lane's cells."""
    return (mix64(x.astype(np.uint64)) >> np.uint64(54)).astype(np.int64)


#: Spelling: orders of the byte contexts, of which the first two know the kind; log2 of their slots.
ORDERS = (1, 2, 3, 5)
SLOTS = (16, 19, 20, 22)
SPELL_GATES = 12


class Spelling:
    """Bytes of words, laid end to end with terminators, each a path in a tree of letters, and
    the slots and cells of the paths' nodes after the bytes before."""

    def __init__(self, words: list[bytes], kind: np.ndarray, letters: Tree):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        byte = np.frombuffer(b" ".join(words) + b" " if words else b"", np.uint8)
        place = np.arange(len(byte)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        of_kind = np.repeat(kind.astype(np.uint64) + np.uint64(1), self.lengths)
        length, where = letters.places(byte)
        self.size = np.diff(np.r_[0, np.cumsum(length)][np.cumsum(self.lengths)], prepend=0)
        # of the nodes of all paths: the bit, and from 1 the gate
        depth = np.arange(len(letters.node)) - np.repeat(letters.start, letters.length)
        self.path = (letters.bit + (3 * SETS * np.searchsorted([1, 2, 4], depth, "right") << 1)).astype(np.uint64).take(where)
        turn = mix64(letters.node.astype(np.uint64)).astype(np.uint32).take(where)
        past, self.slots, self.cells = np.zeros(len(byte), np.uint64), [], []
        for k in range(1, max(ORDERS) + 1):
            before = np.zeros(len(byte), np.uint64)
            before[k:] = byte[:-k]
            before[place < k] = 0
            past = past * np.uint64(257) + before + np.uint64(1)
            if k in ORDERS:
                context = mix64(past * np.uint64(8) + np.uint64(k) + (of_kind * P3 if k < 3 else np.uint64(0))).astype(np.uint32)
                key = np.repeat(context, length)
                key += turn
                key *= np.uint32(0x9E3779B1)
                if k in (2, 3):
                    self.cells.append(key & np.uint32(CELLS - 1))
                key >>= np.uint32(32 - SLOTS[len(self.slots)])
                self.slots.append(key.view(np.int32))

    def count(self, tables: list[np.ndarray]) -> None:
        """Add the bits to tables (of 32-bit numbers) where 2 * slot + bit holds a count."""
        bit = (self.path & np.uint64(1)).astype(np.int32)
        for table, at in zip(tables, self.slots, strict=True):
            np.add.at(table, (at << 1) + bit, np.uint32(1))

    def stream(self, says: list[np.ndarray], leave: np.ndarray, text: np.ndarray, texts: int) -> Stream:
        """The words' bits; ``text`` are the texts of the words, in order, ``says`` the tables as
        ``looked_up`` makes them. Of words that have ``leave`` set, one occurrence is in the tables
        and is left out."""
        case = np.repeat(leave.astype(np.int32), self.size)
        case += case * (self.path & np.uint64(1)).astype(np.int32)
        said = np.empty((len(case), 4), np.uint8)
        for k, at in enumerate(self.slots):
            at = at + (case << SLOTS[k])
            said[:, k] = says[k].take(at)
        # bit, gate, cells, and from 32 what the tables say
        packed = said.view(np.uint32).ravel().astype(np.uint64) << np.uint64(32)
        packed += self.path
        packed += says[-1].take(at).astype(np.uint64) * np.uint64(2 * SETS)
        for x, place in ((self.cells[0], 9), (self.cells[1], 20)):
            packed |= x.astype(np.uint64) << np.uint64(place)
        packed = packed.view(np.int64)

        def feed(at: np.ndarray):
            u = packed.take(at)
            x = np.empty((len(at), len(ORDERS) + 3), np.float32)
            x[:, : len(ORDERS)] = SAYS.take(u.view(np.uint8).reshape(-1, 8)[:, 4:])
            return u & 1, x, u >> 9 & (CELLS - 1), (u >> 20 & (CELLS - 1)) + CELLS, u >> 1 & 127

        return Stream(np.bincount(text, self.size, texts).astype(np.int64), feed)


#: Counts in a byte: exact up to 64, then eight steps an octave.
COUNT = np.r_[np.arange(64), 64 * np.exp2(np.arange(192) / 8)]


def encode(n: np.ndarray) -> np.ndarray:
    """Pairs of counts as pairs of bytes."""
    return np.where(n < 64, np.round(n), np.minimum(255, 64 + np.round(8 * np.log2(np.maximum(n, 64) / 64)))).astype(np.uint8)


def looked_up(codes: list[np.ndarray]) -> list[np.ndarray]:
    """From tables of coded pairs, what each slot says, in a byte: as it is, and without an occurrence
    of a 0 or of a 1, one after the other; and how much the slots of the last have seen."""
    n0, n1 = np.tile(COUNT, 256), np.repeat(COUNT, 256)
    cases = [(n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))]
    look = [np.round((np.clip(np.log((b + 0.05) / (a + 0.05)), -10, 10) + 10) * SAY).astype(np.uint8) for a, b in cases]
    seen = [np.searchsorted([1, 4], a + b, "right").astype(np.uint8) for a, b in cases]
    pairs = [t.view("<u2") for t in codes]
    return [np.concatenate([x[t] for x in look]) for t in pairs] + [np.concatenate([x[pairs[-1]] for x in seen])]


#: Steps, a unit, of what coded counts say, which is held in a byte, and the bytes' meanings.
SAY = 12.75
SAYS = (np.arange(256) / SAY - 10).astype(np.float32)


#: Whether a token follows the two before it as it did elsewhere: gates of the count (five steps) and of the last three outcomes.
MATCH_GATES = 40


def match_stream(state: np.ndarray, per_text: np.ndarray) -> Stream:
    """Flags as 2 * (8 * step of the count + last outcomes) + flag."""

    def feed(at: np.ndarray):
        s = state.take(at).astype(np.int64)
        gate = s >> 1
        return s & 1, np.empty((len(at), 3), np.float32), gate & 7, gate + CELLS, gate * SETS

    return Stream(per_text, feed)
