"""The language model against a plain coder that goes bit by bit and counts by itself."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lm_scoring, mixing, queries
from lectern.llm.lm_scoring import AGAIN, CLASSES, END, ESCAPE

WORD = r"[^\x20\x09-\x0D]+"
DOC = "doc_id long, text string, lang string"


def tokens(text):
    return [w.encode() for w in re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))] + [None]


def in_training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def grams(ts):
    """Each token with the two before it; before the first there are two starts."""
    return [((ts[k - 2] if k > 1 else "<"), (ts[k - 1] if k else "<"), w) for k, w in enumerate(ts)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(1, 7))) for _ in range(300)] for k, a in (("aa", "abcdefg"), ("bb", "defghié"))}
    out = []
    for i in range(160):
        lang = r.choice(["aa", "aa", "bb", None])
        mine = words[lang or "aa"]
        text = " ".join(mine[min(299, int(r.expovariate(0.03)))] if r.random() < 0.95 else "".join(r.choice("xyzuvw") for _ in range(5)) for _ in range(r.randint(5, 120)))
        out.append((i, text.upper() if i % 7 == 0 else text, lang))
    out += [(300 + k, out[3 * k][1], "aa") for k in range(12)]
    return [*out, (400, None, "aa"), (401, "", None), (402, " \n\t", "bb"), (403, "Word", "aa"), (404, "x" * 3000, "aa"), (405, "go " * 2500, "bb"), (None, "no id here", "aa"), out[5], out[5]]


@pytest.fixture(scope="module")
def scored(spark, rows):
    """Scores, what the driver knew, and the block of each row."""
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_scoring.Model, "new", classmethod((lambda old: lambda cls, *a: (made.append(old(*a)), made[-1])[1])(lm_scoring.Model.new)))
        df = spark.createDataFrame(rows, DOC).withColumns({"kind": F.lit("clash"), "block": F.lit(1), "body": F.lit("x"), "a": F.lit(2)})
        got = lm_scoring.score(df.repartition(3), theme="lang").collect()
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return got, made[0], [r[0] for r in df.select(F.pmod(F.xxhash64("doc_id", body), F.lit(blocks))).collect()]


class Plain:
    """The mixing of a stream of a block, with plain numbers: all texts step by step."""

    def __init__(self, mixer, rate, most):
        self.w, self.refine = mixer.weights.astype(float), mixer.refine.astype(float)
        self.rate, self.most, self.texts = rate, most, []

    def add(self, train):
        self.texts.append((train, []))

    def bit(self, *what):
        self.texts[-1][1].append(what)

    def run(self):
        """Bits that each text costs."""
        lanes = [(k, train, bits[i : i + self.most], {}) for k, (train, bits) in enumerate(self.texts) for i in range(0, len(bits), self.most)]
        cost = [0.0] * len(self.texts)
        for t in range(max((len(x) for _, _, x, _ in lanes), default=0)):
            moves, steps = defaultdict(list), defaultdict(list)
            for k, train, bits, cells in lanes:
                if t >= len(bits):
                    continue
                bit, fixed, one, two, gate = bits[t]
                a, b = cells.get((0, one), (0, 0)), cells.get((1, two), (0, 0))
                x = np.array([*fixed, *(math.log((c[1] + 0.4) / (c[0] + 0.4)) for c in (a, b)), 0.3])
                chosen = gate * 6 + (0 if sum(a) < 1 else 2 if sum(a) < 3 else 4) + (sum(b) > 0)
                z = max(-14.0, min(14.0, float(self.w[chosen] @ x)))
                p, step = 1 / (1 + math.exp(-z)), int(z * 2 + 28.5)
                final = (p + self.refine[step]) / 2
                cost[k] -= math.log2(final if bit else 1 - final)
                for key, c in (((0, one), a), ((1, two), b)):
                    n = list(c)
                    n[bit] = min(15, n[bit] + 1)
                    n[1 - bit] = n[1 - bit] // 2 + 1 if n[1 - bit] > 2 else n[1 - bit]
                    cells[key] = tuple(n)
                if train:
                    moves[chosen].append((bit - p) * x)
                    steps[step].append(bit - self.refine[step])
            for chosen, found in moves.items():
                self.w[chosen] += self.rate / (1 + t / 400) * min(1, len(found) / 16) * np.mean(found, axis=0)
            for step, found in steps.items():
                self.refine[step] += 0.05 * min(1, len(found) / 16) * np.mean(found)
        return cost


def plain_scores(rows, blocks, model):
    """log2 cost of each row, from counts made by hand."""
    know, settings = model.know, lm_scoring.Settings()
    docs = [(i, tokens(t), in_training(i)) for i, t, _ in rows]
    count = Counter(w for _, ts, tr in docs if tr for w in ts)
    kinds = {w: k for w, k in _main_kinds(rows).items()}
    classes, follows, around = Counter(), Counter(), Counter()
    for w, n in count.items():
        if w is not None and w not in know.frequent:
            classes[min(39, int(math.log2(n))), kinds[w]] += n
    for _, ts, tr in docs:
        if tr:
            follows.update(grams(ts))
            around.update(g[:2] for g in grams(ts))
    tables = [Counter() for _ in mixing.ORDERS]
    letters = model.letters
    paths = lambda tree, leaf: [(int(tree.node[p]), int(tree.bit[p])) for p in range(tree.start[leaf], tree.start[leaf] + tree.length[leaf])]

    def spelled(word, kind):
        """(order contexts, node, bit) of each bit of a word."""
        for at, byte in enumerate(word + b" "):
            for depth, (node, bit) in enumerate(paths(letters, byte)):
                yield [(o, word[max(0, at - o) : at].rjust(o, b"\0"), kind if o < 3 else None, node) for o in mixing.ORDERS], depth, node, bit

    for w in count:
        if w is not None:
            for keys, _, _, bit in spelled(w, kinds[w]):
                for table, key in zip(tables, keys, strict=True):
                    table[key, bit] += 1
    new = {"match": (0, mixing.MATCH_GATES), "tree": (2, mixing.Tree.GATES), "spell": (4, mixing.SPELL_GATES, 1.3)}
    mixed = {b: {name: Plain(mixing.Mixer.new(*args), settings.rate, settings.lane_flags if name == "match" else settings.lane_bits) for name, args in new.items()} for b in set(blocks)}
    out = []
    for (_, ts, tr), block in zip(docs, blocks, strict=True):
        own, mine, mine_around = Counter(ts), Counter(grams(ts)), Counter(g[:2] for g in grams(ts))
        coders = mixed[block]
        for coder in coders.values():
            coder.add(tr)
        cost, seen, hits, said, before = 0.0, Counter(), [0, 0, 0], np.log(know.mass.sum(0) + 1), 0
        for g in grams(ts):
            w = g[2]
            left = count[w] - own[w] * tr
            plain = END if w is None else know.frequent.get(w, -1)
            rare = plain < 0
            if rare:
                plain = CLASSES + min(know.octaves - 1, int(math.log2(left))) * know.mass.shape[1] + kinds.get(w, 0) if left > 0 else ESCAPE
            leaf = AGAIN if rare and seen[w] else plain
            kind = int(said.argmax())
            n, both = around[g[:2]] - mine_around[g[:2]] * tr, follows[g] - mine[g] * tr
            hit = int(both > 0)
            if n > 0:
                step = sum(n >= x for x in (2, 3, 5, 17))
                context = 8 * step + hits[-1] + 2 * hits[-2] + 4 * hits[-3]
                coders["match"].bit(hit, [], context & 7, context, context)
            if hit:
                cost -= math.log2(both / n)
            else:
                for depth, (node, bit) in enumerate(paths(model.tree, leaf)):
                    coders["tree"].bit(bit, [model.tree.stretch[0, node], model.tree.stretch[kind + 1, node]], node, (before, node), sum(depth >= x for x in (2, 4, 7)))
                before = leaf + 1
                if leaf == AGAIN:
                    cost -= math.log2(seen[w] / sum(seen.values()))
                elif leaf == ESCAPE:
                    for keys, depth, node, bit in spelled(w, kind):
                        pairs = []
                        for table, key in zip(tables, keys, strict=True):
                            c = [table[key, 0], table[key, 1]]
                            c[bit] = max(0, c[bit] - 1) if tr else c[bit]
                            pairs.append(c)
                        fixed = [round((max(-10, min(10, math.log((c[1] + 0.05) / (c[0] + 0.05)))) + 10) * mixing.SAY) / mixing.SAY - 10 for c in pairs]
                        gate = 3 * sum(depth >= x for x in (1, 2, 4)) + sum(sum(pairs[-1]) >= x for x in (1, 4))
                        coders["spell"].bit(bit, fixed, keys[1], keys[2], gate)
                elif rare:
                    total = classes[min(know.octaves - 1, int(math.log2(left))), kinds[w]]
                    cost -= math.log2(min(1, left / max(1, total)))
            if not (rare and seen[w]):
                said = said + know.speaks[plain]
            if rare:
                seen[w] += 1
            hits.append(hit)
        out.append(cost)
    totals = {b: iter(np.sum([coder.run() for coder in coders.values()], axis=0)) for b, coders in mixed.items()}
    return [cost + next(totals[b]) for cost, b in zip(out, blocks, strict=True)]


def _main_kinds(rows):
    """Each training word's most frequent kind: the languages by frequency, then all others."""
    train = [(t, lang) for i, t, lang in rows if in_training(i)]
    order = [k for k, _ in sorted(Counter(lang for _, lang in train if lang).items(), key=lambda x: (-x[1], x[0]))][:4]
    n = defaultdict(Counter)
    for t, lang in train:
        for w in tokens(t)[:-1]:
            n[w][order.index(lang) if lang in order else len(order)] += 1
    return {w: min(c, key=lambda k: (-c[k], k)) for w, c in n.items()}


def test_scores_equal_a_plain_coder(rows, scored):
    got, model, blocks = scored
    found = defaultdict(list)
    for r in got:
        found[r.doc_id, r.n_bytes].append(-r.score * math.log2(10))
    for (i, t, _), want in zip(rows, plain_scores(rows, blocks, model), strict=True):
        have = found[i, len((t or "").encode())]
        # cells are hashed into a thousand places, where a few of a text meet
        assert all(x == pytest.approx(want, rel=0.03, abs=0.5) for x in have), (i, have, want)


def test_baseline_columns(rows, scored):
    got, _, _ = scored
    count = Counter(w for i, t, _ in rows if in_training(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        k = tokens(t)
        want[i, not in_training(i), len(k), sum(count[w] > 0 for w in k), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k), 6), len((t or "").encode())] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.n_bytes) for r in got)
    assert all(r.score < 0 and r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes if r.n_bytes else 0) for r in got)


def test_bits_of_a_stream_have_probabilities_that_sum_to_one():
    mass = np.random.default_rng(1).random((40, 2)) * 100
    tree, r = mixing.Tree(mass), np.random.default_rng(2)
    past = r.integers(0, 40, 30)
    mixer = mixing.Mixer.new(2, tree.GATES)
    total = 0.0
    for leaf in range(40):
        cost = [mixing.run(mixer, tree.stream(np.array(x), np.zeros(len(x), "u1"), np.array([len(x)])), np.array([False]), 0.1, 4096)[0] for x in (past, [*past, leaf])]
        total += 2 ** (cost[0] - cost[1])
    assert total == pytest.approx(1, abs=1e-3)


def test_held_out_documents_cost_less_than_the_baseline(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    got = queries.op9_lm_scoring(spark, sf).where("held_out").collect()
    bits = lambda k: -sum(r[k] for r in got) * math.log2(10) / sum(r.n_bytes for r in got)
    assert bits("score") < bits("base_score") - 0.2
    assert sum(r.score > r.base_score for r in got) > 0.75 * len(got)


def test_documents_that_occur_twice_are_told_apart(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    texts = [" ".join(words[min(499, int(r.expovariate(0.01)))] for _ in range(80)) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(0, 400, 10)]
    got = {x.doc_id: (x.bits_per_byte, x.held_out) for x in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[i][0] for i in range(0, 400, 10) if not got[1000 + i][1]]  # the twin is a training document
    once = [got[i][0] for i in range(400) if i % 10]
    assert max(twice) < 0.3 and min(once) > 1


def test_weights_learn_from_training_texts_alone():
    r, tree = np.random.default_rng(3), mixing.Tree(np.random.default_rng(1).random((40, 1)) * 100)
    leaves, per_text = r.integers(0, 3, 4000), np.full(40, 100)
    one = mixing.Mixer.new(2, tree.GATES)
    stream = lambda: tree.stream(leaves, np.zeros(4000, "u1"), per_text)
    plain = mixing.run(one, stream(), np.zeros(40, bool), 0.1, 2048)
    assert (one.weights == mixing.Mixer.new(2, tree.GATES).weights).all()
    learnt = mixing.run(one, stream(), np.arange(40) % 2 == 0, 0.1, 2048)
    assert (one.weights != mixing.Mixer.new(2, tree.GATES).weights).any() and learnt.sum() < plain.sum()
    # in lanes of the same length, what a text costs does not depend on its place
    again = mixing.run(mixing.Mixer.new(2, tree.GATES), stream(), np.ones(40, bool), 0.1, 2048)
    assert again.sum() < plain.sum()


def test_words_are_split_as_bytes_are(rows):
    bodies = [(t or "").encode() for _, t, _ in rows] + [b"", b"  a\x0bb \x00 c" + "é\u00a0x".encode(), b"w" * 3000 + b" tail"]
    for window in (64, 1 << 20):
        pieces = []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lm_scoring, "WINDOW", window)
            patch.setattr(lm_scoring.np, "frombuffer", (lambda old: lambda *a: (pieces.append(a[2]) if len(a) == 4 else None, old(*a))[1])(np.frombuffer))
            text = lm_scoring.Text(bodies)
        assert len(pieces) > 20 if window == 64 else len(pieces) == 1  # the data are taken in windows
        want = [b.lower().split() for b in bodies]
        assert text.n.tolist() == [len(w) + 1 for w in want] and (np.diff(text.keys.astype(object)) > 0).all()
        names = [*text.words(np.arange(len(text.keys))), None]
        assert [names[k] for k in text.token.tolist()] == [w for ws in want for w in [*ws, None]]


def test_a_page_sum_holds_few_payloads_at_a_time(spark):
    rows = [(0, p, t, lm_scoring._pack_page(np.array([t, 70]), np.array([1, 2]))) for p in range(2) for t in range(50)]
    df = spark.createDataFrame(rows, lm_scoring.ROWS_SQL)
    got = lm_scoring._tree_sum(df, 50, lm_scoring._add_pages(lm_scoring.Settings()), 4).collect()
    assert len(got) == 2
    for r in got:
        used, n = lm_scoring._unpack_page(bytes(r.payload))
        assert used.tolist() == [*range(50), 70] and n.tolist() == [1] * 50 + [100]


def test_no_training_documents(spark):
    held = [i for i in range(60) if not in_training(i)]
    got = lm_scoring.score(spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)
