"""Units of a book to chunks.

Costs are a quarter of the characters. Within a chapter the units that fit are cut by
their running costs: a draft begins at a unit and reaches as far as the room lasts, found by
bisection of the running sum; where it ends and what it leaves as overlap say where the next one
begins. A unit that is too large makes drafts of its own, windows of sentences (or of words,
where a sentence alone is too large), cut the same way. Small drafts then join a neighbour.

No task holds a book, or a chapter. Units stand in ranges of their chapter's run. A long run is cut
by a table of routes: for each state in which drafts can enter a range, the state in which they leave it. Many
beginnings soon share their cuts, so the table is short. Following it from the start of the run,
by doubling, gives the state in which each range is entered, and then all ranges are cut at once. What
small drafts become depends on their neighbours alone; where that crosses ranges it is settled by
repeating the ranges concerned until nothing changes.

Defined cases. A unit without text: no draft. A unit, range or run of any number of units. Null chapter
or section: empty. Equal positions: in any order. Empty table: empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import section_label
from lectern.operators.ordered import carried
from lectern.sources.scratch import stored

# Where sentences part, and what joins the texts of a chunk.
SENTENCE_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9(])")
AFTER_SENTENCE = re.compile(r"(?<=[.!?])\s+")
GLUE = "\n\n"


@dataclass(frozen=True)
class Limits:
    """In tokens: the most of a chunk, its overlap with the one before, the least that stands alone."""

    most: int = 700
    overlap: int = 120
    least: int = 60

    def __post_init__(self):
        if 2 * self.least + 2 > self.most:
            raise ValueError("the least of a chunk must be under half of the most")


@dataclass(frozen=True)
class Unit:
    text: str
    chapter: str = ""
    section: str = ""
    first: int = 1
    last: int = 1
    marks: tuple[tuple[int, int], ...] = ((0, 1),)

    def page(self, offset: int) -> int:
        """Page of a character: that of the last mark not after it, or of the first."""
        return self.marks[max(0, bisect_right(self.marks, offset, key=lambda m: m[0]) - 1)][1]


@dataclass(frozen=True)
class Lead:
    """What a draft takes over from the one before it."""

    text: str
    section: str
    page: int


@dataclass(frozen=True)
class Draft:
    """Text that begins at a unit; ``part`` counts those of one unit. A ``whole`` one stands alone however small,
    and nothing may be put before one that is not ``open``."""

    at: int
    part: int
    text: str
    sections: tuple[str, ...]
    first: int
    last: int
    whole: bool = False
    open: bool = True


@dataclass
class Chunk:
    text: str
    chapter: str
    sections: tuple[str, ...]
    first: int
    last: int

    @property
    def label(self) -> str:
        """The first and the last of its sections."""
        ends = self.sections[:1] + self.sections[1:][-1:]
        return " \u2013 ".join(ends)


def distinct(names: Sequence[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(n for n in names if n))


def cost(text: str) -> int:
    return max(1, len(text) // 4)


def reach(running: Sequence[int], start: int, room: int) -> int:
    """End of the longest run from ``start`` whose costs stay within ``room``; one at least.
    ``running`` are the sums of costs up to each item, from 0."""
    return max(start + 1, bisect_right(running, running[start] + room) - 1)


def runs(costs: Sequence[int], room: int) -> Iterator[tuple[int, int]]:
    """The items cut into consecutive runs within ``room``."""
    running, start = [0, *accumulate(costs)], 0
    while start < len(costs):
        end = reach(running, start, room)
        yield start, end
        start = end


def spans(text: str, limits: Limits) -> list[tuple[int, int, int]]:
    """(from, to, cost) of the sentences, and of runs of words of those that are too large."""
    breaks = [m.span() for m in SENTENCE_BREAK.finditer(text)]
    sentences = zip([0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(text)], strict=True)
    out = []
    for a, b in sentences:
        if a < b and cost(text[a:b]) <= limits.most:
            out.append((a, b, cost(text[a:b])))
        elif a < b:
            words = [(m.start() + a, m.end() + a, cost(" " + m[0])) for m in re.finditer(r"\S+", text[a:b])]
            for i, j in runs([c for *_, c in words], limits.most):
                out.append((words[i][0], words[j - 1][1], sum(c for *_, c in words[i:j])))
    return out


def windows(text: str, limits: Limits) -> Iterator[tuple[int, int]]:
    """Windows over the spans of a text, which overlap by as many whole spans as the overlap holds
    if the next span then still finds room."""
    parts = spans(text, limits)
    running, start = [0, *accumulate(c + 1 for *_, c in parts)], 0
    while start < len(parts):
        end = reach(running, start, limits.most)
        yield parts[start][0], parts[end - 1][1]
        if end == len(parts):
            return
        back = next(k for k in range(start, end + 1) if running[end] - running[k] <= limits.overlap)
        start = back if running[end + 1] - running[back] <= limits.most else end


def ending(text: str, tokens: int) -> str:
    """The last tokens, from the first sentence that begins in them if that leaves 40 characters."""
    if tokens <= 0:
        return ""
    part = text[-4 * tokens :]
    found = AFTER_SENTENCE.search(part)
    return (part[found.end() :] if found and len(part) - found.end() > 40 else part).strip()


class Run:
    """A stretch of units of one chapter run: all its units, or those of a range and as many after it as a draft
    that begins in the range can reach. ``base`` is the place of the first in the run, ``ends`` whether the
    run ends with the last, ``closing`` whether the book does."""

    def __init__(self, units: Sequence[Unit], limits: Limits, base: int = 0, ends: bool = True, closing: bool = True):
        self.units, self.limits, self.base, self.ends, self.closing = units, limits, base, ends, closing
        self.costs = [cost(u.text) for u in units]
        self.running = [0, *accumulate(c + 2 for c in self.costs)]
        # where the units that fit end, from each unit on
        self.stop = [0] * len(units)
        for k in range(len(units) - 1, -1, -1):
            follows = k + 1 < len(units) and self.costs[k + 1] <= limits.most
            self.stop[k] = self.stop[k + 1] if follows else k + 1

    def step(self, at: int, lead: Lead | None) -> tuple[int, Lead | None, Draft | None]:
        """The unit after the draft that begins at ``at``, what the next draft takes over, and the draft."""
        k, most = at - self.base, self.limits.most
        if self.costs[k] > most:
            return at + 1, None, None
        room = most - (cost(lead.text) + 2 if lead else 0)
        end = min(reach(self.running, k, room), self.stop[k])
        part = self.units[k:end]
        raw = GLUE.join([lead.text, *(u.text for u in part)] if lead else [u.text for u in part])
        text = raw.strip()
        sections = distinct(((lead.section,) if lead else ()) + tuple(u.section for u in part))
        last = end == self.stop[k]
        whole = last and self.closing and self.ends and end == len(self.units)
        draft = Draft(at, 0, text, sections, lead.page if lead else part[0].first, max(u.last for u in part), whole) if text else None
        if last or not text or cost(text) < self.limits.least:
            return self.base + end, None, draft
        tail = ending(raw, self.limits.overlap)
        if tail and cost(tail) + self.costs[end] + 2 <= most:
            return self.base + end, Lead(tail, sections[-1] if sections else "", draft.last), draft
        return self.base + end, None, draft

    def drafts(self, at: int, lead: Lead | None, stop: int) -> Iterator[Draft]:
        """Those that begin at ``at`` and later, before the unit ``stop``."""
        while at < stop:
            unit, begun = self.units[at - self.base], at
            at, lead, draft = self.step(at, lead)
            if draft:
                yield draft
            elif self.costs[begun - self.base] > self.limits.most:
                yield from self._windows(unit, begun)

    def _windows(self, unit: Unit, at: int) -> Iterator[Draft]:
        width, n = 4 * self.limits.most, 0
        for a, b in windows(unit.text, self.limits):
            text = unit.text[a:b].strip()
            fits = cost(text) <= self.limits.most
            for piece in [text] if fits else [text[i : i + width].strip() for i in range(0, len(text), width)]:
                if piece:
                    yield Draft(at, n, piece, distinct([unit.section]), unit.page(a), unit.page(b - 1), True, fits)
                    n += 1


@dataclass(frozen=True)
class Shelf:
    """What came before: the head and length of the last chunk, and those of a small draft that waits."""

    chunk: tuple[int, int] | None = None
    chunk_chars: int = 0
    waiting: tuple[int, int] | None = None
    waiting_chars: int = 0


def shelve(drafts: Sequence[tuple[tuple[int, int], int, bool, bool]], shelf: Shelf, limits: Limits) -> tuple[list[tuple[int, int]], Shelf]:
    """The head of the chunk that each draft (key, characters, whole, open) belongs to. A small one
    belongs to the chunk before it if they fit together, else to the next draft's, else to its own."""
    fits = lambda a, b: max(1, (a + len(GLUE) + b) // 4) <= limits.most
    chunk, chars, waiting, waits = shelf.chunk, shelf.chunk_chars, shelf.waiting, shelf.waiting_chars
    heads = []
    for key, n, whole, is_open in drafts:
        if waiting is not None and is_open and fits(waits, n):
            key, n = waiting, waits + len(GLUE) + n
        elif waiting is not None:
            chunk, chars = waiting, waits
        waiting = None
        if whole or max(1, n // 4) >= limits.least:
            chunk, chars = key, n
        elif chunk is not None and fits(chars, n):
            key, chars = chunk, chars + len(GLUE) + n
        else:
            waiting, waits = key, n
        heads.append(key)
    return heads, Shelf(chunk, chars, waiting, waits if waiting is not None else 0)


def _merged(drafts: list[Draft], heads: list[tuple[int, int]], chapter: str) -> list[Chunk]:
    out: dict[tuple[int, int], Chunk] = {}
    for d, head in zip(drafts, heads, strict=True):
        if head in out:
            c = out[head]
            c.text, c.sections, c.last = c.text + GLUE + d.text, distinct(c.sections + d.sections), max(c.last, d.last)
        else:
            out[head] = Chunk(d.text, chapter, d.sections, d.first, d.last)
    return list(out.values())


def chunks_of(units: Sequence[Unit], limits: Limits) -> list[Chunk]:
    """The chunks of a book's units, in order, without Spark."""
    borders = [0, *(k for k in range(1, len(units)) if units[k].chapter != units[k - 1].chapter), len(units)]
    out = []
    for a, b in zip(borders, borders[1:], strict=False):
        drafts = list(Run(units[a:b], limits, closing=b == len(units)).drafts(0, None, b - a))
        heads, _ = shelve([((d.at, d.part), len(d.text), d.whole, d.open) for d in drafts], Shelf(), limits)
        out += _merged(drafts, heads, units[a].chapter)
    return out


# ---- the same over ranges -------------------------------------------------------------------------------

#: Units of a range.
RANGE_UNITS = 1024
KEY = ["book", "run", "range"]
STATE = "at long, lead_text string, lead_section string, lead_page int"
PLACE = "book string, run long, range long"
SHELF = "chunk_at long, chunk_part int, chunk_chars long, waiting_at long, waiting_part int, waiting_chars long"
DRAFT = f"{PLACE}, at long, part int, text string, sections array<string>, first int, last int, whole boolean, open boolean, head_at long, head_part int, {SHELF}"


def _none(x):
    return None if x is None or pd.isna(x) else x


def _lead(text, section, page) -> Lead | None:
    return None if _none(text) is None else Lead(text, section, int(page))


def _run(pdf: pd.DataFrame, limits: Limits) -> tuple[Run, int]:
    """The units of a group, and the place in the run at which the range ends."""
    pdf = pdf.sort_values("i")
    units = [Unit(u.text, u.chapter, u.section, int(u.page_start), int(u.page_end), tuple((m["off"], m["page"]) for m in u.page_marks)) for u in pdf.itertuples()]
    base, size = int(pdf["i"].iloc[0]), int(pdf["n"].iloc[0])
    own = int((~pdf["halo"]).sum())
    return Run(units, limits, base, base + len(units) == size, bool(pdf["closing"].iloc[0])), base + own


def _routes(limits: Limits, every: bool):
    """(state in which a range is entered, state in which it is left): for the states given beside the units, or for
    drafts that begin at any unit of the range with nothing taken over."""

    def run(pdf: pd.DataFrame, states: pd.DataFrame | None) -> pd.DataFrame:
        place = {k: pdf[k].iloc[0] for k in KEY}
        units, stop = _run(pdf, limits)
        starts = [(at, None) for at in range(units.base, stop)] if every else list({(int(e.at), _lead(e.lead_text, e.lead_section, e.lead_page)) for e in states.itertuples()})
        known: dict = {}
        rows = []
        for start in starts:
            path, now = [], start
            while now[0] < stop and now not in known:
                path.append(now)
                now = units.step(*now)[:2]
            left = known.get(now, now)
            known.update(dict.fromkeys(path, left))
            rows.append((start, left))
        if every:  # only where drafts can leave matters
            rows = [(left, left) for left in dict.fromkeys(left for _, left in rows)]
        flat = lambda s: (s[0], *((s[1].text, s[1].section, s[1].page) if s[1] else (None, None, None)))
        out = pd.DataFrame([(*flat(a), *flat(b)) for a, b in rows], columns=["at", "lead_text", "lead_section", "lead_page", "to_at", "to_text", "to_section", "to_page"])
        return out.astype({"lead_page": "Int32", "to_page": "Int32"}).assign(**place)[[*KEY, *out.columns]]

    return (lambda pdf: run(pdf, None)) if every else run


ROUTE = f"{PLACE}, {STATE}, to_at long, to_text string, to_section string, to_page int"
_STATE = [x.split()[0] for x in STATE.split(", ")]


def _entered(states: DataFrame) -> DataFrame:
    """States with a key of their own, in the range that they enter."""
    return states.withColumn("range", F.col("range") + 1).select(*KEY, *_STATE, F.xxhash64(*_STATE).alias("key")).distinct()


def _thin(text: Column, limits: Limits) -> Column:
    """A text of the same length for which drafts begin, end and take over as for ``text``: only the end of a unit that fits
    is ever taken over, of what stands before it only its length counts and what of it is space; of a unit that
    is too large, that it is."""
    n, tail = F.length(text), 4 * limits.overlap
    fits = F.concat(F.regexp_replace(F.substring(text, F.lit(1), n - tail), "[A-Za-z0-9]", "x"), F.substring(text, n - tail + 1, F.lit(tail)))
    return F.when(F.floor(n / 4) > limits.most, F.lit("x" * 4 * (limits.most + 1))).when(n > tail, fits).otherwise(text)


def _entries(units: DataFrame, long: DataFrame, limits: Limits) -> DataFrame:
    """(book, run, range, state) in which each range of the long runs (book, run, ranges) is entered."""
    rows = stored(units.join(long, ["book", "run"]).withColumn("text", _thin(F.col("text"), limits)))
    start = long.select("book", "run", F.lit(-1).cast("long").alias("range"), F.lit(0).cast("long").alias("at"), *[F.lit(None).cast(t).alias(n) for n, t in zip(_STATE[1:], ("string", "string", "int"), strict=True)])
    left = rows.groupBy(*KEY).applyInPandas(_routes(limits, True), ROUTE).select(*KEY, *_STATE)
    there_is = lambda states: states.join(long, ["book", "run"]).where("range < ranges").drop("ranges")
    fresh, table = stored(there_is(_entered(start.unionByName(left)))), None
    while not fresh.isEmpty():
        # units go to their range once, however many states it is entered in
        asked = rows.join(fresh.select(*KEY).distinct(), KEY, "left_semi")
        found = asked.groupBy(*KEY).cogroup(fresh.drop("key").groupBy(*KEY)).applyInPandas(_routes(limits, False), ROUTE)
        found = found.withColumns({"key": F.xxhash64(*_STATE), "to_key": F.xxhash64("to_at", "to_text", "to_section", "to_page")})
        table = stored(found if table is None else table.unionByName(found))
        outs = table.select(*KEY, *[F.col(c).alias(n) for c, n in zip(("to_at", "to_text", "to_section", "to_page"), _STATE, strict=True)])
        there = table.select(*KEY, "key").distinct()
        fresh = stored(there_is(_entered(outs)).join(there, [*KEY, "key"], "left_anti"))
    # which states are met on the way from the start, by doubling the length of steps
    steps = table.select("book", "run", "range", "key", (F.col("range") + 1).alias("to"), F.col("to_key"))
    met = stored(table.where("range = 0 and at = 0 and lead_text is null").select(*KEY, "key"))
    for _ in range(math.ceil(math.log2(max(2, long.agg(F.max("ranges")).first()[0] or 2)))):
        beyond = met.join(steps, [*KEY, "key"]).select("book", "run", F.col("to").alias("range"), F.col("to_key").alias("key"))
        met = stored(met.unionByName(beyond).distinct())
        on = steps.select("book", "run", F.col("range").alias("to"), F.col("key").alias("to_key"), F.col("to").alias("to2"), F.col("to_key").alias("key2"))
        steps = stored(steps.join(on, ["book", "run", "to", "to_key"]).select("book", "run", "range", "key", F.col("to2").alias("to"), F.col("key2").alias("to_key")))
    return stored(table.join(met, [*KEY, "key"], "left_semi").select(*KEY, *_STATE).distinct())


def _heads(limits: Limits):
    """Heads of the drafts of a range, behind the shelf that the rows name."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "part"])
        one = pdf.iloc[0]
        pair = lambda a, b: None if _none(a) is None else (int(a), int(b))
        shelf = Shelf(pair(one.chunk_at, one.chunk_part), int(_none(one.chunk_chars) or 0), pair(one.waiting_at, one.waiting_part), int(_none(one.waiting_chars) or 0))
        heads, after = shelve([((int(d.at), int(d.part)), int(d.chars), d.whole, d.open) for d in pdf.itertuples()], shelf, limits)
        return _with_heads(pdf[[*KEY, "at", "part"]], heads, after)

    return run


def _with_heads(rows: pd.DataFrame, heads: list[tuple[int, int]], after: Shelf) -> pd.DataFrame:
    chunk, waiting = after.chunk or (None, None), after.waiting or (None, None)
    shelf = {"chunk_at": chunk[0], "chunk_part": chunk[1], "chunk_chars": after.chunk_chars, "waiting_at": waiting[0], "waiting_part": waiting[1], "waiting_chars": after.waiting_chars}
    kinds = dict.fromkeys(shelf, "Int64") | {"chunk_part": "Int32", "waiting_part": "Int32"}
    return rows.assign(head_at=[h[0] for h in heads], head_part=[h[1] for h in heads], **{k: pd.array([v] * len(rows), kinds[k]) for k, v in shelf.items()})


def _drafts(limits: Limits):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = {k: pdf[k].iloc[0] for k in KEY}
        units, stop = _run(pdf, limits)
        entry = pdf.iloc[0]
        at = units.base if _none(entry["at"]) is None else int(entry["at"])
        found = list(units.drafts(at, _lead(entry.lead_text, entry.lead_section, entry.lead_page), stop))
        heads, after = shelve([((d.at, d.part), len(d.text), d.whole, d.open) for d in found], Shelf(), limits)
        names = ["at", "part", "text", "sections", "first", "last", "whole", "open"]
        rows = pd.DataFrame([[getattr(d, n) if n != "sections" else list(d.sections) for n in names] for d in found], columns=names).assign(**place)
        out = _with_heads(rows, heads, after)
        return out[[x.split()[0] for x in DRAFT.split(", ")]]

    return run


def _settled(made: DataFrame, long: DataFrame, limits: Limits) -> DataFrame:
    """(book, run, at, part, head) of the drafts of long runs that belong elsewhere once every range stands behind the shelf
    that the one before it leaves. A range whose shelf is what it was is not repeated."""
    rows = stored(made.join(long, ["book", "run"], "left_semi").withColumn("chars", F.length("text").cast("long")).select(*KEY, "at", "part", "chars", "whole", "open", "head_at", "head_part", *_SHELF))
    plain = rows.select(*KEY, "at", "part", "chars", "whole", "open")
    heads, before = rows.drop("chars", "whole", "open"), rows.select(*KEY).distinct().withColumns({n: F.lit(None).cast(t) for n, t in (x.split() for x in SHELF.split(", "))})
    while True:
        after = heads.select(*KEY, *_SHELF).distinct().withColumn("range", F.col("range") + 1)
        now = stored(rows.select(*KEY).distinct().join(after, KEY, "left"))
        same = [F.coalesce(F.col(f"x.{n}"), F.lit(0)) == F.coalesce(F.col(f"y.{n}"), F.lit(0)) for n in _SHELF]
        changed = now.alias("x").join(before.alias("y"), KEY).where(~_all(same)).select(*KEY, *[F.col(f"x.{n}").alias(n) for n in _SHELF])
        if changed.isEmpty():
            first = rows.select("book", "run", "at", "part", F.col("head_at").alias("was_at"), F.col("head_part").alias("was_part"))
            moved = heads.select("book", "run", "at", "part", "head_at", "head_part").join(first, ["book", "run", "at", "part"])
            return moved.where("head_at <> was_at or head_part <> was_part").drop("was_at", "was_part")
        again = plain.join(changed, KEY).groupBy(*KEY).applyInPandas(_heads(limits), f"{PLACE}, at long, part int, head_at long, head_part int, {SHELF}")
        heads = stored(heads.join(changed.select(*KEY), KEY, "left_anti").unionByName(again))
        before = now


_SHELF = [x.split()[0] for x in SHELF.split(", ")]


def _all(conditions: list):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def pack_chunks(units: DataFrame, chunk_tokens: int = 700, overlap_tokens: int = 120, min_tokens: int = 60, range_units: int | None = None, ready: bool = False) -> DataFrame:
    """Chunks (book, ordinal, id, chapter, section, page_start, page_end, token_count, text) of units (book,
    unit, chapter, section, page_start, page_end, text, page_marks), which are ``ready`` if they are cheap to read again."""
    limits, size = Limits(chunk_tokens, overlap_tokens, min_tokens), range_units or RANGE_UNITS
    halo = chunk_tokens // 3 + 2  # a unit and what parts it from the next cost three at least
    size = max(size, halo)
    plain = units.select("book", "unit", F.coalesce("chapter", F.lit("")).alias("chapter"), F.coalesce("section", F.lit("")).alias("section"), "page_start", "page_end", F.coalesce("text", F.lit("")).alias("text"), "page_marks")
    placed = stored(carried(plain, ["book"], ["unit"], sums={"nth": F.lit(1).cast("long")}, changes={"run": F.col("chapter")}, ready=ready))
    runs_ = placed.groupBy("book", "run").agg(F.min("nth").alias("start"), F.count("*").alias("n"), F.max("chapter").alias("chapter"))
    lasts = runs_.groupBy("book").agg(F.max("run").alias("last_run"))
    known = stored(runs_.join(lasts, "book").withColumn("closing", F.col("run") == F.col("last_run")).withColumn("ranges", F.ceil(F.col("n") / size)).drop("last_run"))
    rows = placed.join(known.drop("chapter", "ranges"), ["book", "run"]).withColumn("i", F.col("nth") - F.col("start")).drop("nth", "start", "unit")
    own = F.floor(F.col("i") / size).cast("long")
    # the first units of a range also stand behind the one before it
    both = F.when((own > 0) & (F.col("i") % size < halo), F.array(own, own - 1)).otherwise(F.array(own))
    rows = rows.withColumn("range", F.explode(both)).withColumn("halo", F.col("range") != own)
    long = known.where("ranges > 1").select("book", "run", "ranges")
    long = stored(long)
    crossing = not long.isEmpty()
    if crossing:
        entries = _entries(rows, long, limits)
        entered = rows.join(entries, KEY, "left")
    else:
        entered = rows.withColumns({n: F.lit(None).cast(t) for n, t in (x.split() for x in STATE.split(", "))})
    made = stored(entered.groupBy(*KEY).applyInPandas(_drafts(limits), DRAFT))
    parts = made.drop(*_SHELF)
    if crossing:
        # stored, as few belong elsewhere, and Spark sees then that they are few
        moved = stored(_settled(made, long, limits).withColumnsRenamed({"head_at": "to_at", "head_part": "to_part"}))
        parts = parts.join(moved, ["book", "run", "at", "part"], "left").withColumns({"head_at": F.coalesce("to_at", "head_at"), "head_part": F.coalesce("to_part", "head_part")})
    listed = F.array_sort(F.collect_list(F.struct("at", "part", "text", "sections", "first", "last")))
    chunks = parts.groupBy("book", "run", "head_at", "head_part").agg(listed.alias("x")).join(known.select("book", "run", "chapter"), ["book", "run"])
    chunks = chunks.select(
        "book", "run", "head_at", "head_part", "chapter",
        section_label(F.flatten(F.transform("x", lambda d: d["sections"]))).alias("section"),
        F.get("x", F.lit(0))["first"].alias("page_start"),
        F.array_max(F.transform("x", lambda d: d["last"])).alias("page_end"),
        F.array_join(F.transform("x", lambda d: d["text"]), GLUE).alias("text"),
    )
    # numbers are found without the texts, which stay where they were put together
    keys = stored(parts.select("book", "run", "head_at", "head_part").distinct())
    numbers = stored(carried(keys, ["book"], ["run", "head_at", "head_part"], sums={"ordinal": F.lit(1)}, ready=True))
    numbered = chunks.join(numbers, ["book", "run", "head_at", "head_part"])
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int")
    return numbered.select("book", F.col("ordinal").cast("int").alias("ordinal"), F.format_string("%s::%05d", "book", F.col("ordinal").cast("int")).alias("id"), "chapter", "section", "page_start", "page_end", tokens.alias("token_count"), "text")
