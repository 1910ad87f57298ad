"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure sets one bit, and the measurements
stand beside the bits. Versioned policies are masks over the bits, and ablations come from
counting distinct bitmasks and combining them bitwise. Only DataFrame functions are used,
and nothing is shuffled but the counts of an ablation.

A word is a run of characters other than space and the control characters 9 to 13.

Defined cases. Null or empty text, or one without words: all measurements 0, and only the
rule on few words fails. Repeated rows are judged alike. Empty table: empty result. Texts
are measured whole, whatever their length. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Rules in the order of their bits; each is the SQL condition of failure over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "symbols": "100 * n_symbols > 30 * n_words",
    "short_words": "n_words > 0 and word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "exclamations": "100 * n_exclamations > 50 * n_words",
}
BASE = ("few_words", "repeated_windows")

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "repeated_lines", "symbols"),
    "v3": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found at two or more places."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(p, j)["h"] == F.get(p, k)["h"], F.lit(False))
            found = F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(p, j)["i"])), lambda i: i.isNotNull())
            start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("total"))
            step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(width), i - acc["last"])).alias("total"))
            return F.aggregate(F.sort_array(found), start, step, lambda acc: acc["total"])

        return _let(pairs, places)

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        whole = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(whole)

    return _let(words, count)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements of each document."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)).alias("w"))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    long = lambda c: c.cast("long")
    return rows.select(
        "doc_id",
        long(F.size("w")).alias("n_words"),
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.regexp_count("t", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.regexp_count("t", F.lit("!"))).alias("n_exclamations"),
    )


def ledger(docs: DataFrame, policy: str = "v2", **columns: str) -> DataFrame:
    """Measurements, ``failures`` (the bitmask) and the verdict of a policy. A document that
    fails a base rule is never kept."""
    bits = sum((F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)) for k, cond in enumerate(RULES.values())), F.lit(0)).cast("long")
    judged = measure(docs, **columns).withColumn("failures", bits)
    return judged.withColumns({"base_failed": F.col("failures").bitwiseAND(F.lit(mask(BASE))) != 0, "kept": F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]) | mask(BASE))) == 0})


def verdicts(judged: DataFrame) -> DataFrame:
    """The ledger with ``kept_<version>``, the verdict of every policy."""
    return judged.withColumns({f"kept_{k}": F.col("failures").bitwiseAND(F.lit(mask(rules) | mask(BASE))) == 0 for k, rules in POLICIES.items()})


def ablations(judged: DataFrame) -> DataFrame:
    """For each rule of each policy: documents that fail it, those that fail it alone and would
    be kept without it, and those that the policy without it keeps. The ledger's bitmasks are
    counted once, at most 2 ** rules rows; all else is bitwise arithmetic on them."""
    seen = judged.groupBy("failures").agg(F.count("*").alias("n"))
    cases = [F.struct(F.lit(k).alias("policy"), F.lit(name).alias("rule"), F.lit(mask((name,))).cast("long").alias("bit"), F.lit(mask(rules)).cast("long").alias("all_bits")) for k, rules in POLICIES.items() for name in rules]
    one = seen.select("failures", "n", F.explode(F.array(*cases)).alias("x")).select("failures", "n", "x.*")
    caught = F.col("failures").bitwiseAND(F.col("all_bits"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))
    return one.groupBy("policy", "rule").agg(
        total(caught.bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(caught == F.col("bit")).alias("regained_without"),
        total(caught.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select *, case when len(w) < 5 then [] else list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) end as g from w),
p as (select doc_id, unnest(g) as x, generate_subscripts(g, 1) as i from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as c from p) where c > 1),
c as (select doc_id, count(distinct i + k) as n from r, (select unnest(range(0, 5)) as k) group by doc_id),
m as (select g.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
             len(l)::bigint as n_lines, (length(t) - length(replace(t, '!', '')))::bigint as n_exclamations
      from g left join c using (doc_id)),
f as (select *, ({bits})::bigint as failures from m)
select *, (failures & 3) <> 0 as base_failed, (failures & {mask}) = 0 as kept, {versions} from f
"""


def oracle(policy: str = "v2") -> str:
    bits = " + ".join(f"(case when {cond} then {1 << k} else 0 end)" for k, cond in enumerate(RULES.values()))
    versions = ", ".join(f"(failures & {mask(rules) | mask(BASE)}) = 0 as kept_{k}" for k, rules in POLICIES.items())
    return ORACLE.replace("{bits}", bits).replace("{mask}", str(mask(POLICIES[policy]) | mask(BASE))).replace("{versions}", versions)


def ablations_oracle() -> str:
    """Each policy without each of its rules, judged anew over the measurements."""
    parts = []
    for k, rules in POLICIES.items():
        for name in rules:
            rest = " or ".join(f"({RULES[x]})" for x in rules if x != name)
            parts.append(f"select '{k}' as policy, '{name}' as rule, count(*) filter (where {RULES[name]})::bigint as failing, count(*) filter (where ({RULES[name]}) and not ({rest}))::bigint as regained_without, count(*) filter (where not ({rest}))::bigint as kept_without from j")
    return f"with j as materialized ({oracle()}) " + " union all ".join(parts)
