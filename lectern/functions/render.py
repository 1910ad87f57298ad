"""Texts made of results: summaries, questions, keywords, safe Markdown."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _percent(x: Column, digits: int, missing: str) -> Column:
    return F.when(x.isNull(), missing).otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def retrieval_summary(n: Column, hit1: Column, hit3: Column, hitk: Column, mrr: Column, refusals: Column) -> Column:
    parts = [F.format_string("n=%d", n), *(F.concat(F.lit(f"{name}="), _percent(x, 1, "n/a")) for name, x in (("Hit@1", hit1), ("Hit@3", hit3), ("Hit@k", hitk))), F.format_string("MRR=%.3f", mrr), F.concat(F.lit("refusals="), _percent(refusals, 1, "n/a"))]
    return F.when(n == 0, "n=0: nothing evaluated").otherwise(F.concat_ws("  ", *parts))


def gold_summary(row: dict[str, Column]) -> Column:
    """Lines on a summary of gold cases; a metric without cases reads n/a."""
    p = lambda name: _percent(row[name], 0, "n/a")
    lines = [
        F.format_string("cases %d, errors %d, unreviewed %d", row["n"], row["errors"], row["unreviewed"]),
        F.concat(F.lit("answerable: answered "), p("answer_rate"), F.lit(", right page cited "), p("cited_page_hit"), F.lit(", retrieved "), p("context_page_hit"), F.lit(", keywords "), p("keyword_recall")),
        F.concat(F.lit("unanswerable: refused "), p("correct_refusal_rate")),
        F.when(row["unreviewed"] > 0, "some cases are unreviewed drafts: provisional"),
    ]
    return F.concat_ws("\n", *lines)


# Fixed value: how a question's key is said.
KEY_LINE = "\nStated correct answer: "


def full_question(text: Column, options: Column, correct: Column) -> Column:
    """A question with lettered options and its stated key."""
    shown = F.transform(options, lambda o, i: F.concat(F.lit("  "), F.char(F.lit(65) + i), F.lit(") "), o))
    return F.when(F.size(F.coalesce(options, F.array().cast("array<string>"))) > 0, F.concat(text, F.lit("\n"), F.array_join(shown, "\n"), F.lit(KEY_LINE), F.coalesce(correct, F.lit("")))).otherwise(text)


def style_note(instructions: Column, guide: Column, examples: Column, feedback: Column) -> Column:
    """What a question is to be like: the parts that say anything, with a blank line between them."""
    shown = F.when(F.size(examples) > 0, F.concat(F.lit("Examples of the style:\n"), F.array_join(F.transform(examples, lambda e: F.concat(F.lit("- "), e)), "\n")))
    return F.concat_ws("\n\n", *[F.nullif(F.trim(p), F.lit("")) for p in (instructions, guide)], shown, F.nullif(F.trim(feedback), F.lit("")))


def filled(template: str, **values: Column) -> Column:
    """A prompt made of a template with ``{names}`` (doubled braces stand for themselves); a null
    value is empty, and a name without a value is an error before anything runs."""
    parts = [F.lit("")]
    for plain, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(plain))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def row_json(*columns: str) -> Column:
    """A row as a JSON object, fields without a value included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def gold_keywords(keywords: Column, passage: Column, most: int = 4) -> Column:
    """Keywords that occur in the passage, each once whatever its case, in its first spelling."""
    trimmed = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: (k != "") & F.contains(F.lower(passage), F.lower(k)))
    lower = F.transform(trimmed, lambda k: F.lower(k))
    first = F.filter(trimmed, lambda k, i: F.array_position(lower, F.lower(k)) == i + 1)
    return F.slice(first, 1, most)


def split_for_context(text: Column, most: int = 18_000) -> Column:
    """Runs of whole lines of at most ``most`` characters; a longer line stands alone."""
    lines = F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(line) > most)
        return F.when(full, F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), line.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], line).alias("open")))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


_FENCED = r"(?sm)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\z)"


# What makes links and images, a line that could define one, and what opens an autolink.
LINK, NO_LINK = "](", "] ("
DEFINES = r"(?m)^((?:[ \t]*(?:>|[-+*](?=[ \t])|\d{1,9}[.)](?=[ \t])))*[ \t]*)\["
AUTOLINK = r"(?i)<(?=[a-z][a-z0-9+.-]{1,31}:[^\s<>]*>)"


def safe_markdown(text: Column) -> Column:
    """Links, images and autolinks disabled outside fenced blocks."""
    fenced = F.regexp_extract_all(text, F.lit(_FENCED), F.lit(0))
    open_ = F.split(F.regexp_replace(text, _FENCED, "\u0002"), "\u0002")

    def calm(piece: Column) -> Column:
        plain = F.regexp_replace(F.replace(piece, F.lit(LINK), F.lit(NO_LINK)), DEFINES, r"$1\\[")
        return F.regexp_replace(plain, AUTOLINK, r"\\<")

    return F.array_join(F.zip_with(F.transform(open_, lambda p: calm(p)), fenced, lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.coalesce(f, F.lit("")))), "")
