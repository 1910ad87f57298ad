"""JSON in the replies of language models, and the question items they hold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import repair_escapes, strip_sources, strip_thinking, stripped


def _valid(text: Column) -> Column:
    """The text if it is JSON other than null; with its escapes repaired, if it is so."""
    candidates = [F.when(F.try_parse_json(t).isNotNull() & (stripped(t) != "null"), t) for t in (repair_escapes(text), text)]
    return F.coalesce(*candidates)


def reply_json(reply: Column) -> Column:
    """The JSON text of a reply, or null: what a fence holds, else the whole, else the outermost
    object, else the outermost array. What was thought aloud does not count."""
    said = stripped(strip_thinking(reply))
    body = F.when(said.rlike(r"(?s)```.*?```"), stripped(F.regexp_extract(said, r"(?s)```(?:json)?\s*(.*?)```", 1))).otherwise(said)
    outermost = [F.regexp_extract(body, pattern, 0) for pattern in (r"(?s)\{.*\}", r"(?s)\[.*\]")]
    return F.coalesce(_valid(body), *[_valid(F.nullif(x, F.lit(""))) for x in outermost])


ITEM = "array<struct<text:string,options:array<string>,correct_option:string,answer:string,topic:string,bloom:string,source_ids:array<string>>>"


def question_items(reply: Column, most: Column, topic: Column, bloom: Column) -> Column:
    """Question items of a reply: a list, or the list or single object under ``questions``. Of the
    first ``most`` objects those with a text count; blank options go, and what an item leaves out
    is taken from the slot."""
    body = reply_json(reply)
    held = F.when(stripped(body).startswith("{"), F.get_json_object(body, "$.questions")).otherwise(body)
    listed = F.when(stripped(held).startswith("{"), F.concat(F.lit("["), held, F.lit("]"))).when(stripped(held).startswith("["), held)
    objects = F.filter(F.from_json(listed, "array<string>"), lambda x: stripped(x).startswith("{"))
    said = lambda x, name: stripped(F.coalesce(F.get_json_object(x, f"$.{name}"), F.lit("")))
    texts = lambda x, name: F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object(x, f"$.{name}"), "array<string>"), F.array().cast("array<string>")), stripped), lambda o: o != "")

    def item(x: Column) -> Column:
        fallback = lambda name, other: F.coalesce(F.nullif(said(x, name), F.lit("")), other)
        return F.struct(
            strip_sources(said(x, "text")).alias("text"),
            texts(x, "options").alias("options"),
            F.coalesce(F.get_json_object(x, "$.correct_option"), F.lit("")).alias("correct_option"),
            said(x, "answer").alias("answer"),
            fallback("topic", topic).alias("topic"),
            F.lower(fallback("bloom", bloom)).alias("bloom"),
            texts(x, "source_ids").alias("source_ids"),
        )

    items = F.transform(F.slice(objects, F.lit(1), most), item)
    return F.coalesce(F.filter(items, lambda q: q["text"] != ""), F.lit(None).cast(ITEM), F.array().cast(ITEM))


def without_thinking(pieces: Iterable[str], opened: str = "<think>", closed: str = "</think>") -> Iterator[str]:
    """A stream of text without what stands between the marks, which may be cut anywhere. Of what is
    held back, only a beginning that could still become a mark waits for the next piece."""
    held, inside = "", False
    for piece in pieces:
        held += piece
        while held:
            mark = closed if inside else opened
            at = held.find(mark)
            if at < 0:
                keep = next((n for n in range(min(len(mark) - 1, len(held)), 0, -1) if mark.startswith(held[-n:])), 0)
                if not inside and len(held) > keep:
                    yield held[: len(held) - keep]
                held = held[len(held) - keep :]
                break
            if not inside and at:
                yield held[:at]
            held, inside = held[at + len(mark) :], not inside
    if held and not inside:
        yield held
