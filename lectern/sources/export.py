"""Papers as Markdown, JSON and DOCX; reports as JSON; uploaded files."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.books import SUFFIXES


def marks_note(attempt: Column, count: Column, marks: Column) -> Column:
    k = F.when(attempt > 0, attempt).otherwise(count)
    lead = F.when((attempt > 0) & (attempt < count), F.format_string("answer %d of %d questions", attempt, count)).otherwise(F.format_string("%d questions", count))
    return F.concat(lead, F.format_string(" × %d marks = %d marks", marks, k * marks))


def to_markdown(questions: DataFrame, with_key: bool = True) -> DataFrame:
    """(paper, markdown): sections in order of their first question; without the key, no answers."""
    letters = F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda o, i: F.concat(F.lit("   "), F.char(F.lit(65) + i), F.lit(") "), o))
    key = F.concat(F.lit("\n   Answer: "), F.coalesce("correct_option", "answer", F.lit(""))) if with_key else F.lit("")
    body = F.concat(F.format_string("%d. %s [%d]", "number", "text", "marks"), F.when(F.size(letters) > 0, F.concat(F.lit("\n"), F.array_join(letters, "\n"))).otherwise(""), key)
    rows = questions.select("paper", "section", "number", body.alias("body"))
    parts = rows.groupBy("paper", "section").agg(F.min("number").alias("first"), F.array_sort(F.collect_list(F.struct("number", "body"))).alias("q"))
    part = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"), F.array_join(F.transform("q", lambda r: r["body"]), "\n\n"))
    return parts.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("first", part.alias("part")))).alias("p")).select("paper", F.array_join(F.transform("p", lambda r: r["part"]), "\n\n").alias("markdown"))


def to_json(questions: DataFrame, with_key: bool = True) -> DataFrame:
    shown = questions if with_key else questions.drop("answer", "correct_option", "verify_notes")
    return shown.select("paper", "number", F.to_json(F.struct(*shown.columns)).alias("json"))


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def docx(markdown: str) -> bytes:
    """A DOCX file of lines; those that begin with ``#`` are headings of that depth."""

    def paragraph(line: str) -> str:
        depth = len(line) - len(line.lstrip("#"))
        style = f'<w:pPr><w:pStyle w:val="Heading{min(depth, 9)}"/></w:pPr>' if depth and line[depth : depth + 1] == " " else ""
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(line[depth:].strip() if style else line)}</w:t></w:r></w:p>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, text)
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_WORD}"><w:body>{"".join(map(paragraph, markdown.splitlines()))}</w:body></w:document>')
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _docx(batch: pd.Series) -> pd.Series:
    return batch.map(lambda t: docx(t or ""))


def to_docx(questions: DataFrame, with_key: bool = True) -> DataFrame:
    """(paper, docx): the same content as ``to_markdown``."""
    return to_markdown(questions, with_key).select("paper", _docx(F.col("markdown")).alias("docx"))


def save_report(report: DataFrame, path: str) -> None:
    """A report as lines of JSON; metrics without cases are null, not left out."""
    report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_upload(folder: str, name: str, data: bytes) -> str:
    """Put an uploaded book into a folder: ``saved``, ``same`` if it is there already, or why not. A
    file is never replaced by another, and appears whole or not at all."""
    target = Path(folder) / os.path.basename(name)
    if target.suffix.lower().lstrip(".") not in SUFFIXES:
        return "unknown suffix"
    if target.exists():
        return "same" if hashlib.sha256(target.read_bytes()).digest() == hashlib.sha256(data).digest() else "another file of that name"
    part = target.with_name(f".{target.name}.{os.getpid()}.part")
    part.write_bytes(data)
    try:
        os.link(part, target)  # fails if the name has been taken meanwhile
    except FileExistsError:
        return "another file of that name"
    finally:
        part.unlink()
    return "saved"
