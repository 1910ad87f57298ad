"""Books as files: discovery, hashes, and readers by format.

Readers give blocks (path, page, line_no, text, size, bold, level, y). Plain text and Markdown are
read with built-in functions; zip formats by Arrow functions, after a check of the archive's directory: EPUB by
its documents, which many tasks parse, DOCX, which has one, by the file. PDF needs PyMuPDF, and is skipped with a reason without it.
"""

from __future__ import annotations

import io
import re
import subprocess
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.markup import BODY_SIZE, HTML_SIZES, blocks
from lectern.functions.text import book_id
from lectern.operators.ingest import text_blocks
from lectern.operators.ordered import carried
from lectern.sources.scratch import stored

SUFFIXES = ("pdf", "epub", "txt", "md", "docx")
MOST_MEMBERS, MOST_BYTES = 20_000, 2 << 30
BLOCKS = "path string, page int, line_no long, text string, size double, bold boolean, level int, y double, problem string"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Files of known suffixes, whatever their case, below a folder: path, suffix, sha, book_id, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    sha = F.sha2("content", 256)
    return files.withColumn("suffix", suffix(F.col("path"))).where(F.col("suffix").isin(*SUFFIXES)).select("path", "suffix", "length", sha.alias("sha"), book_id(F.col("path"), sha).alias("book_id"), "content")


def archive_problem(data: bytes) -> str | None:
    """Why an archive must not be opened, from its directory alone."""
    try:
        members = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except zipfile.BadZipFile:
        return "not a zip archive"
    if len(members) > MOST_MEMBERS:
        return f"{len(members)} members"
    total = sum(m.file_size for m in members)
    return f"{total} bytes unpacked" if total > MOST_BYTES else None


def _markup(document: str) -> list[tuple[str, float, bool, int | None]]:
    return [(text, HTML_SIZES.get(tag, BODY_SIZE), tag in HTML_SIZES, int(tag[1]) if tag in HTML_SIZES else None) for tag, text in blocks(document)]


def epub_documents(data: bytes) -> Iterator[bytes]:
    """The documents of the spine, one at a time."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = [n for n in z.namelist() if re.search(r"\.x?html?$", n, re.IGNORECASE)]
    try:
        root = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
        package, base = ET.fromstring(z.read(opf)), opf.rpartition("/")[0]
        items = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
        spine = [items[e.get("idref")] for e in package.iter() if e.tag.endswith("}itemref")]
        names = [f"{base}/{n}".lstrip("/") for n in spine]
    except (KeyError, StopIteration, ET.ParseError):
        names.sort()
    there = set(z.namelist())
    yield from (z.read(n) for n in names if n in there)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Sizes of headings one and two, and of all others.
DOCX_SIZES, DOCX_HEADING = {1: 18.0, 2: 16.0}, 14.0


def _paragraph(e: ET.Element) -> str:
    said = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(t.text or "" if t.tag == f"{_W}t" else said.get(t.tag, "") for t in e.iter()).strip()


def _table_rows(table: ET.Element) -> Iterator[str]:
    """Rows of a table as their cells' texts. A cell merged over columns counts once in a row; one
    merged over rows counts in each of them."""
    above: dict[int, str] = {}
    for row in table.findall(f"{_W}tr"):
        cells, column = [], 0
        for cell in row.findall(f"{_W}tc"):
            span, merged = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            text = " ".join(" ".join(_paragraph(p) for p in cell.findall(f"{_W}p")).split())
            if merged is not None and merged.get(f"{_W}val") != "restart":
                text = above.get(column, text)
            width = int(span.get(f"{_W}val") or 1) if span is not None else 1
            above |= dict.fromkeys(range(column, column + width), text)
            column += width
            cells.append(text)
        if any(cells):
            yield " | ".join(c for c in cells if c)


def read_docx(data: bytes) -> list[list[tuple]]:
    """One page: paragraphs in order, headings by style, tables as rows of cells."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out: list[tuple] = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p" and _paragraph(e):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            m = re.search(r"heading\s*(\d)", name)
            level = int(m[1]) if m else 1 if name == "title" else None
            out.append((_paragraph(e), BODY_SIZE if not level else DOCX_SIZES.get(level, DOCX_HEADING), bool(level), level or None))
        elif e.tag == f"{_W}tbl":
            out += [(row, BODY_SIZE, False, None) for row in _table_rows(e)]
    return [out] if out else []


def read_pdf(data: bytes) -> list[list[tuple]]:
    import fitz  # PyMuPDF

    pages = []
    with fitz.open(stream=data, filetype="pdf") as book:
        for page in book:
            lines = [ln for b in page.get_text("dict")["blocks"] for ln in b.get("lines", ())]
            rows = [("".join(s["text"] for s in ln["spans"]).strip(), round(max(s["size"] for s in ln["spans"]), 1), bool(ln["spans"][0]["flags"] & 16), None, float(ln["bbox"][1])) for ln in lines if ln["spans"]]
            pages.append([r for r in rows if r[0]])
    return pages


def contents(data: bytes) -> tuple[str, list[tuple[int, str, int]]]:
    """Title of a PDF, and (level, title, page) of its contents."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as book:
        return (book.metadata or {}).get("title") or "", [(int(e[0]), str(e[1]).strip(), int(e[2])) for e in book.get_toc() if e[1] and e[2] > 0]


READERS = {"docx": read_docx, "pdf": read_pdf}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, kind, data in zip(pdf["path"], pdf["suffix"], pdf["content"], strict=True):
            problem, pages = archive_problem(data) if kind != "pdf" else None, []
            if problem is None:
                try:
                    pages = READERS[kind](data)
                except Exception as e:  # a bad file is reported and does not stop the others
                    problem = f"{type(e).__name__}: {e}"[:200]
            found = [(k, *b) for k, p in enumerate(pages, 1) for b in p]
            rows = [(path, k, i, text, size, bold, level, top[0] if top else 0.0, None) for i, (k, text, size, bold, level, *top) in enumerate(found)]
            rows = rows or [(path, *[None] * 7, problem or "no text")]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])
            yield frame.astype({"page": "Int32", "line_no": "Int64", "level": "Int32", "bold": "boolean"})


MEMBER = "path string, k int, body binary, problem string"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of EPUB files as rows, unpacked but not parsed."""
    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            problem, n = archive_problem(data), 0
            try:
                for n, body in enumerate(epub_documents(data) if problem is None else (), 1):  # noqa: B007
                    yield pd.DataFrame({"path": [path], "k": [n], "body": [body], "problem": [None]})
            except Exception as e:  # a bad file is reported and does not stop the others
                problem = f"{type(e).__name__}: {e}"[:200]
            if problem or not n:
                yield pd.DataFrame({"path": [path], "k": [0], "body": [None], "problem": [problem or "no text"]})


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, k, body in zip(pdf["path"], pdf["k"], pdf["body"], strict=True):
            frame = pd.DataFrame([(path, k, j, *b) for j, b in enumerate(_markup(bytes(body).decode("utf-8", "ignore")))], columns=["path", "k", "j", "text", "size", "bold", "level"])
            yield frame.astype({"level": "Int32", "bold": "boolean", "k": "int32", "j": "int32", "size": "float64"})


def _dealt(files: DataFrame) -> DataFrame:
    """Documents of files, dealt to a number of tasks that their size on disk does not lower."""
    parts = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "content").mapInPandas(_members, MEMBER).repartition(parts, "path", "k")


def _epub_blocks(files: DataFrame) -> DataFrame | None:
    """Blocks of EPUB files: one task takes a file apart, after a check of its directory, and its documents
    are parsed by as many as there are. A page is a document that has text."""
    members = stored(_dealt(files.where("suffix = 'epub'")))
    if members.isEmpty():
        return None
    bad = members.where("problem is not null").select("path", "problem")
    good = members.where("problem is null").join(bad.select("path"), "path", "left_anti").select("path", "k", "body")
    found = stored(good.mapInPandas(_parsed, "path string, k int, j int, text string, size double, bold boolean, level int"))
    rows = carried(found, ["path"], ["k", "j"], sums={"nth": F.lit(1).cast("long")}, changes={"page": F.col("k")}, ready=True)
    rows = rows.select("path", F.col("page").cast("int").alias("page"), (F.col("nth") - 1).alias("line_no"), "text", "size", "bold", "level", F.lit(0.0).alias("y"), F.lit(None).cast("string").alias("problem"))
    silent = good.select("path").distinct().join(found.select("path"), "path", "left_anti").withColumn("problem", F.lit("no text"))
    return rows.unionByName(bad.distinct().unionByName(silent), allowMissingColumns=True)


def read_blocks(files: DataFrame) -> DataFrame:
    """Blocks of discovered files; a file that cannot be read gives one row with its problem."""
    plain = files.where(F.col("suffix").isin("txt", "md")).select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"))
    lines = text_blocks(plain).select("path", F.lit(1).alias("page"), F.col("line_no").cast("long").alias("line_no"), "text", "size", F.col("level").isNotNull().alias("bold"), "level", F.lit(0.0).alias("y"), F.lit(None).cast("string").alias("problem"))
    packed = lines.unionByName(files.where(F.col("suffix").isin(*READERS)).select("path", "suffix", "content").mapInPandas(_read, BLOCKS))
    epub = _epub_blocks(files)
    return packed if epub is None else packed.unionByName(epub)


def read_contents(files: DataFrame) -> DataFrame:
    """(path, title, seq, level, entry, page): the titles and contents of PDF files; a file without
    contents gives one row without an entry, one that cannot be read none (see ``read_blocks``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    title, entries = contents(data)
                except Exception:  # reported with its blocks
                    continue
                rows += [(path, title, i, *e) for i, e in enumerate(entries)] or [(path, title, 0, None, None, None)]
            yield pd.DataFrame(rows, columns=["path", "title", "seq", "level", "entry", "page"]).astype({"level": "Int32", "page": "Int32"})

    return files.where("suffix = 'pdf'").select("path", "content").mapInPandas(run, "path string, title string, seq int, level int, entry string, page int")


def ocr(files: DataFrame, command: tuple[str, ...] = ("ocrmypdf", "--force-ocr"), timeout: float = 3600.0) -> DataFrame:
    """(path, content, problem): PDF files as a program makes them that reads one path and writes
    another; what fails, or takes too long, is reported and does not stop the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                with tempfile.TemporaryDirectory() as folder:  # the task's own, gone when it is done
                    source, made = Path(folder) / "in.pdf", Path(folder) / "out.pdf"
                    source.write_bytes(data)
                    try:
                        subprocess.run([*command, str(source), str(made)], check=True, capture_output=True, timeout=timeout)
                        rows.append((path, made.read_bytes(), None))
                    except (OSError, subprocess.SubprocessError) as e:
                        rows.append((path, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "content", "problem"])

    return files.where("suffix = 'pdf'").select("path", "content").mapInPandas(run, "path string, content binary, problem string")
