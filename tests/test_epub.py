"""EPUB files: documents in the order of the spine, read by many tasks; bad ones are reported."""

import io
import zipfile

import pytest

from lectern.sources import books

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'


def epub(pages, order=None, broken=False):
    """An archive of (name, html) documents; ``order`` is that of the spine."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if order is not None:
            z.writestr("META-INF/container.xml", CONTAINER)
            items = "".join(f'<item id="i{k}" href="{name}"/>' for k, (name, _) in enumerate(pages))
            refs = "".join(f'<itemref idref="i{k}"/>' for k in order)
            z.writestr("OPS/p.opf", "<oops" if broken else f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for name, html in pages:
            z.writestr(f"OPS/{name}", html)
    return out.getvalue()


@pytest.fixture
def found(spark, tmp_path):
    many = [(f"c{k:03d}.xhtml", f"<h1>Chapter {k}</h1><p>Line one of {k}.</p><p>Line two of {k}.</p>" if k != 3 else "<div></div>") for k in range(40)]
    made = {
        "many": epub(many, list(range(39, -1, -1))),
        "plain": epub([("b.html", "<p>second</p>"), ("a.htm", "<h2>first</h2>")]),
        "spoiled": epub([("b.html", "<p>two</p>"), ("a.html", "<p>one</p>")], [0, 1], broken=True),
        "silent": epub([("a.html", "<div>no block</div>")]),
        "nothing": epub([]),
        "bad": b"no archive",
    }
    for name, data in made.items():
        (tmp_path / f"{name}.epub").write_bytes(data)
    (tmp_path / "t.txt").write_text("plain text")
    return books.read_blocks(books.discover(spark, str(tmp_path)))


def test_documents_of_the_spine_in_order(found):
    rows = found.collect()
    own = {}
    for r in sorted(rows, key=lambda r: (r.path, r.line_no or 0)):
        own.setdefault(r.path.rsplit("/", 1)[1].split(".")[0], []).append(r)
    many = own["many"]
    want = [k for k in range(39, -1, -1) if k != 3]
    assert [r.line_no for r in many] == list(range(3 * 39))
    assert [(r.page, r.text) for r in many[::3]] == [(i, f"Chapter {k}") for i, k in enumerate(want, 1)]
    assert all((r.level, r.bold, r.size) == ((1, True, 20.0) if i % 3 == 0 else (None, False, 11.0)) for i, r in enumerate(many))
    assert [(r.page, r.line_no, r.text, r.level) for r in own["plain"]] == [(1, 0, "first", 2), (2, 1, "second", None)]
    assert [r.text for r in own["spoiled"]] == ["one", "two"]
    assert {n: [(r.text, r.problem) for r in own[n]] for n in ("silent", "nothing", "bad")} == {"silent": [(None, "no text")], "nothing": [(None, "no text")], "bad": [(None, "not a zip archive")]}
    assert [r.text for r in own["t"]] == ["plain text"]


def test_limits_hold_before_anything_is_unpacked(spark, tmp_path, monkeypatch):
    (tmp_path / "a.epub").write_bytes(epub([(f"{k}.html", "<p>x</p>") for k in range(9)]))
    monkeypatch.setattr(books, "MOST_MEMBERS", 5)
    assert [r.problem for r in books.read_blocks(books.discover(spark, str(tmp_path))).collect()] == ["9 members"]


def test_documents_are_parsed_in_many_tasks(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub([(f"{k:02d}.html", f"<p>{k}</p>") for k in range(30)]))
    files = books.discover(spark, str(tmp_path))
    members = books._dealt(files)
    assert members.rdd.glom().filter(len).count() > 1
