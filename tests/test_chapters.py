"""Chapters, sections, nested outlines and manifests with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import blocks, chapters, manifest
from foliant.plans import chapter_queries

LINE = "book string, page long, pos long, line string"
HEAD = "book string, page long, pos long, level long, label string, title string"


def heads(spark, rows):
    return spark.createDataFrame([(b, p, k, level, t, t) for b, p, k, level, t in rows], HEAD)


def test_lines_fall_to_the_heading_before_them(spark):
    """A chapter over many bins, one within a page, headings on one line after another, books without headings."""
    lines = [("a", p, k, f"{p}.{k}") for p in range(1, 41) for k in range(3)] + [("b", 5, 0, "only line")]
    found = heads(spark, [("a", 2, 1, 1, "One"), ("a", 30, 0, 2, "Two"), ("a", 30, 1, 2, "Three")])
    rows = chapters.chapter_lines(spark.createDataFrame(lines, LINE), found).collect()
    by = {(r.book, r.line): r.n for r in rows}
    assert len(rows) == len(by) == 121 - 3
    for b, p, k, t in lines:
        at = (p, k)
        want = None if b == "a" and at in ((2, 1), (30, 0), (30, 1)) else 0 if b == "b" or at < (2, 1) else 1 if at < (30, 0) else 3
        assert by.get((b, t)) == want
    sizes = {(r.book, r.n): r for r in chapters.chapters(spark.createDataFrame(lines, LINE), found).collect()}
    assert (sizes["a", 1].start_page, sizes["a", 1].end_page) == (2, 40) and (sizes["a", 2].start_page, sizes["a", 2].end_page) == (30, 30)
    assert sizes["a", 2].lines == 0 and ("a", 0) not in sizes and sizes["b", 0].label == chapters.FRONT


def test_a_concept_is_led_to_its_section(spark):
    """The section with all below it; the first of its name; the book where none has it."""
    lines = spark.createDataFrame([("a", 1, k, f"line {k}") for k in range(10)], LINE)
    found = heads(spark, [("a", 1, 1, 2, "Chapter 1: Cells"), ("a", 1, 3, 3, "1.1 Walls"), ("a", 1, 5, 2, "Chapter 2: Energy"), ("a", 1, 8, 3, "1.1 Walls")])
    asked = spark.createDataFrame([("x", "a", "chapter 1: cells"), ("y", "a", "1.1 Walls"), ("z", "a", "Chapter Three, On Flux"), ("w", "a", None)], "concept string, book string, section string")
    rows = chapters.section_source(lines, found, asked).collect()
    got = {c: sorted(r.pos for r in rows if r.concept == c) for c in "xyzw"}
    assert got == {"x": [2, 3, 4], "y": [4], "z": list(range(10)), "w": list(range(10))}


def sections(spark, texts):
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "doc string, pos long, line string")
    return chapters.section_tree(df).orderBy("section").collect()


def test_levels_are_compressed_and_paths_known(spark):
    got = sections(spark, [
        "Part One: Foundations", "An opening paragraph about the foundations of the subject, long enough to count.", "Chapter 1: Cells", "A paragraph about cells and the way they are organised.",
        "1.1 Membranes", "A paragraph about membranes, their structure, and the transport across them.", "Chapter 2: Energy", "A paragraph about energy, respiration and the way a cell pays for its work.",
    ])
    assert [r.level for r in got] == [1, 2, 3, 2]
    assert got[2].path == "Part One: Foundations > Chapter 1: Cells > 1.1 Membranes"
    assert got[1].total_chars > got[1].chars and got[0].total_chars > got[1].total_chars == got[1].chars + got[2].chars
    deep = sections(spark, ["1.1 Names", "some prose that is no heading at all.", "2 Later", "more of the prose, which goes on.", "2.1 Below", "and the end of it."])
    assert [r.level for r in deep] == [1, 1, 2]


def test_texts_without_structure(spark):
    assert sections(spark, [f"Paragraph {k} runs on for a while and does not look like a heading in any way." for k in range(8)]) == []
    assert sections(spark, [f"Some Title Case Line {'I' * (k + 1)}" for k in range(10)]) == []


@pytest.mark.parametrize("depth", [1, 3, 12])
def test_flatten_after_nest_is_the_identity(spark, depth):
    levels = [k + 1 for k in range(depth)] + [1, 3, 2, 2] + [k + 1 for k in range(depth)]
    rows = spark.createDataFrame([("d", n, x, f'Title "{n}", {{[\\') for n, x in enumerate(levels)] + [("e", 0, 4, "one")], "doc string, n long, level long, title string")
    out = chapters.nested(rows, "doc", "n", ["title", "level"])
    for r in out.collect():
        json.loads(r.outline)
    back = chapters.flattened(out, "doc", "outline", {"title": "string", "level": "long"}).orderBy("doc", "n").collect()
    assert [(r.title, r.level) for r in back if r.doc == "d"] == [(f'Title "{n}", {{[\\', x) for n, x in enumerate(levels)]
    stack, want = [], []
    for x in levels:
        stack = [y for y in stack if y < x] + [x]
        want.append(len(stack))
    assert [r.depth for r in back if r.doc == "d"] == want
    plans = chapters.flattened(out, "doc", "outline", {"title": "string"})._jdf.queryExecution().optimizedPlan().toString()
    assert plans.count("UnionLoop ") == 1  # one loop, whatever the depth


def test_nothing_to_flatten(spark):
    rows = spark.createDataFrame([("a", "[]"), ("b", None), ("c", "no json")], "doc string, outline string")
    assert chapters.flattened(rows, "doc", "outline", {"title": "string"}).count() == 0


def document(spark):
    kinds = [("heading", 1, "Part One"), ("paragraph", 0, "x" * 300), ("heading", 2, "Chapter 1"), ("paragraph", 0, "y" * 300), ("footnote", 0, "a note"), ("heading", 2, "Chapter 2"), ("table", 0, "| a |"), ("figure", 0, "**[image]**"), ("paragraph", 0, "z" * 900), ("paragraph", 0, "w" * 50)]
    rows = [("d", k, kind, level, text, 1 + k // 3) for k, (kind, level, text) in enumerate(kinds)]
    return blocks.markdown(spark.createDataFrame(rows, "doc string, seq long, kind string, level long, text string, page long"))


def test_sections_and_chunks_of_a_document(spark):
    md = document(spark)
    found = manifest.sections(md).orderBy("n").collect()
    assert [(r.id, r.page_start, r.page_end, list(r.path)) for r in found] == [("s001", 1, 4, ["Part One"]), ("s002", 1, 1, ["Part One", "Chapter 1"]), ("s003", 2, 4, ["Part One", "Chapter 2"])]
    pieces = manifest.chunk_map(md, 800, 400).orderBy("id").collect()
    assert [(r.id, r.path, r.part, r.parts, list(r.headings)) for r in pieces] == [("c001", "Part One", 1, 1, ["Part One", "Chapter 1"]), ("c002", "Part One › Chapter 2", 1, 2, ["Chapter 2"]), ("c003", "Part One › Chapter 2", 2, 2, [])]
    whole = blocks.rendered(md).first().markdown
    note = md.filter("kind = 'footnote'").first()
    assert all(r.md_end <= note.md_start for r in pieces) and whole[pieces[1].md_start :].startswith("## Chapter 2")


def test_the_whole_manifest(spark):
    md = document(spark)
    titles = spark.createDataFrame([("d", 'A "title"')], "doc string, title string")
    got = json.loads(manifest.manifests(md, titles, target=800).first().manifest)
    assert got["document"] == {"title": 'A "title"', "page_count": 4, "chars": md.agg(F.sum(F.length("text"))).first()[0], "block_index": "structural"}
    assert got["counts"] == {"blocks": 10, "headings": 3, "paragraphs": 4, "lists": 0, "tables": 1, "figures": 1, "formulas": 0, "footnotes": 1, "chunks": 3}
    assert got["outline"][0]["title"] == "Part One" and [c["title"] for c in got["outline"][0]["children"]] == ["Chapter 1", "Chapter 2"]
    assert [b["id"] for b in got["blocks"]] == ["b0001", "b0003", "b0005", "b0006", "b0007", "b0008"] and got["blocks"][4]["ref"] == "t001"
    assert [t["id"] for t in got["tables"]] == ["t001"] and got["figures"][0]["page"] == 3 and [p["number"] for p in got["pages"]] == [1, 2, 3, 4]
    full = json.loads(manifest.manifests(md, full=True).first().manifest)
    assert len(full["blocks"]) == 10 and full["document"]["title"] == "Document"


@pytest.mark.parametrize("name", ["chapter_sizes", "section_source", "section_tree", "manifest_sections"])
def test_what_follows_is_not_read_anew_for_every_heading(spark, sf, name):
    plan = chapter_queries.QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "specifiedwindowframe(RowFrame" in plan and "RowFrame, 1, unboundedfollowing" not in plan
