"""Cases that are typed in: numerals, headings, tests of lines, tables, JSON that is cut short."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import blocks, lessons, structure

NUMERALS = {"7": 7, "12.": 12, "one": 1, "Third": 3, "IV": 4, "MCMXCIV": 1994, "ב": 2, "ג'": 3, 'כ"ה': 25, "שלישי": 3, "X": 10, "2024": 2024, "ראשונה": 1, "IX:": 9, "iv": None, "words": None, "": None, "cat": None}


def test_numerals(spark):
    rows = spark.createDataFrame([(t,) for t in NUMERALS], "t string")
    assert {r.t: r.n for r in rows.select("t", structure.numeral(F.col("t")).alias("n")).collect()} == NUMERALS


HEADINGS = {
    "Chapter 1: The start": (2, 1, "The start", "Chapter 1 — The start"), "Chapter Two": (2, 2, "", "Chapter 2"), "PART IV Beyond": (1, 4, "Beyond", "PART 4 — Beyond"), "Part of the plan": None, "Chapter which is long": None,
    "פרק 2 - מבוא": (2, 2, "מבוא", "פרק 2 — מבוא"), "פרק2 דבר": (2, 2, "דבר", "פרק 2 — דבר"), "Appendix A": (2, None, "A", "Appendix — A"), "section 3": (3, 3, "", "section 3"), "Unit one": (2, 1, "", "Unit 1"), "book Nine: End": (1, 9, "End", "book 9 — End"),
    "Chapters are many": None, "A plain line": None, "Chapter 9 " + "x" * 60 + ".": None,
}


def test_keyword_headings(spark):
    rows = spark.createDataFrame([(t,) for t in HEADINGS], "t string").select("t", structure.keyword_heading(F.col("t")).alias("h")).collect()
    assert {r.t: r.h and (r.h.level, r.h.number, r.h.title, r.h.label) for r in rows} == HEADINGS


def test_outline_headings(spark):
    want = {"1.2 Scope": (3, 1, "1.2 — Scope"), "1.2.3 Deeper still": (4, 1, "1.2.3 — Deeper still"), "3) Third": (2, 3, "3 — Third"), "1.4 lower case": None, "2.1 Ends with a stop.": None, "10.1.2.3 Deep": (4, 10, "10.1.2.3 — Deep"), "plain": None}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", structure.outline_heading(F.col("t")).alias("h")).collect()
    assert {r.t: r.h and (r.h.level, r.h.number, r.h.label) for r in rows} == want


LINES = {
    "is_page_number": (["42", "- 42 -", "xiv", "page 12", "p. 3", "3 / 12", "3 of 12", "3 מתוך 12", "עמ' 42", "mix"], ["Chapter 3", "in 1984", "", "12345", "a 12"]),
    "is_decoration": (["* * * *", "-----"], ["--", "a ---"]),
    "is_list_item": (["• item", "1. first", "iv) four", "a) one", "item•", "2.1 sub"], ["plain text"]),
    "is_caption": (["Figure 3: a map", "fig. 2 x", "Table of things", "תרשים 2: מפה"], ["Tables turn", "The figure above shows the rise."]),
    "is_contents_row": (["1.4 Intro ..... 27", "Chapter One   12", "part of it 7"], ["Chapter without", "in 1984"]),
}


@pytest.mark.parametrize("name", LINES)
def test_lines(spark, name):
    yes, no = LINES[name]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", getattr(T, name)(F.col("t")).alias("is")).collect()
    assert {r.t for r in rows if r["is"]} == set(yes)


def test_tables(spark):
    rows = spark.range(1).select(F.array().cast("array<string>").alias("h"), F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("1"))).alias("r"))
    got = rows.select(blocks.table_markdown(F.col("h"), F.col("r")).alias("md"), blocks.table_kept(F.col("r")).alias("kept")).first()
    assert got.md == "| a\\|b | c |\n| --- | --- |\n| 1 |  |" and got.kept


def test_json_that_is_cut_short():
    whole = {'```json\n{"a": [1, 2]}\n```': {"a": [1, 2]}, "[1,2,3": [1, 2], '{"xs":[1,2,3': {"xs": [1, 2]}, '[{"a":1},{"b":2': [{"a": 1}], 'x {"k": [1, {"z": 2}], "m"': {"k": [1, {"z": 2}]}}
    for text, want in whole.items():
        assert json.loads(lessons.repaired(text)) == want, text
    for text in (None, "", "no json", '{"a": "cut in a str', '{"title":"Some Ti', "}{", "[1"):
        assert lessons.repaired(text) is None, text
    full = '{"title":"A","concepts":[{"name":"x"},{"name":"y","parts":[1,2]},{"name":"z"}]}'
    for cut in range(len(full)):
        got = lessons.repaired(full[:cut])
        if got and "concepts" in json.loads(got):
            assert all(a["name"] == b["name"] for a, b in zip(json.loads(got)["concepts"], json.loads(full)["concepts"]))
