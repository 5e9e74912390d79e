"""The command line, through main()."""

import json

import pytest

from foliant import cli

PROSE = "The {0} grow in rows along the river. Farmers water the {0} every morning. In dry years the {0} need more care than other plants do."


@pytest.fixture(scope="module")
def book(tmp_path_factory, spark):
    pages = ["Contents\n" + "\n".join(f"Chapter {k} of the book .... {k * 2}" for k in range(1, 5))]
    for k, plant in enumerate(("apples", "melons", "onions", "lentils"), 1):
        pages.append(f"A Book of Plants\nChapter {k}: About {plant}\n{PROSE.format(plant)}\n- first of the {plant}\n- second of the {plant}\n{k * 2}")
        pages.append(f"A Book of Plants\nMore is known. {PROSE.format(plant)}\nA last line on {plant}.\n{k * 2 + 1}")
    path = tmp_path_factory.mktemp("book") / "plants.txt"
    path.write_text("\f".join(pages))
    return str(path)


def test_missing_file(capsys):
    assert cli.main(["text", "/nowhere/at/all.txt"]) == 1
    assert "no file" in capsys.readouterr().err


def test_text_is_cleaned(book, capsys):
    assert cli.main(["text", book, "--pages", "2-9"]) == 0
    out = capsys.readouterr().out
    assert "A Book of Plants" not in out and "About melons" in out and "\n4\n" not in out


def test_index_and_chapters(book, capsys):
    assert cli.main(["index", book]) == 0
    out = capsys.readouterr().out
    assert "Chapter 2 — About melons" in out and "pages 4-5" in out
    assert cli.main(["index", book, "--chapter", "77"]) == 2


def test_context_answers_from_the_right_chapter(book, capsys):
    assert cli.main(["context", book, "--query", "who waters the onions", "--budget", "400", "--json"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert rows and all("onions" in r["text"] for r in rows) and sum(len(r["text"]) for r in rows) <= 400
    assert cli.main(["context", book, "--chapter", "1", "--budget", "100"]) == 0
    assert "apples" in capsys.readouterr().out


def test_inspect(book, capsys):
    assert cli.main(["inspect", book, "--json"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {"A Book of Plants"} <= {r["text"] for r in rows if r["what"] == "dropped"}
    assert [r["text"] for r in rows if r["what"].startswith("heading")][0].startswith("Chapter 1")


def test_prepare(book, capsys, tmp_path):
    assert cli.main(["prepare", book, "--out", str(tmp_path / "out")]) == 0
    out = capsys.readouterr().out
    assert "## Chapter 1: About apples" in out and "- first of the apples\n- second of the apples" in out
    assert any((tmp_path / "out" / "bundle").rglob("part-*"))
    assert cli.main(["prepare", book, "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out)["outline"]) == 4
