"""Folds and parsers against plain Python, and streams against batches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.plans import text_queries
from foliant.functions import text as T
from foliant.operators import mathx, metering, retrieval, structure
from foliant.sources import bundles
from foliant.streaming import metering as live


def test_knapsack(spark):
    r = random.Random(1)
    rows = [(q, k, q, k, r.randrange(50, 400)) for q in range(40) for k in range(1, 9)]
    got = {x.query_id: [p.rank for p in x.picked] for x in retrieval.knapsack(spark.createDataFrame(rows, "query_id long, rank long, doc_id long, pos long, chars long"), 600).collect()}
    for q in range(40):
        used, want = 0, []
        for _, rank, _, _, chars in (x for x in rows if x[0] == q):
            if not want or used + chars <= 600:
                used, want = used + chars, [*want, rank]
        assert got[q] == want


def test_hyphens(spark):
    cases = [["the consid-", "eration of it"], ["ab-", "cd-", "ef"], ["Well-", "Known"], ["x-", "ray"], ["one"], []]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, l array<string>").select("id", T.join_hyphens(F.col("l")).alias("l")).collect()
    assert [r.l for r in sorted(rows)] == [["the consideration", "of it"], ["abcdef"], ["Well-", "Known"], ["x-", "ray"], ["one"], []]


def test_flip_is_its_own_inverse(spark):
    lines = ["שלום 2024 abc", "12:30 אב", "", "a", "x-1/2 ו 3.5"]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", T.flip(F.col("x")).alias("y"), T.flip(T.flip(F.col("x"))).alias("z")).collect()
    assert all(r.x == r.z for r in rows)
    assert "2024" in rows[0].y and "12:30" in rows[1].y


def test_sentences_are_packed_whole(spark):
    r = random.Random(2)
    texts = [" ".join("w" * r.randrange(3, 60) + r.choice(".!?") for _ in range(r.randrange(1, 80))) + r.choice(["", " tail without an end"]) for _ in range(25)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("t", T.pack_sentences(F.col("t")).alias("c"), T.pack_sentences(F.col("t"), overlap=0).alias("d")).collect()
    for row in rows:
        assert all(len(c) <= 1200 + 150 for c in row.c)
        if len(row.t) > 1200:
            assert re.sub(r"\s", "", "".join(row.d)) == re.sub(r"\s", "", row.t)


@pytest.mark.parametrize(("text", "value"), [("1 + 2 * 3", 7), ("2 ^ 3 ^ 2", 512), ("-2 ^ 2", -4), ("7 % 4", 3), ("sqrt(16)", 4), ("1/0", None), ("f(2)", None), ("open('x')", None), ("", None), ("(" * 5000, None), ("2x", None)])
def test_expressions(text, value):
    assert mathx.evaluate(text) == value


def test_booleans():
    for a in (True, False):
        for b in (True, False):
            v = {"A": a, "B": b}
            assert mathx.evaluate_bool("A or B", v) == (a or b)
            assert mathx.evaluate_bool("not A and B", v) == (not a and b)
            assert mathx.evaluate_bool("A → B", v) == (not a or b)
            assert mathx.evaluate_bool("A xor B iff A", v) == ((a != b) == a)
    assert mathx.evaluate_bool("A nand B", {"A": True, "B": True}) is None
    assert mathx.evaluate_bool("A or", {"A": False}) is None


def test_search_trace(spark):
    rows = {r.id: r.probes for r in mathx.search_trace(spark.createDataFrame([(1, 8, 5), (2, 1, 0), (3, 16, 0)], "id long, size long, target long")).collect()}
    assert rows == {1: "3,5", 2: "0", 3: "7,3,1,0"}


def test_keyword_headings(spark):
    lines = ["Chapter 1: The start", "PART IV Beyond", "Part of the plan", "פרק 2 - מבוא", "פרק2 דבר", "Appendix A", "Chapters are many", "Chapter which is long"]
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, l string").select("id", structure.keyword_heading(F.col("l")).alias("h")).collect()
    assert [(r.h.level, r.h.number, r.h.title) if r.h else None for r in sorted(rows, key=lambda r: r.id)] == [(2, 1, "The start"), (1, 4, "Beyond"), None, (2, 2, "מבוא"), (2, 2, "דבר"), (2, None, "A"), None, None]


def test_frames_live_equal_batch(spark, tmp_path):
    chunks = [(1, 0, 'data: {"a": 1}\n\nda'), (1, 1, 'ta: {"b": 2}\r\n\r\n'), (1, 2, 'data: {"c"'), (2, 0, ': hi\n\ndata: [DONE]\n\ndata: {"x":\ndata: 1}\n\n')]
    spark.createDataFrame(chunks, "stream_id long, seq long, chunk string").repartition(3).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("stream_id long, seq long, chunk string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    got = sorted((r.stream_id, r.data.replace("\n", "")) for r in live.finished(live.frame_stream(stream), "append").collect())
    batch = metering.frames(spark.read.parquet(str(tmp_path / "c"))).collect()
    assert got == sorted((r.stream_id, r.data.replace("\n", "")) for r in batch)
    assert got == [(1, '{"a": 1}'), (1, '{"b": 2}'), (2, '{"x":1}')]


def test_text_pages_source(spark, tmp_path):
    (tmp_path / "book.txt").write_text("one\fsecond\npage\fthird")
    bundles.register(spark)
    pages = spark.read.format("page_text").option("path", str(tmp_path / "book.txt")).load()
    assert [tuple(r) for r in pages.collect()] == [(1, "one"), (2, "second\npage"), (3, "third")]
    assert [r.page for r in pages.filter("page >= 2").collect()] == [2, 3]


def test_content_blocks(spark):
    rows = spark.createDataFrame([('"a"',), ("[]",), ('["a", {"type": "text", "text": "b"}]',), ('[{"type": "image"}]',), ("oops",), (None,)], "c string").select(metering.content_blocks(F.col("c")).alias("b")).collect()
    assert [r.b for r in rows] == [["a"], None, ["a", "b"], None, None, None]


def test_unicode_forms(spark):
    from foliant.functions import normalise as N

    rows = spark.createDataFrame([("x²​  y",), ("שׁ a b ",), (None,), ("é",)], "t string")
    got = rows.select(N.page_text(F.col("t")).alias("p"), N.line_text(F.col("t")).alias("l"), N.run_text(F.col("t")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("x2 y", "x² y", "x² y"), ("שׁ a b", "שׁ a b", "שׁ a b "), (None, None, None), ("é", "é", "é")]


def test_repaired_json_never_invents():
    import json

    from foliant.operators import lessons

    whole = '{"a": [1, {"b": "x,y"}, "z"], "c": true}'
    assert json.loads(lessons.repaired(whole)) == json.loads(whole)
    for k in range(len(whole)):
        out = lessons.repaired(whole[:k])
        if out is not None:
            assert json.loads(out).get("a", [])[:1] in ([], [1])


def test_sentences_are_not_folded_by_an_interpreted_expression(spark, sf):
    plan = text_queries.chunk_text(spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction" not in plan
