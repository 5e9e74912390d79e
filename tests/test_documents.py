"""Whole ways through: digests and outputs."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.operators import blocks, digest
from foliant.plans import layout_queries as L
from foliant.sources import bundles


def passages(spark, parts):
    rows, pos = [], 0
    for part, n in enumerate(parts):
        for k in range(n):
            rows.append(("d", part, f"Part {part}", pos, f"part{part} passage{k} " + "words " * 20))
            pos += 1
    return spark.createDataFrame(rows, "doc string, part long, title string, pos long, text string")


def test_digest_reaches_every_part(spark):
    rows = passages(spark, [60] + [3] * 9)
    out = digest.digests(rows, 5000).first().digest
    assert len(out) <= 5000 and out.startswith("[OUTLINE] ") and "[CLOSING]" in out and digest.GAP in out
    assert all(f"part{p} passage0" in out and f"Part {p}" in out for p in range(10))
    assert out == digest.digests(rows, 5000).first().digest


def test_digest_names_many_parts(spark):
    out = digest.digests(passages(spark, [4] * 80), 5000).first().digest
    assert all(f"Part {p}" in out for p in range(80)) and len(out) <= 5000


def test_short_text_is_its_own_digest(spark):
    rows = passages(spark, [2])
    assert digest.digests(rows, 5000).first().digest == "\n\n".join(r.text for r in rows.orderBy("pos").collect())


def test_outputs_are_written_and_read_again(spark, sf, tmp_path):
    rows = blocks.markdown(L.BLOCKS.df(spark, sf))
    both = blocks.rendered(rows).join(blocks.manifests(L.BLOCKS.df(spark, sf)), "doc")
    bundles.write_outputs(both, str(tmp_path / "out"))
    back = bundles.read_bundles(spark.read.text(str(tmp_path / "out/bundle")), "value")
    assert 100 < back.filter("code is null").count() <= back.count() == both.count()
    want = {r.doc: r.markdown for r in both.collect()}
    assert {r.part: r.markdown for r in back.collect()} == want


def test_digest_names_shares_and_labels(spark):
    out = digest.digests(passages(spark, [8] * 12), 5000).first().digest
    assert len(out) <= 5000 and out.startswith("[OUTLINE] Part 0 (8%); ") and "[Part 11]\n" in out and all(f"part{p} passage0" in out for p in range(12))
    big = digest.digests(passages(spark, [8] * 12), 14000).first().digest
    assert len(big) <= 14000 and sum(f"part{p} passage7" in big for p in range(12)) >= 1


def test_the_long_part_gets_the_most_room(spark):
    out = digest.digests(passages(spark, [60] + [3] * 9), 5000).first().digest
    assert out.count("part0 passage") >= 2 and all(f"part{p} passage0" in out for p in range(10))


def brute_depth(sizes, budget):
    """sizes: by part, those of its passages.  The passages by (part, place) with their round."""
    got, used = {}, 0
    for p, own in enumerate(sizes):
        used += own[0]
        if used <= budget:
            got[p, 0] = 1
    left = budget - sum(sizes[p][0] for p, _ in got)
    total = sum(map(sum, sizes))
    exact = [left * sum(own) for own in sizes]
    quota = [x // total for x in exact]
    for p in sorted(range(len(sizes)), key=lambda p: (-(exact[p] % total), p))[: left - sum(quota)]:
        quota[p] += 1
    for p, own in enumerate(sizes):
        n = 0
        for k, x in enumerate(own[1:], 1):
            n += x
            if n <= quota[p]:
                got[p, k] = 2
    left -= sum(sizes[p][k] for (p, k), r in got.items() if r == 2)
    n = 0
    for p, own in enumerate(sizes):
        for k, x in enumerate(own):
            if (p, k) not in got or got[p, k] == 3:
                n += x
                if n <= left:
                    got[p, k] = 3
    return got


def test_depth_by_largest_remainder(spark):
    import random

    rng = random.Random(4)
    docs = [[[rng.randrange(5, 60) for _ in range(rng.choice((1, 2, 5, 9)))] for _ in range(rng.choice((1, 3, 7)))] for _ in range(12)]
    rows = spark.createDataFrame([(d, p, 10 * p + k, x) for d, doc in enumerate(docs) for p, own in enumerate(doc) for k, x in enumerate(own)], "doc long, part long, pos long, size long")
    got = {}
    for r in digest.apportioned(rows, 300).collect():
        got.setdefault(r.doc, {})[r.part, r.pos - 10 * r.part] = r.round
    assert got == {d: brute_depth(doc, 300) for d, doc in enumerate(docs)}


def test_lines_keep_the_digits_at_their_ends(spark):
    rows = spark.createDataFrame([(["  10 and 0", "1 more 21", "2 in all 2 "],)], "l array<string>")
    assert rows.select(blocks.healed(F.col("l"))).first()[0] == "10 and 0 1 more 21 2 in all 2"


@pytest.mark.parametrize("name", ["paragraph_texts", "document_titles"])
def test_titles_and_texts_that_end_in_their_place(spark, tmp_path, name):
    rows = [(6, "Budget for year 2050\nThe lines below are all of one size, and there are more of them.", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(L.ORACLE[name])
    at = [c[0] for c in want.description]
    assert sorted(map(tuple, L.QUERIES[name](spark, str(tmp_path)).select(*at).collect())) == sorted(want.fetchall())


def test_titles_that_a_word_makes_headings(spark, tmp_path):
    opening = ["Chapter 3 The Sea", "Part One of it", "Unit: the tides", "chapter and verse", "פרק ב: הים", "Section 4 Shores", "Book 7a", "Appendix " + "long " * 12 + "ends."]
    rows = [(11 * k + 7, f"{x}\nThe lines below are all of one size, of which there are three.\nThe last.", "a") for k, x in enumerate(opening)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc, title FROM ({L.ORACLE['document_titles']})").fetchall())
    assert sorted(map(tuple, L.QUERIES["document_titles"](spark, str(tmp_path)).select("doc", "title").collect())) == want
    assert dict(want)["d7"] == hashlib.md5(b"Chapter 3 The Sea").hexdigest()
