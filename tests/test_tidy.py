"""Direction and furniture of whole books, on small books with known answers."""

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import tidy

LINE = "doc string, page long, seq long, top double, bottom double, text string"
HEBREW = "הוא אשר על כל זה 12 גם כי abc/def של את"


def book(spark, pages, doc="d"):
    """pages: lists of (top, text)."""
    rows = [(doc, p + 1, k, float(top), float(top + 10), text) for p, own in enumerate(pages) for k, (top, text) in enumerate(own)]
    return spark.createDataFrame(rows, LINE), spark.createDataFrame([(doc, p + 1, 800.0) for p in range(len(pages))], "doc string, page long, height double")


def kept(spark, pages):
    rows = tidy.tidied(*book(spark, pages)).orderBy("page", "seq").collect()
    return [[r.text for r in rows if r.page == p + 1] for p in range(len(pages))]


def test_running_heads_go_and_sparse_pages_stay(spark):
    full = [[(30, f"The Quarterly Review, page {p}"), (300, f"Body text on page {p}"), (760, f"- {p} -")] for p in range(1, 7)]
    assert kept(spark, full) == [[f"Body text on page {p}"] for p in range(1, 7)]
    sparse = [[(300, f"Body text on page {p}")] for p in range(1, 7)]
    assert kept(spark, sparse) == [[f"Body text on page {p}"] for p in range(1, 7)]
    two = [[(30, "Head"), (300, f"text {p}")] for p in range(2)]
    assert kept(spark, two) == [["Head", "text 0"], ["Head", "text 1"]]


def test_a_line_like_a_head_stays_inside_the_page(spark):
    pages = [[(30, "Running head"), (300, "Running head"), (400, f"text {p}")] for p in range(4)]
    assert kept(spark, pages) == [["Running head", f"text {p}"] for p in range(4)]
    long = [[(30, "a long line at the edge of the page, which is text and no running head " + "and more " * 5), (300, "x" + str(p))] for p in range(4)]
    assert all(len(p) == 2 for p in kept(spark, long))


def test_headings_are_exempt(spark):
    lines, pages = book(spark, [[(30, "Chapter 1"), (300, "text of it")] for _ in range(4)])
    assert tidy.judged(lines, pages).filter("reason = 'header'").count() == 4
    assert tidy.judged(lines.withColumn("heading", F.col("seq") == 0), pages).filter("reason IS NOT NULL").count() == 0


def test_contents_rules_and_reasons(spark):
    contents = [(100 + 20 * k, f"Part {k} ........ {k}") for k in range(5)]
    lines, pages = book(spark, [contents, [(300, "* * *"), (320, "12 / 40"), (340, "A sentence.")]])
    got = {(r.page, r.text): r.reason for r in tidy.judged(lines, pages).collect()}
    assert {v for (p, _), v in got.items() if p == 1} == {"contents"} and got[2, "* * *"] == "decoration" and got[2, "12 / 40"] == "page_number" and got[2, "A sentence."] is None
    row = tidy.taken(lines, pages).first()
    assert (row.headers, row.page_numbers, row.decoration, row.contents_pages) == (0, 1, 1, 1)


def test_books_the_wrong_way_round(spark):
    """Flipped where 40 letters vote for it; ties, few letters and other scripts are left."""
    right, _ = book(spark, [[(100, HEBREW), (120, "plain words"), (140, "7 " + HEBREW)]] * 3, "right")
    wrong = right.withColumn("doc", F.lit("wrong")).withColumn("text", T.flip(F.col("text")))
    few, _ = book(spark, [[(100, "לע אוה")]], "few")
    latin, _ = book(spark, [[(100, "Only words of another script, and many of them.")]], "latin")
    every = right.unionByName(wrong).unionByName(few).unionByName(latin)
    assert {r.doc for r in tidy.directions(every).filter("flipped").collect()} == {"wrong"}
    back = {(r.doc, r.page, r.seq): r.text for r in tidy.repaired(every).collect()}
    for r in right.collect():
        assert back["right", r.page, r.seq] == back["wrong", r.page, r.seq] == r.text
    assert back["few", 1, 0] == "לע אוה" and back["latin", 1, 0].startswith("Only words")
    assert {r.doc: r.language for r in tidy.languages(every).collect()} == {"right": "he", "wrong": "he", "few": "he", "latin": "en"}


def test_only_the_first_pages_vote(spark):
    late, _ = book(spark, [[(100, "plain")]] * 30 + [[(100, HEBREW[::-1])]] * 20, "late")
    assert tidy.directions(late).first().letters == 0 and tidy.repaired(late).filter(F.col("text") == HEBREW[::-1]).count() == 20
    assert tidy.languages(late).first().direction == "rtl"
