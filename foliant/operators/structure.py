"""Numerals, headings, chapters: from lines to an outline with page ranges.

Heading frames have book, page, pos, level, number, title and label; windows run over a book in the order of (page, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: heading words with their level, number words, letter values
KEYWORDS = {"חלק": 1, "שער": 1, "book": 1, "part": 1, "פרק": 2, "chapter": 2, "יחידה": 2, "unit": 2, "נספח": 2, "appendix": 2, "סעיף": 3, "section": 3, "תת-פרק": 3}
ORDINALS = {
    "one": 1, "first": 1, "two": 2, "second": 2, "three": 3, "third": 3, "four": 4, "fourth": 4, "five": 5, "fifth": 5, "six": 6, "sixth": 6,
    "seven": 7, "seventh": 7, "eight": 8, "eighth": 8, "nine": 9, "ninth": 9, "ten": 10, "tenth": 10, "eleven": 11, "twelve": 12,
    "ראשון": 1, "ראשונה": 1, "שני": 2, "שנייה": 2, "שניה": 2, "שלישי": 3, "שלישית": 3, "רביעי": 4, "רביעית": 4, "חמישי": 5, "חמישית": 5,
    "שישי": 6, "ששי": 6, "שישית": 6, "שביעי": 7, "שביעית": 7, "שמיני": 8, "שמינית": 8, "תשיעי": 9, "תשיעית": 9, "עשירי": 10, "עשירית": 10,
}
LETTERS = {
    "א": 1, "ב": 2, "ג": 3, "ד": 4, "ה": 5, "ו": 6, "ז": 7, "ח": 8, "ט": 9, "י": 10, "כ": 20, "ך": 20, "ל": 30, "מ": 40, "ם": 40, "נ": 50, "ן": 50,
    "ס": 60, "ע": 70, "פ": 80, "ף": 80, "צ": 90, "ץ": 90, "ק": 100, "ר": 200, "ש": 300, "ת": 400,
}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
NO_NUMBER = "of in the and is was this that which זה זו הזה של את אשר הוא היא כי על עם".split()
OUTLINE = r"^(?<num>[0-9]{1,2}(?:\.[0-9]{1,2}){0,3})[.)]?\s+(?<title>\S.{0,90})$"
SENTENCE_END = r"[.!?:;,]$"
#: What a title does not begin or end with.
EDGE = r"^[ \t:.\-–—]+|[ \t:.\-–—]+$"
MAX_LEVEL = 6


def lookup(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def roman(token: Column) -> Column:
    """The value of an upper-case Roman numeral: a letter counts against the total if a greater one follows."""
    letters = F.reverse(F.split(token, ""))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    step = lambda a, c: F.struct((a["sum"] + F.when(lookup(ROMAN)[c] < a["top"], -lookup(ROMAN)[c]).otherwise(lookup(ROMAN)[c])).alias("sum"), F.greatest(a["top"], lookup(ROMAN)[c]).alias("top"))
    return F.when(token.rlike("^[IVXLCDM]+$"), F.aggregate(F.filter(letters, lambda c: c != ""), start, step)["sum"])


def gematria(token: Column) -> Column:
    """The sum of up to three letters; several letters only with a mark before the last, one with or without its own."""
    bare = F.regexp_replace(token, "[\"'׳״]", "")
    well = token.rlike("^[א-ת]['׳]?$") | token.rlike("^[א-ת]{1,2}[\"״][א-ת]$")
    letters = F.filter(F.split(bare, ""), lambda c: c != "")
    return F.when(well, F.aggregate(letters, F.lit(0), lambda a, c: a + F.coalesce(lookup(LETTERS)[c], F.lit(0))))


def numeral(token: Column) -> Column:
    """A token's number: digits, a number word, a Roman numeral, letters by value; null for other words."""
    bare = F.regexp_replace(token, r"[.:,;)\]\-–—]+$", "")
    return F.coalesce(F.try_cast(F.when(bare.rlike("^[0-9]{1,4}$"), bare), "int") if hasattr(F, "try_cast") else F.when(bare.rlike("^[0-9]{1,4}$"), bare.cast("int")), lookup(ORDINALS)[F.lower(bare)], roman(bare), gematria(bare)).cast("long")


#: A heading word, white space or directly a digit, a token, and the rest behind a separator.
KEYWORD_LINE = rf"(?iu)^({'|'.join(sorted(KEYWORDS, key=len, reverse=True))})(?:\s+|(?=[0-9]))(\S+?)(?:[\s:\-–—.,)\]]+(.*))?$"


def keyword_heading(line: Column) -> Column:
    """level, number, title, kind and label of a keyword heading; the label is rebuilt as word, number and title.

    Without a numeral the line has at most 60 characters, the next word is no function word, and a Latin one starts
    with a capital; a line of over 60 characters that ends like a sentence is none.
    """
    get = lambda k: F.regexp_extract(line, KEYWORD_LINE, k)

    def of(p, n):
        plain = (F.char_length(line) <= 60) & ~F.lower(p["token"]).isin(NO_NUMBER) & ~p["token"].rlike("^[a-z]")
        sentence = (F.char_length(line) > 60) & line.rlike(SENTENCE_END)
        rest = F.when(n.isNotNull(), p["title"]).otherwise(F.trim(F.concat_ws(" ", p["token"], p["title"])))
        head = F.concat_ws(" ", p["printed"], n.cast("string"))
        label = F.when(rest != "", F.concat(head, F.lit(" — "), rest)).otherwise(head)
        found = F.struct(lookup(KEYWORDS)[F.lower(p["printed"])].cast("long").alias("level"), n.alias("number"), rest.alias("title"), F.lit("keyword").alias("kind"), label.alias("label"))
        return F.when((n.isNotNull() | plain) & ~sentence, found)

    parts = F.struct(get(1).alias("printed"), get(2).alias("token"), F.regexp_replace(F.trim(get(3)), EDGE, "").alias("title"))
    return F.when(line.rlike(KEYWORD_LINE), T.let(parts, lambda p: T.let(numeral(p["token"]), lambda n: of(p, n))))


def outline_heading(line: Column) -> Column:
    """level, number (the first), title, kind and label of a line like 1.2 Title: at most 80 characters, no sentence, no small first letter."""
    num, title = F.regexp_extract(line, OUTLINE, 1), F.regexp_extract(line, OUTLINE, 2)
    depth = F.size(F.split(num, r"\."))
    fits = (num != "") & (F.char_length(title) <= 80) & ~title.rlike(SENTENCE_END) & ~title.rlike("^[a-z]")
    return F.when(fits, F.struct(F.least(1 + depth, F.lit(4)).cast("long").alias("level"), F.element_at(F.split(num, r"\."), 1).cast("long").alias("number"), title.alias("title"), F.lit("outline").alias("kind"), F.concat(num, F.lit(" — "), title).alias("label")))


def headings(lines: DataFrame) -> DataFrame:
    """The lines that are headings, keyword before outline."""
    rows = lines.withColumn("h", F.coalesce(keyword_heading(F.col("line")), outline_heading(F.col("line")))).filter("h is not null")
    return rows.select("book", "page", "pos", "h.label", "h.level", "h.number", "h.title", "h.kind")


def without_contents(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Headings but those on pages where four or more, and half of all lines, are headings."""
    per_page = lines.groupBy("book", "page").agg(F.count("*").alias("n"))
    crowded = found.groupBy("book", "page").agg(F.count("*").alias("k")).join(per_page, ["book", "page"]).filter("k >= 4 and k >= 0.5 * n")
    return found.join(crowded, ["book", "page"], "left_anti")


def first_line_guesses(lines: DataFrame) -> DataFrame:
    """First lines that look like titles: 4 to 60 characters, at most 8 words, no digit, no sentence end, and at most 0.7
    of the upper median length of the page's other lines."""
    page = Window.partitionBy("book", "page")
    rows = lines.withColumn("nth", F.row_number().over(page.orderBy("pos")))
    sizes = F.sort_array(F.collect_list(F.when(F.col("nth") > 1, F.char_length("line"))))
    rest = rows.groupBy("book", "page").agg(sizes.alias("sizes"))
    middle = F.try_element_at("sizes", (F.floor(F.size("sizes") / 2) + 1).cast("int"))
    n = F.char_length("line")
    first = rows.filter("nth = 1").join(rest, ["book", "page"])
    good = (n >= 4) & (n <= 60) & (F.size(F.split("line", r"\s+")) <= 8) & ~F.col("line").rlike(r"[0-9]") & ~F.col("line").rlike(SENTENCE_END) & (middle.isNull() | (n <= 0.7 * middle))
    return first.filter(good).select("book", "page", "pos", F.col("line").alias("label"), F.lit(2).cast("long").alias("level"), F.lit(None).cast("long").alias("number"), F.col("line").alias("title"), F.lit("title").alias("kind"))


def with_fallback(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Where a book has fewer than two headings: also first-line titles on pages without one, unless they are more than
    max(4, 34 % of the pages)."""
    pages = lines.groupBy("book").agg(F.count_distinct("page").alias("pages"))
    have = found.groupBy("book").agg(F.count("*").alias("have"))
    guesses = first_line_guesses(lines).join(found.select("book", "page").distinct(), ["book", "page"], "left_anti")
    counts = guesses.groupBy("book").agg(F.count("*").alias("guessed"))
    sparse = pages.join(have, "book", "left").join(counts, "book").filter((F.coalesce("have", F.lit(0)) < 2) & (F.col("guessed") <= F.greatest(F.lit(4.0), 0.34 * F.col("pages")))).select("book")
    return found.unionByName(guesses.join(sparse, "book", "left_semi"))


def deduped(found: DataFrame) -> DataFrame:
    """Headings but those whose label was kept at most one page before."""
    item = F.struct("page", "pos", "level", "number", "title", "kind")
    kind = "array<struct<page:bigint,pos:bigint,level:bigint,number:bigint,title:string,kind:string>>"
    near = lambda kept, x: F.coalesce(x["page"] - F.try_element_at(kept, F.lit(-1))["page"] <= 1, F.lit(False))
    fold = F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kind), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    return found.groupBy("book", "label").agg(fold.alias("kept")).select("book", "label", F.inline("kept"))


def spans(found: DataFrame, last_page: DataFrame) -> DataFrame:
    """Headings with end_page, parent_pos and path.  last_page: book, last.

    For each level: the page of the next heading at that level or above, and the last one before at that level or
    above; all in one window pass.  A heading ends before the next one at its level or above, or with the book.
    """
    order = Window.partitionBy("book").orderBy("page", "pos")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    # what follows, read backwards: a frame that begins at the row and has no end is worked out anew for every row
    ahead = Window.partitionBy("book").orderBy(F.desc("page"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, MAX_LEVEL + 1)
    me = F.struct("level", "page", "pos", "label")
    rows = found.select(
        "*",
        *(F.last(F.when(F.col("level") <= k, F.col("page")), ignorenulls=True).over(ahead).alias(f"_next{k}") for k in levels),
        *(F.last(F.when(F.col("level") <= k, me), ignorenulls=True).over(behind).alias(f"_last{k}") for k in levels),
    ).join(last_page, "book")
    pick = lambda make: F.coalesce(*(F.when(F.col("level") == k, make(k)) for k in levels))
    closing = pick(lambda k: F.col(f"_next{k}"))
    ancestors = F.array_compact(F.array(*(F.when((F.col("level") > k) & (F.col(f"_last{k}.level") == k), F.col(f"_last{k}.label")) for k in levels)))
    parent = pick(lambda k: F.col(f"_last{k - 1}.label") if k > 1 else F.lit(None).cast("string"))
    path = F.array_join(F.concat(ancestors, F.array("label")), " › ")
    return rows.select("book", "page", "pos", "level", "label", F.when(closing.isNull(), F.col("last")).otherwise(F.greatest("page", closing - 1)).alias("end_page"), parent.alias("parent"), path.alias("path"))


def find_chapter(chapters: DataFrame, selector: str) -> DataFrame:
    """book and the chapter a selector means: p31 the deepest that covers the page, a number by level 2, 1, 3, 4, else
    the first whose label contains the text."""
    rows = chapters
    if selector[:1] == "p" and selector[1:].isdigit():
        page = int(selector[1:])
        rows, order = rows.filter((F.col("page") <= page) & (F.col("end_page") >= page)), F.struct(-F.col("level"), "page", "pos")
    elif selector.isdigit():
        rank = F.coalesce(lookup({2: 0, 1: 1, 3: 2, 4: 3})[F.col("level").cast("int")], F.lit(9))
        rows, order = rows.filter(F.col("number") == int(selector)), F.struct(rank, "page", "pos")
    else:
        rows, order = rows.filter(F.lower("label").contains(selector.lower())), F.struct("page", "pos")
    return rows.groupBy("book").agg(F.min_by("label", order).alias("label"))


def rendered_index(chapters: DataFrame, width: int = 46) -> DataFrame:
    """book, page, pos, text: labels of levels 1 and 2, indented, dotted, with their pages."""
    head = F.concat(F.repeat(F.lit("  "), (F.col("level") - 1).cast("int")), F.col("label"))
    dots = F.repeat(F.lit("."), F.greatest(F.lit(4), F.lit(width) - F.char_length(head)).cast("int"))
    pages = F.when(F.col("page") == F.col("end_page"), F.concat(F.lit("page "), F.col("page"))).otherwise(F.concat(F.lit("pages "), F.col("page"), F.lit("-"), F.col("end_page")))
    return chapters.filter("level <= 2").select("book", "page", "pos", F.concat(head, F.lit(" "), dots, F.lit(" "), pages).alias("text"))
