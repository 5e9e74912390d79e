"""Pages with geometry tidied: reading direction repaired, running heads and feet, page numbers and rules taken away.

`lines` have doc, page, seq, top, bottom and text, with `heading` where it is known (a heading is never furniture); `pages`
have doc, page and height.  Nothing goes silently: what is taken away comes back with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import PAGE

#: What the direction of a book is judged by: its first pages, so many characters, and letters from right to left at least.
SAMPLE_PAGES, SAMPLE_CHARS, LEAST_LETTERS = 30, 20_000, 40
#: The margin at either end of a page, the share of pages, and the lengths that make a line furniture.
BAND, SHARE = 0.12, 0.35
LEAST, MOST, LEAST_PAGES = 4, 90, 3


def samples(lines: DataFrame, pages: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc, sample: the texts of a book's first pages, cut at so many characters: what a judgement of the whole reads."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    first = Window.partitionBy("doc").orderBy("page")
    numbers = lines.select(*PAGE).distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= pages).drop("_n")
    page = lines.join(numbers, PAGE, "left_semi").groupBy(*PAGE).agg(F.left(text, F.lit(chars)).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    return page.groupBy("doc").agg(F.left(whole, F.lit(chars)).alias("sample"))


def directions(lines: DataFrame) -> DataFrame:
    """doc, letters, forward, backward, flipped: a book was handed back in the order it was painted if 40 letters vote and
    more of its common words are there when the sample is read backwards; a tie leaves it."""
    rows = samples(lines).select("doc", T.rtl_letters(F.col("sample")).alias("letters"), T.marker_hits(F.col("sample")).alias("forward"), T.marker_hits(F.reverse("sample")).alias("backward"))
    return rows.withColumn("flipped", (F.col("letters") >= LEAST_LETTERS) & (F.col("backward") > F.col("forward")))


def languages(lines: DataFrame, pages: int = 60, chars: int = 40_000) -> DataFrame:
    """doc, direction, language of whole books, by the letters of their sample."""
    rtl, latin = T.rtl_letters(F.col("sample")), T.latin_letters(F.col("sample"))
    return samples(lines, pages, chars).select("doc", F.when(rtl > latin, "rtl").otherwise("ltr").alias("direction"), F.when(rtl > latin, "he").otherwise("en").alias("language"))


def repaired(lines: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """`lines` with these columns flipped in the books that are the wrong way round; all others as they were.  The verdicts
    are one row a book, of which the few that flip go back to the rows."""
    wrong = directions(lines).filter("flipped").select("doc", F.lit(True).alias("_flip"))
    rows = lines.join(wrong, "doc", "left")
    return rows.withColumns({c: F.when(F.col("_flip"), T.flip(F.col(c))).otherwise(F.col(c)) for c in columns}).drop("_flip").select(*lines.columns)


def margin_lines(lines: DataFrame, pages: DataFrame, band: float = BAND) -> DataFrame:
    """`lines` with margin: whether they lie in the band at the top or the bottom of their page.  By place alone: on a sparse
    page the first line is the text."""
    rows = lines.join(pages.select(*PAGE, "height"), PAGE)
    exempt = F.coalesce("heading", F.lit(False)) if "heading" in lines.columns else F.lit(False)
    return rows.withColumn("margin", ((F.col("bottom") <= F.col("height") * band) | (F.col("top") >= F.col("height") * (1 - band))) & ~exempt).drop("height")


def furniture(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """doc, fp, n: fingerprints (digits blanked, 4 to 90 characters) in the margins of max(3, share) pages or more; books of
    under three pages have none.  rows: as `margin_lines` gives them."""
    fp = T.line_fingerprint(F.col("text"))
    size = F.char_length("fp")
    seen = rows.filter("margin").select(*PAGE, fp.alias("fp")).filter((size >= LEAST) & (size <= MOST)).distinct()
    pages = rows.select(*PAGE).distinct().groupBy("doc").agg(F.count("*").alias("_pages")).filter(F.col("_pages") >= LEAST_PAGES)
    counts = seen.groupBy("doc", "fp").agg(F.count("*").alias("n")).join(pages, "doc")
    return counts.filter(F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("_pages") * share))).select("doc", "fp", "n")


def judged(lines: DataFrame, pages: DataFrame, share: float = SHARE, band: float = BAND) -> DataFrame:
    """`lines` with reason: contents (the whole page), header, page_number, decoration, or null for what stays."""
    rows = margin_lines(lines, pages, band)
    counts = lines.groupBy(*PAGE).agg(F.count("*").alias("_n"), F.count_if(T.is_contents_row(F.col("text"))).alias("_rows"))
    contents = counts.filter((F.col("_n") >= 4) & (F.col("_rows") >= 3) & (F.col("_rows") >= 0.4 * F.col("_n"))).select(*PAGE, F.lit(True).alias("_contents"))
    # only what is in a margin is held against the furniture, so a book's common lines elsewhere never meet it
    known = furniture(rows, share).select("doc", F.col("fp").alias("_fp"), F.lit(True).alias("_known"))
    rows = rows.withColumn("_fp", F.when(F.col("margin"), T.line_fingerprint(F.col("text")))).join(known, ["doc", "_fp"], "left").join(contents, PAGE, "left")
    text = F.trim("text")
    why = F.when(F.col("_contents"), "contents").when(F.col("_known"), "header").when(T.is_page_number(text), "page_number").when(T.is_decoration(text), "decoration")
    return rows.withColumn("reason", why).select(*lines.columns, "reason")


def tidied(lines: DataFrame, pages: DataFrame, share: float = SHARE, band: float = BAND) -> DataFrame:
    """The lines that stay, the right way round."""
    rows = repaired(lines)
    return judged(rows, pages, share, band).filter("reason IS NULL").drop("reason")


def taken(lines: DataFrame, pages: DataFrame, share: float = SHARE, band: float = BAND) -> DataFrame:
    """doc, headers, page_numbers, decoration, contents_pages: what tidying takes from every book."""
    rows = judged(lines, pages, share, band)
    of = lambda reason: F.count_if(F.col("reason") == reason)
    return rows.groupBy("doc").agg(of("header").alias("headers"), of("page_number").alias("page_numbers"), of("decoration").alias("decoration"), F.count_distinct(F.when(F.col("reason") == "contents", F.col("page"))).alias("contents_pages"))
