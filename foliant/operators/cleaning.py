"""Running heads and feet, page numbers, rules and contents pages of a book's pages.

`lines` frames have book, page, pos and line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def edges(lines: DataFrame, edge: int = 3) -> DataFrame:
    """The first and last `edge` lines of each page, with `nth` (from 1) and `left` (lines from the end)."""
    page = Window.partitionBy("book", "page")
    nth = F.row_number().over(page.orderBy("pos"))
    return lines.withColumn("nth", nth).withColumn("left", F.count("*").over(page) - F.col("nth") + 1).filter((F.col("nth") <= edge) | (F.col("left") <= edge))


def repeated_edges(lines: DataFrame, share: float = 0.35, edge: int = 3, least_pages: int = 4) -> DataFrame:
    """book, fp, n: fingerprints of edge lines (4 to 90 characters) on at least max(3, share of the pages) pages."""
    size = F.char_length("line")
    seen = edges(lines, edge).filter((size >= 4) & (size <= 90)).select("book", "page", T.line_fingerprint(F.col("line")).alias("fp")).distinct()
    pages = lines.select("book", "page").distinct().groupBy("book").agg(F.count("*").alias("pages"))
    counts = seen.groupBy("book", "fp").agg(F.count("*").alias("n")).join(pages, "book")
    return counts.filter((F.col("pages") >= least_pages) & (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share)))).select("book", "fp", "n")


def drop_furniture(lines: DataFrame, share: float = 0.35, edge: int = 3) -> DataFrame:
    """The lines that are no running head or foot.  Only edge lines are held against the repeated ones."""
    page, size = Window.partitionBy("book", "page"), F.char_length("line")
    placed = lines.withColumn("_nth", F.row_number().over(page.orderBy("pos"))).withColumn("_left", F.count("*").over(page) - F.col("_nth") + 1)
    tried = ((F.col("_nth") <= edge) | (F.col("_left") <= edge)) & (size >= 4) & (size <= 90)
    outer = placed.filter(tried).withColumn("fp", T.line_fingerprint(F.col("line"))).join(repeated_edges(lines, share, edge), ["book", "fp"], "left_anti")
    return placed.filter(~tried).select(*lines.columns).unionByName(outer.select(*lines.columns))


def contents_pages(lines: DataFrame, least: int = 4, rows: int = 3, share: float = 0.4) -> DataFrame:
    """book, page, n, rows: pages of which at least `rows` lines and `share` of them are contents rows."""
    counts = lines.groupBy("book", "page").agg(F.count("*").alias("n"), F.count_if(T.is_contents_row(F.col("line"))).alias("rows"))
    return counts.filter((F.col("n") >= least) & (F.col("rows") >= rows) & (F.col("rows") >= share * F.col("n")))


def dropped(lines: DataFrame) -> DataFrame:
    """book, headers, page_numbers, decoration, contents_pages: what cleaning takes away."""
    flags = lines.select("book", T.is_page_number(F.col("line")).alias("number"), T.is_decoration(F.col("line")).alias("rule"))
    counts = flags.groupBy("book").agg(F.count_if("number").alias("page_numbers"), F.count_if("rule").alias("decoration"), F.count("*").alias("all_lines"))
    left = drop_furniture(lines).groupBy("book").agg(F.count("*").alias("left_lines"))
    contents = contents_pages(lines).groupBy("book").agg(F.count("*").alias("contents_pages"))
    out = counts.join(left, "book", "left").join(contents, "book", "left")
    return out.select("book", (F.col("all_lines") - F.coalesce("left_lines", F.lit(0))).alias("headers"), "page_numbers", "decoration", F.coalesce("contents_pages", F.lit(0)).cast("long").alias("contents_pages"))


def direction_votes(pages: DataFrame, group: str, text: str = "text", max_pages: int = 30) -> DataFrame:
    """group, forward, backward, flipped: marker words in the first pages as they stand and reversed; ties do not flip."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy("page"))
    sample = pages.withColumn("nth", nth).filter(F.col("nth") <= max_pages)
    votes = sample.groupBy(group).agg(F.sum(T.marker_hits(F.col(text))).alias("forward"), F.sum(T.marker_hits(F.reverse(text))).alias("backward"))
    return votes.withColumn("flipped", F.col("backward") > F.col("forward"))
