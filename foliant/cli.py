"""python -m foliant.cli index|context|text|inspect|prepare FILE [--query Q] [--budget N] [--pages A-B] [--chapter C] [--json]

Thin driver functions over a text file of pages (parted by form feeds).  Exit codes: 1 no file, 2 no such chapter.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import blocks, cleaning, layout, manifest, retrieval, structure
from .sources import bundles


def read_lines(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """book, page, pos, line of the pages asked for."""
    bundles.register(spark)
    pages = spark.read.format("page_text").option("path", path).load().filter(F.col("page") >= first)
    if last is not None:
        pages = pages.filter(F.col("page") <= last)
    return T.lines(pages.withColumn("book", F.lit(os.path.basename(path))), "page").select("book", "page", "pos", "line")


def cleaned(lines: DataFrame) -> DataFrame:
    """`lines` without furniture, page numbers, rules and contents pages."""
    rows = cleaning.drop_furniture(lines).filter(~T.is_page_number(F.col("line")) & ~T.is_decoration(F.col("line")))
    return rows.join(cleaning.contents_pages(lines).select("book", "page"), ["book", "page"], "left_anti")


def headings_of(lines: DataFrame) -> DataFrame:
    found = structure.without_contents(structure.headings(lines), lines)
    return structure.deduped(structure.with_fallback(found, lines)).cache()  # a book's headings, used twice


def chapters_of(lines: DataFrame) -> DataFrame:
    found = headings_of(lines)
    spans = structure.spans(found, lines.groupBy("book").agg(F.max("page").alias("last")))
    return spans.join(found.select("book", "page", "pos", "number"), ["book", "page", "pos"])


def chapter_texts(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """doc_id (the chapter's number in the book, 0 before the first), book, page (its first), label, text."""
    rows = lines.join(chapters.select("book", "page", "pos", "label"), ["book", "page", "pos"], "left")
    order = Window.partitionBy("book").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("doc_id", F.count("label").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("book", "doc_id").agg(F.min("page").alias("page"), F.coalesce(F.max("label"), F.lit("")).alias("label"), text.alias("text"))


def context_of(spark: SparkSession, lines: DataFrame, query: str, budget: int) -> DataFrame:
    """The passages that answer a query, within the budget, in document order with gap marks; without a query the pages
    from their start."""
    texts = chapter_texts(lines, chapters_of(lines)).cache()  # one book
    rows = retrieval.passages(texts)
    if query.strip():
        chosen = retrieval.relevant(texts, spark.createDataFrame([(1, query)], "item_id long, text string"), budget)
    else:
        chosen = retrieval.trim(rows, "book", ("doc_id", "pos"), budget).withColumn("gap", F.lit(False))
    return chosen.select("doc_id", "pos", "gap", "text").join(rows.select("doc_id", "pos", "page", "label"), ["doc_id", "pos"]).orderBy("doc_id", "pos").select("page", "label", "gap", "text")


def inspected(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """What the cleaner takes away, and what the detector finds: page, what, text."""
    gone = raw.join(lines, ["book", "page", "pos"], "left_anti").select("page", "pos", F.lit("dropped").alias("what"), F.col("line").alias("text"))
    found = headings_of(lines).select("page", "pos", F.concat_ws(" ", F.lit("heading"), F.col("level"), F.col("kind")).alias("what"), F.col("label").alias("text"))
    return gone.unionByName(found).orderBy("page", "pos").select("page", "what", "text")


def prepared(lines: DataFrame) -> DataFrame:
    """doc, markdown, manifest of a book without geometry: boxes made up, then blocks, Markdown and manifest."""
    boxes = layout.plain_boxes(lines.select(F.col("book").alias("doc"), "page", F.col("pos").alias("seq"), F.col("line").alias("text")))
    body = layout.body_size(boxes)
    kinds = blocks.classified(boxes, body.join(layout.size_ranks(boxes, body), "doc", "left"), layout.PLAIN_HEIGHT)
    order = F.row_number().over(Window.partitionBy("doc").orderBy("page", "seq")).cast("long")
    rows = blocks.built(blocks.assembled(kinds.withColumn("place", order), layout.line_gap(boxes), layout.PLAIN_WIDTH))
    rows = rows.select("doc", F.col("block").alias("seq"), "kind", "level", "text", "items", "ordered", F.col("first_page").alias("page"))
    written = blocks.markdown(rows.cache()).cache()  # one book, which the map reads several times
    return blocks.rendered(written).join(manifest.manifests(written), "doc")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliant")
    parser.add_argument("what", choices=("index", "context", "text", "inspect", "prepare"))
    parser.add_argument("file")
    parser.add_argument("--query", default="")
    parser.add_argument("--budget", type=int, default=12_000)
    parser.add_argument("--pages", default="")
    parser.add_argument("--chapter")
    parser.add_argument("--out", help="prepare: write Markdown, manifest and bundle below this folder")
    parser.add_argument("--json", action="store_true")
    asked = parser.parse_args(args)
    if not os.path.exists(asked.file):
        print(f"no file {asked.file}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    first, _, last = asked.pages.partition("-")
    raw = read_lines(spark, asked.file, int(first or 1), int(last) if last else (int(first) if first and "-" not in asked.pages else None)).cache()  # one book, read once
    lines = cleaned(raw).cache()
    if asked.chapter:
        chapters = chapters_of(lines)
        label = structure.find_chapter(chapters, asked.chapter).first()
        if label is None:
            print(f"no chapter {asked.chapter}", file=sys.stderr)
            return 2
        span = chapters.filter(F.col("label") == label.label).first()
        lines = lines.filter(F.col("page").between(span.page, span.end_page))
    if asked.what == "index":
        out = structure.rendered_index(chapters_of(lines)).orderBy("page", "pos").select("text")
    elif asked.what == "context":
        out = context_of(spark, lines, asked.query, asked.budget)
    elif asked.what == "inspect":
        out = inspected(raw, lines)
    elif asked.what == "prepare":
        out = prepared(lines)
        if asked.out:
            bundles.write_outputs(out, asked.out)
        out = out.select("manifest" if asked.json else "markdown")
    else:
        out = lines.orderBy("page", "pos").select("page", "line")
    for row in out.toJSON().toLocalIterator() if asked.json and asked.what != "prepare" else out.toLocalIterator():
        print(row if isinstance(row, str) else row[-1])
    return 0


if __name__ == "__main__":
    sys.exit(main())
