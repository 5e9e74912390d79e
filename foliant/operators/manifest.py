"""The map of a document: sections, chunks with their paths, objects, pages and counts, as JSON beside its Markdown.

`blocks` have doc, seq, kind, level, text, page, md_start and md_end, as `blocks.markdown` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import chunks, parts
from .chapters import nested

#: fixed values: the kinds that are named one by one, and the kinds that are counted
STRUCTURAL = ("heading", "table", "figure", "formula", "footnote")
COUNTED = ("heading", "paragraph", "list", "table", "figure", "formula", "footnote")
LEVELS = range(1, 7)


def ident(letter: str, n: Column, width: int = 3) -> Column:
    """An identifier such as s001; longer numbers are whole."""
    text = n.cast("string")
    return F.concat(F.lit(letter), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def sections(blocks: DataFrame) -> DataFrame:
    """doc, n, id, seq, title, level, page_start, page_end, path (array): the headings in document order.

    A section's pages end before the next heading of its level or above begins, or with the document.
    """
    last = blocks.groupBy("doc").agg(F.max("page").alias("_last"))
    heads = blocks.filter("kind = 'heading'").select("doc", "seq", F.trim("text").alias("title"), F.greatest("level", F.lit(1)).cast("long").alias("level"), "page")
    order = Window.partitionBy("doc").orderBy("seq")
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("doc").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)  # backwards, as in `structure.spans`
    rows = heads.select(
        "*",
        F.row_number().over(order).cast("long").alias("n"),
        *(F.last(F.when(F.col("level") <= k, F.col("page")), ignorenulls=True).over(ahead).alias(f"_end{k}") for k in LEVELS),
        *(F.last(F.when(F.col("level") <= k, F.struct("level", "title")), ignorenulls=True).over(behind).alias(f"_up{k}") for k in LEVELS),
    ).join(last, "doc")
    closing = F.coalesce(*(F.when(F.col("level") == k, F.col(f"_end{k}")) for k in LEVELS))
    # an ancestor of level k is the last heading at or above k, if its level is k
    above = F.array_compact(F.array(*(F.when((F.col("level") > k) & (F.col(f"_up{k}.level") == k), F.col(f"_up{k}.title")) for k in LEVELS)))
    path = F.filter(F.concat(above, F.array("title")), lambda t: t != "")
    end = F.when(closing.isNull(), F.col("_last")).otherwise(F.greatest("page", closing - 1))
    return rows.select("doc", "n", ident("s", F.col("n")).alias("id"), "seq", "title", "level", F.col("page").alias("page_start"), end.alias("page_end"), path.alias("path"))


def outlines(blocks: DataFrame) -> DataFrame:
    """doc, outline: the sections as nested JSON."""
    rows = sections(blocks).withColumn("path", F.array_join("path", " › "))
    return nested(rows, "doc", "n", ["id", "title", "level", "page_start", "page_end", "path"])


def contiguous(f, column: str) -> Column:
    """The least or largest offset of blocks that stand where they were found; of footnotes only where there is nothing else."""
    there = F.col("md_end") > F.col("md_start")
    return F.coalesce(f(F.when(there & (F.col("kind") != "footnote"), F.col(column))), f(F.when(there, F.col(column))), F.lit(0).cast("long"))


def chunk_map(blocks: DataFrame, target: int = 4000, least: int = 400) -> DataFrame:
    """doc, id, path, level, part, parts, page_start, page_end, chars, headings, blocks, md_start, md_end of every chunk.

    The path says where a chunk begins; a section that was cut by size is part k of n of its path; `headings` has those of
    short sections that a chunk took along.
    """
    rows = blocks.withColumn("chars", F.char_length("text").cast("long"))
    cut = chunks(rows, target, least)
    own = cut.select("doc", "chunk", F.explode(F.sequence("first", "last")).alias("seq"))
    order = Window.partitionBy("doc").orderBy("seq")
    n = F.sum((F.col("kind") == "heading").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = rows.withColumn("n", n).join(own, ["doc", "seq"])
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "heading", F.struct("seq", "text")))), lambda x: x["text"])
    found = at.groupBy("doc", "chunk").agg(
        F.min_by("n", "seq").alias("n"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum("chars").alias("chars"), heads.alias("headings"), F.array_sort(F.collect_list("seq")).alias("blocks"),
        contiguous(F.min, "md_start").alias("md_start"), contiguous(F.max, "md_end").alias("md_end"),
    )
    paths = sections(blocks).select("doc", "n", "path", "level")
    found = found.join(paths, ["doc", "n"], "left").withColumn("path", F.array_join(F.coalesce("path", F.array().cast("array<string>")), " › ")).withColumn("level", F.coalesce("level", F.lit(1).cast("long")))
    return parts(found, ["doc", "path"], "chunk").select("doc", ident("c", F.col("chunk") + 1).alias("id"), "path", "level", "part", "parts", "page_start", "page_end", "chars", "headings", "blocks", "md_start", "md_end")


def objects(blocks: DataFrame) -> DataFrame:
    """doc, seq, kind, id, page, text, md_start, md_end: tables (t001), figures (f001), and formulas and footnotes by block."""
    nth = F.row_number().over(Window.partitionBy("doc", "kind").orderBy("seq"))
    rows = blocks.filter(F.col("kind").isin("table", "figure", "formula", "footnote")).withColumn("_n", nth)
    name = F.when(F.col("kind") == "table", ident("t", F.col("_n"))).when(F.col("kind") == "figure", ident("f", F.col("_n"))).otherwise(ident("b", F.col("seq") + 1, 4))
    return rows.select("doc", "seq", "kind", name.alias("id"), "page", "text", "md_start", "md_end")


def page_map(blocks: DataFrame) -> DataFrame:
    """doc, number, chars, blocks, md_start, md_end of every page that has a block."""
    rows = blocks.groupBy("doc", F.col("page").alias("number")).agg(F.sum(F.char_length("text").cast("long")).alias("chars"), F.count("*").alias("blocks"), contiguous(F.min, "md_start").alias("md_start"), contiguous(F.max, "md_end").alias("md_end"))
    return rows


def block_map(blocks: DataFrame, full: bool = False) -> DataFrame:
    """doc, seq, id, kind, page, chars, md_start, md_end, level, ref: the blocks that are named; all of them if `full`."""
    refs = objects(blocks).filter("kind IN ('table', 'figure')").select("doc", "seq", F.col("id").alias("ref"))
    rows = blocks if full else blocks.filter(F.col("kind").isin(*STRUCTURAL))
    return rows.join(refs, ["doc", "seq"], "left").select("doc", "seq", ident("b", F.col("seq") + 1, 4).alias("id"), "kind", "page", F.char_length("text").cast("long").alias("chars"), "md_start", "md_end", F.when(F.col("kind") == "heading", F.col("level")).alias("level"), "ref")


def manifests(blocks: DataFrame, titles: DataFrame | None = None, full: bool = False, target: int = 4000, least: int = 400) -> DataFrame:
    """doc, manifest: one JSON for each document, everything about it except its text.  titles: doc, title.
    `blocks` is read for each list: give a written table where it takes work to make."""

    def listed(df, key, order):
        one = F.struct(F.col(order).alias("_o"), F.struct(*(c for c in df.columns if c not in ("doc", "seq"))).alias("x"))
        return df.groupBy("doc").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda v: v["x"])).alias(key))

    things = objects(blocks)
    of = lambda kind: things.filter(F.col("kind") == kind).drop("kind")
    pieces = chunk_map(blocks, target, least)
    counted = blocks.groupBy("doc").agg(F.count("*").alias("blocks"), *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in COUNTED), F.max("page").alias("pages"), F.sum(F.char_length("text").cast("long")).alias("chars"))
    counted = counted.join(pieces.groupBy("doc").agg(F.count("*").alias("chunks")), "doc", "left")
    counts = F.to_json(F.struct("blocks", *(f"{k}s" for k in COUNTED), F.coalesce("chunks", F.lit(0)).alias("chunks")))
    names = counted.select("doc").withColumn("title", F.lit("Document")) if titles is None else titles
    rows = counted.join(names, "doc", "left").select("doc", counts.alias("counts"), F.to_json(F.struct(F.coalesce("title", F.lit("Document")).alias("title"), F.col("pages").alias("page_count"), "chars", F.lit("full" if full else "structural").alias("block_index"))).alias("document"))
    lists = {"outline": outlines(blocks), "chunks": listed(pieces, "chunks", "id"), "pages": listed(page_map(blocks), "pages", "number"), "blocks": listed(block_map(blocks, full), "blocks", "seq")}
    lists |= {f"{k}s": listed(of(k), f"{k}s", "seq") for k in ("table", "figure", "formula", "footnote")}
    for df in lists.values():
        rows = rows.join(df, "doc", "left")
    body = [F.concat(F.lit(f'"{k}": '), F.coalesce(k, F.lit("[]"))) for k in lists]
    head = [F.lit('"schema": "foliant/1"'), F.concat(F.lit('"document": '), "document"), F.concat(F.lit('"counts": '), "counts")]
    return rows.select("doc", F.concat(F.lit("{"), F.array_join(F.array(*head, *body), ", "), F.lit("}")).alias("manifest"))
