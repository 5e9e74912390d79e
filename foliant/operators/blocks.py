"""From lines to blocks, sections, chunks, Markdown and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: a sentence's end, a small first letter, mathematical signs and fonts, a footnote's marker
SENTENCE_END = r"[.!?:;׃״\"')\]]\s*$"
OPENS_LOWER = r"[a-zà-ÿ]"
MATH_SIGNS = "=+−*/^_<>≤≥≈≠±×÷∑∏∫√∞∂∇πθαβγδλμσωΔΩ→←↔⇒⇔∈∉⊆⊂∪∩∀∃¬∧∨"
MATH_FONT = r"(?i)(cmmi|cmsy|cmex|mathjax|math|symbol|euclid|mtmi)"
FOOTNOTE = r"^(\[?[0-9]{1,3}\]?[.)]?|[¹²³⁴⁵⁶⁷⁸⁹⁰]+|[*†‡§]{1,3})\s+(\S.*)$"
#: Kinds that stand alone, whatever is around them.
ALONE = ("heading", "caption", "formula", "footnote", "table", "figure")


def is_formula(line: Column, fonts: Column | None = None) -> Column:
    """2 to 200 characters, and a font of mathematics, or two signs or more, at most four longer words, signs at least 8 %
    and letters at most 60 % of the characters."""
    n, signs, letters = F.char_length(line), F.regexp_count(line, F.lit("[" + MATH_SIGNS.replace("^", r"\^") + "]")), F.regexp_count(line, F.lit(r"\p{L}"))
    words = F.size(F.filter(F.split(line, r"\s+"), lambda w: (F.char_length(w) > 2) & w.rlike(r"^\p{L}+$")))
    dense = (signs >= 2) & (words <= 4) & (signs >= 0.08 * n) & (letters <= 0.6 * n)
    return n.between(2, 200) & (dense if fonts is None else F.coalesce(F.exists(fonts, lambda f: f.rlike(MATH_FONT)), F.lit(False)) | dense)


def is_footnote(line: Column, top: Column, height: Column, size: Column, body: Column, superscript: Column | None = None) -> Column:
    """At the foot of the page (from 72 % of its height), opening with a marker or a raised one, and small (95 % of the
    body's size): all three."""
    marked = line.rlike(FOOTNOTE) if superscript is None else line.rlike(FOOTNOTE) | (F.coalesce(superscript, F.lit("")) != "")
    return (top >= 0.72 * height) & marked & (size <= 0.95 * body)


def heading_level(line: Column, size: Column, ranks: Column, bold: Column | None = None) -> Column:
    """A line's level as a heading, 0 for none: by the first size rank that it reaches to 0.96 (then at most 120
    characters); else by its wording; else 2 for a short bold line that ends no sentence, where there are no ranks."""
    from .structure import keyword_heading, outline_heading

    n = F.char_length(F.trim(line))
    hit = F.array_position(F.transform(ranks, lambda r: F.bround(size, 1) >= 0.96 * r), True)
    by_size = F.when(hit > 0, F.when(n <= 120, F.least(hit, F.lit(6))).otherwise(0))
    by_words = F.coalesce(keyword_heading(F.trim(line)), outline_heading(F.trim(line)))["level"]  # 4 at most
    weight = F.lit(0) if bold is None else F.when((F.coalesce(F.size(ranks), F.lit(0)) < 1) & bold & (n <= 80) & ~line.rlike(SENTENCE_END), 2).otherwise(0)
    return F.when((n < 1) | (n > 200), 0).otherwise(F.coalesce(by_size, by_words, weight)).cast("long")


def classified(lines: DataFrame, ranks: DataFrame, height: float) -> DataFrame:
    """`lines` (doc, page, seq, top, text, size and, where known, bold, fonts, superscript) with kind and level: heading,
    footnote, caption, formula, list or paragraph, in this order.  ranks: doc, body, ranks."""
    have = lambda c: F.col(c) if c in lines.columns else None
    text = F.trim("text")
    rows = lines.join(ranks, "doc", "left").withColumn("level", heading_level(F.col("text"), F.col("size"), F.col("ranks"), have("bold")))
    foot = is_footnote(F.col("text"), F.col("top"), F.lit(height), F.col("size"), F.col("body"), have("superscript"))
    kind = F.when(F.col("level") > 0, "heading").when(F.coalesce(foot, F.lit(False)), "footnote").when(T.is_caption(text), "caption").when(is_formula(text, have("fonts")), "formula").when(T.is_list_item(text), "list").otherwise("paragraph")
    return rows.withColumn("kind", kind).drop("body", "ranks")


def stream(lines: DataFrame, objects: DataFrame) -> DataFrame:
    """Lines and objects (doc, page, anchor, kind, text) in one order: place; an object follows the line it is anchored to."""
    rows = lines.withColumn("_at", F.col("seq")).withColumn("_is", F.lit(0)).unionByName(objects.withColumnRenamed("anchor", "_at").withColumn("_is", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("doc").orderBy("page", "_at", "_is", "kind", "text")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).drop("_at", "_is")


def assembled(lines: DataFrame, gaps: DataFrame, width: float) -> DataFrame:
    """`lines` (as `stream` or `classified` give them, with col) with block and item, numbers within their document.

    Headings, captions, formulas, footnotes, tables and figures stand alone.  A list line goes on with an open list; an
    unmarked line under an item is the item's next line if it stands no further left and the item has not ended a
    sentence.  A paragraph goes on over a page break while its sentence is open, and else while no new one starts: in
    another column, after more than 1.8 usual gaps, with an indent of over 0.9 heights after a line of 55 % of the width,
    or after a sentence's end on a line of under 62 %.
    """
    w = Window.partitionBy("doc").orderBy("place")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    was = {c: F.lag(c).over(w).alias(f"_{c}") for c in ("kind", "page", "col", "x0", "x1", "bottom", "text")}
    rows = lines.join(gaps.select("doc", "page", F.col("gap").alias("_gap")), ["doc", "page"], "left")
    rows = rows.select("*", *was.values(), F.sum((F.col("kind") != "paragraph").cast("long")).over(so_far).alias("_part"))
    ended = F.coalesce(F.col("_text").rlike(SENTENCE_END), F.lit(False))
    # a part is a line of another kind and the paragraph lines behind it; behind a list line they may be its item's
    part = Window.partitionBy("doc", "_part").orderBy("place")
    rows = rows.withColumn("_head", F.first("kind").over(part)).withColumn("_left", F.first("x0").over(part))
    leaves = (F.col("kind") == "paragraph") & ((F.col("x0") < F.col("_left") - 2) | ended)
    rows = rows.withColumn("_out", F.sum(F.coalesce(leaves, F.lit(False)).cast("long")).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_in", (F.col("_head") == "list") & (F.col("_out") == 0)).withColumn("_was_in", F.coalesce(F.lag("_in").over(w), F.lit(False)))
    gap, tall = F.coalesce("_gap", F.lit(0.0)), F.col("bottom") - F.col("top")
    far = F.col("top") - F.col("_bottom")
    wide = (F.col("_x1") - F.col("_x0")) / width
    starts = (F.col("col") != F.col("_col")) | ((gap > 0) & (far > 1.8 * gap)) | ((F.abs(F.col("x0") - F.col("_x0")) > 0.9 * tall) & (far <= 1.8 * gap) & (wide >= 0.55)) | (ended & (wide < 0.62))
    follows = (F.col("_kind") == "paragraph") & ~F.col("_was_in")
    goes_on = F.when(F.col("kind") == "list", F.col("_was_in")).when(F.col("kind") != "paragraph", False).when(F.col("_in"), True).when(~follows, False).when(F.col("page") != F.col("_page"), ~ended).otherwise(~starts)
    rows = rows.withColumn("block", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("long")).over(so_far))
    item = F.sum((F.col("kind") == "list").cast("long")).over(Window.partitionBy("doc", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("item", item).drop(*(c for c in rows.columns if c.startswith("_")))


def healed(lines: Column) -> Column:
    """An array of lines as one text; a word cut by a hyphen at a line's end is whole again."""
    joined = F.array_join(F.transform(lines, lambda x: F.trim(x)), "\n")  # F.trim alone would take the place for the characters to trim
    return F.regexp_replace(F.regexp_replace(joined, rf"-\n({OPENS_LOWER})", "$1"), "\n", " ")


def list_item(text: Column) -> Column:
    """marker, text and ordered of a list line, its marker at either end; without one the marker is empty."""
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    said = lambda marker, rest, ordered: F.struct(marker.alias("marker"), F.trim(rest).alias("text"), F.lit(ordered).alias("ordered"))
    return (
        F.when(text.rlike(T.BULLET), said(part(T.BULLET, 1), part(T.BULLET, 2), False)).when(text.rlike(T.NUMBERED), said(part(T.NUMBERED, 1), part(T.NUMBERED, 3), True))
        .when(text.rlike(T.BULLET_RTL), said(part(T.BULLET_RTL, 2), part(T.BULLET_RTL, 1), False)).otherwise(said(F.lit(""), text, False))
    )


def built(lines: DataFrame) -> DataFrame:
    """doc, block, id, kind, level, text, items, ordered, marker, first_page, last_page of `assembled` lines."""
    line = F.trim("text")
    own = F.when(F.col("kind") == "list", list_item(line)["text"]).when((F.col("kind") == "footnote") & line.rlike(FOOTNOTE), F.regexp_extract(line, FOOTNOTE, 2)).otherwise(line)
    mark = F.when(F.col("kind") == "list", list_item(line)["marker"]).when(F.col("kind") == "footnote", F.regexp_replace(F.regexp_extract(line, FOOTNOTE, 1), r"^[.)\]\[]+|[.)\]\[]+$", "")).otherwise("")
    rows = lines.select("doc", "block", "item", "place", "page", "kind", "level", own.alias("own"), mark.alias("mark"), ((F.col("kind") == "list") & list_item(line)["ordered"]).alias("number"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "own"))), lambda x: x["own"])
    parts = rows.groupBy("doc", "block", "item").agg(healed(ordered).alias("text"), F.min("place").alias("place"), F.min_by("kind", "place").alias("kind"), F.min_by("level", "place").alias("level"), F.min_by("mark", "place").alias("mark"), F.min_by("number", "place").alias("number"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda x: x["text"])
    first = lambda c: F.min_by(c, "place").alias(c)
    out = parts.groupBy("doc", "block").agg(texts.alias("_t"), first("kind"), first("level"), first("mark"), first("number"), F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))
    listed = F.col("kind") == "list"
    return out.select(
        "doc", "block", F.concat(F.lit("b"), F.lpad(F.col("block").cast("string"), 4, "0")).alias("id"), "kind", F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.when(listed, "").otherwise(F.col("_t")[0]).alias("text"),
        F.when(listed, F.col("_t")).otherwise(F.array().cast("array<string>")).alias("items"), (listed & F.col("number")).alias("ordered"), F.col("mark").alias("marker"), "first_page", "last_page",
    )


def document_title(blocks: DataFrame, titles: DataFrame, fallback: str = "Document") -> DataFrame:
    """doc, title: that of the metadata (doc, meta_title) where it is one and no file's name, else the first heading of
    the first two levels and pages, else the fallback."""
    found = blocks.filter((F.col("kind") == "heading") & (F.col("first_page") <= 2) & F.col("level").between(1, 2)).groupBy("doc").agg(F.min_by("text", "block").alias("_first"))
    meta = F.trim(F.coalesce("meta_title", F.lit("")))
    good = (F.char_length(meta) >= 4) & ~meta.rlike(r"(?i)\.(docx?|pdf|indd|pptx?|tex|pages)\b") & ~meta.rlike(r"(?i)^(untitled|document[0-9]*|microsoft word)")
    return titles.join(found, "doc", "left").select("doc", F.when(good, meta).otherwise(F.coalesce("_first", F.lit(fallback))).alias("title"))


def chunks(blocks: DataFrame, target: int = 4000, least: int = 400) -> DataFrame:
    """doc, chunk, first, last, chars: blocks (doc, seq, kind, chars) packed in order.

    A heading closes a chunk of at least `least` characters; a chunk closes once it has `target`.
    """
    item = F.struct("seq", "kind", "chars")
    one = "struct<first:bigint,last:bigint,chars:bigint>"
    kind = f"struct<done:array<{one}>,now:{one}>"
    start = F.struct(F.array().alias("done"), F.lit(None).alias("now")).cast(kind)

    def step(s, b):
        own = F.struct(b["seq"].alias("first"), b["seq"].alias("last"), b["chars"].alias("chars")).cast(one)
        more = F.struct(s["now"]["first"].alias("first"), b["seq"].alias("last"), (s["now"]["chars"] + b["chars"]).alias("chars")).cast(one)
        full = (s["now"]["chars"] >= target) | ((b["kind"] == "heading") & (s["now"]["chars"] >= least))
        return F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), own.alias("now")).cast(kind)).when(full, F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), own.alias("now")).cast(kind)).otherwise(F.struct(s["done"].alias("done"), more.alias("now")).cast(kind))

    out = F.aggregate(F.array_sort(F.collect_list(item)), start, step)
    rows = blocks.groupBy("doc").agg(F.concat(out["done"], F.array(out["now"])).alias("c")).select("doc", F.posexplode("c").alias("chunk", "c"))
    return rows.select("doc", F.col("chunk").cast("long").alias("chunk"), "c.first", "c.last", "c.chars")


def parts(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """`rows` with part and parts within their path."""
    w = Window.partitionBy(*group)
    return rows.withColumn("part", F.row_number().over(w.orderBy(order)).cast("long")).withColumn("parts", F.count("*").over(w))


def markdown(blocks: DataFrame) -> DataFrame:
    """doc, seq, md, md_start, md_end: blocks (doc, seq, kind, level, text, page) as Markdown with offsets (code points).

    A page mark stands before the first block of a page; footnotes go to the end; blocks are parted by a blank line.
    """
    foot = (F.col("kind") == "footnote").cast("int")
    order = Window.partitionBy("doc").orderBy(foot, "seq")
    body = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.col("text"))).when(F.col("kind") == "list", list_markdown(F.col("items"), F.col("ordered")) if "items" in blocks.columns else F.concat(F.lit("- "), F.col("text"))).when(F.col("kind") == "quote", F.concat(F.lit("> "), F.col("text"))).when(F.col("kind") == "footnote", F.concat(F.lit("[^"), F.col("seq"), F.lit("]: "), F.col("text"))).otherwise(F.col("text"))
    turned = ~F.col("page").eqNullSafe(F.lag("page").over(order)) & (F.col("kind") != "footnote")
    rows = blocks.withColumn("mark", F.when(turned, F.concat(F.lit("<!-- page "), F.col("page"), F.lit(" -->\n\n"))).otherwise(F.lit(""))).withColumn("md", body)
    size = F.char_length("mark") + F.char_length("md") + 2
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (before + F.char_length("mark")).cast("long")
    return rows.withColumn("md_start", start).withColumn("md_end", (F.col("md_start") + F.char_length("md")).cast("long")).withColumn("foot", foot)


def rendered(rows: DataFrame) -> DataFrame:
    """doc, markdown: what the offsets of `markdown` refer to."""
    piece = F.transform(F.array_sort(F.collect_list(F.struct("foot", "seq", F.concat("mark", "md").alias("piece")))), lambda x: F.concat(x["piece"], F.lit("\n\n")))
    return rows.groupBy("doc").agg(F.array_join(piece, "").alias("markdown"))


def page_ranges(rows: DataFrame) -> DataFrame:
    """doc, page, md_start, md_end: from the first to the last block of a page, footnotes only where there is nothing else."""
    w = lambda c, f: F.coalesce(f(F.when(F.col("kind") != "footnote", F.col(c))), f(c)).alias(c)
    return rows.groupBy("doc", "page").agg(w("md_start", F.min), w("md_end", F.max))


def kind_counts(blocks: DataFrame) -> DataFrame:
    """doc and a count for each kind."""
    kinds = ("heading", "paragraph", "list", "table", "footnote")
    return blocks.groupBy("doc").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds))


def manifests(blocks: DataFrame) -> DataFrame:
    """doc, manifest: JSON with the outline and the counts of a document."""
    outline = F.array_sort(F.collect_list(F.when(F.col("kind") == "heading", F.struct("seq", "level", "text", "page"))))
    return blocks.groupBy("doc").agg(F.to_json(F.struct(F.lit("foliant/1").alias("schema"), F.count("*").alias("blocks"), F.max("page").alias("page_count"), outline.alias("outline"))).alias("manifest"))


def list_markdown(items: Column, ordered: Column) -> Column:
    """A list's items on lines of their own, with dashes or numbers."""
    return F.array_join(F.transform(items, lambda x, k: F.concat(F.when(ordered, F.concat((k + 1).cast("string"), F.lit("."))).otherwise(F.lit("-")), F.lit(" "), F.trim(x))), "\n")


def figure_markdown(figure: Column, page: Column, kind: Column, caption: Column, asset: Column) -> Column:
    """An image, or its bold caption where no file was taken out, with a note of what it is."""
    label = F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.when(kind == "drawing", "drawing").otherwise("image"))
    line = F.when(F.coalesce(asset, F.lit("")) != "", F.concat(F.lit("!["), label, F.lit("]("), asset, F.lit(")"))).otherwise(F.concat(F.lit("**["), label, F.lit("]**")))
    return F.concat(line, F.lit("\n<!-- figure: "), figure, F.lit(" | page "), page.cast("string"), F.lit(" | "), kind, F.lit(" -->"))


def front_matter(**fields: Column) -> Column:
    """A YAML header of quoted fields."""
    rows = [F.concat(F.lit(f'{k}: "'), F.replace(v.cast("string"), F.lit('"'), F.lit("'")), F.lit('"')) for k, v in fields.items()]
    return F.concat(F.array_join(F.array(F.lit("---"), *rows, F.lit("---")), "\n"), F.lit("\n\n"))


def table_markdown(header: Column, rows: Column) -> Column:
    """A table of cells as Markdown; pipes are escaped, rows padded, the first row leads where there is no header."""
    clean = lambda r: F.transform(r, lambda c: F.regexp_replace(F.regexp_replace(c, "\\n", " "), r"\|", r"\\|"))
    head = F.when(F.size(header) > 0, header).otherwise(F.element_at(rows, 1))
    body = F.when(F.size(header) > 0, rows).otherwise(F.slice(rows, F.lit(2), F.size(rows)))
    width = F.greatest(F.size(head), F.array_max(F.transform(rows, F.size)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(clean(r), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.array_join(F.concat(F.array(line(head), rule), F.transform(body, line)), "\n")


def table_kept(rows: Column) -> Column:
    """Two rows and two columns at least, and as many filled cells as max(3, 30 %)."""
    cells = F.flatten(rows)
    return (F.size(rows) >= 2) & (F.array_max(F.transform(rows, F.size)) >= 2) & (F.size(F.filter(cells, lambda c: F.trim(c) != "")) >= F.greatest(F.lit(3.0), 0.3 * F.size(cells)))
