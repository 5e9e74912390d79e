"""Books cut into chapters, concepts led to their sections, and outlines nested.

Lines have book, page, pos (their place on the page) and line; headings have book, page, pos, level, label and title.  A
book's lines are never gathered: chapters are intervals of (page, pos), and lines meet them by book and bin of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of a bin.  A chapter is in as many bins as it has runs of so many pages.
BIN = 8
#: Characters before the first heading that make a chapter of their own.
FRONT_CHARS = 200
FRONT = "Front matter"
#: A page beyond all others.
END = 2**31 - 1


def binned(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Each line with every span that holds it.  spans: book, from_page, from_pos (excluded), to_page, to_pos (excluded) and
    more.  A span's bins are counted over the pages that its book has."""
    last = lines.groupBy("book").agg(F.max("page").alias("_last"))
    first_bin, last_bin = F.floor(F.greatest(F.col("from_page"), F.lit(0)) / BIN), F.floor(F.least("to_page", "_last") / BIN)
    dealt = spans.join(last, "book").filter(first_bin <= last_bin).withColumn("_bin", F.explode(F.sequence(first_bin, last_bin))).drop("_last")
    rows = lines.withColumn("_bin", F.floor(F.col("page") / BIN))
    after = (F.col("page") > F.col("from_page")) | ((F.col("page") == F.col("from_page")) & (F.col("pos") > F.col("from_pos")))
    before = (F.col("page") < F.col("to_page")) | ((F.col("page") == F.col("to_page")) & (F.col("pos") < F.col("to_pos")))
    return rows.join(dealt, ["book", "_bin"]).filter(after & before).drop("_bin", "from_page", "from_pos", "to_page", "to_pos")


def own_spans(found: DataFrame, books: DataFrame) -> DataFrame:
    """book, n, span: from each heading to the next of any level, and what stands before the first (n = 0)."""
    order = Window.partitionBy("book").orderBy("page", "pos")
    rows = found.select("book", "page", "pos", F.row_number().over(order).cast("long").alias("n"), F.lead(F.struct("page", "pos")).over(order).alias("next"))
    end = lambda c, other: F.coalesce(F.col(f"next.{c}"), F.lit(other).cast("long"))
    spans = rows.select("book", "n", F.col("page").alias("from_page"), F.col("pos").alias("from_pos"), end("page", END).alias("to_page"), end("pos", 0).alias("to_pos"))
    first = books.select("book").distinct().join(rows.filter("n = 1").select("book", "page", "pos"), "book", "left")
    front = first.select("book", F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("from_page"), F.lit(-1).cast("long").alias("from_pos"), F.coalesce("page", F.lit(END).cast("long")).alias("to_page"), F.coalesce("pos", F.lit(0).cast("long")).alias("to_pos"))
    return spans.unionByName(front)


def chapter_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """book, n, page, pos, line: every line under its heading; n = 0 before the first one.  Headings are in no chapter."""
    return binned(lines.select("book", "page", "pos", "line"), own_spans(found, lines)).select("book", "n", "page", "pos", "line")


def chapters(lines: DataFrame, found: DataFrame) -> DataFrame:
    """book, n, label, level, start_page, end_page, chars, lines: the chapters of every book.

    A chapter's lines end at the next heading, its pages only before the next heading of its level or above.  What stands
    before the first heading is a chapter where it has over 200 characters, or where there are no headings.
    """
    from .structure import spans

    sizes = chapter_lines(lines, found).groupBy("book", "n").agg(F.sum(F.char_length("line").cast("long")).alias("chars"), F.count("*").alias("lines"))
    books = lines.groupBy("book").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    n = F.row_number().over(Window.partitionBy("book").orderBy("page", "pos")).cast("long")
    rows = spans(found, books.select("book", "last")).select("book", n.alias("n"), "label", "level", F.col("page").alias("start_page"), "end_page")
    first = found.groupBy("book").agg(F.min("page").alias("to"))
    front = books.join(first, "book", "left").join(sizes.filter("n = 0"), "book").filter(F.col("to").isNull() | (F.col("chars") > FRONT_CHARS))
    front = front.select("book", "n", F.lit(FRONT).alias("label"), F.lit(1).cast("long").alias("level"), F.col("first").alias("start_page"), F.coalesce("to", "last").alias("end_page"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.unionByName(front).join(sizes, ["book", "n"], "left").select("book", "n", "label", "level", "start_page", "end_page", zero("chars"), zero("lines"))


def section_source(lines: DataFrame, found: DataFrame, concepts: DataFrame) -> DataFrame:
    """concept, book, page, pos, line: what a concept is to be read in.  concepts: concept, book, section.

    The first section with the concept's label, case aside, with all below it; the whole book where none has it.
    """
    key = lambda c: F.lower(F.trim(c))
    ahead = Window.partitionBy("book").orderBy(F.desc("page"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)  # backwards, as in `structure.spans`
    levels = range(1, 5)
    closing = F.coalesce(*(F.when(F.col("level") == k, F.last(F.when(F.col("level") <= k, F.struct("page", "pos")), ignorenulls=True).over(ahead)) for k in levels))
    rows = found.select("book", key("label").alias("_k"), "page", "pos", closing.alias("next"))
    hits = concepts.withColumn("_k", key("section")).join(rows, ["book", "_k"]).groupBy("concept", "book").agg(F.min_by(F.struct("page", "pos", "next"), F.struct("page", "pos")).alias("at"))
    every = concepts.select("concept", "book").join(hits, ["concept", "book"], "left")
    long = lambda c, other: F.coalesce(F.col(c), F.lit(other).cast("long"))
    spans = every.select("concept", "book", long("at.page", -1).alias("from_page"), long("at.pos", -1).alias("from_pos"), long("at.next.page", END).alias("to_page"), long("at.next.pos", 0).alias("to_pos"))
    return binned(lines.select("book", "page", "pos", "line"), spans).select("concept", "book", "page", "pos", "line")


def section_tree(blocks: DataFrame, most: float = 0.8) -> DataFrame:
    """doc, section, title, level, path, chars, total_chars: the sections of texts (doc, pos, line) by their headings.

    Levels are the depth among a section's ancestors, so they go from 1 without a gap; the path has the ancestors' titles
    and the own one; chars ends at the next heading, total_chars at the next one of the level or above.  A text without
    headings, or of headings nearly all, has none.
    """
    from .lessons import heading_level

    rows = blocks.select("doc", "pos", "line", heading_level(F.col("line")).alias("raw"))
    order = Window.partitionBy("doc").orderBy("pos")
    rows = rows.withColumn("section", F.sum((F.col("raw") > 0).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    good = rows.groupBy("doc").agg(F.count("*").alias("n"), F.count_if(F.col("raw") > 0).alias("heads")).filter((F.col("heads") > 0) & (F.col("heads") < most * F.col("n")))
    chars = F.sum(F.when(F.col("raw") == 0, F.char_length("line")).otherwise(0).cast("long"))
    own = rows.join(good, "doc", "left_semi").filter("section > 0").groupBy("doc", "section").agg(F.min_by("line", "pos").alias("title"), F.min_by("raw", "pos").alias("raw"), chars.alias("chars"))
    w = Window.partitionBy("doc").orderBy("section")
    behind = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("doc").orderBy(F.desc("section")).rowsBetween(Window.unboundedPreceding, -1)  # backwards, as in `structure.spans`
    me = F.struct("raw", "title")
    own = own.withColumn("_before", F.coalesce(F.sum("chars").over(behind), F.lit(0).cast("long"))).withColumn("_all", F.sum("chars").over(Window.partitionBy("doc")))
    own = own.select("*", *(F.last(F.when(F.col("raw") <= k, me), ignorenulls=True).over(behind).alias(f"_up{k}") for k in (1, 2)), *(F.last(F.when(F.col("raw") <= k, F.col("_before")), ignorenulls=True).over(ahead).alias(f"_end{k}") for k in (1, 2, 3)))
    above = F.array_compact(F.array(*(F.when((F.col("raw") > k) & (F.col(f"_up{k}.raw") == k), F.col(f"_up{k}.title")) for k in (1, 2))))
    end = F.coalesce(*(F.when(F.col("raw") == k, F.col(f"_end{k}")) for k in (1, 2, 3)), F.col("_all"))
    return own.select("doc", "section", "title", (F.size(above) + 1).cast("long").alias("level"), F.array_join(F.concat(above, F.array("title")), " > ").alias("path"), "chars", (end - F.col("_before")).alias("total_chars"))


def nested(rows: DataFrame, key: str, order: str, fields: list[str], level: str = "level") -> DataFrame:
    """key, outline: rows in order as one nested JSON; a row is a child of the last one before with a lesser level.

    A row's depth is that of its ancestors and one; its text opens it, and closes it and all that end with it, which the
    next row's depth tells.  So one pass nests outlines of any depth, without a step for each.
    """
    levels = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(level).cast("long").alias("l"), F.to_json(F.struct(*fields)).alias("j")))).alias("all"))
    kind = "struct<stack:array<bigint>,out:array<int>>"
    start = F.struct(F.array().alias("stack"), F.array().alias("out")).cast(kind)

    def step(s, x):
        held = F.concat(F.filter(s["stack"], lambda y: y < x["l"]), F.array(x["l"]))
        return F.struct(held.alias("stack"), F.concat(s["out"], F.array(F.size(held))).alias("out")).cast(kind)

    deep = levels.select(key, "all", F.aggregate("all", start, step)["out"].alias("d"))
    depth = lambda k: F.coalesce(F.get("d", k), F.lit(1))

    def piece(x, k):
        here, then = depth(k), depth(k + 1)
        last = k == F.size("d") - 1
        opened = F.concat(F.substr(x["j"], F.lit(1), F.length(x["j"]) - 1), F.lit(', "children": ['))
        closed = F.when(then > here, "").otherwise(F.concat(F.repeat(F.lit("]}"), here - then + 1), F.when(last, "").otherwise(", ")))
        return F.concat(opened, closed)

    return deep.select(key, F.concat(F.lit("["), F.array_join(F.transform("all", piece), ""), F.lit("]")).alias("outline"))


def flattened(rows: DataFrame, key: str, json: str, fields: dict[str, str]) -> DataFrame:
    """key, n, depth and `fields` (name: type): the nodes of nested outlines in document order, however deep.

    One recursive query: each round goes to the children of the round before.
    """
    spark = rows.sparkSession
    for limit in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"):  # a finite text ends by itself
        spark.conf.set(limit, "-1")
    own = rows.select(F.col(key).alias("_key"), F.col(json).alias("_json"))
    found = spark.sql(
        """WITH RECURSIVE nodes (_key, path, node) AS (
  SELECT _key, array(at), node FROM (SELECT _key, posexplode(from_json(_json, 'array<string>')) AS (at, node) FROM {own})
  UNION ALL SELECT _key, concat(path, array(at)), child FROM (SELECT _key, path, posexplode(from_json(get_json_object(node, '$.children'), 'array<string>')) AS (at, child) FROM nodes))
SELECT * FROM nodes""",
        own=own,
    )
    get = lambda name, kind: F.get_json_object("node", f"$.{name}").cast(kind).alias(name)
    n = F.row_number().over(Window.partitionBy("_key").orderBy("path")).cast("long")
    return found.select(F.col("_key").alias(key), n.alias("n"), F.size("path").cast("long").alias("depth"), *(get(k, v) for k, v in fields.items()))


def numbered(rows: DataFrame, key: str, order: str, prefixes: Column) -> DataFrame:
    """`rows` with id: a letter for their kind and their number among its kind in the order of the document."""
    nth = F.row_number().over(Window.partitionBy(key, prefixes).orderBy(order))
    return rows.withColumn("id", F.concat(prefixes, F.lpad(nth.cast("string"), 4, "0")))
