"""Digests of long documents: every part named, then passages of all parts by their share, within a budget of characters.

`passages` have doc, part, title, pos and text.  A passage beyond the budget within its own part can never be picked, so what
a document's windows see is bounded by its parts times the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = "[...]"
#: Characters that a passage takes beside its own: a gap mark, blank lines, the brackets of its label.
MARKS = len(GAP) + 8
#: The longest label of a passage, and the share of the budget that goes to the outline and to the closing passage.
LABEL = 40
OUTLINE_SHARE, CLOSING_SHARE = 3, 10


def in_turn(passages: DataFrame, budget: int) -> DataFrame:
    """Passages (doc, part, pos, text) in turns: one of each part before any second one, while the budget lasts."""
    turn = F.row_number().over(Window.partitionBy("doc", "part").orderBy("pos"))
    order = Window.partitionBy("doc").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("text").cast("long") + len(GAP) + 4
    rows = passages.withColumn("turn", turn.cast("long")).withColumn("used", F.sum(size).over(order))
    return rows.filter(F.col("used") <= budget)


def apportioned(sizes: DataFrame, budget: int) -> DataFrame:
    """Passages (doc, part, pos, size) by proportional depth, with round (1, 2 or 3).

    First one of each part, in order, while the budget lasts.  What is left is dealt to the parts by their share of the
    document's characters, by largest remainder: whole characters by share, the rest one each to the parts with the
    largest fractions, earlier parts first.  A part takes its next passages up to its portion.  What then is left takes
    passages in the order of the document, while it lasts.
    """
    of_part, of_doc = Window.partitionBy("doc", "part").orderBy("pos"), Window.partitionBy("doc")
    so_far = Window.unboundedPreceding
    rows = sizes.withColumn("_nth", F.row_number().over(of_part)).withColumn("_in", F.sum("size").over(of_part.rowsBetween(so_far, 0))).withColumn("_part", F.sum("size").over(Window.partitionBy("doc", "part")))
    rows = rows.filter(F.col("_in") <= budget)
    first = F.col("_nth") == 1
    taken = F.sum(F.when(first, F.col("size")).otherwise(0)).over(of_doc.orderBy("part", "pos").rowsBetween(so_far, 0))
    rows = rows.withColumn("_one", first & (taken <= budget))
    left = budget - F.coalesce(F.sum(F.when(F.col("_one"), F.col("size"))).over(of_doc), F.lit(0))
    rows = rows.withColumn("_left", left).withColumn("_head", F.sum(F.when(first, F.col("size"))).over(Window.partitionBy("doc", "part")))
    # shares are of whole parts, one row a part; the exact share is _left * _part / _all
    parts = rows.filter("_nth = 1").select("doc", "part", "_part", "_left")
    parts = parts.withColumn("_all", F.sum("_part").over(of_doc)).withColumn("_floor", F.expr("_left * _part div _all")).withColumn("_rest", F.expr("_left * _part % _all"))
    spare = F.col("_left") - F.sum("_floor").over(of_doc)
    parts = parts.withColumn("_quota", F.col("_floor") + (F.row_number().over(of_doc.orderBy(F.desc("_rest"), "part")) <= spare).cast("long")).select("doc", "part", "_quota")
    rows = rows.join(parts, ["doc", "part"]).withColumn("_two", ~F.col("_one") & (F.col("_nth") > 1) & (F.col("_in") - F.col("_head") <= F.col("_quota")))
    rest = F.col("_left") - F.coalesce(F.sum(F.when(F.col("_two"), F.col("size"))).over(of_doc), F.lit(0))
    more = F.sum(F.when(~F.col("_one") & ~F.col("_two"), F.col("size")).otherwise(0)).over(of_doc.orderBy("part", "pos").rowsBetween(so_far, 0))
    rows = rows.withColumn("_rest", rest).withColumn("_more", more)
    turn = F.when(F.col("_one"), 1).when(F.col("_two"), 2).when(F.col("_more") <= F.col("_rest"), 3)
    return rows.withColumn("round", turn.cast("long")).filter("round IS NOT NULL").select(*sizes.columns, "round")


def joined(order: list[str], text: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), by)


def outlines(passages: DataFrame, budget: int) -> DataFrame:
    """doc, outline: every part's title with its share of the document, titles shortened alike where there are many."""
    parts = passages.groupBy("doc", "part").agg(F.min_by("title", "pos").alias("title"), F.sum(F.char_length("text").cast("long")).alias("_n"))
    of_doc = Window.partitionBy("doc")
    parts = parts.withColumn("_share", F.floor(100.0 * F.col("_n") / F.sum("_n").over(of_doc) + 0.5).cast("string")).withColumn("_k", F.count("*").over(of_doc))
    # "; " and " (100%)" beside each title
    room = F.greatest(F.lit(1), F.floor((budget // OUTLINE_SHARE - 12) / F.col("_k")) - 9).cast("int")
    parts = parts.withColumn("name", F.concat(F.left("title", room), F.lit(" ("), "_share", F.lit("%)")))
    return parts.groupBy("doc").agg(F.left(F.concat(F.lit("[OUTLINE] "), joined(["part"], "name", "; ")), F.lit(budget // OUTLINE_SHARE)).alias("outline"))


def digests(passages: DataFrame, budget: int) -> DataFrame:
    """doc, digest: the text itself where it is short, else the outline, passages of all parts in document order, each with
    its part's name where another one begins and with marks where something is left out, and the closing passage."""
    size = F.char_length("text").cast("long")
    rows = passages.withColumn("size", size + MARKS + F.least(F.char_length("title"), F.lit(LABEL)))
    whole = passages.groupBy("doc").agg(F.sum(size + 2).alias("_chars"), F.max_by("text", F.struct("part", "pos")).alias("last"))
    short = whole.filter(F.col("_chars") - 2 <= budget).select("doc")
    long = whole.join(short, "doc", "left_anti")
    room = budget - budget // OUTLINE_SHARE - budget // CLOSING_SHARE - 40
    picked = apportioned(rows.join(long.select("doc"), "doc", "left_semi").select("doc", "part", "pos", "size"), room).select("doc", "part", "pos").join(passages, ["doc", "part", "pos"])
    order = Window.partitionBy("doc").orderBy("part", "pos")
    gone = F.lag("pos").over(order).isNotNull() & (F.col("pos") != F.lag("pos").over(order) + 1)
    opens = ~F.col("part").eqNullSafe(F.lag("part").over(order))
    label = F.concat(F.lit("["), F.left("title", F.lit(LABEL)), F.lit("]\n"))
    piece = F.concat(F.when(gone, f"{GAP}\n").otherwise(""), F.when(opens, label).otherwise(""), F.col("text"))
    body = picked.withColumn("piece", piece).groupBy("doc").agg(joined(["part", "pos"], "piece", "\n\n").alias("body"))
    closing = F.concat(F.lit("[CLOSING] "), F.left("last", F.lit(budget // CLOSING_SHARE)))
    made = long.join(outlines(passages, budget), "doc").join(body, "doc", "left")
    made = made.select("doc", F.left(F.array_join(F.array_compact(F.array("outline", "body", closing)), "\n\n"), F.lit(budget)).alias("digest"))
    kept = passages.join(short, "doc", "left_semi").groupBy("doc").agg(joined(["part", "pos"], "text", "\n\n").alias("digest"))
    return made.unionByName(kept)
