"""Boxes on pages: reading order, columns, cells, captions, sizes.

`boxes` frames have doc, page, seq, x0, top, x1, bottom, and what an operator names besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

BINS = 160
PAGE = ["doc", "page"]


def overlap(a: str, b: str) -> Column:
    """The share of box `a` (a column prefix) that lies in box `b`."""
    w = F.greatest(F.lit(0.0), F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}bottom", f"{b}bottom") - F.greatest(f"{a}top", f"{b}top"))
    area = (F.col(f"{a}x1") - F.col(f"{a}x0")) * (F.col(f"{a}bottom") - F.col(f"{a}top"))
    return F.coalesce(F.try_divide(w * h, area), F.lit(0.0))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*PAGE, *(F.col(c).alias(prefix + c) for c in df.columns if c not in PAGE))


def cell_texts(spans: DataFrame, cells: DataFrame, share: float = 0.7) -> DataFrame:
    """doc, page, cell, text: the spans that lie in each cell, by row and place; pages meet first, then boxes."""
    rows = prefixed(spans, "s_").join(prefixed(cells, "c_"), PAGE).filter(overlap("s_", "c_") >= share)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_top", "s_x0", "s_text"))), lambda s: s["s_text"]), " ")
    return rows.groupBy(*PAGE, F.col("c_seq").alias("cell")).agg(text.alias("text"))


def rebuilt(found: DataFrame, own: DataFrame) -> DataFrame:
    """Cells with the text of `own` where it has some, else what was found."""
    return found.join(own.withColumnRenamed("text", "own"), [*PAGE, "cell"], "left").select(*PAGE, "cell", F.coalesce(F.nullif("own", F.lit("")), "text").alias("text"))


def outside(lines: DataFrame, boxes: DataFrame, share: float = 0.6) -> DataFrame:
    """The lines that no box holds."""
    held = prefixed(lines, "l_").join(prefixed(boxes, "b_"), PAGE).filter(overlap("l_", "b_") >= share).select(*PAGE, F.col("l_seq").alias("seq"))
    return lines.join(held, [*PAGE, "seq"], "left_anti")


def anchors(lines: DataFrame, boxes: DataFrame, share: float = 0.6) -> DataFrame:
    """doc, page, box, anchor: the first line a box holds, else the first that starts at or below its bottom, else one
    past the last."""
    pairs = prefixed(boxes, "b_").join(prefixed(lines, "l_"), PAGE, "left")
    held = F.min(F.when(overlap("l_", "b_") >= share, F.col("l_seq")))
    below = F.min(F.when(F.col("l_top") >= F.col("b_bottom"), F.col("l_seq")))
    return pairs.groupBy(*PAGE, F.col("b_seq").alias("box")).agg(F.coalesce(held, below, F.coalesce(F.max("l_seq"), F.lit(-1)) + 1).alias("anchor"))


#: The page of a reader without geometry, in points.
PLAIN_WIDTH, PLAIN_HEIGHT = 595.0, 842.0


def plain_boxes(lines: DataFrame) -> DataFrame:
    """`lines` (doc, page, seq, text) with made-up boxes, where a reader gives text alone: each 12 points below the one
    before, 6 points for a character, all of size 10 and one column.  They keep the lines in order and nothing else."""
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq")) - 1
    top = (nth * 12).cast("double")
    return lines.withColumns({"x0": F.lit(0.0), "top": top, "x1": (F.char_length("text") * 6).cast("double"), "bottom": top + 10, "size": F.lit(10.0), "col": F.lit(0).cast("long")})


def body_size(lines: DataFrame) -> DataFrame:
    """doc, body: the size (to a tenth) that most characters have; of several, the one seen first."""
    sizes = lines.groupBy("doc", F.bround("size", 1).alias("s")).agg(F.sum(F.char_length("text")).alias("chars"), F.min(F.struct("page", "seq")).alias("first"))
    return sizes.groupBy("doc").agg(F.max_by("s", F.struct("chars", -F.col("first.page"), -F.col("first.seq"))).alias("body"))


def size_ranks(lines: DataFrame, body: DataFrame, factor: float = 1.12, least: int = 8, near: float = 0.92, most: int = 4) -> DataFrame:
    """doc, ranks: up to four heading sizes, largest first; a size above 0.92 of the last rank belongs to it."""
    sizes = lines.join(body, "doc").filter(F.col("size") >= factor * F.col("body")).groupBy("doc", F.bround("size", 1).alias("s")).agg(F.sum(F.char_length("text")).alias("chars")).filter(F.col("chars") >= least)
    fold = lambda kept, s: F.when((F.size(kept) > 0) & (s > near * F.try_element_at(kept, F.lit(-1))), kept).otherwise(F.concat(kept, F.array(s)))
    return sizes.groupBy("doc").agg(F.slice(F.aggregate(F.sort_array(F.collect_list("s"), False), F.array().cast("array<double>"), fold), 1, most).alias("ranks"))


def line_gap(lines: DataFrame) -> DataFrame:
    """doc, page, gap: the median distance between lines that follow each other in one column, from 0 to below four heights
    of the line before."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    before = {c: F.lag(c).over(w) for c in ("top", "bottom", "col")}
    rows = lines.select(*PAGE, "col", before["col"].alias("_col"), (F.col("top") - before["bottom"]).alias("d"), F.greatest(before["bottom"] - before["top"], F.lit(1.0)).alias("_tall"))
    rows = rows.filter((F.col("col") == F.col("_col")) & (F.col("d") >= 0) & (F.col("d") < 4 * F.col("_tall")))
    return rows.groupBy(*PAGE).agg(F.round(F.median("d"), 6).alias("gap"))


def paged(lines: DataFrame, *more: Column) -> DataFrame:
    """doc, page, lines: a physical page's boxes in one array."""
    rest = [c for c in lines.columns if c not in PAGE]
    return lines.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest)).alias("lines"), *more)


def gutters_of(lines: Column, width: float, share: float = 0.12, margin: float = 0.08, least_lines: int = 6) -> Column:
    """The gutters of a page's boxes as (left, right) bins: maximal runs of bins that hardly a line covers, wide enough,
    within the margins, on pages of six lines or more, with a line wholly on either side."""
    step = width / BINS
    at = lambda x: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(x / width * BINS))).cast("int")
    spans = F.transform(lines, lambda x: F.struct(at(x["x0"]).alias("a"), at(x["x1"]).alias("b")))
    first, last = int(margin * BINS), BINS - int(margin * BINS) - 1
    most = F.greatest(F.lit(1), F.floor(share * F.size(lines)).cast("int"))
    free = let(spans, lambda own: F.transform(F.sequence(F.lit(first), F.lit(last)), lambda b: F.size(F.filter(own, lambda s: (s["a"] <= b) & (s["b"] >= b))) <= most))
    bins = F.sequence(F.lit(0), F.lit(last - first))
    is_free = lambda f, k: F.coalesce(F.get(f, k), F.lit(False))
    left, right = (lambda f: F.filter(bins, lambda k: is_free(f, k) & ~is_free(f, k - 1))), (lambda f: F.filter(bins, lambda k: is_free(f, k) & ~is_free(f, k + 1)))
    runs = let(free, lambda f: F.zip_with(left(f), right(f), lambda a, b: F.struct((a + first).cast("long").alias("left"), (b + first).cast("long").alias("right"))))
    starts, ends = F.array_max(F.transform(lines, lambda x: x["x0"])), F.array_min(F.transform(lines, lambda x: x["x1"]))
    wide = lambda r: (r["right"] - r["left"] + 1) * step >= max(0.035 * width, 14.0)
    sides = let(F.struct(starts.alias("s"), ends.alias("e")), lambda m: F.filter(runs, lambda r: wide(r) & (m["s"] >= (r["right"] + 1) * step) & (m["e"] <= r["left"] * step)))
    return F.when(F.size(lines) >= least_lines, sides).otherwise(F.slice(runs, 1, 0))


def column_of(x: Column, found: Column, width: float) -> Column:
    """The column of box x: gutters wholly left of its middle."""
    return F.size(F.filter(found, lambda g: (g["right"] + 1) * (width / BINS) <= (x["x0"] + x["x1"]) / 2)).cast("long")


def crosses(x: Column, found: Column, width: float) -> Column:
    """Whether box x goes from one edge of a gutter to the other, or a point less."""
    step = width / BINS
    return F.exists(found, lambda g: (x["x0"] <= g["left"] * step + 1) & (x["x1"] >= (g["right"] + 1) * step - 1))


def believed(lines: Column, found: Column, width: float, share: float = 0.12) -> Column:
    """The gutters with at least `share` of the page's characters in the column on either side; lines that cross count for
    none.  The columns beside a gutter that is not kept become one."""
    own = F.transform(F.filter(lines, lambda x: ~crosses(x, found, width)), lambda x: F.struct(column_of(x, found, width).alias("col"), F.char_length(x["text"]).alias("n")))
    chars = lambda rows, k: F.aggregate(rows, F.lit(0), lambda n, r: n + F.when((k < 0) | (r["col"] == k), r["n"]).otherwise(0))
    enough = lambda rows, total, k: F.coalesce(F.try_divide(chars(rows, k), total), F.lit(0.0)) >= share
    return let(own, lambda rows: let(chars(rows, F.lit(-1)), lambda total: F.filter(found, lambda g, k: enough(rows, total, k) & enough(rows, total, k + 1))))


def gutters(lines: DataFrame, width: float) -> DataFrame:
    """doc, page, left, right (bins): the gutters of every page, believed or not."""
    return paged(lines.select(*PAGE, "x0", "x1")).select(*PAGE, F.inline(gutters_of(F.col("lines"), width)))


def columns(lines: DataFrame, width: float, *more: Column) -> DataFrame:
    """`lines` with col and crosses, by the gutters that are believed, and with what `more` aggregates of their page; one
    exchange, by page."""
    rest = [c for c in lines.columns if c not in PAGE]
    placed = lambda found: F.transform("lines", lambda x: F.struct(*(x[c].alias(c) for c in rest), column_of(x, found, width).alias("col"), crosses(x, found, width).alias("crosses")))
    kept = lambda found: believed(F.col("lines"), found, width)
    rows = paged(lines, *more)
    return rows.select(*(c for c in rows.columns if c != "lines"), F.inline(let(let(gutters_of(F.col("lines"), width), kept), placed)))


def banded(lines: DataFrame) -> DataFrame:
    """`lines` (col, crosses) with band: 2k - 1 for the k-th crossing line from the top, 2k for what starts at or below it."""
    crossing = F.col("crosses").cast("long")
    above = F.sum(crossing).over(Window.partitionBy(*PAGE).orderBy("top").rangeBetween(Window.unboundedPreceding, 0))
    nth = F.sum(crossing).over(Window.partitionBy(*PAGE).orderBy("top", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("band", F.when(F.col("crosses"), 2 * nth - 1).otherwise(2 * above))


def reading_order(lines: DataFrame, rtl: bool = False) -> DataFrame:
    """`lines` (col, crosses) with place: a line that crosses a gutter closes a band; in a band, column by column."""
    col = F.when(F.col("crosses"), 0).otherwise(-F.col("col") if rtl else F.col("col"))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("band", "_col", "top", -F.col("x0") if rtl else F.col("x0"), "seq"))
    return banded(lines).withColumn("_col", col).withColumn("place", order.cast("long")).drop("band", "_col")


def row_runs(lines: DataFrame, width: float) -> DataFrame:
    """`lines` with run: a new one where the gap to the box before in its row passes max(3 sizes, 5 % of the width)."""
    w = Window.partitionBy(*PAGE, "row").orderBy("x0", "seq")
    wide = F.col("x0") - F.lag("x1").over(w) > F.greatest(3 * F.lag("size").over(w), F.lit(0.05 * width))
    return lines.withColumn("_new", F.coalesce(wide, F.lit(False)).cast("long")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def anchored_rows(lines: DataFrame, tolerance: float) -> DataFrame:
    """doc, page, seq, row: boxes by (top, x0); a row holds what is within the tolerance of its first box."""
    item = F.struct("top", "x0", "seq")
    kind = "struct<row:bigint,top:double,out:array<struct<seq:bigint,row:bigint>>>"
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).alias("top"), F.array().alias("out")).cast(kind)

    def step(s, b):
        same = F.coalesce(b["top"] - s["top"] <= tolerance, F.lit(False))
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(row.alias("row"), F.when(same, s["top"]).otherwise(b["top"]).alias("top"), F.concat(s["out"], F.array(F.struct(b["seq"].alias("seq"), row.alias("row")))).alias("out")).cast(kind)

    return lines.groupBy(*PAGE).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step)["out"].alias("out")).select(*PAGE, F.inline("out"))


def merged(lines: DataFrame) -> DataFrame:
    """doc, page, row, text and the box around the boxes of a row."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ")
    return lines.groupBy(*PAGE, "row").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
