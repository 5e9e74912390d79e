"""Pages put into reading order: fragments of lines become lines, lines become columns and bands.

`fragments` have doc, page, seq, x0, top, x1, bottom, text, size, bold, pad_left and pad_right (whether the page had a space
at that edge).  A page is a physical page, so what is gathered by page is bounded by what fits on paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import PAGE, banded, columns

#: A column of a band.
PART = [*PAGE, "band", "col"]
PIECE = ("x0", "top", "x1", "bottom", "text", "size", "bold", "pad_left", "pad_right", "seq")


def rows_of(fragments: DataFrame) -> DataFrame:
    """`fragments` (band, near) with row: by top and x0; a row holds what starts within `near` of its first piece."""
    rest = [c for c in fragments.columns if c not in PART]
    items = fragments.groupBy(*PART).agg(F.array_sort(F.collect_list(F.struct("top", "x0", "seq", F.struct(*rest).alias("own")))).alias("p"))
    kind = "struct<top:double,rows:array<bigint>>"
    start = F.struct(F.lit(None).alias("top"), F.array().alias("rows")).cast(kind)

    def step(s, b):
        same = F.coalesce(b["top"] - s["top"] <= b["own"]["near"], F.lit(False))
        row = F.coalesce(F.try_element_at(s["rows"], F.lit(-1)), F.lit(-1).cast("long")) + F.when(same, 0).otherwise(1)
        return F.struct(F.when(same, s["top"]).otherwise(b["top"]).alias("top"), F.concat(s["rows"], F.array(row)).alias("rows")).cast(kind)

    numbered = F.zip_with("p", F.aggregate("p", start, step)["rows"], lambda b, row: F.struct(*(b["own"][c].alias(c) for c in rest), row.alias("row")))
    return items.select(*PART, F.inline(numbered))


def gap(before: Column, piece: Column, rtl: bool) -> Column:
    return before["x0"] - piece["x1"] if rtl else piece["x0"] - before["x1"]


def joined(pieces: Column, rtl: bool) -> Column:
    """The pieces of a line as one text.  A space stands where the page had one: at an edge, or as a gap of its width."""
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("a"), F.slice(pieces, 2, F.size(pieces)).alias("b"))

    def spaced(p):
        a, b = p["a"], p["b"]
        space = a["pad_right"] | b["pad_left"] | (gap(a, b, rtl) >= F.greatest(a["size"] * 0.18, F.lit(0.8)))
        return F.concat(F.when(space, " ").otherwise(""), b["text"])

    text = F.concat(F.element_at(pieces, 1)["text"], F.array_join(F.transform(pairs, spaced), ""))
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def weighed(pieces: Column) -> Column:
    """The size that most of the pieces' characters have; of several, the one seen first."""
    chars = lambda x: F.aggregate(pieces, F.lit(0), lambda n, p: n + F.when(p["size"] == x, F.char_length(p["text"])).otherwise(0))
    sizes = F.array_distinct(F.transform(pieces, lambda p: p["size"]))
    return F.array_max(F.transform(sizes, lambda x, k: F.struct(chars(x).alias("n"), (-k).alias("k"), x.alias("size"))))["size"]


def merged(pieces: Column, rtl: bool) -> list[Column]:
    """The line of an array of pieces: its text, box, size, weight and edges."""
    least, most = (lambda c: F.array_min(F.transform(pieces, lambda p: p[c]))), (lambda c: F.array_max(F.transform(pieces, lambda p: p[c])))
    all_chars = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.char_length(p["text"]))
    bold = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.when(p["bold"], F.char_length(p["text"])).otherwise(0))
    one = F.size(pieces) == 1
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    return [
        F.when(one, first["text"]).otherwise(joined(pieces, rtl)).alias("text"), least("x0").alias("x0"), least("top").alias("top"), most("x1").alias("x1"), most("bottom").alias("bottom"),
        weighed(pieces).alias("size"), F.when(one, first["bold"]).otherwise(bold * 2 > all_chars).alias("bold"), first["pad_left"].alias("pad_left"), last["pad_right"].alias("pad_right"), F.size(pieces).cast("long").alias("pieces"),
    ]


def lines_in_order(fragments: DataFrame, width: float, rtl: bool = False) -> DataFrame:
    """doc, page, place, col and the lines of every page as a person reads them.

    A line across a gutter stands alone between what starts above it and the rest.  In between, columns are read whole (the
    right one first where `rtl`), each by rows; a row's pieces are one line unless a gap of over three sizes (5 % of the
    width at least) parts them.
    """
    near = F.greatest(F.median(F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0))) * 0.5, F.lit(2.0)).alias("near")
    # a crossing line is a band of its own, so its row and run are the first
    rest = rows_of(banded(columns(fragments, width, near)).withColumn("col", F.when(F.col("crosses"), F.lit(0)).otherwise(F.col("col"))))
    w = Window.partitionBy(*PART, "row").orderBy(F.col("x0").desc() if rtl else "x0", "top", "seq")
    before = F.struct(F.lag("x0").over(w).alias("x0"), F.lag("x1").over(w).alias("x1"))
    far = gap(before, F.struct("x0", "x1"), rtl) > F.greatest(F.lag("size").over(w) * 3.0, F.lit(width * 0.05))
    rest = rest.withColumn("_new", F.coalesce(far, F.lit(False)).cast("long")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    every = rest.groupBy(*PART, "row", "run")
    key = (-F.col("x0") if rtl else F.col("x0")).alias("_k")
    pieces = F.array_sort(F.collect_list(F.struct(key, F.col("top").alias("_t"), F.col("seq").alias("_s"), F.struct(*PIECE).alias("p"))))
    found = every.agg(F.transform(pieces, lambda x: x["p"]).alias("p")).select(*PART, "row", "run", *merged(F.col("p"), rtl)).filter("text <> ''")
    order = Window.partitionBy(*PAGE).orderBy("band", -F.col("col") if rtl else F.col("col"), "row", "run")
    return found.withColumn("place", F.row_number().over(order).cast("long")).drop("band", "row", "run")
