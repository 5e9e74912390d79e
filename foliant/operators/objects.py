"""Things on a page that are no prose: tables, figures, drawings, their captions, and their places in the text.

`lines` have doc, page, seq (their place in the reading order), x0, top, x1, bottom and text; `boxes` have doc, page, seq and
a box.  What is gathered by page is bounded by what fits on one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import written
from .layout import PAGE, overlap, prefixed

# fixed values: what is a logo or a rule and no figure, and what fills a page
LEAST_SIDE, LEAST_AREA = 42.0, 0.012
DRAWING_SIDES, DRAWING_AREAS, LEAST_PATHS = 1.5, 3.0, 6
FILLS_PAGE, FILLS_SCAN = 0.9, 0.6
MOST_TABLES = 12
#: How near two drawings are to be one, in points.
TOUCH = 3.0


def touching(boxes: list[tuple[float, float, float, float]], near: float = TOUCH) -> list[int]:
    """The number of each box's cluster: boxes within `near` of each other are one, and so are clusters whose common boxes
    are.  A sweep along x over the boxes that are still open, by their tops, until a sweep unites nothing."""
    import bisect

    of = list(range(len(boxes)))
    clusters = {k: list(b) for k, b in enumerate(boxes)}
    while True:
        up = {k: k for k in clusters}

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        events = sorted([(b[0] - near, 0, k) for k, b in clusters.items()] + [(b[2], 1, k) for k, b in clusters.items()])
        open_: list[tuple[float, int]] = []  # by top
        tallest = max((b[3] - b[1] for b in clusters.values()), default=0.0)
        for _, ends, k in events:
            x = clusters[k]
            at = bisect.bisect_left(open_, (x[1], k))
            if ends:
                del open_[at]
                continue
            low = bisect.bisect_left(open_, (x[1] - tallest - near, -1))
            for top, other in open_[low:]:
                if top > x[3] + near:
                    break
                if clusters[other][3] + near >= x[1]:
                    up[root(other)] = root(k)
            open_.insert(at, (x[1], k))
        if all(up[k] == k for k in up):
            break
        new: dict[int, list[float]] = {}
        for k, b in clusters.items():
            r = root(k)
            if r in new:
                new[r] = [min(new[r][0], b[0]), min(new[r][1], b[1]), max(new[r][2], b[2]), max(new[r][3], b[3])]
            else:
                new[r] = list(b)
        of = [root(k) for k in of]
        clusters = new
    return of


def clusters(drawings: DataFrame, near: float = TOUCH) -> DataFrame:
    """doc, page, seq, box of what the drawings of a page unite to; seq is the least of a cluster's drawings."""
    box = ("seq", "x0", "top", "x1", "bottom")
    pages = drawings.groupBy(*PAGE).agg(F.collect_list(F.struct(*box)).alias("_b"))

    def unite(batches):
        import pyarrow as pa

        for t in batches:
            places, out = [], {k: [] for k in box}
            every = t.column(2).flatten()
            columns = [every.field(k).to_pylist() for k in range(len(box))]
            ends = t.column(2).value_lengths().to_pylist()
            lo = 0
            for at, n in enumerate(ends):
                seq, *sides = (c[lo : lo + n] for c in columns)
                lo += n
                found: dict[int, list] = {}
                for c, row in zip(touching(list(zip(*sides, strict=True)), near), zip(seq, *sides, strict=True), strict=True):
                    f = found.get(c)
                    found[c] = list(row) if f is None else [g(x, y) for g, x, y in zip((min, min, min, max, max), f, row, strict=True)]
                places.extend([at] * len(found))
                for f in found.values():
                    for k, x in zip(box, f, strict=True):
                        out[k].append(x)
            rows = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([t.column(0).take(rows), t.column(1).take(rows), *(pa.array(out[k], pa.int64() if k == "seq" else pa.float64()) for k in box)], names=[*PAGE, *box])

    return pages.select(*PAGE, "_b").mapInArrow(unite, "doc string, page bigint, seq bigint, x0 double, top double, x1 double, bottom double")


def covering(boxes: DataFrame, others: DataFrame, share: float) -> DataFrame:
    """doc, page, seq, n: the boxes that others cover by more than `share` of their own area, and how many do."""
    pairs = prefixed(boxes, "b_").join(prefixed(others, "o_"), PAGE).filter(overlap("b_", "o_") > share)
    return pairs.groupBy(*PAGE, F.col("b_seq").alias("seq")).agg(F.count("*").alias("n"))


def figure_candidates(images: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, page, seq, box, kind, paths: images that are neither glyphs nor the page itself, then clusters of six drawings or
    more that no image shows already.  pages: doc, page, width, height, scanned."""
    side = lambda c, k: F.col(f"{k}1" if k == "x" else "bottom") - F.col(f"{k}0" if k == "x" else "top")
    wide, tall = side(None, "x"), side(None, "y")
    area = wide * tall / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    full = F.when(F.col("scanned"), FILLS_SCAN).otherwise(FILLS_PAGE)
    shown = images.join(pages, PAGE).filter((wide >= LEAST_SIDE) & (tall >= LEAST_SIDE) & (area >= LEAST_AREA) & (area < full))
    shown = shown.select(*PAGE, "seq", "x0", "top", "x1", "bottom", F.lit("image").alias("kind"), F.lit(0).cast("long").alias("paths"))
    found = clusters(drawings)
    large = written(found.join(pages, PAGE).filter((wide >= LEAST_SIDE * DRAWING_SIDES) & (tall >= LEAST_SIDE * DRAWING_SIDES) & (area >= LEAST_AREA * DRAWING_AREAS)).select(*found.columns))
    inside = prefixed(drawings, "d_").join(prefixed(large, "c_"), PAGE).filter(overlap("d_", "c_") > 0.9).groupBy(*PAGE, F.col("c_seq").alias("seq")).agg(F.count("*").alias("paths"))
    charts = large.join(inside.filter(F.col("paths") >= LEAST_PATHS), [*PAGE, "seq"]).join(covering(large, shown, 0.5), [*PAGE, "seq"], "left_anti")
    return shown.unionByName(charts.withColumn("kind", F.lit("drawing")).select(*shown.columns))


def figures(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """The candidates that no table holds by over 60 %."""
    return candidates.join(covering(candidates, tables, 0.6), [*PAGE, "seq"], "left_anti")


LINE = "struct<seq:bigint,x0:double,top:double,x1:double,bottom:double,text:string,caption:boolean>"
OBJECT = "struct<kind:string,seq:bigint,x0:double,top:double,x1:double,bottom:double,caption:string,anchor:bigint>"


def _share(a: Column, x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """The share of box `a` inside another."""
    w, h = F.least(a["x1"], x1) - F.greatest(a["x0"], x0), F.least(a["bottom"], bottom) - F.greatest(a["top"], top)
    area = F.greatest((a["x1"] - a["x0"]) * (a["bottom"] - a["top"]), F.lit(1e-6))
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / area)


def _object(o: Column, caption: Column, anchor: Column) -> Column:
    return F.struct(o["kind"].alias("kind"), o["seq"].alias("seq"), o["x0"].alias("x0"), o["top"].alias("top"), o["x1"].alias("x1"), o["bottom"].alias("bottom"), caption.alias("caption"), anchor.alias("anchor")).cast(OBJECT)


def _position(lines: Column, o: Column) -> Column:
    """The first line that starts at or below the object's foot, else one past the last."""
    seqs = lambda xs: F.transform(xs, lambda x: x["seq"])
    return F.coalesce(F.array_min(seqs(F.filter(lines, lambda x: x["top"] >= o["bottom"]))), F.array_max(seqs(lines)) + 1, F.lit(0).cast("long"))


def _caption(lines: Column, o: Column) -> Column:
    """The first caption line within a quarter of the object's height (60 points at least) above or below it, half inside
    the object and 40 points to either side; null without one."""
    near = F.greatest((o["bottom"] - o["top"]) * 0.25, F.lit(60.0))

    def fits(x):
        by = (x["top"] - o["bottom"]).between(F.lit(0.0), near) | (o["top"] - x["bottom"]).between(F.lit(0.0), near)
        return x["caption"] & by & (_share(x, o["x0"] - 40, o["top"] - near, o["x1"] + 40, o["bottom"] + near) >= 0.5)

    return F.try_element_at(F.filter(lines, fits), F.lit(1))


def _without(lines: Column, taken: Column) -> Column:
    return F.when(taken.isNull(), lines).otherwise(F.filter(lines, lambda x: x["seq"] != taken["seq"]))


def harvested(lines: DataFrame, tables: DataFrame, found: DataFrame, most: int = MOST_TABLES) -> DataFrame:
    """doc, page, objects (array of OBJECT), lines (array of LINE): what a page's objects are and which lines they leave.

    Each page is one fold over its objects with a shrinking list of lines.  First the first `most` tables take the lines
    that lie in them; then each table, in order, takes the first caption line by it; then each figure does.  A line is
    taken once.  An object's anchor is the place of the first line that it took, else of the first line below it.
    """
    box = ["seq", "x0", "top", "x1", "bottom"]
    rows = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*box, "text", T.is_caption(F.trim("text")).alias("caption")))).cast(f"array<{LINE}>").alias("lines"))
    objects = lambda df, kind, name: df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.lit(kind).alias("kind"), *box, F.lit("").alias("caption"), F.lit(None).cast("long").alias("anchor")))).cast(f"array<{OBJECT}>").alias(name))
    first = Window.partitionBy(*PAGE).orderBy("seq")
    kept = tables.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most)
    pages = rows.join(objects(kept, "table", "tables"), PAGE, "full").join(objects(found, "figure", "figures"), PAGE, "full")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    pages = pages.select(*PAGE, none("lines", LINE).alias("lines"), none("tables", OBJECT).alias("tables"), none("figures", OBJECT).alias("figures"))
    kind = f"struct<lines:array<{LINE}>,out:array<{OBJECT}>>"
    state = lambda xs, out: F.struct(xs.alias("lines"), out.alias("out")).cast(kind)

    def swallow(s, o):
        held = F.filter(s["lines"], lambda x: _share(x, o["x0"], o["top"], o["x1"], o["bottom"]) >= 0.6)
        left = F.filter(s["lines"], lambda x: _share(x, o["x0"], o["top"], o["x1"], o["bottom"]) < 0.6)
        anchor = F.coalesce(F.array_min(F.transform(held, lambda x: x["seq"])), _position(s["lines"], o))
        return state(left, F.concat(s["out"], F.array(_object(o, F.lit(""), anchor))))

    def label(s, o):
        line = _caption(s["lines"], o)
        anchor = F.least(o["anchor"], line["seq"])  # of those that are there
        return state(_without(s["lines"], line), F.concat(s["out"], F.array(_object(o, F.coalesce(line["text"], F.lit("")), anchor))))

    def picture(s, o):
        line = _caption(s["lines"], o)
        anchor = F.coalesce(line["seq"], _position(s["lines"], o))
        return state(_without(s["lines"], line), F.concat(s["out"], F.array(_object(o, F.coalesce(line["text"], F.lit("")), anchor))))

    empty = F.array().cast(f"array<{OBJECT}>")
    pages = pages.withColumn("_s", F.aggregate("tables", state(F.col("lines"), empty), swallow))
    pages = pages.withColumn("_s", F.aggregate(F.col("_s.out"), state(F.col("_s.lines"), empty), label))
    pages = pages.withColumn("_s", F.aggregate("figures", F.col("_s"), picture))
    return pages.select(*PAGE, F.col("_s.out").alias("objects"), F.col("_s.lines").alias("lines"))


def captions(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, page, box, line: the caption line that each figure takes, in order; a line is taken once."""
    none = boxes.limit(0)
    rows = harvested(lines, none, boxes).select(*PAGE, F.explode("objects").alias("o")).filter(F.col("o.caption") != "")
    return rows.select(*PAGE, F.col("o.seq").alias("box"), F.col("o.anchor").alias("line"))
