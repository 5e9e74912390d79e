"""Pages put in order and objects lifted out, on small pages with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import layout, objects, reading

WIDTH = 595.0
KIND = "doc string, page long, seq long, x0 double, top double, x1 double, bottom double, text string, size double, bold boolean, pad_left boolean, pad_right boolean"


def piece(text, top, x0, width, size=11.0, bold=False, pad_left=False, pad_right=False):
    return (float(x0), float(top), float(x0 + width), float(top + 12), text, size, bold, pad_left, pad_right)


def column(texts, top, x0, width):
    return [piece(t, top + 16 * k, x0, width) for k, t in enumerate(texts)]


def pages(spark, *of):
    return spark.createDataFrame([("d", n + 1, k, *p) for n, pieces in enumerate(of) for k, p in enumerate(pieces)], KIND)


def read(spark, *of, rtl=False):
    rows = reading.lines_in_order(pages(spark, *of), WIDTH, rtl).orderBy("page", "place").collect()
    return [[r.text for r in rows if r.page == n + 1] for n in range(len(of))]


LEFT, RIGHT = ["left one", "left two", "left three"], ["right one", "right two", "right three"]


def test_columns_and_headings_across(spark):
    two = column(LEFT, 100, 60, 180) + column(RIGHT, 100, 320, 180)
    heading = piece("A heading that spans the whole page", 60, 60, 470)
    middle = piece("Across the middle of the page it goes", 124, 60, 470)
    three = column(LEFT, 100, 50, 130) + column(RIGHT, 100, 230, 130) + column(["far one", "far two"], 100, 410, 130)
    got = read(spark, two, [heading, *two], [*two, middle], three)
    assert got[0] == LEFT + RIGHT
    assert got[1] == ["A heading that spans the whole page", *LEFT, *RIGHT]
    assert got[2] == ["left one", "left two", "right one", "right two", "Across the middle of the page it goes", "left three", "right three"]
    assert got[3] == LEFT + RIGHT + ["far one", "far two"]


def test_right_to_left(spark):
    right, left = ["ימין א", "ימין ב", "ימין ג"], ["שמאל א", "שמאל ב", "שמאל ג"]
    pieces = [piece("פרק 1", 100, 460, 60, pad_right=True), piece("—", 100, 440, 12), piece("חוזים", 100, 380, 55, pad_right=True)]
    got = read(spark, column(left, 100, 60, 180) + column(right, 100, 320, 180), pieces, rtl=True)
    assert got[0] == right + left and got[1] == ["פרק 1 — חוזים"]


def test_pieces_of_a_line(spark):
    split = [piece("Def", 100, 60, 20, bold=True), piece("inition", 100, 80, 40)]
    apart = [piece("one", 100, 60, 30), piece("side", 101, 140, 30, size=9.0), piece("low", 108, 60, 30)]
    rows = reading.lines_in_order(pages(spark, split, apart), WIDTH).orderBy("page", "place").collect()
    assert [r.text for r in rows] == ["Definition", "one", "side", "low"]
    assert (rows[0].x0, rows[0].x1, rows[0].bold, rows[0].pieces) == (60, 120, False, 2)


def test_gutters_that_are_none(spark):
    """A page of one column; short lines under a heading; notes in the margin with too few characters."""
    one = column(["one", "two", "three", "four", "five", "six"], 100, 60, 440)
    short = [piece("A wide heading over all", 60, 60, 470), *column(["short"] * 11, 100, 60, 180)]
    notes = column(["A line of the body of the text"] * 12, 100, 60, 330) + column(["1", "2"], 100, 480, 15)
    df = pages(spark, one, short, notes)
    assert {r.page for r in layout.gutters(df, WIDTH).collect()} == {3}
    assert layout.columns(df, WIDTH).filter("col > 0 OR crosses").count() == 0


def test_a_line_a_point_short_crosses(spark):
    two = column(LEFT, 100, 60, 180) + column(RIGHT, 100, 320, 180)
    g = layout.gutters(pages(spark, two), WIDTH).first()
    step = WIDTH / layout.BINS
    left, right = g.left * step, (g.right + 1) * step
    df = pages(spark, [*two, (left + 0.9, 60.0, right - 0.9, 72.0, "nearly across", 11.0, False, False, False)])
    rows = {r.text: r.crosses for r in layout.columns(df, WIDTH).collect()}
    assert rows["nearly across"] and not rows["left one"]


def test_gap_is_bounded_by_the_line_before(spark):
    lines = [("d", 1, 0, 0.0, 4.0, 0), ("d", 1, 1, 29.0, 49.0, 0), ("d", 1, 2, 52.0, 64.0, 0), ("d", 1, 3, 70.0, 82.0, 1)]
    df = spark.createDataFrame(lines, "doc string, page long, seq long, top double, bottom double, col long")
    assert layout.line_gap(df).first().gap == 3.0


def test_sizes_of_one_level(spark):
    sized = lambda s: [("d", 1, k, x, "twelve chars") for k, x in enumerate((*s, 10.0, 10.0, 10.0, 10.0))]
    df = spark.createDataFrame(sized([25.0, 23.0, 18.0]), "doc string, page long, seq long, size double, text string")
    assert layout.size_ranks(df, layout.body_size(df)).first().ranks == [25.0, 23.0, 18.0]
    df = spark.createDataFrame(sized([25.0, 23.1, 18.0]), "doc string, page long, seq long, size double, text string")
    assert layout.size_ranks(df, layout.body_size(df)).first().ranks == [25.0, 18.0]


def brute_clusters(boxes, near):
    groups = [(b, {k}) for k, b in enumerate(boxes)]
    while True:
        found = next(((i, j) for i in range(len(groups)) for j in range(i) if all(groups[i][0][a] - near <= groups[j][0][a + 2] and groups[j][0][a] - near <= groups[i][0][a + 2] for a in (0, 1))), None)
        if not found:
            return sorted(sorted(g) for _, g in groups)
        i, j = found
        (a, own), (b, other) = groups[i], groups[j]
        groups = [g for k, g in enumerate(groups) if k not in found] + [((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), own | other)]


@pytest.mark.parametrize("seed", range(12))
def test_clusters_against_all_pairs(seed):
    rng = random.Random(seed)
    boxes = []
    for _ in range(rng.choice((0, 1, 5, 40))):
        x, y = rng.randrange(300), rng.randrange(300)
        boxes.append((float(x), float(y), float(x + rng.randrange(40)), float(y + rng.randrange(40))))
    of = objects.touching(boxes, 3.0)
    groups = {}
    for k, c in enumerate(of):
        groups.setdefault(c, []).append(k)
    assert sorted(groups.values()) == brute_clusters(boxes, 3.0)


def harvest(spark, lines, tables, figures):
    box = "doc string, page long, seq long, x0 double, top double, x1 double, bottom double"
    rows = objects.harvested(spark.createDataFrame([("d", 1, k, *x) for k, x in enumerate(lines)], box + ", text string"), spark.createDataFrame([("d", 1, k, *x) for k, x in enumerate(tables)], box), spark.createDataFrame([("d", 1, k, *x) for k, x in enumerate(figures)], box)).first()
    return [(o.kind, o.seq, o.anchor, o.caption) for o in rows.objects], [x.seq for x in rows.lines]


def test_a_caption_is_taken_once_and_the_first_one_first(spark):
    lines = [(60.0, 40.0, 300.0, 50.0, "Prose above."), (60.0, 252.0, 300.0, 262.0, "Figure 1: the first"), (60.0, 256.0, 300.0, 266.0, "Figure 2: nearer, but later"), (60.0, 300.0, 300.0, 310.0, "Prose below.")]
    figures = [(60.0, 100.0, 300.0, 250.0), (60.0, 100.0, 310.0, 250.0), (60.0, 100.0, 320.0, 250.0)]
    got, left = harvest(spark, lines, [], figures)
    assert got == [("figure", 0, 1, "Figure 1: the first"), ("figure", 1, 2, "Figure 2: nearer, but later"), ("figure", 2, 3, "")] and left == [0, 3]


def test_captions_in_the_band_only(spark):
    figure = (100.0, 100.0, 300.0, 200.0)
    at = lambda x0, top, x1, text="Figure 3: a map": harvest(spark, [(float(x0), float(top), float(x1), top + 10.0, text)], [], [figure])[0][0][3]
    assert at(100, 255, 300) and at(100, 35, 300) and not at(100, 256, 300) and not at(100, 150, 300)
    assert at(40, 210, 78) == "" and at(62, 210, 98) and at(100, 210, 300, "The figure above shows it.") == ""


def test_tables_come_first_and_twelve_at_most(spark):
    lines = [(60.0, 40.0 + 20 * k, 200.0, 50.0 + 20 * k, "cell") for k in range(20)] + [(60.0, 450.0, 300.0, 460.0, "Table 1: all of it")]
    tables = [(50.0, 38.0 + 20 * k, 210.0, 52.0 + 20 * k) for k in range(20)]
    got, left = harvest(spark, lines, tables, [(60.0, 300.0, 300.0, 445.0)])
    assert [g[:3] for g in got[:12]] == [("table", k, k) for k in range(12)] and len(got) == 13
    assert got[12] == ("figure", 0, 20, "Table 1: all of it") and left == list(range(12, 20))
    got, left = harvest(spark, lines, [(50.0, 38.0, 210.0, 440.0)], [(60.0, 300.0, 300.0, 445.0)])
    assert got == [("table", 0, 0, "Table 1: all of it"), ("figure", 0, 0, "")] and left == []


def test_charts_are_many_paths_that_no_image_shows(spark):
    box = "doc string, page long, seq long, x0 double, top double, x1 double, bottom double"
    bars = [("d", 1, k, 100.0 + 30 * k, 200.0 - 10 * k, 129.0 + 30 * k, 300.0) for k in range(6)]
    few = [("d", 2, k, 100.0 + 80 * k, 200.0, 180.0 + 80 * k, 300.0) for k in range(3)]
    shown = [("d", 3, k, *b[3:]) for k, b in enumerate(bars)]
    images = [("d", 1, 90, 10.0, 10.0, 30.0, 30.0), ("d", 3, 91, 90.0, 140.0, 300.0, 310.0), ("d", 4, 92, 0.0, 0.0, 500.0, 700.0), ("d", 5, 93, 0.0, 0.0, 500.0, 700.0)]
    sizes = spark.createDataFrame([("d", n, 595.0, 842.0, n == 5) for n in range(1, 6)], "doc string, page long, width double, height double, scanned boolean")
    df = lambda rows: spark.createDataFrame(rows, box)
    got = objects.figure_candidates(df(images), df(bars + few + shown), sizes)
    assert sorted((r.page, r.kind, r.seq, r.paths) for r in got.collect()) == [(1, "drawing", 0, 6), (3, "image", 91, 0), (4, "image", 92, 0)]
    table = df([("d", 1, 0, 90.0, 140.0, 300.0, 310.0)])
    assert {r.page for r in objects.figures(got, table).collect()} == {3, 4}
    assert objects.clusters(df(few)).select(F.count("*")).first()[0] == 1


def test_clusters_of_many_pages_go_in_batches(spark):
    rows = [(f"d{k % 30}", k % 7, k, 10.0 * (k % 11), 9.0 * (k % 5), 10.0 * (k % 11) + 8, 9.0 * (k % 5) + 5) for k in range(2000)]
    out = objects.clusters(spark.createDataFrame(rows, "doc string, page long, seq long, x0 double, top double, x1 double, bottom double"))
    want = set()
    for page in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == page]
        held: dict = {}
        for r, c in zip(own, objects.touching([r[3:] for r in own]), strict=True):
            held.setdefault(c, []).append(r)
        want |= {(*page, *(f(r[k] for r in x) for k, f in ((2, min), (3, min), (4, min), (5, max), (6, max)))) for x in held.values()}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert "GroupsInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()  # a call for each page costs more than the page
