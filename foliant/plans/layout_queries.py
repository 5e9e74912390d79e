"""Queries over boxes, blocks and bundles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import layout as L
from ..operators import structure as S
from ..sources import bundles
from . import derived as D

WIDTH = 600.0
LINES, SPANS, CELLS, FIGURES, CAPTIONS, BLOCKS, BUNDLES, RANGES = D.LAID_OUT, D.SPANS, D.CELLS, D.FIGURES, D.CAPTIONS, D.BLOCKS, D.BUNDLES, D.RANGES


def overlap_join(spark, sf_dir):
    return L.cell_texts(SPANS.df(spark, sf_dir), CELLS.df(spark, sf_dir))


def cell_fallback(spark, sf_dir):
    found = CELLS.df(spark, sf_dir).select("doc", "page", F.col("seq").alias("cell"), F.concat(F.lit("cell "), F.col("seq")).alias("text"))
    return L.rebuilt(found, L.cell_texts(SPANS.df(spark, sf_dir), CELLS.df(spark, sf_dir)))


def swallow_anti_join(spark, sf_dir):
    return L.outside(SPANS.df(spark, sf_dir), CELLS.df(spark, sf_dir).filter("seq < 3")).select("doc", "page", "seq")


def object_anchor(spark, sf_dir):
    return L.anchors(SPANS.df(spark, sf_dir), FIGURES.df(spark, sf_dir))


def body_size_mode(spark, sf_dir):
    return L.body_size(LINES.df(spark, sf_dir))


def heading_size_ranks(spark, sf_dir):
    lines = LINES.df(spark, sf_dir)
    return L.size_ranks(lines, L.body_size(lines)).select("doc", F.array_join(F.transform("ranks", lambda r: F.format_number(r, 1)), " ").alias("ranks"))


def line_gap_median(spark, sf_dir):
    return L.line_gap(L.columns(LINES.df(spark, sf_dir).drop("col"), WIDTH))


def gutter_islands(spark, sf_dir):
    return L.gutters(LINES.df(spark, sf_dir), WIDTH)


def column_assign(spark, sf_dir):
    return L.columns(LINES.df(spark, sf_dir).drop("col"), WIDTH).select("doc", "page", "seq", "col", "crosses")


def band_order(spark, sf_dir):
    lines = L.columns(LINES.df(spark, sf_dir).drop("col"), WIDTH)
    return L.reading_order(lines).select("doc", "page", "seq", "place")


def row_runs(spark, sf_dir):
    rows = SPANS.df(spark, sf_dir).withColumn("row", F.floor(F.col("top") / 30)).withColumn("size", F.lit(10.0))
    return L.row_runs(rows, WIDTH).select("doc", "page", "seq", "row", "run")


def anchored_rows(spark, sf_dir):
    return L.anchored_rows(SPANS.df(spark, sf_dir), 6.0)


def row_merge(spark, sf_dir):
    rows = SPANS.df(spark, sf_dir).withColumn("row", F.floor(F.col("top") / 30))
    return L.merged(rows)


HEIGHT = 300.0


def classified(spark, sf_dir):
    lines = LINES.df(spark, sf_dir)
    body = L.body_size(lines)
    return B.classified(lines, body.join(L.size_ranks(lines, body), "doc", "left"), HEIGHT)


def block_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("doc", "page", "seq", "kind", "level")


def assembled(spark, sf_dir):
    rows = B.stream(classified(spark, sf_dir), FIGURES.df(spark, sf_dir).select("doc", "page", F.col("seq").alias("anchor"), F.lit("figure").alias("kind"), F.lit("").alias("text")))
    return B.assembled(rows, L.line_gap(LINES.df(spark, sf_dir)), WIDTH)


def paragraph_islands(spark, sf_dir):
    """Lines and figures of each document in one order, and the block and item that each falls to."""
    return assembled(spark, sf_dir).select("doc", "place", "kind", "block", "item")


def paragraph_texts(spark, sf_dir):
    """Blocks with their texts, items, markers and pages."""
    rows = B.built(assembled(spark, sf_dir))
    return rows.select("doc", "id", "kind", "level", F.md5("text").alias("text"), F.md5(F.array_join("items", "|")).alias("items"), "ordered", "marker", "first_page", "last_page")


def document_titles(spark, sf_dir):
    """The first heading of the first pages where the metadata has no title."""
    names = LINES.df(spark, sf_dir).groupBy("doc").agg(F.max("seq").alias("k")).select("doc", F.when(F.col("k") % 3 == 0, F.concat(F.lit("The book of "), "doc")).when(F.col("k") % 3 == 1, "Microsoft Word - final.doc").alias("meta_title"))
    return B.document_title(B.built(assembled(spark, sf_dir)), names).select("doc", F.md5("title").alias("title"))


def chunk_pack(spark, sf_dir):
    return B.chunks(BLOCKS.df(spark, sf_dir).withColumn("chars", F.char_length("text").cast("long")), 2000, 400)


def chunk_parts(spark, sf_dir):
    return B.parts(BLOCKS.df(spark, sf_dir).select("doc", "seq", "kind"), ["doc", "kind"], "seq")


def markdown_offsets(spark, sf_dir):
    return B.markdown(BLOCKS.df(spark, sf_dir)).select("doc", "seq", "md_start", "md_end")


def markdown_slices(spark, sf_dir):
    """Every block's text as its offsets cut it from the rendered document."""
    rows = B.markdown(BLOCKS.df(spark, sf_dir))
    both = rows.join(B.rendered(rows), "doc")
    return both.select("doc", "seq", (F.substring("markdown", (F.col("md_start") + 1).cast("int"), (F.col("md_end") - F.col("md_start")).cast("int")) == F.col("md")).alias("same"))


def page_ranges(spark, sf_dir):
    return B.page_ranges(B.markdown(BLOCKS.df(spark, sf_dir)))


def manifest_counts(spark, sf_dir):
    return B.kind_counts(BLOCKS.df(spark, sf_dir))


def manifest_json(spark, sf_dir):
    m = B.manifests(BLOCKS.df(spark, sf_dir))
    return m.select("doc", F.get_json_object("manifest", "$.blocks").cast("long").alias("blocks"), F.get_json_object("manifest", "$.page_count").cast("long").alias("pages"), F.coalesce(F.json_array_length(F.get_json_object("manifest", "$.outline")), F.lit(0)).cast("long").alias("headings"))


def block_lookup(spark, sf_dir):
    """Chunks with their blocks, by page as well: ids exploded, then joined."""
    blocks = BLOCKS.df(spark, sf_dir)
    c = B.chunks(blocks.withColumn("chars", F.char_length("text").cast("long")), 2000, 400)
    ids = c.select("doc", "chunk", F.explode(F.sequence("first", "last")).alias("seq"))
    return ids.join(blocks, ["doc", "seq"]).groupBy("doc", "chunk").agg(F.count("*").alias("blocks"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def table_render(spark, sf_dir):
    """Each document's lines as a table: escaped, and whether it is one worth keeping."""
    cells = F.array_sort(F.collect_list(F.struct("pos", F.array("cell", "size").alias("r"))))
    rows = D.GRIDS.df(spark, sf_dir).groupBy("doc_id").agg(F.transform(cells, lambda x: x["r"]).alias("r"))
    header = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("line"), F.lit("length|n"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.md5(B.table_markdown(header, F.col("r"))).alias("md"), B.table_kept(F.col("r")).alias("kept"))


def bundle_check(spark, sf_dir):
    return bundles.read_bundles(BUNDLES.df(spark, sf_dir)).select("id", F.coalesce("code", F.lit("ok")).alias("code"))


def bundle_outline_flatten(spark, sf_dir):
    return bundles.outline(bundles.read_bundles(BUNDLES.df(spark, sf_dir)).filter("code is null"), "id")


def page_range_parse(spark, sf_dir):
    rows = RANGES.df(spark, sf_dir).withColumn("r", bundles.page_range(F.col("value")))
    return rows.select("id", "r.first", F.coalesce("r.last", F.lit(-1)).alias("last"))


QUERIES = {
    k.__name__: k
    for k in (
        overlap_join, cell_fallback, swallow_anti_join, object_anchor, body_size_mode, heading_size_ranks, line_gap_median, gutter_islands, column_assign, band_order, row_runs, anchored_rows,
        row_merge, block_classify, paragraph_islands, paragraph_texts, document_titles, chunk_pack, chunk_parts, markdown_offsets, markdown_slices, page_ranges, manifest_counts, manifest_json, block_lookup, table_render,
        bundle_check, bundle_outline_flatten, page_range_parse,
    )
}

OV = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.bottom, {b}.bottom) - greatest({a}.top, {b}.top)) / (({a}.x1 - {a}.x0) * ({a}.bottom - {a}.top))"
SC = OV.format(a="s", b="c")
SQL_CELLS = f"SELECT doc, page, c.seq AS cell, string_agg(s.text, ' ' ORDER BY s.top, s.x0, s.text) AS text FROM {SPANS.sql} s JOIN {CELLS.sql} c USING (doc, page) WHERE {SC} >= 0.7 GROUP BY ALL"
SQL_BODY = f"SELECT doc, arg_max(s, (chars, -fp, -fs)) AS body FROM (SELECT doc, s, sum(length(text)) AS chars, min(page) AS fp, min(seq) FILTER (page = mp) AS fs FROM (SELECT *, round_even(size, 1) AS s, min(page) OVER (PARTITION BY doc, round_even(size, 1)) AS mp FROM {LINES.sql}) GROUP BY ALL) GROUP BY doc"

def sql_columns(t: str) -> str:
    """gut: gutters; held: those that are believed; cols: the boxes of `t` with c, their column, and crosses."""
    return f"""
cov AS (SELECT doc, page, bin, count(*) AS n FROM (SELECT doc, page, unnest(range(CAST(least(159, greatest(0, floor(x0 / 600 * 160))) AS BIGINT), CAST(least(159, greatest(0, floor(x1 / 600 * 160))) AS BIGINT) + 1)) AS bin FROM {t}) GROUP BY ALL),
pg AS (SELECT doc, page, count(*) AS k, min(x1) AS ends, max(x0) AS starts FROM {t} GROUP BY ALL HAVING count(*) >= 6),
free AS (SELECT doc, page, ends, starts, b.bin, b.bin - row_number() OVER (PARTITION BY doc, page ORDER BY b.bin) AS island FROM pg CROSS JOIN (SELECT unnest(range(12, 148)) AS bin) b LEFT JOIN cov USING (doc, page, bin) WHERE coalesce(n, 0) <= greatest(1, floor(0.12 * k))),
gut AS (SELECT doc, page, min(bin) AS g_left, max(bin) AS g_right FROM free GROUP BY doc, page, island HAVING (max(bin) - min(bin) + 1) * 3.75 >= 21 AND max(starts) >= (max(bin) + 1) * 3.75 AND min(ends) <= min(bin) * 3.75),
raw AS (SELECT l.*, (SELECT count(*) FROM gut g WHERE g.doc = l.doc AND g.page = l.page AND (g_right + 1) * 3.75 <= (l.x0 + l.x1) / 2) AS c, EXISTS (SELECT 1 FROM gut g WHERE g.doc = l.doc AND g.page = l.page AND l.x0 <= g_left * 3.75 + 1 AND l.x1 >= (g_right + 1) * 3.75 - 1) AS crosses FROM {t} l),
side AS (SELECT doc, page, c, sum(length(text)) / sum(sum(length(text))) OVER (PARTITION BY doc, page) AS part FROM raw WHERE NOT crosses GROUP BY doc, page, c),
held AS (SELECT g.* FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY g_left) - 1 AS i FROM gut) g JOIN side a ON a.doc = g.doc AND a.page = g.page AND a.c = i JOIN side b ON b.doc = g.doc AND b.page = g.page AND b.c = i + 1 WHERE a.part >= 0.12 AND b.part >= 0.12),
cols AS (SELECT l.*, (SELECT count(*) FROM held g WHERE g.doc = l.doc AND g.page = l.page AND (g_right + 1) * 3.75 <= (l.x0 + l.x1) / 2) AS c, EXISTS (SELECT 1 FROM held g WHERE g.doc = l.doc AND g.page = l.page AND l.x0 <= g_left * 3.75 + 1 AND l.x1 >= (g_right + 1) * 3.75 - 1) AS crosses FROM {t} l)"""


SQL_GUTTERS = sql_columns(LINES.sql)
SQL_MD = f"""m AS (SELECT *, CASE WHEN kind = 'footnote' THEN 1 ELSE 0 END AS foot, length(CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list' THEN '- ' || text WHEN 'quote' THEN '> ' || text WHEN 'footnote' THEN '[^' || seq || ']: ' || text ELSE text END) AS n FROM {BLOCKS.sql}),
k AS (SELECT *, CASE WHEN page IS DISTINCT FROM lag(page) OVER (PARTITION BY doc ORDER BY foot, seq) AND kind <> 'footnote' THEN length('<!-- page ' || page || ' -->') + 2 ELSE 0 END AS mark FROM m),
o AS (SELECT doc, seq, kind, page, CAST(coalesce(sum(mark + n + 2) OVER (PARTITION BY doc ORDER BY foot, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + mark AS BIGINT) AS md_start, n FROM k)"""
SQL_RANKS = f"""
sz AS (SELECT doc, s, row_number() OVER (PARTITION BY doc ORDER BY s DESC) AS k FROM (SELECT l.doc, round_even(size, 1) AS s, sum(length(text)) AS n FROM {LINES.sql} l JOIN ({SQL_BODY}) b ON b.doc = l.doc WHERE size >= 1.12 * body GROUP BY ALL) WHERE n >= 8),
rk AS (SELECT doc, k, [s] AS ranks FROM sz WHERE k = 1 UNION ALL SELECT z.doc, z.k, CASE WHEN z.s > 0.92 * rk.ranks[-1] THEN rk.ranks ELSE list_append(rk.ranks, z.s) END FROM rk JOIN sz z ON z.doc = rk.doc AND z.k = rk.k + 1),
ranks AS (SELECT doc, arg_max(ranks, k)[1:4] AS ranks FROM rk GROUP BY doc)"""
SIGNS = B.MATH_SIGNS.replace("^", r"\^")
RE = {"item": "|".join((T.BULLET, T.NUMBERED, T.BULLET_RTL)), "end": B.SENTENCE_END.replace("'", "''"), "foot": B.FOOTNOTE, "caption": T.CAPTION, "keyword": rf"^({'|'.join(sorted(S.KEYWORDS, key=len, reverse=True))})(?:\s+(\S+?)|([0-9]\S*?))(?:[\s:\-–—.,)\]]+(?:.*))?$", "outline": r"^([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})[.)]?\s+(\S.{0,90})$"}
SQL_KINDS = rf"""{SQL_RANKS},
lv AS (SELECT l.*, trim(text, ' ') AS t, body, list_position(list_transform(ranks, lambda r: round_even(size, 1) >= 0.96 * r), true) AS hit, regexp_extract(trim(text, ' '), '{RE["outline"]}', 1) AS num, regexp_extract(trim(text, ' '), '{RE["outline"]}', 2) AS title FROM {LINES.sql} l LEFT JOIN ({SQL_BODY}) b USING (doc) LEFT JOIN ranks USING (doc)),
le AS (SELECT *, CAST(CASE WHEN length(t) < 1 OR length(t) > 200 THEN 0 WHEN hit > 0 THEN CASE WHEN length(t) <= 120 THEN least(hit, 6) ELSE 0 END
  WHEN num <> '' AND length(title) <= 80 AND NOT regexp_matches(title, '[.!?:;,]$') AND NOT regexp_matches(title, '^[a-z]') THEN least(1 + len(string_split(num, '.')), 4) ELSE 0 END AS BIGINT) AS level FROM lv),
kinds AS (SELECT *, CASE WHEN level > 0 THEN 'heading' WHEN top >= 0.72 * {HEIGHT} AND regexp_matches(text, '{RE["foot"]}') AND size <= 0.95 * body THEN 'footnote' WHEN regexp_matches(t, '{RE["caption"]}', 'i') THEN 'caption'
  WHEN length(t) BETWEEN 2 AND 200 AND len(regexp_extract_all(t, '[{SIGNS}]')) >= 2 AND len(regexp_extract_all(t, '[{SIGNS}]')) >= 0.08 * length(t) AND len(regexp_extract_all(t, '\p{{L}}')) <= 0.6 * length(t) AND len(list_filter(string_split_regex(t, '\s+'), lambda w: length(w) > 2 AND regexp_matches(w, '^\p{{L}}+$'))) <= 4 THEN 'formula'
  WHEN regexp_matches(t, '{RE["item"]}') THEN 'list' ELSE 'paragraph' END AS kind FROM le)"""
SQL_ASSEMBLED = f"""{SQL_KINDS},
gaps AS (SELECT doc, page, round(median(d), 6) AS gap FROM (SELECT *, top - lag(bottom) OVER w AS d, greatest(lag(bottom) OVER w - lag(top) OVER w, 1) AS tall, lag(col) OVER w AS before FROM {LINES.sql} WINDOW w AS (PARTITION BY doc, page ORDER BY seq)) WHERE col = before AND d >= 0 AND d < 4 * tall GROUP BY ALL),
every AS (SELECT doc, page, seq AS spot, 0 AS obj, kind, text, level, x0, x1, top, bottom, col FROM kinds UNION ALL SELECT doc, page, seq, 1, 'figure', '', NULL, NULL, NULL, NULL, NULL, NULL FROM {FIGURES.sql}),
placed AS (SELECT e.*, gap, row_number() OVER (PARTITION BY e.doc ORDER BY e.page, spot, obj, kind, text) AS place FROM every e LEFT JOIN gaps USING (doc, page)),
prev AS (SELECT *, lag(kind) OVER w AS p_kind, lag(page) OVER w AS p_page, lag(col) OVER w AS p_col, lag(x0) OVER w AS p_x0, lag(x1) OVER w AS p_x1, lag(bottom) OVER w AS p_bottom, coalesce(regexp_matches(lag(text) OVER w, '{RE["end"]}'), false) AS ended, sum(CASE WHEN kind <> 'paragraph' THEN 1 ELSE 0 END) OVER w AS part FROM placed WINDOW w AS (PARTITION BY doc ORDER BY place)),
heads AS (SELECT *, first_value(kind) OVER v AS head, first_value(x0) OVER v AS head_x0 FROM prev WINDOW v AS (PARTITION BY doc, part ORDER BY place)),
outs AS (SELECT *, sum(CASE WHEN kind = 'paragraph' AND (coalesce(x0 < head_x0 - 2, false) OR ended) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, part ORDER BY place) AS outs FROM heads),
ins AS (SELECT *, head = 'list' AND outs = 0 AS inside, coalesce(lag(head = 'list' AND outs = 0) OVER (PARTITION BY doc ORDER BY place), false) AS was_in FROM outs),
goes AS (SELECT *, CASE WHEN kind = 'list' THEN was_in WHEN kind <> 'paragraph' THEN false WHEN inside THEN true WHEN p_kind IS DISTINCT FROM 'paragraph' OR was_in THEN false WHEN page <> p_page THEN NOT ended
  ELSE NOT (col <> p_col OR (coalesce(gap, 0) > 0 AND top - p_bottom > 1.8 * coalesce(gap, 0)) OR (abs(x0 - p_x0) > 0.9 * (bottom - top) AND top - p_bottom <= 1.8 * coalesce(gap, 0) AND (p_x1 - p_x0) / {WIDTH} >= 0.55) OR (ended AND (p_x1 - p_x0) / {WIDTH} < 0.62)) END AS goes_on FROM ins),
blocked AS (SELECT *, CAST(sum(CASE WHEN coalesce(goes_on, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY place) AS BIGINT) AS block FROM goes),
assembled AS (SELECT *, CAST(sum(CASE WHEN kind = 'list' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, block ORDER BY place) AS BIGINT) AS item FROM blocked)"""
SQL_BUILT = rf"""{SQL_ASSEMBLED},
own AS (SELECT *, CASE WHEN kind = 'list' THEN trim(CASE WHEN regexp_matches(trim(text, ' '), '{T.BULLET}') THEN regexp_extract(trim(text, ' '), '{T.BULLET}', 2) WHEN regexp_matches(trim(text, ' '), '{T.NUMBERED}') THEN regexp_extract(trim(text, ' '), '{T.NUMBERED}', 3) ELSE regexp_extract(trim(text, ' '), '{T.BULLET_RTL}', 1) END, ' ')
    WHEN kind = 'footnote' AND regexp_matches(trim(text, ' '), '{B.FOOTNOTE}') THEN regexp_extract(trim(text, ' '), '{B.FOOTNOTE}', 2) ELSE trim(text, ' ') END AS own,
  CASE WHEN kind = 'list' THEN CASE WHEN regexp_matches(trim(text, ' '), '{T.BULLET}') THEN regexp_extract(trim(text, ' '), '{T.BULLET}', 1) WHEN regexp_matches(trim(text, ' '), '{T.NUMBERED}') THEN regexp_extract(trim(text, ' '), '{T.NUMBERED}', 1) ELSE regexp_extract(trim(text, ' '), '{T.BULLET_RTL}', 2) END
    WHEN kind = 'footnote' THEN trim(regexp_extract(trim(text, ' '), '{B.FOOTNOTE}', 1), '.)][') ELSE '' END AS mark,
  kind = 'list' AND NOT regexp_matches(trim(text, ' '), '{T.BULLET}') AND regexp_matches(trim(text, ' '), '{T.NUMBERED}') AS number FROM assembled),
items AS (SELECT doc, block, item, replace(regexp_replace(string_agg(trim(own, ' '), chr(10) ORDER BY place), '-\n([a-zà-ÿ])', '\1', 'g'), chr(10), ' ') AS text, min(place) AS place, arg_min(kind, place) AS kind, arg_min(coalesce(level, 0), place) AS level, arg_min(mark, place) AS mark, arg_min(number, place) AS number, min(page) AS first_page, max(page) AS last_page FROM own GROUP BY ALL),
built AS (SELECT doc, block, list(text ORDER BY item) AS t, arg_min(kind, place) AS kind, arg_min(level, place) AS level, arg_min(mark, place) AS marker, arg_min(number, place) AS number, min(first_page) AS first_page, max(last_page) AS last_page FROM items GROUP BY ALL)"""
#: Level of a line that a heading's word opens, 0 for none; t: the line.
SQL_KEYWORD = rf"""(SELECT coalesce(max(CASE WHEN word <> '' AND (numbered OR (length(t) <= 60 AND lower(token) NOT IN ({", ".join(f"'{w}'" for w in S.NO_NUMBER)}) AND NOT regexp_matches(token, '^[a-z]'))) AND NOT (length(t) > 60 AND regexp_matches(t, '{S.SENTENCE_END}'))
    THEN CASE lower(word) {" ".join(f"WHEN '{w}' THEN {k}" for w, k in S.KEYWORDS.items())} END END), 0)
  FROM (SELECT *, regexp_matches(bare, '^[0-9]{{1,4}}$') OR lower(bare) IN ({", ".join(f"'{w}'" for w in S.ORDINALS)}) OR regexp_matches(bare, '^[IVXLCDM]+$') OR regexp_matches(bare, '^[א-ת][''׳]?$') OR regexp_matches(bare, '^[א-ת]{{1,2}}["״][א-ת]$') AS numbered
    FROM (SELECT word, token, regexp_replace(token, '[.:,;)\]\-–—]+$', '') AS bare FROM (SELECT regexp_extract(t, '{RE["keyword"]}', 1, 'i') AS word, regexp_extract(t, '{RE["keyword"]}', 2, 'i') || regexp_extract(t, '{RE["keyword"]}', 3, 'i') AS token))))"""
#: As SQL_BUILT, with the headings that their words show: those come before the numbered ones.
SQL_WORDED = SQL_BUILT.replace("WHEN num <> ''", f"WHEN {SQL_KEYWORD} > 0 THEN {SQL_KEYWORD} WHEN num <> ''")
ORACLE = {
    "overlap_join": SQL_CELLS,
    "cell_fallback": f"SELECT doc, page, k.seq AS cell, coalesce(o.text, 'cell ' || k.seq) AS text FROM {CELLS.sql} k LEFT JOIN ({SQL_CELLS}) o USING (doc, page) WHERE o.cell = k.seq UNION ALL SELECT doc, page, seq, 'cell ' || seq FROM {CELLS.sql} k WHERE NOT EXISTS (SELECT 1 FROM ({SQL_CELLS}) o WHERE o.doc = k.doc AND o.page = k.page AND o.cell = k.seq)",
    "swallow_anti_join": f"SELECT doc, page, seq FROM {SPANS.sql} s WHERE NOT EXISTS (SELECT 1 FROM {CELLS.sql} c WHERE c.seq < 3 AND c.doc = s.doc AND c.page = s.page AND {SC} >= 0.6)",
    "object_anchor": f"SELECT b.doc, b.page, b.seq AS box, coalesce(min(s.seq) FILTER ({OV.format(a='s', b='b')} >= 0.6), min(s.seq) FILTER (s.top >= b.bottom), coalesce(max(s.seq), -1) + 1) AS anchor FROM {FIGURES.sql} b LEFT JOIN {SPANS.sql} s ON s.doc = b.doc AND s.page = b.page GROUP BY ALL",
    "body_size_mode": SQL_BODY,
    "heading_size_ranks": f"""WITH RECURSIVE s AS (SELECT doc, s, row_number() OVER (PARTITION BY doc ORDER BY s DESC) AS k FROM (SELECT l.doc, round_even(size, 1) AS s, sum(length(text)) AS n FROM {LINES.sql} l JOIN ({SQL_BODY}) b ON b.doc = l.doc WHERE size >= 1.12 * body GROUP BY ALL) WHERE n >= 8),
r AS (SELECT doc, k, [s] AS ranks FROM s WHERE k = 1 UNION ALL SELECT s.doc, s.k, CASE WHEN s.s > 0.92 * r.ranks[-1] THEN r.ranks ELSE list_append(r.ranks, s.s) END FROM r JOIN s ON s.doc = r.doc AND s.k = r.k + 1)
SELECT doc, array_to_string(list_transform(arg_max(ranks, k)[1:4], lambda x: printf('%.1f', x)), ' ') AS ranks FROM r GROUP BY doc""",
    "line_gap_median": f"WITH {SQL_GUTTERS} SELECT doc, page, round(median(d), 6) AS gap FROM (SELECT *, top - lag(bottom) OVER w AS d, greatest(lag(bottom) OVER w - lag(top) OVER w, 1) AS tall, lag(c) OVER w AS before FROM cols WINDOW w AS (PARTITION BY doc, page ORDER BY seq)) WHERE c = before AND d >= 0 AND d < 4 * tall GROUP BY ALL",
    "gutter_islands": f"WITH {SQL_GUTTERS} SELECT doc, page, g_left AS \"left\", g_right AS \"right\" FROM gut",
    "column_assign": f"WITH {SQL_GUTTERS} SELECT doc, page, seq, c AS col, crosses FROM cols",
    "band_order": f"WITH {SQL_GUTTERS}, b AS (SELECT *, CASE WHEN crosses THEN 2 * sum(CAST(crosses AS INT)) OVER (PARTITION BY doc, page ORDER BY top, seq) - 1 ELSE 2 * sum(CAST(crosses AS INT)) OVER (PARTITION BY doc, page ORDER BY top RANGE UNBOUNDED PRECEDING) END AS band FROM cols) SELECT doc, page, seq, row_number() OVER (PARTITION BY doc, page ORDER BY band, CASE WHEN crosses THEN 0 ELSE c END, top, x0, seq) AS place FROM b",
    "row_runs": f"WITH r AS (SELECT *, CAST(floor(top / 30) AS BIGINT) AS \"row\" FROM {SPANS.sql}), g AS (SELECT *, coalesce(x0 - lag(x1) OVER w > 30, false) AS new FROM r WINDOW w AS (PARTITION BY doc, page, \"row\" ORDER BY x0, seq)) SELECT doc, page, seq, \"row\", CAST(sum(CAST(new AS INT)) OVER (PARTITION BY doc, page, \"row\" ORDER BY x0, seq) AS BIGINT) AS run FROM g",
    "anchored_rows": f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY top, x0, seq) AS k FROM {SPANS.sql}),
a AS (SELECT doc, page, seq, k, top AS anchor, CAST(0 AS BIGINT) AS "row" FROM s WHERE k = 1 UNION ALL SELECT s.doc, s.page, s.seq, s.k, CASE WHEN s.top - a.anchor <= 6 THEN a.anchor ELSE s.top END, CASE WHEN s.top - a.anchor <= 6 THEN a."row" ELSE a."row" + 1 END FROM a JOIN s ON s.doc = a.doc AND s.page = a.page AND s.k = a.k + 1)
SELECT doc, page, seq, "row" FROM a""",
    "row_merge": f"SELECT doc, page, CAST(floor(top / 30) AS BIGINT) AS \"row\", string_agg(text, ' ' ORDER BY x0, text) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM {SPANS.sql} GROUP BY doc, page, CAST(floor(top / 30) AS BIGINT)",
    "block_classify": f"WITH RECURSIVE {SQL_KINDS} SELECT doc, page, seq, kind, level FROM kinds",
    "paragraph_islands": f"WITH RECURSIVE {SQL_ASSEMBLED} SELECT doc, place, kind, block, item FROM assembled",
    "paragraph_texts": f"WITH RECURSIVE {SQL_BUILT} SELECT doc, 'b' || lpad(CAST(block AS VARCHAR), 4, '0') AS id, kind, level, md5(CASE WHEN kind = 'list' THEN '' ELSE t[1] END) AS text, md5(CASE WHEN kind = 'list' THEN array_to_string(t, '|') ELSE '' END) AS items, kind = 'list' AND number AS ordered, marker, first_page, last_page FROM built",
    "document_titles": f"WITH RECURSIVE {SQL_WORDED}, f AS (SELECT doc, arg_min(t[1], block) AS first FROM built WHERE kind = 'heading' AND first_page <= 2 AND level BETWEEN 1 AND 2 GROUP BY 1), k AS (SELECT doc, max(seq) AS k FROM {LINES.sql} GROUP BY 1) SELECT doc, md5(CASE WHEN k % 3 = 0 THEN 'The book of ' || doc ELSE coalesce(first, 'Document') END) AS title FROM k LEFT JOIN f USING (doc)",
    "chunk_pack": f"""WITH RECURSIVE b AS (SELECT doc, seq, kind, length(text) AS n FROM {BLOCKS.sql}),
c AS (SELECT doc, seq, CAST(0 AS BIGINT) AS chunk, n AS chars, n FROM b WHERE seq = 0
  UNION ALL SELECT b.doc, b.seq, c.chunk + CAST(f AS BIGINT), CASE WHEN f THEN b.n ELSE c.chars + b.n END, b.n FROM (SELECT c.*, b2.seq AS s2, c.chars >= 2000 OR (b2.kind = 'heading' AND c.chars >= 400) AS f FROM c JOIN b b2 ON b2.doc = c.doc AND b2.seq = c.seq + 1) c JOIN b ON b.doc = c.doc AND b.seq = c.s2)
SELECT doc, chunk, min(seq) AS first, max(seq) AS last, CAST(sum(n) AS BIGINT) AS chars FROM c GROUP BY ALL""",
    "chunk_parts": f"SELECT doc, seq, kind, row_number() OVER (PARTITION BY doc, kind ORDER BY seq) AS part, count(*) OVER (PARTITION BY doc, kind) AS parts FROM {BLOCKS.sql}",
    "markdown_offsets": f"WITH {SQL_MD} SELECT doc, seq, md_start, md_start + n AS md_end FROM o",
    "markdown_slices": f"SELECT doc, seq, true AS same FROM {BLOCKS.sql}",
    "page_ranges": f"WITH {SQL_MD} SELECT doc, page, coalesce(min(md_start) FILTER (kind <> 'footnote'), min(md_start)) AS md_start, coalesce(max(md_start + n) FILTER (kind <> 'footnote'), max(md_start + n)) AS md_end FROM o GROUP BY ALL",
    "manifest_counts": "SELECT doc, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}s" for k in ("heading", "paragraph", "list", "table", "footnote")) + f" FROM {BLOCKS.sql} GROUP BY doc",
    "manifest_json": f"SELECT doc, count(*) AS blocks, max(page) AS pages, count(*) FILTER (kind = 'heading') AS headings FROM {BLOCKS.sql} GROUP BY doc",
    "table_render": f"""WITH r AS (SELECT doc_id, pos, '| ' || replace(replace(cell, chr(10), ' '), '|', '\\|') || ' | ' || size || ' |' AS row FROM {D.GRIDS.sql}), h AS (SELECT doc_id, min(pos) AS first, count(*) AS n, string_agg(row, chr(10) ORDER BY pos) AS every, arg_min(row, pos) AS head FROM r GROUP BY 1)
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '| line | length\\|n |' || chr(10) || '| --- | --- |' || chr(10) || every ELSE head || chr(10) || '| --- | --- |' || coalesce(chr(10) || (SELECT string_agg(row, chr(10) ORDER BY pos) FROM r WHERE r.doc_id = h.doc_id AND r.pos > h.first), '') END) AS md, n >= 2 AS kept FROM h""",
    "bundle_check": f"""SELECT id, CASE WHEN json_valid(raw) AND json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.schema') = 'foliant/1' AND json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.kind') = 'bundle' AND length(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.markdown')) >= 20 THEN 'ok' ELSE 'BUNDLE_INVALID' END AS code FROM {BUNDLES.sql}""",
    "bundle_outline_flatten": f"""WITH RECURSIVE good AS (SELECT id, raw FROM {BUNDLES.sql} WHERE json_valid(raw) AND json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.schema') = 'foliant/1' AND length(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.markdown')) >= 20),
tops AS (SELECT id, unnest(CAST(json_extract(raw, '$.manifest.outline') AS JSON[])) AS node, unnest(range(0, CAST(json_array_length(raw, '$.manifest.outline') AS BIGINT))) AS place FROM good),
nodes AS (SELECT id, CAST(1 AS BIGINT) AS depth, [place] AS path, node FROM tops
  UNION ALL SELECT id, depth + 1, list_append(path, place), child FROM (SELECT id, depth, path, unnest(CAST(json_extract(node, '$.children') AS JSON[])) AS child, unnest(range(0, CAST(json_array_length(node, '$.children') AS BIGINT))) AS place FROM nodes WHERE json_array_length(node, '$.children') > 0))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY path) AS n, depth, json_extract_string(node, '$.title') AS title, CAST(json_extract(node, '$.level') AS BIGINT) AS level, CAST(json_extract(node, '$.page_start') AS BIGINT) AS page_start, CAST(json_extract(node, '$.page_end') AS BIGINT) AS page_end FROM nodes""",
    "page_range_parse": f"SELECT id, coalesce(try_cast(string_split(value, '-')[1] AS BIGINT), 1) AS first, CASE WHEN contains(value, '-') THEN coalesce(try_cast(string_split(value, '-')[2] AS BIGINT), -1) ELSE coalesce(try_cast(value AS BIGINT), -1) END AS last FROM {RANGES.sql}",
}
ORACLE["block_lookup"] = f"WITH c AS ({ORACLE['chunk_pack']}) SELECT c.doc, c.chunk, count(*) AS blocks, min(page) AS first_page, max(page) AS last_page FROM c JOIN {BLOCKS.sql} b ON b.doc = c.doc AND b.seq BETWEEN c.first AND c.last GROUP BY ALL"
