"""Queries that put pages into order and lift tables and figures out of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import objects as O
from ..operators import reading as R
from ..operators import tidy as Y
from .derived import DRAWINGS, FRAGMENTS, IMAGES, OBJECT_LINES, PAGE_SIZES, PRINTED, SHEETS, TABLES
from .layout_queries import WIDTH, sql_columns
from .text_queries import SQL_NUMBER, SQL_RULE, SQL_TOC

BOX = ["x0", "top", "x1", "bottom"]


def reading_lines(spark, sf_dir):
    """Pieces of lines fused and in reading order."""
    rows = R.lines_in_order(FRAGMENTS.df(spark, sf_dir), WIDTH)
    return rows.select("doc", "page", "place", "col", F.md5("text").alias("text"), *BOX, "size", "bold", "pad_left", "pad_right", "pieces")


def drawing_clusters(spark, sf_dir):
    return O.clusters(DRAWINGS.df(spark, sf_dir))


def candidates(spark, sf_dir):
    return O.figure_candidates(IMAGES.df(spark, sf_dir), DRAWINGS.df(spark, sf_dir), PAGE_SIZES.df(spark, sf_dir))


def figure_candidates(spark, sf_dir):
    """Images and charts, without those that a table holds."""
    return O.figures(candidates(spark, sf_dir), TABLES.df(spark, sf_dir)).select("doc", "page", "seq", *BOX, "kind", "paths")


def harvested(spark, sf_dir):
    return O.harvested(OBJECT_LINES.df(spark, sf_dir), TABLES.df(spark, sf_dir), IMAGES.df(spark, sf_dir))


def object_harvest(spark, sf_dir):
    """Every table and figure with the caption that it took and its place."""
    rows = harvested(spark, sf_dir).select("doc", "page", F.explode("objects").alias("o"))
    return rows.select("doc", "page", "o.kind", "o.seq", "o.anchor", F.md5("o.caption").alias("caption"))


def object_lines_left(spark, sf_dir):
    """The lines that no table holds and no object took as its caption."""
    return harvested(spark, sf_dir).select("doc", "page", F.explode("lines").alias("x")).select("doc", "page", "x.seq")


def caption_band_join(spark, sf_dir):
    """The caption line of each image, where there are no tables."""
    return O.captions(IMAGES.df(spark, sf_dir), OBJECT_LINES.df(spark, sf_dir))


def book_directions(spark, sf_dir):
    """Which books were handed back the wrong way round."""
    return Y.directions(PRINTED.df(spark, sf_dir))


def book_languages(spark, sf_dir):
    return Y.languages(PRINTED.df(spark, sf_dir))


def direction_repair(spark, sf_dir):
    """Every line of every book, the right way round."""
    return Y.repaired(PRINTED.df(spark, sf_dir)).select("doc", "page", "seq", F.md5("text").alias("text"))


def margin_furniture(spark, sf_dir):
    """Why a line goes, for those that do."""
    return Y.judged(PRINTED.df(spark, sf_dir), SHEETS.df(spark, sf_dir)).filter("reason IS NOT NULL").select("doc", "page", "seq", "reason")


def tidy_counts(spark, sf_dir):
    return Y.taken(PRINTED.df(spark, sf_dir), SHEETS.df(spark, sf_dir))


QUERIES = {k.__name__: k for k in (book_directions, book_languages, direction_repair, margin_furniture, tidy_counts, reading_lines, drawing_clusters, figure_candidates, object_harvest, object_lines_left, caption_band_join)}

STRUCT = "{{'kind': {k}, 'seq': seq, 'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom}}"


def share(a: str, x0: str, top: str, x1: str, bottom: str) -> str:
    """The share of box `a` in another."""
    return f"(greatest(0, least({a}.x1, {x1}) - greatest({a}.x0, {x0})) * greatest(0, least({a}.bottom, {bottom}) - greatest({a}.top, {top})) / greatest(({a}.x1 - {a}.x0) * ({a}.bottom - {a}.top), 0.000001))"


def within(a: str, b: str) -> str:
    return share(a, *(f"{b}.{c}" for c in BOX))


SQL_READING = f"""WITH RECURSIVE {sql_columns(FRAGMENTS.sql)},
bands AS (SELECT *, CASE WHEN crosses THEN 2 * sum(CAST(crosses AS INT)) OVER (PARTITION BY doc, page ORDER BY top, seq) - 1 ELSE 2 * sum(CAST(crosses AS INT)) OVER (PARTITION BY doc, page ORDER BY top RANGE UNBOUNDED PRECEDING) END AS band, greatest(median(greatest(bottom - top, 1)) OVER (PARTITION BY doc, page) * 0.5, 2) AS near FROM cols),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc, page, band, c ORDER BY top, x0, seq) AS k FROM bands WHERE NOT crosses),
walk AS (SELECT doc, page, band, c, seq, k, top AS first, CAST(0 AS BIGINT) AS r FROM nth WHERE k = 1
  UNION ALL SELECT n.doc, n.page, n.band, n.c, n.seq, n.k, CASE WHEN n.top - w.first <= n.near THEN w.first ELSE n.top END, CASE WHEN n.top - w.first <= n.near THEN w.r ELSE w.r + 1 END FROM walk w JOIN nth n ON n.doc = w.doc AND n.page = w.page AND n.band = w.band AND n.c = w.c AND n.k = w.k + 1),
pieces AS (SELECT b.* EXCLUDE (c), b.c AS col, w.r FROM bands b JOIN walk w ON w.doc = b.doc AND w.page = b.page AND w.seq = b.seq UNION ALL SELECT * EXCLUDE (c), 0, 0 FROM bands WHERE crosses),
far AS (SELECT *, x0 - lag(x1) OVER v AS gap, lag(size) OVER v AS was, coalesce(lag(pad_right) OVER v, false) AS pad FROM pieces WINDOW v AS (PARTITION BY doc, page, band, col, r ORDER BY x0, top, seq)),
runs AS (SELECT *, sum(CASE WHEN gap > greatest(3 * was, {WIDTH} * 0.05) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, band, col, r ORDER BY x0, top, seq) AS run FROM far),
parts AS (SELECT *, row_number() OVER v AS i, sum(length(text)) OVER (PARTITION BY doc, page, band, col, r, run, size) AS weight FROM runs WINDOW v AS (PARTITION BY doc, page, band, col, r, run ORDER BY x0, top, seq)),
fused AS (SELECT doc, page, band, col, r, run, string_agg(CASE WHEN i > 1 AND (pad OR pad_left OR gap >= greatest(was * 0.18, 0.8)) THEN ' ' ELSE '' END || text, '' ORDER BY i) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom,
  arg_max(size, (weight, -i)) AS size, sum(CASE WHEN bold THEN length(text) ELSE 0 END) * 2 > sum(length(text)) AS bold, arg_min(pad_left, i) AS pad_left, arg_max(pad_right, i) AS pad_right, count(*) AS pieces FROM parts GROUP BY ALL)
SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY band, col, r, run) AS place, CAST(col AS BIGINT) AS col, md5(CASE WHEN pieces = 1 THEN text ELSE trim(regexp_replace(text, ' {{2,}}', ' ', 'g'), ' ') END) AS text, x0, top, x1, bottom, size, bold, pad_left, pad_right, pieces FROM fused"""

NEAR = O.TOUCH
SQL_CLUSTERS = f"""pages AS (SELECT doc, page, list({STRUCT.format(k="1")} ORDER BY seq) AS b FROM {DRAWINGS.sql} GROUP BY ALL),
step AS (SELECT doc, page, b FROM pages UNION ALL SELECT doc, page, list_append(list_filter(b, lambda x, i: i <> p.i AND i <> p.j), {{'kind': 1, 'seq': least(b[p.i].seq, b[p.j].seq), 'x0': least(b[p.i].x0, b[p.j].x0), 'top': least(b[p.i].top, b[p.j].top), 'x1': greatest(b[p.i].x1, b[p.j].x1), 'bottom': greatest(b[p.i].bottom, b[p.j].bottom)}})
  FROM (SELECT doc, page, b, list_filter(list_transform(range(1, len(b) + 1), lambda i: {{'i': i, 'j': list_position(list_transform(b, lambda y, j: j > i AND b[i].x0 - {NEAR} <= y.x1 AND y.x0 - {NEAR} <= b[i].x1 AND b[i].top - {NEAR} <= y.bottom AND y.top - {NEAR} <= b[i].bottom), true)}}), lambda z: z.j > 0)[1] AS p FROM step) WHERE p IS NOT NULL),
united AS (SELECT doc, page, unnest(arg_min(b, len(b)), recursive := true) FROM step GROUP BY doc, page)"""
AREA = "((x1 - x0) * (bottom - top) / (width * height))"
SQL_FIGURES = f"""{SQL_CLUSTERS},
shown AS (SELECT doc, page, seq, x0, top, x1, bottom FROM {IMAGES.sql} JOIN {PAGE_SIZES.sql} USING (doc, page) WHERE x1 - x0 >= 42 AND bottom - top >= 42 AND {AREA} >= 0.012 AND {AREA} < CASE WHEN scanned THEN 0.6 ELSE 0.9 END),
charts AS (SELECT doc, page, seq, x0, top, x1, bottom, (SELECT count(*) FROM {DRAWINGS.sql} d WHERE d.doc = u.doc AND d.page = u.page AND {within("d", "u")} > 0.9) AS paths FROM united u JOIN {PAGE_SIZES.sql} USING (doc, page) WHERE x1 - x0 >= 63 AND bottom - top >= 63 AND {AREA} >= 0.036),
found AS (SELECT *, 'image' AS kind, 0 AS paths FROM shown UNION ALL SELECT doc, page, seq, x0, top, x1, bottom, 'drawing', paths FROM charts c WHERE paths >= 6 AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.doc = c.doc AND s.page = c.page AND {within("c", "s")} > 0.5))"""


def sql_harvest(tables: str) -> str:
    """r: each page's state after k steps; nt tables swallow, then take captions, then figures do."""
    near = "greatest((o.bottom - o.top) * 0.25, 60)"
    fits = f"x.caption AND (x.top - o.bottom BETWEEN 0 AND {near} OR o.top - x.bottom BETWEEN 0 AND {near}) AND {share('x', 'o.x0 - 40', f'o.top - {near}', 'o.x1 + 40', f'o.bottom + {near}')} >= 0.5"
    seqs = "list_transform({}, lambda x: x.seq)"
    below = f"coalesce(list_min({seqs.format('list_filter(lines, lambda x: x.top >= o.bottom)')}), list_max({seqs.format('lines')}) + 1, 0)"
    return f"""ln AS (SELECT doc, page, list({{'seq': seq, 'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom, 'text': text, 'caption': regexp_matches(trim(text, ' '), '{T.CAPTION}', 'i')}} ORDER BY seq) AS lines FROM {OBJECT_LINES.sql} GROUP BY ALL),
tb AS (SELECT doc, page, list({STRUCT.format(k="'table'")} ORDER BY seq)[1:12] AS tables FROM {tables} GROUP BY ALL), fg AS (SELECT doc, page, list({STRUCT.format(k="'figure'")} ORDER BY seq) AS figures FROM {IMAGES.sql} GROUP BY ALL),
base AS (SELECT doc, page, coalesce(lines, []) AS lines, coalesce(tables, []) AS tables, coalesce(figures, []) AS figures FROM ln FULL JOIN tb USING (doc, page) FULL JOIN fg USING (doc, page)),
r AS (SELECT doc, page, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS op, CAST(NULL AS STRUCT(kind VARCHAR, seq BIGINT, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE)) AS o, lines, CAST(NULL AS BIGINT) AS anchor, CAST(NULL AS VARCHAR) AS text FROM base
  UNION ALL SELECT doc, page, k, op, o, CASE WHEN op = 1 THEN list_filter(lines, lambda x: {within("x", "o")} < 0.6) WHEN line IS NULL THEN lines ELSE list_filter(lines, lambda x: x.seq <> line.seq) END,
    CASE WHEN op = 1 THEN coalesce(list_min({seqs.format(f"list_filter(lines, lambda x: {within('x', 'o')} >= 0.6)")}), {below}) WHEN op = 2 THEN line.seq ELSE coalesce(line.seq, {below}) END, CASE WHEN op > 1 THEN coalesce(line.text, '') END
  FROM (SELECT *, list_filter(lines, lambda x: {fits})[1] AS line FROM (SELECT doc, page, r.k + 1 AS k, r.lines, CASE WHEN r.k < len(tables) THEN 1 WHEN r.k < 2 * len(tables) THEN 2 ELSE 3 END AS op, CASE WHEN r.k < len(tables) THEN tables[r.k + 1] WHEN r.k < 2 * len(tables) THEN tables[r.k - len(tables) + 1] ELSE figures[r.k - 2 * len(tables) + 1] END AS o
    FROM r JOIN base USING (doc, page) WHERE r.k < 2 * len(tables) + len(figures)))),
got AS (SELECT doc, page, o.kind AS kind, o.seq AS seq, min(anchor) AS anchor, max(text) AS text FROM r WHERE k > 0 GROUP BY ALL)"""


SQL_HARVEST = sql_harvest(TABLES.sql)
HITS = "CAST(len(list_intersect(list_distinct(regexp_extract_all({x}, '[\\x{{0590}}-\\x{{05ff}}]+')), {m})) AS BIGINT)"
RTL = "CAST(len(regexp_extract_all({x}, '[\\x{{0590}}-\\x{{05ff}}\\x{{0600}}-\\x{{06ff}}]')) AS BIGINT)"


def sql_samples(pages: int, chars: int) -> str:
    return f"pg AS (SELECT doc, page, left(string_agg(text, chr(10) ORDER BY seq), {chars}) AS text, row_number() OVER (PARTITION BY doc ORDER BY page) AS n FROM {PRINTED.sql} GROUP BY doc, page), sm AS (SELECT doc, left(string_agg(text, chr(10) ORDER BY page), {chars}) AS sample FROM pg WHERE n <= {pages} GROUP BY doc)"


SQL_DIRECTIONS = f"{sql_samples(30, 20000)}, dir AS (SELECT doc, {RTL.format(x='sample')} AS letters, {HITS.format(x='sample', m=T.MARKERS)} AS forward, {HITS.format(x='reverse(sample)', m=T.MARKERS)} AS backward FROM sm), dirs AS (SELECT *, letters >= 40 AND backward > forward AS flipped FROM dir)"
SQL_FLIP = r"array_to_string(list_transform(regexp_extract_all(reverse(text), '(?s)(?:[0-9A-Za-z.,:/\\-]*[0-9A-Za-z]|.)'), lambda x: CASE WHEN length(x) > 1 AND regexp_matches(x, '^[0-9A-Za-z.,:/\\-]+$') THEN reverse(x) ELSE x END), '')"
SQL_JUDGED = f"""rows AS (SELECT *, regexp_replace(lower(trim(text, ' ')), '[0-9]+', '#', 'g') AS fp, bottom <= 842 * 0.12 OR top >= 842 * (1 - 0.12) AS margin, trim(text, ' ') AS line FROM {PRINTED.sql}),
many AS (SELECT doc, count(DISTINCT page) AS pages FROM rows GROUP BY 1), known AS (SELECT doc, fp, count(DISTINCT page) AS n FROM rows WHERE margin AND length(fp) BETWEEN 4 AND 90 GROUP BY ALL), furn AS (SELECT doc, fp FROM known JOIN many USING (doc) WHERE pages >= 3 AND n >= greatest(3, floor(pages * 0.35))),
toc AS (SELECT doc, page FROM rows GROUP BY ALL HAVING count(*) >= 4 AND count(*) FILTER ({SQL_TOC.replace('(line', '(text')}) >= 3 AND count(*) FILTER ({SQL_TOC.replace('(line', '(text')}) >= 0.4 * count(*)),
why AS (SELECT r.doc, r.page, seq, CASE WHEN toc.doc IS NOT NULL THEN 'contents' WHEN margin AND furn.doc IS NOT NULL THEN 'header' WHEN {SQL_NUMBER} THEN 'page_number' WHEN {SQL_RULE} THEN 'decoration' END AS reason FROM rows r LEFT JOIN toc ON toc.doc = r.doc AND toc.page = r.page LEFT JOIN furn ON furn.doc = r.doc AND furn.fp = r.fp)"""
ORACLE = {
    "book_directions": f"WITH {SQL_DIRECTIONS} SELECT * FROM dirs",
    "book_languages": f"WITH {sql_samples(60, 40000)} SELECT doc, CASE WHEN {RTL.format(x='sample')} > len(regexp_extract_all(sample, '[A-Za-z]')) THEN 'rtl' ELSE 'ltr' END AS direction, CASE WHEN {RTL.format(x='sample')} > len(regexp_extract_all(sample, '[A-Za-z]')) THEN 'he' ELSE 'en' END AS language FROM sm",
    "direction_repair": f"WITH {SQL_DIRECTIONS} SELECT doc, page, seq, md5(CASE WHEN flipped THEN {SQL_FLIP} ELSE text END) AS text FROM {PRINTED.sql} JOIN dirs USING (doc)",
    "margin_furniture": f"WITH {SQL_JUDGED} SELECT * FROM why WHERE reason IS NOT NULL",
    "tidy_counts": f"WITH {SQL_JUDGED} SELECT doc, count(*) FILTER (reason = 'header') AS headers, count(*) FILTER (reason = 'page_number') AS page_numbers, count(*) FILTER (reason = 'decoration') AS decoration, count(DISTINCT page) FILTER (reason = 'contents') AS contents_pages FROM why GROUP BY doc",
    "reading_lines": SQL_READING,
    "drawing_clusters": f"WITH RECURSIVE {SQL_CLUSTERS} SELECT doc, page, seq, x0, top, x1, bottom FROM united",
    "figure_candidates": f"WITH RECURSIVE {SQL_FIGURES} SELECT doc, page, seq, x0, top, x1, bottom, kind, CAST(paths AS BIGINT) AS paths FROM found f WHERE NOT EXISTS (SELECT 1 FROM {TABLES.sql} t WHERE t.doc = f.doc AND t.page = f.page AND {within('f', 't')} > 0.6)",
    "object_harvest": f"WITH RECURSIVE {SQL_HARVEST} SELECT doc, page, kind, seq, anchor, md5(text) AS caption FROM got",
    "object_lines_left": f"WITH RECURSIVE {SQL_HARVEST} SELECT doc, page, unnest({'list_transform(arg_max(lines, k), lambda x: x.seq)'}) AS seq FROM r GROUP BY doc, page",
    "caption_band_join": f"WITH RECURSIVE {sql_harvest(f'(SELECT * FROM {TABLES.sql} WHERE false)')} SELECT doc, page, seq AS box, anchor AS line FROM got WHERE text <> ''",
}
