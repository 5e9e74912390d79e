"""Queries over learners' state and computed numbers, with their SQL.  Events stand for lessons and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import learning as L
from ..operators import logic as B
from ..operators import mathx as X
from . import derived as D

NUMBERS, WORDS_, SAMPLE, EXPRESSIONS, CROSSES, SEARCHES, QUADRATICS = D.NUMBERS, D.LETTERS, D.SAMPLE, D.EXPRESSIONS, D.CROSSES, D.SEARCHES, D.QUADRATICS
NOW = "2024-01-15 00:00:00"


def progress(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", F.col("event_id").alias("idx"), (F.col("event_id") % 3 != 0).alias("completed"), (F.col("event_id") % 5 != 0).alias("has_lesson"), (F.col("event_id") % 101).cast("double").alias("accuracy"), F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp_ntz")).alias("due_at"))


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def sm2_schedule(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return L.schedule(e.select("user_id", "event_type", F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 101).cast("double").alias("accuracy")), ["user_id", "event_type"])


def due_lessons(spark, sf_dir):
    return L.due(progress(spark, sf_dir), now()).groupBy("user_id").agg(F.count("*").alias("due"))


def practice_lessons(spark, sf_dir):
    return L.practice(progress(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("lessons"))


def review_overview(spark, sf_dir):
    p = progress(spark, sf_dir).filter("completed")
    return p.groupBy("user_id").agg(F.count_if(F.col("due_at") <= now()).alias("due"), F.date_format(F.min(F.when(F.col("due_at") > now(), F.col("due_at"))), "yyyy-MM-dd HH:mm:ss").alias("next_review"))


def warmup_pick(spark, sf_dir):
    return L.warm_up(progress(spark, sf_dir), 5000, now())


def review_nudge(spark, sf_dir):
    p = progress(spark, sf_dir).filter("due_at is not null")
    return p.select("user_id", "idx", F.date_format(L.nudged(F.col("due_at"), now()), "yyyy-MM-dd HH:mm:ss").alias("due"))


def calibration(spark, sf_dir):
    return L.calibration(progress(spark, sf_dir))


def course_progress(spark, sf_dir):
    return L.course_progress(progress(spark, sf_dir))


def xp_cost_totals(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") != "click", F.col("event_id") % 50).otherwise(0)).alias("xp"), F.sum(F.col("event_id") % 1000).alias("t_in"), F.sum(F.col("event_id") % 100).alias("t_out"))
    return rows.select("user_id", "xp", L.cost(F.col("t_in"), F.col("t_out")).alias("cost"))


def step_interleave(spark, sf_dir):
    """A conversation's questions as cards, its answers as quiz questions."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("lesson"), "role", "turn")
    numbered = rows.withColumn("n", (F.row_number().over(Window.partitionBy("lesson", "role").orderBy("turn")) - 1).cast("long"))
    of = lambda role: numbered.filter(F.col("role") == role).select("lesson", "n")
    return L.interleaved(of("user"), of("assistant"))


def streak_merge(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return L.streaks(e.select("user_id", F.to_date("ts").alias("seen"), (F.col("event_id") % 13).alias("streak")))


def number_parse(spark, sf_dir):
    return NUMBERS.df(spark, sf_dir).select("id", F.round(X.learner_number(F.col("s")), 6).alias("value")).filter("value is not null")


def gematria_sum(spark, sf_dir):
    return WORDS_.df(spark, sf_dir).select("id", *(X.letter_sum(F.col("word"), r).alias(r) for r in ("standard", "large", "ordinal", "small")))


def summary_stats(spark, sf_dir):
    return X.summary(SAMPLE.df(spark, sf_dir), "g", "v")


def summary_by_type(spark, sf_dir):
    return X.summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")


def histogram(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.width_bucket("value", F.lit(0.0), F.lit(100.0), F.lit(10)).alias("bin")).agg(F.count("*").alias("n"))


def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def chronology_gaps(spark, sf_dir):
    """The years that a customer's orders span, and the least and largest gap between those with orders."""
    years = orders(spark, sf_dir).select("o_custkey", F.year("o_orderdate").cast("long").alias("year")).distinct()
    rows = years.withColumn("gap", F.col("year") - F.lag("year").over(Window.partitionBy("o_custkey").orderBy("year")))
    return rows.groupBy("o_custkey").agg((F.max("year") - F.min("year")).alias("span"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap"))


def ranked_comparison(spark, sf_dir):
    """A customer's orders by price."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("value"), rank.cast("long").alias("rank"))


def compound_interest(spark, sf_dir):
    rows = orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p"), (F.col("o_orderkey") % 12).cast("double").alias("percent"), (1 + F.col("o_custkey") % 10).alias("years"))
    return rows.select("id", "years", F.round(X.compound(F.col("p"), F.col("percent"), F.col("years")), 2).alias("amount"))


def quadratic_roots(spark, sf_dir):
    low, high = X.quadratic(F.col("a"), F.col("b"), F.col("c"))
    return QUADRATICS.df(spark, sf_dir).select("id", low.alias("low"), high.alias("high"))


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def polygon_angles(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", X.polygon_angle(F.col("event_id") % 15).alias("angle"))


def binary_digits(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.bin("event_id").alias("digits"))


def punnett(spark, sf_dir):
    return X.punnett(CROSSES.df(spark, sf_dir))


def binary_search_trace(spark, sf_dir):
    return X.search_trace(SEARCHES.df(spark, sf_dir))


def truth_table(spark, sf_dir):
    """The rows of the tables of all propositions."""
    return B.table_rows(B.truth_tables(D.PROPOSITIONS.df(spark, sf_dir), "id", "text"), "id")


def proposition_kinds(spark, sf_dir):
    return B.kinds(B.truth_tables(D.PROPOSITIONS.df(spark, sf_dir), "id", "text"), "id")


def expressions(spark, sf_dir):
    return X.expression_values(EXPRESSIONS.df(spark, sf_dir), "id", "text").filter("value is not null").withColumn("value", F.round("value", 6))


QUERIES = {
    k.__name__: k
    for k in (
        sm2_schedule, due_lessons, practice_lessons, review_overview, warmup_pick, review_nudge, calibration, course_progress, xp_cost_totals, step_interleave, streak_merge, number_parse, gematria_sum,
        summary_stats, summary_by_type, histogram, chronology_gaps, ranked_comparison, compound_interest, quadratic_roots, polygon_angles, binary_digits, punnett, binary_search_trace, truth_table, proposition_kinds, expressions,
    )
}

P = "(SELECT user_id, event_id AS idx, event_id % 3 <> 0 AS completed, event_id % 5 <> 0 AS has_lesson, CAST(event_id % 101 AS DOUBLE) AS accuracy, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS TIMESTAMP) END AS due_at FROM events)"
T0 = f"TIMESTAMP '{NOW}'"
_PLAIN, _FINAL = "אבגדהוזחטיכלמנסעפצקרשת", dict(zip("ךםןףץ", "כמנפצ", strict=True))
_VALUE = {c: (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 400)[k] for k, c in enumerate(_PLAIN)}


def _letter_sum(value) -> str:
    """SQL that adds up a value for each letter."""
    cases = " ".join(f"WHEN '{c}' THEN {value(c)}" for c in (*_PLAIN, *_FINAL))
    return f"CAST(coalesce(list_sum(list_transform(string_split(word, ''), lambda c: CASE c {cases} ELSE 0 END)), 0) AS BIGINT)"


_plain = lambda c: _FINAL.get(c, c)
SQL_LETTERS = f"SELECT id, {_letter_sum(lambda c: _VALUE[_plain(c)])} AS standard, {_letter_sum(lambda c: 500 + 100 * 'ךםןףץ'.index(c) if c in _FINAL else _VALUE[c])} AS large, {_letter_sum(lambda c: _PLAIN.index(_plain(c)) + 1)} AS ordinal, {_letter_sum(lambda c: int(str(_VALUE[_plain(c)])[0]))} AS small FROM {WORDS_.sql}"
SQL_SUMMARY = "SELECT {g}, count({v}) AS n, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(max({v}) - min({v}), 6) AS span, round(stddev_pop({v}), 6) AS deviation FROM {t} GROUP BY 1"
SQL_TRUTH = f"""WITH n AS (SELECT id, text, CASE id % 6 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 ELSE 2 END AS names FROM {D.PROPOSITIONS.sql} WHERE id % 6 < 5),
b AS (SELECT id, names, row, row >> (names - 1) & 1 = 1 AS p, names > 1 AND row >> (names - 2) & 1 = 1 AS q, names > 2 AND row & 1 = 1 AS r FROM (SELECT *, unnest(range(0, CAST(1 << names AS BIGINT))) AS row FROM n)),
t AS (SELECT *, CASE id % 6 WHEN 0 THEN p AND q WHEN 1 THEN NOT p OR q WHEN 2 THEN NOT p OR NOT q OR r WHEN 3 THEN (p <> q) = r ELSE true END AS holds FROM b)"""
ORACLE = {
    "sm2_schedule": """WITH RECURSIVE r AS (SELECT user_id, event_type, CASE WHEN a >= 90 THEN 5 WHEN a >= 75 THEN 4 WHEN a >= 60 THEN 3 WHEN a >= 40 THEN 2 ELSE 1 END AS q, k, n FROM
  (SELECT user_id, event_type, event_id * 37 % 101 AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)),
s AS (SELECT DISTINCT user_id, event_type, CAST(0 AS BIGINT) AS k, n, CAST(2.5 AS DOUBLE) AS ease, CAST(0 AS BIGINT) AS gap, CAST(0 AS BIGINT) AS reps FROM r
  UNION ALL SELECT s.user_id, s.event_type, r.k, s.n, CASE WHEN q >= 3 THEN greatest(CAST(1.3 AS DOUBLE), s.ease + CAST(0.1 AS DOUBLE) - (5 - q) * (CAST(0.08 AS DOUBLE) + (5 - q) * CAST(0.02 AS DOUBLE))) ELSE s.ease END,
    CASE WHEN q < 3 THEN 1 WHEN s.reps = 0 THEN 1 WHEN s.reps = 1 THEN 6 ELSE CAST(floor(s.gap * s.ease + 0.5) AS BIGINT) END, CASE WHEN q >= 3 THEN s.reps + 1 ELSE 0 END
  FROM s JOIN r ON r.user_id = s.user_id AND r.event_type = s.event_type AND r.k = s.k + 1)
SELECT user_id, event_type, round(ease, 6) AS ease, gap AS interval, reps FROM s WHERE k = n""",
    "due_lessons": f"SELECT user_id, count(*) AS due FROM {P} WHERE completed AND has_lesson AND due_at <= {T0} GROUP BY 1",
    "practice_lessons": f"SELECT user_id, count(*) AS lessons FROM {P} WHERE completed GROUP BY 1",
    "review_overview": f"SELECT user_id, count(*) FILTER (due_at <= {T0}) AS due, strftime(min(due_at) FILTER (due_at > {T0}), '%Y-%m-%d %H:%M:%S') AS next_review FROM {P} WHERE completed GROUP BY 1",
    "warmup_pick": f"SELECT user_id, arg_min(idx, (coalesce(due_at, {T0}), idx)) AS idx FROM {P} WHERE completed AND has_lesson AND idx < 5000 GROUP BY 1",
    "review_nudge": f"SELECT user_id, idx, strftime(least(due_at, {T0} + INTERVAL 1 DAY), '%Y-%m-%d %H:%M:%S') AS due FROM {P} WHERE due_at IS NOT NULL",
    "calibration": f"SELECT user_id, CASE WHEN avg(accuracy) > 90 THEN 'harder' WHEN avg(accuracy) < 60 THEN 'slower' ELSE 'none' END AS note FROM {P} WHERE completed GROUP BY 1 HAVING count(*) >= 2",
    "course_progress": f"SELECT user_id, CAST(round(100.0 * count(*) FILTER (completed) / count(*)) AS BIGINT) AS pct FROM {P} GROUP BY 1",
    "xp_cost_totals": "SELECT user_id, CAST(sum(CASE WHEN event_type <> 'click' THEN event_id % 50 ELSE 0 END) AS BIGINT) AS xp, round(sum(event_id % 1000) / 1e6 + 5 * sum(event_id % 100) / 1e6, 6) AS cost FROM events GROUP BY 1",
    "step_interleave": """WITH r AS (SELECT conv_id AS lesson, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS n FROM conversations), k AS (SELECT lesson, count(*) FILTER (role = 'user') AS c, count(*) FILTER (role = 'assistant') AS q FROM r GROUP BY 1),
u AS (SELECT lesson, 'card' AS kind, n, 2.0 * n AS key FROM r WHERE role = 'user' UNION ALL SELECT lesson, 'quiz', n, CASE WHEN n < CASE WHEN c > 1 AND q > 1 THEN least(c - 1, q // 2) ELSE 0 END THEN 2.0 * n + 1 ELSE 1000000000.0 + n END FROM r JOIN k USING (lesson) WHERE role = 'assistant' AND c > 0)
SELECT lesson, row_number() OVER (PARTITION BY lesson ORDER BY key) AS place, kind, n FROM u""",
    "streak_merge": "SELECT user_id, arg_max(event_id % 13, (CAST(ts AS DATE), event_id % 13)) AS streak FROM events GROUP BY 1",
    "number_parse": rf"""WITH n AS (SELECT id, replace(replace(replace(trim(s, ' '), '"', ''), '−', '-'), '–', '-') AS s FROM {NUMBERS.sql}), v AS (SELECT id, CASE WHEN regexp_matches(s, '^-?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?$') THEN try_cast(replace(s, ',', '') AS DOUBLE) WHEN regexp_matches(s, '^-?[0-9]+,[0-9]+$') THEN try_cast(replace(s, ',', '.') AS DOUBLE)
  WHEN regexp_matches(s, '^-?[0-9]+/[0-9]+$') THEN try_cast(string_split(s, '/')[1] AS DOUBLE) / nullif(try_cast(string_split(s, '/')[2] AS DOUBLE), 0) ELSE try_cast(s AS DOUBLE) END AS value FROM n) SELECT id, round(value, 6) AS value FROM v WHERE value IS NOT NULL""",
    "gematria_sum": SQL_LETTERS,
    "summary_stats": SQL_SUMMARY.format(g="g", v="v", t=SAMPLE.sql),
    "summary_by_type": SQL_SUMMARY.format(g="event_type", v="value", t="events"),
    "histogram": "SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1",
    "chronology_gaps": "SELECT o_custkey, max(year) - min(year) AS span, min(gap) AS least_gap, max(gap) AS most_gap FROM (SELECT o_custkey, year, year - lag(year) OVER (PARTITION BY o_custkey ORDER BY year) AS gap FROM (SELECT DISTINCT o_custkey, year(o_orderdate) AS year FROM orders)) GROUP BY 1",
    "ranked_comparison": "SELECT o_custkey, o_orderkey AS id, round(o_totalprice, 2) AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "compound_interest": "SELECT o_orderkey AS id, 1 + o_custkey % 10 AS years, round(o_totalprice * pow(1 + (o_orderkey % 12) / 100.0, 1 + o_custkey % 10), 2) AS amount FROM orders",
    "quadratic_roots": f"SELECT id, round(least((-b - sqrt(d)) / (2 * a), (-b + sqrt(d)) / (2 * a)), 6) + 0.0 AS low, round(greatest((-b - sqrt(d)) / (2 * a), (-b + sqrt(d)) / (2 * a)), 6) + 0.0 AS high FROM (SELECT *, b * b - 4 * a * c AS d FROM {QUADRATICS.sql})",
    "polygon_angles": "SELECT event_id, round((n - 2) * 180.0 / n, 6) AS angle FROM (SELECT event_id, greatest(3, least(12, event_id % 15)) AS n FROM events)",
    "binary_digits": "SELECT event_id, bin(event_id) AS digits FROM events",
    "punnett": f"SELECT id, CASE WHEN ascii(x) <= ascii(y) THEN x || y ELSE y || x END AS genotype, count(*) AS n FROM (SELECT id, substr(mother, i, 1) AS x, substr(father, j, 1) AS y FROM {CROSSES.sql}, (SELECT unnest([1, 2]) AS i), (SELECT unnest([1, 2]) AS j)) GROUP BY ALL",
    "truth_table": f"{SQL_TRUTH} SELECT id, row, CASE WHEN names = 1 THEN CAST(row AS VARCHAR) WHEN names = 2 THEN lpad(bin(row), 2, '0') ELSE lpad(bin(row), 3, '0') END AS values, holds FROM t",
    "proposition_kinds": f"{SQL_TRUTH} SELECT id, CASE WHEN count(*) FILTER (holds) = count(*) THEN 'always' WHEN count(*) FILTER (holds) = 0 THEN 'never' ELSE CAST(count(*) FILTER (holds) AS VARCHAR) END AS kind FROM t GROUP BY id",
    "expressions": f"SELECT id, round(CASE id % 6 WHEN 0 THEN a + b * c WHEN 1 THEN (a - b) * (a - b) WHEN 2 THEN a / nullif(CAST(c AS DOUBLE), 0) WHEN 3 THEN 4 - b * b WHEN 4 THEN abs(b - a) % 4 END, 6) AS value FROM {EXPRESSIONS.sql} WHERE id % 6 < 5 AND NOT (id % 6 = 2 AND c = 0)",
    "binary_search_trace": f"""WITH RECURSIVE r AS (SELECT id, target, CAST(0 AS BIGINT) AS lo, size - 1 AS hi, [(size - 1) // 2] AS probes FROM {SEARCHES.sql}
  UNION ALL SELECT id, target, lo2, hi2, list_append(probes, (lo2 + hi2) // 2) FROM (SELECT *, CASE WHEN probes[-1] < target THEN probes[-1] + 1 ELSE lo END AS lo2, CASE WHEN probes[-1] < target THEN hi ELSE probes[-1] - 1 END AS hi2 FROM r WHERE probes[-1] <> target))
SELECT id, array_to_string(arg_max(probes, len(probes)), ',') AS probes FROM r GROUP BY id""",
}
