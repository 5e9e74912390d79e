"""Lessons, questions, JSON that was cut short, titles, sections of a text, and small rules around them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


KEYWORD_LINE = r"(?iu)^(part|book|chapter|unit|appendix|section|פרק|חלק|שער|יחידה|נספח|סעיף)[\s:.-]+\S"


def escaped(text: Column, attribute: bool = False) -> Column:
    """HTML escapes; attributes escape both quotes as well."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;")) if attribute else out


def interest_summary(names: Column) -> Column:
    """Two names, or the first two and how many more."""
    n = F.size(names)
    return F.when(n <= 2, F.array_join(names, " and ")).otherwise(F.concat(F.array_join(F.slice(names, 1, 2), ", "), F.lit(" and "), n - 2, F.lit(" more")))


def starter_picks(layout: DataFrame, chosen: Column, k: int = 3) -> DataFrame:
    """user_id, n, id: chosen interests first in the order of the layout, filled up to k.  layout: user_id, place, id."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy(F.when(chosen, 0).otherwise(1), "place"))
    return layout.withColumn("n", order.cast("long")).filter(F.col("n") <= k).select("user_id", "n", "id")


def heading_level(line: Column) -> Column:
    """part 1, chapter and like words 2, n 2, n.n 3, a short title of capitals or Title Case 2, else 0."""
    low = F.lower(line)
    short = (F.char_length(line) <= 80) & ~line.rlike(r"[.!?;,]$")
    title = line.rlike(r"^[\p{Lu}][\p{L}'’-]*(\s+([\p{Lu}][\p{L}'’-]*|of|the|and|in|a|to|for))*$") | (line.rlike(r"^[\p{Lu}\s]+$") & line.rlike(r"\p{Lu}{2}"))
    return F.when(~short, 0).when(low.rlike(r"^(part|book|חלק|שער)[\s:.-]+\S"), 1).when(line.rlike(KEYWORD_LINE), 2).when(line.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.?\s+\S"), 3).when(line.rlike(r"^[0-9]{1,2}[.)]?\s+\S"), 2).when(title, 2).otherwise(0).cast("long")


def sections(blocks: DataFrame) -> DataFrame:
    """doc_id, section, title, own (characters), share (percent, to 0.1): blocks (doc_id, pos, line) under the heading
    before them; a text that is nearly all headings has none."""
    rows = blocks.withColumn("level", heading_level(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum((F.col("level") > 0).cast("long")).over(order))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("level") > 0).alias("heads"), F.sum(F.char_length("line")).alias("whole")).filter("heads < 0.8 * n")
    out = rows.groupBy("doc_id", "section").agg(F.min_by("line", F.when(F.col("level") > 0, F.col("pos"))).alias("title"), F.sum(F.char_length("line").cast("long")).alias("own")).join(counts, "doc_id")
    return out.select("doc_id", "section", F.coalesce("title", F.lit("")).alias("title"), "own", F.round(100.0 * F.col("own") / F.col("whole"), 1).alias("share"))


def located(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, n, pos, page: outline titles (doc_id, n, title, page) found among lines, Markdown marks and case aside; the first place counts."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"^#+\s*", "")))
    hits = outline.withColumn("k", norm(F.col("title"))).join(blocks.select("doc_id", "pos", norm(F.col("line")).alias("k")), ["doc_id", "k"])
    return hits.groupBy("doc_id", "n").agg(F.min("pos").alias("pos"), F.min("page").alias("page"))


def runs_to_lines(runs: DataFrame, tolerance: float = 2.0, gap: float = 1.0) -> DataFrame:
    """page, row, text: text runs (page, str, width, x, y) with baselines within the tolerance, by place, top first;
    a blank where runs stand apart.  y grows upward."""
    w = Window.partitionBy("page").orderBy(F.desc("y"), "x")
    rows = runs.withColumn("row", F.sum(F.coalesce((F.lag("y").over(w) - F.col("y") > tolerance).cast("long"), F.lit(0))).over(w))
    v = Window.partitionBy("page", "row").orderBy("x")
    space = F.coalesce(F.col("x") - (F.lag("x").over(v) + F.lag("width").over(v)) > gap, F.lit(False))
    rows = rows.withColumn("piece", F.concat(F.when(space, " ").otherwise(""), F.col("str")))
    return rows.groupBy("page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "piece"))), lambda r: r["piece"]), "").alias("text"))


def dominant_lines(spans: DataFrame) -> DataFrame:
    """page, line, text, size (that of most characters, the first of several), bold (over half of the characters)."""
    n = F.char_length("text")
    spans = spans.filter(F.trim("text") != "")
    sizes = spans.groupBy("page", "line", F.bround("size", 2).alias("size")).agg(F.sum(n).alias("chars"), F.min("seq").alias("first"))
    size = sizes.groupBy("page", "line").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("size"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "")
    bold = 2 * F.sum(F.when(F.col("bold"), n).otherwise(0)) > F.sum(n)
    return spans.groupBy("page", "line").agg(text.alias("text"), bold.alias("bold")).join(size, ["page", "line"])


def ocr_lines(words: DataFrame) -> DataFrame:
    """page, block, par, line, text and box of recognised words (conf >= 0)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ")
    return words.filter("conf >= 0").groupBy("page", "block", "par", "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def ocr_language(wanted: Column, installed: Column) -> tuple[Column, Column]:
    """The installed ones of the languages asked for (else eng, else the first installed), and those that are missing."""
    asked = F.split(wanted, r"\+")
    have = F.array_intersect(asked, installed)
    fall = F.when(F.array_contains(installed, "eng"), F.array(F.lit("eng"))).otherwise(F.slice(installed, 1, 1))
    return F.array_join(F.when(F.size(have) > 0, have).otherwise(fall), "+"), F.array_join(F.array_except(asked, installed), "+")


def repaired(text: str | None) -> str | None:
    """The JSON object or list in a text, without fences and prose around it; of one cut short, only elements that are
    surely whole (a number at the cut is not); None for none, and for a cut within a string."""
    if text is None:
        return None
    starts = [k for k in (text.find("{"), text.find("[")) if k >= 0]
    if not starts:
        return None
    body, stack, quoted, slash, cut = text[min(starts) :], [], False, False, None
    for k, c in enumerate(body):
        if quoted:
            slash, quoted = (c == "\\" and not slash), (c != '"' or slash)
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return valid(body[: k + 1])
        elif c == ",":
            cut = (k, list(stack))
        if c in "}]":
            cut = (k + 1, list(stack))
    if quoted or cut is None:
        return None
    return valid(body[: cut[0]] + "".join(reversed(cut[1])))


def valid(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


def repaired_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, json: in Arrow batches, as a scanner with a stack is no built-in."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([repaired(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "json"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, json string")


STEPS = ("hook", "explore", "cards", "practice", "quiz", "summary")


def lesson_progress(partial: Column) -> Column:
    """The share (below 1) of a lesson's parts that a partial answer has begun: by the last key seen.  A key follows a bracket
    or a comma; inside a text its quotes would be escaped."""
    place = F.greatest(*(F.when(partial.rlike(rf'[{{,]\s*"{s}"'), F.lit(k + 1)).otherwise(F.lit(0)) for k, s in enumerate(STEPS)))
    return F.round(place / (len(STEPS) + 1.0), 4)


def prefetch_ok(exists: Column, held: Column, online: Column, signed_in: Column, left: Column) -> Column:
    """Whether a lesson may be fetched ahead: it is there, not held, and two or more are left (unknown: no limit)."""
    return exists & ~held & online & signed_in & (F.coalesce(left.cast("double"), F.lit(float("inf"))) >= 2)


def numeric_grade(answer: Column, target: Column, tolerance: Column) -> Column:
    from .mathx import learner_number

    return F.coalesce(F.abs(learner_number(answer) - target) <= F.abs(tolerance), F.lit(False))


def shuffled(options: Column, why: Column, correct: Column, seed: Column) -> Column:
    """Options in an order by the seed, their reasons and the correct place along."""
    zipped = F.transform(options, lambda o, k: F.struct(F.xxhash64(seed, k).alias("key"), o.alias("option"), F.get(why, k).alias("why"), (k == correct).alias("right")))
    order = F.array_sort(zipped)
    return F.struct(F.transform(order, lambda x: x["option"]).alias("options"), F.transform(order, lambda x: x["why"]).alias("why"), (F.array_position(F.transform(order, lambda x: x["right"]), True) - 1).alias("correct"))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """The area of a triangle with these sides; null where there is none."""
    s = (a + b + c) / 2
    q = s * (s - a) * (s - b) * (s - c)
    return F.round(F.when((a > 0) & (b > 0) & (c > 0) & (q > 0), F.sqrt(q)), 6)


def set_plan(subscriptions: DataFrame, caller: Column, allowed: int, plan: str) -> DataFrame:
    """Subscriptions after the one allowed caller sets a known plan; all others change nothing."""
    may = F.coalesce((caller == allowed) & F.lit(plan).isin("trial", "basic", "pro", "max"), F.lit(False))
    return subscriptions.withColumn("plan", F.when(may & (F.col("user_id") == caller), plan).otherwise(F.col("plan")))


