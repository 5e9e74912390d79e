"""SpotSigs fingerprints, with DataFrame functions only.

A spot is a common word (in the languages of ANCHORS) or the start of the text; its signature is the chain of the next
CHAIN content words (a shorter chain at the end of the text is none, unless the text has no full chain at all: then all
its content words, or all its words, are the one signature).  Where fewer than one chain in SPARSE content words follows a
common word (other languages, tables, code), every content word is a spot, so that the signatures cover the whole text.
A fingerprint is the sorted set of the signatures' 48-bit hashes, 12 hexadecimal digits each.  The likeness of two fingerprints is their Jaccard similarity; where a threshold is
given, pairs whose set lengths alone rule it out are pruned.

`near_pairs` joins a whole table: equal fingerprints are one class; classes are partitioned by set length so that only
neighbouring partitions can hold partners; within them the rarest signatures of each set (a prefix that any partner
must share one of) find candidates, and the Jaccard similarity is worked out for these.

Edge cases: null texts count as empty; a text without words has the empty fingerprint, whose likeness is 1 to another
empty one and 0 to any other; ties among identifiers in the order of documents go by their text; equal texts have equal
fingerprints; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table, text_or_empty

# fixed values: frequent function words of four languages
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it its not of on or she that the their they this to was were which with you "
    "auf aus bei das dem den der des die ein eine einem einen einer es für ich im ist mit nicht sich sie sind und von war wie wird zu "
    "au aux avec ce cette dans de du elle en est et il je la le les leur ne nous ou par pas pour que qui se son sur un une vous "
    "al con como del el ella ellos esta este fue ha las lo los más no para pero por su sus una y"
).split()
CHAIN = 2
#: Content words for each chain after a common word, above which all chains of the text are taken.
SPARSE = 20
DIGITS = 12


def _one_of(words: list[str]) -> str:
    """A pattern for any of the words, grouped by their first letter."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by_first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))


def _bound(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of the signatures' hashes, as an array of longs below 2^48."""
    # one blank around each word; markers stand for common words and for the start
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    marked = F.regexp_replace(F.concat(F.lit(" # "), words, F.lit(" ")), rf"(?<= )(?:{_one_of(ANCHORS)})(?= )", "#")
    word = "[^# ]++"

    def chosen(m, spots):
        # one of the spots is the start
        n_words = F.length(F.trim(m)) - F.length(F.translate(m, " ", "")) + 1 - (F.length(m) - F.length(F.translate(m, "#", "")))
        content = F.trim(F.regexp_replace(m, "[# ]+", " "))
        every = F.regexp_extract_all(F.concat(F.lit(" "), content, F.lit(" ")), F.lit(f" (?=({word}{f' {word}' * (chain - 1)}) )"), F.lit(1))
        rest = F.when(content != "", content).otherwise(words)
        full = F.when((F.size(spots) - 1) * SPARSE < n_words, every).otherwise(spots)
        return F.when(F.size(spots) > 0, full).when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))

    spotted = lambda m: F.regexp_extract_all(m, F.lit(f"#(?=[# ]++({word}{f'[# ]++{word}' * (chain - 1)}) )"), F.lit(1))
    spots = _bound(marked, lambda m: _bound(spotted(m), lambda x: chosen(m, x)))
    code = lambda x: F.xxhash64(F.regexp_replace(x, "[# ]+", " ")).bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))
    return F.array_sort(F.array_distinct(F.transform(spots, code)))


def fingerprint(signs: Column) -> Column:
    """The set as a string: DIGITS hexadecimal digits for each signature."""
    return F.array_join(F.transform(signs, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def likeness(x: Column, y: Column, least: float = 0.0) -> Column:
    """The Jaccard similarity of two signature sets; 0 where their lengths rule out `least`."""
    n, m = F.size(x), F.size(y)
    common = F.size(F.array_intersect(x, y))
    exact = F.when((n == 0) & (m == 0), 1.0).otherwise(common / (n + m - common))
    return F.when(F.least(n, m) < least * F.greatest(n, m), 0.0).otherwise(exact).cast("double")


def near_pairs(sets: DataFrame, least: float = 0.75, key: str = "doc_id", signs: str = "signs") -> tuple[DataFrame, DataFrame]:
    """(doc_id → class_id), and pairs (a, b, likeness) of classes with at least `least`, a > b.

    The class of a document is the least identifier that has its very set.  Empty sets pair with nothing.
    """
    rows = sets.select(F.col(key).alias("doc_id"), F.col(signs).alias("signs"))
    owners = rows.groupBy("signs").agg(F.min("doc_id").alias("class_id"))
    member = rows.join(owners, "signs").select("doc_id", "class_id")
    classes = cut(owners.filter(F.size("signs") > 0).withColumn("n", F.size("signs")))
    each = classes.select("class_id", "n", F.explode("signs").alias("sign"))
    often = each.groupBy("sign").agg(F.count("*").alias("df"))
    # set lengths: partition p holds lengths from least^-p on, so a partner is at most one partition away
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / least)).cast("int")
    in_order = Window.partitionBy("class_id").orderBy("df", "sign")
    prefix = each.join(often, "sign").withColumn("at", F.row_number().over(in_order))
    prefix = prefix.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("class_id", "n", "sign", part.alias("part"))
    near = prefix.withColumn("part", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)))
    x, y = prefix.toDF("a", "n_a", "sign", "part"), near.toDF("b", "n_b", "sign", "part")
    hit = x.join(y, ["sign", "part"]).filter((F.col("a") > F.col("b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")))
    own = classes.select("class_id", "signs")
    full = hit.select("a", "b").distinct().join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    return member, full.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).filter(F.col("likeness") >= least)


#: Stands for a null identifier in the order of documents.
NO_ID = -(1 << 63)


def with_next(docs: DataFrame, columns: list[str], id_col: str = "_id") -> DataFrame:
    """`docs` with a struct `next` of the given columns of the following row, in the order of (id_col, text); the last
    row's next is the first row.

    Rows are dealt out once, by ranges of identifiers (their splitters are quantiles, four or more ranges a
    partition); each range gets a copy of the row that starts the following one, so no range needs another.
    """
    n = 4 * max(2, partitions(docs.sparkSession))
    size = 1 << math.ceil(math.log2(n))
    marks = docs.agg(F.percentile_approx(id_col, [k / size for k in range(1, size)], 100 * size)).first()[0]
    if not marks:
        return docs.withColumn("next", F.struct(*columns))
    array = F.array(*(F.lit(m).cast("long") for m in sorted(marks)))
    steps = F.array(*(F.lit(size >> k) for k in range(1, size.bit_length())))
    # a binary search in the splitters
    place = F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.try_element_at(array, at + k) <= F.col(id_col), at + k).otherwise(at))
    docs = docs.withColumn("_range", place)
    firsts = {r[0]: r[1] for r in docs.groupBy("_range").agg(F.min(id_col)).collect()}  # a row a range
    used = sorted(firsts)
    before = [None] * size  # by range, the last one before it that has rows; the first range follows the last
    for i, k in enumerate(used):
        before[k] = used[i - 1]
    ghosts = docs.filter(F.col(id_col).isin(*firsts.values())).withColumn("_ghost", F.lit(1))
    table_of = F.array(*(F.lit(k).cast("int") for k in before))
    ghosts = ghosts.withColumn("_range", F.element_at(table_of, F.col("_range") + 1))
    rows = docs.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    own = Window.partitionBy("_range").orderBy("_ghost", id_col, "text")
    ahead = rows.withColumns({f"_next_{c}": F.lead(c).over(own) for c in columns})
    return ahead.withColumn("next", F.struct(*(F.col(f"_next_{c}").alias(c) for c in columns))).drop(*(f"_next_{c}" for c in columns)).filter("_ghost = 0").drop("_range", "_ghost")


def compare(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, signs, edited_signs, next_signs for each row.

    edited: the text whose last half (rounded down) is replaced by as many first characters of the next document.
    """
    docs = df.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    docs = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rows = with_next(docs.withColumn("signs", signatures(F.col("text"))), ["text", "signs"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(F.col("next.text"), half))
    rows = rows.select("doc_id", "n_chars", "signs", F.col("next.signs").alias("next_signs"), edited.alias("edited"))
    return rows.withColumn("edited_signs", signatures(F.col("edited")))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprints of all texts and their edited texts."""
    rows = compare(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
