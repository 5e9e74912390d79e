"""Budgeted TF-IDF retrieval over passages.

A passage is a chunk of whole sentences of one text (`passages`: doc_id, pos, text and whatever else the texts have).
Retrieval can be confined to a scope, such as a chapter or a source: then words are counted within it.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import written

FLOOR = 0.55
#: The share of the room left that a passage cut back to a sentence's end must fill.
LEAST_SHARE = 0.4
ENDERS = ".!?׃。"


def passages(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts' chunks, white space as single spaces: doc_id, pos, text, and the other columns."""
    rest = [c for c in docs.columns if c not in (doc, text)]
    rows = docs.filter(F.col(text).rlike(r"[^\t\n\x0B\f\r ]")).select(F.col(doc).alias("doc_id"), *rest, T.clean(F.col(text)).alias("_t"))
    rows = rows.select("doc_id", *rest, F.posexplode(T.pack_sentences(F.col("_t"))).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def word_counts(rows: DataFrame, text: str, *keep: str, also: str | None = None) -> DataFrame:
    """`keep`, word, tf: a row for each different word that counts of each row's text, and one for `also`.  A row is counted
    in Python: as rows of single words it would move word by word."""
    kept = rows.select(*keep, F.lower(F.col(text)).alias("_t"))
    kind = kept.drop("_t").schema.add("word", "string").add("tf", "long")

    def count(batches):
        import pyarrow as pa

        for b in batches:
            words, tf, at = [], [], []
            for k, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                own = counted(t)
                if also is not None:
                    own[also] = 1
                words.extend(own)
                tf.extend(own.values())
                at.extend([k] * len(own))
                if len(at) >= MANY_WORDS or k + 1 == b.num_rows:
                    places = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.take(places) for c in b.columns[:-1]), pa.array(words, pa.string()), pa.array(tf, pa.int64())], names=kind.names)
                    words, tf, at = [], [], []

    return kept.mapInArrow(count, kind)


#: How many words of a batch go on at once.
MANY_WORDS = 100_000
_WORD = re.compile(r"\w{3,}")
_STOP = frozenset(T.STOPWORDS)


def counted(lowered: str | None) -> Counter:
    """The words of a lower-case text that count, with their numbers."""
    own = Counter(_WORD.findall(lowered or ""))
    for w in _STOP.intersection(own):
        del own[w]
    return own


def query_words(queries: DataFrame, key: str = "item_id", text: str = "text", scope: tuple[str, ...] = ()) -> DataFrame:
    """query_id, scope, word, times: repeats count."""
    rows = word_counts(queries.withColumn("query_id", F.col(key)), text, "query_id", *scope)
    return rows.groupBy("query_id", *scope, "word").agg(F.sum("tf").alias("times"))


#: What stands for a passage itself among its words (no word is a space), so that counting words counts passages too.
ITSELF = " "
#: Passages that are scored at once, and cells of their table with the queries.
BLOCK, CELLS = 5_000, 1 << 22


def postings(rows: DataFrame, wanted: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """scope, doc_id, pos, chars, words (array of word and tf): a passage's wanted words, ITSELF among them."""
    every = word_counts(rows.withColumn("chars", F.char_length("text").cast("long")), "text", *scope, "doc_id", "pos", "chars", also=ITSELF)
    kept = wanted.select(*scope, "word").distinct()
    if scope:
        kept = kept.unionByName(wanted.select(*scope).distinct().withColumn("word", F.lit(ITSELF)))
    else:
        kept = kept.unionByName(rows.sparkSession.range(1).select(F.lit(ITSELF).alias("word")))
    found = every.join(kept, [*scope, "word"], "left_semi")
    return found.groupBy(*scope, "doc_id", "pos", "chars").agg(F.collect_list(F.struct("word", "tf")).alias("words"))


def score(rows: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text", scope: tuple[str, ...] = (), floor: float = 0.0) -> DataFrame:
    """query_id, doc_id, pos, chars, score (rounded to 6): the sum over a query's words, repeats included, of
    (1 + ln tf) * ln(1 + N / df); passages with a score above 0.  N and df count passages, of the query's scope.

    The passages' postings are written, and all else follows from these.  Passages are scored in blocks, each of which
    gets the queries' weights; with a `floor`, what is below that share of the best score in its block stays there.
    """
    asked = query_words(queries, key, text, scope)
    tf = written(postings(rows, asked, scope))
    df = tf.select(*scope, F.explode(F.array_distinct(F.transform("words", lambda x: x["word"]))).alias("word")).groupBy(*scope, "word").agg(F.count("*").alias("df"))
    df = written(df)  # of wanted words alone
    n = df.filter(F.col("word") == ITSELF).select(*scope, F.col("df").alias("n"))
    every = df.filter(F.col("word") != ITSELF)
    weight = (every.join(n, list(scope)) if scope else every.join(F.broadcast(n))).select(*scope, "word", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # without a scope n is one row
    blocks = max(1, -(-(n.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    name = lambda word: F.concat(*(x for c in scope for x in (F.col(c).cast("string"), F.lit("\0"))), word) if scope else word
    right = asked.join(weight, [*scope, "word"]).select("query_id", name(F.col("word")).alias("word"), (F.col("times") * F.col("idf")).alias("weight"))
    right = right.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    left = tf.select("doc_id", "pos", "chars", F.transform("words", lambda x: name(x["word"])).alias("words"), F.transform("words", lambda x: x["tf"]).alias("tf"), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(blocks)).alias("_b"))
    kind = right.select("query_id").schema
    for c in left.schema.fields[:3]:
        kind = kind.add(c)
    kind = kind.add("score", "double")
    names = kind.names

    def scored(block, own):
        import pyarrow as pa

        parts = [_scored(block.slice(lo, most), own, floor) for most in (max(1, CELLS // max(1, own.num_rows)),) for lo in range(0, block.num_rows, most)] if own.num_rows else []
        out = pa.concat_tables(parts) if parts else None
        if out is None:
            types = [own.schema.field("query_id").type, *(block.schema.field(c).type for c in ("doc_id", "pos", "chars")), pa.float64()]
            return pa.table([pa.array([], t) for t in types], names=names)
        return out.select(names)

    found = left.groupBy("_b").cogroup(right.groupBy("_b")).applyInArrow(scored, kind)
    return found.withColumn("score", F.round("score", 6)).filter("score > 0")


def _scored(block, own, floor: float):
    """query_id, doc_id, pos, chars, score of the pairs of passages (a table with lists words and tf) and queries (query_id,
    word, weight) that share words and reach `floor` of their query's best."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    block, own = block.combine_chunks(), own.combine_chunks()
    ids, words = pc.unique(own["query_id"]), pc.unique(own["word"])
    queries = len(ids)
    of, word = (pc.index_in(own[c], x).to_numpy().astype(np.int64) for c, x in (("query_id", ids), ("word", words)))
    order = np.argsort(word, kind="stable")
    of, weight = of[order], own["weight"].to_numpy()[order]
    first = np.searchsorted(word[order], np.arange(len(words) + 1))
    row = np.repeat(np.arange(block.num_rows), pc.list_value_length(block["words"]).to_numpy())
    at = pc.fill_null(pc.index_in(pc.list_flatten(block["words"]), words), -1).to_numpy().astype(np.int64)
    tf = pc.list_flatten(block["tf"]).to_numpy()
    key, place = np.unique((row * len(words) + at)[at >= 0], return_inverse=True)
    tf = 1 + np.log(np.bincount(place, tf[at >= 0], len(key)))
    row, at = np.divmod(key, len(words))
    many = first[at + 1] - first[at]
    entry = np.repeat(np.arange(len(key)), many)
    use = first[at][entry] + np.arange(len(entry)) - (np.cumsum(many) - many)[entry]
    total = np.bincount(row[entry] * queries + of[use], tf[entry] * weight[use], block.num_rows * queries).reshape(block.num_rows, queries)
    row, query = np.nonzero((total > 0) & (total >= floor * total.max(axis=0) - 2e-6))
    rows = pa.array(row)
    return pa.table({"query_id": ids.take(pa.array(query)), **{c: block[c].take(rows) for c in ("doc_id", "pos", "chars")}, "score": total[row, query]})


def ranked(scored: DataFrame, floor: float = FLOOR) -> DataFrame:
    """`scored` with best and rank, for passages with at least `floor` of their query's best score; ties in document order.
    The best scores are found by partial maxima; only what is above the floor meets by query."""
    best = scored.groupBy("query_id").agg(F.max("score").alias("best"))
    good = scored.join(best, "query_id").filter(F.col("score") >= floor * F.col("best"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "pos")
    return good.withColumn("rank", F.row_number().over(order).cast("long"))


def top(scored: DataFrame, k: int = 5, floor: float = FLOOR) -> DataFrame:
    """query_id, doc_id, pos, score, rank of the k best above the floor."""
    return ranked(scored, floor).filter(F.col("rank") <= k).select("query_id", "doc_id", "pos", "score", "rank")


def pick(chosen: DataFrame, budget: int) -> DataFrame:
    """query_id, rank, doc_id, pos, chars: ranked passages (with chars) picked greedily within the budget of characters.

    The first passage is always taken; one that does not fit is skipped once something is picked.  Of passages of one
    length only as many as fit can ever be picked, so that a query's candidates are bounded before they meet in a row.
    """
    alike = F.row_number().over(Window.partitionBy("query_id", "chars").orderBy("rank"))
    sized = chosen.withColumn("_nth", alike).filter((F.col("_nth") * F.col("chars") <= budget) | (F.col("rank") == 1))
    return knapsack(sized.select("query_id", "rank", "doc_id", "pos", "chars"), budget).select("query_id", F.inline("picked"))


def knapsack(rows: DataFrame, budget: int) -> DataFrame:
    """query_id, picked: the fold behind `pick`.  rows: query_id, rank, doc_id, pos, chars."""
    item = F.struct("rank", "doc_id", "pos", "chars")
    kind = "struct<used:bigint,picked:array<struct<rank:bigint,doc_id:bigint,pos:bigint,chars:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().alias("picked")).cast(kind)
    step = lambda a, x: F.when(
        (F.size(a["picked"]) == 0) | (a["used"] + x["chars"] <= budget), F.struct((a["used"] + x["chars"]).alias("used"), F.concat(a["picked"], F.array(x)).alias("picked"))
    ).otherwise(a).cast(kind)
    ordered = F.array_sort(F.collect_list(item))
    return rows.groupBy("query_id").agg(F.aggregate(ordered, start, step)["picked"].alias("picked"))


def fill_in_order(rows: DataFrame, group: str, order: tuple[str, ...], budget: int) -> DataFrame:
    """`rows` (with text) in order with `used`, the characters before each, as long as the budget is not used up."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.char_length("text").cast("long")).over(before), F.lit(0).cast("long"))
    return rows.withColumn("used", used).filter(F.col("used") < budget)


def trim(rows: DataFrame, group: str, order: tuple[str, ...], budget: int) -> DataFrame:
    """`rows` in order up to the budget; the passage that passes it is cut back to its last sentence's end, if that leaves
    more than LEAST_SHARE of the room, and is the last."""
    filled = fill_in_order(rows, group, order, budget)
    head = F.left("text", (F.lit(budget) - F.col("used")).cast("int"))
    whole = F.regexp_extract(head, f"(?s)^(.*[{ENDERS}])", 1)
    cut = F.when(F.char_length(whole) - 1 > LEAST_SHARE * (F.lit(budget) - F.col("used")), whole).otherwise(head)
    text = F.when(F.char_length("text") <= F.lit(budget) - F.col("used"), F.col("text")).otherwise(F.trim(cut))
    return filled.withColumn("text", text).filter("text <> ''")


def gap_marks(chosen: DataFrame) -> DataFrame:
    """In document order: whether a passage opens a document, and whether something was left out before it."""
    w = Window.partitionBy("query_id").orderBy("doc_id", "pos")
    before_doc, before_pos = F.lag("doc_id").over(w), F.lag("pos").over(w)
    return chosen.select(
        "query_id", "doc_id", "pos", (~F.col("doc_id").eqNullSafe(before_doc)).alias("opens"),
        F.coalesce((F.col("doc_id") == before_doc) & (F.col("pos") != before_pos + 1), F.lit(False)).alias("gap"),
    )


def relevant(docs: DataFrame, queries: DataFrame, budget: int = 12_000, key: str = "item_id", text: str = "text", scope: tuple[str, ...] = (), doc: str = "doc_id") -> DataFrame:
    """query_id, doc_id, pos, text, opens, gap: the passages of `docs` (doc, text) that are worth the budget, in document
    order, the last one trimmed.  Texts are cut again for the documents of picked passages alone."""
    picked = written(pick(ranked(score(passages(docs, doc), queries, key, text, scope, FLOOR)), budget).select("query_id", "doc_id", "pos"))
    own = docs.join(picked.select(F.col("doc_id").alias(doc)).distinct(), doc, "left_semi")
    texts = passages(own, doc).select("doc_id", "pos", "text")
    kept = written(trim(picked.join(texts, ["doc_id", "pos"]), "query_id", ("doc_id", "pos"), budget).select("query_id", "doc_id", "pos", "text"))
    return kept.join(gap_marks(kept), ["query_id", "doc_id", "pos"])


def terms(docs: DataFrame, scope: str, doc: str = "doc_id", text: str = "text", k: int = 8) -> DataFrame:
    """scope, doc, rank, word, score: the words that set a text apart within its scope.

    Raw tf * ln(1 + N / df), for words that are in at most max(2, 0.6 N) of the scope's texts; ties: later words first.
    Texts go in blocks.  A block sends each of its different words once, with the number of its texts that have it, and
    gets back how many have it in all; so what moves are the texts and the blocks' words, and no frequent word is a key
    of more than one row a block.
    """
    n = written(docs.groupBy(scope).agg(F.count("*").alias("n"), F.sum(F.octet_length(text).cast("long")).alias("bytes")))
    whole = docs.groupBy(scope, doc).agg(F.lower(F.array_join(F.collect_list(text), "\n")).alias("_t"))  # rows of one text, if there are several
    parts = n.select(scope, F.greatest(F.ceil(F.col("bytes") / TEXT), F.lit(1)).alias("_of"))
    block = F.xxhash64(scope, F.pmod(F.xxhash64(doc), F.col("_of")))  # of one scope, but for hashes that meet
    left = whole.join(parts, scope).select(block.alias("_b"), scope, doc, "_t")
    place = docs.select(F.lit(0).cast("long").alias("_b"), scope).schema
    found = written(left.groupBy("_b").applyInArrow(_words_of_block, place.add("word", "string").add("k", "long")))
    df = found.groupBy(scope, "word").agg(F.sum("k").alias("df")).join(n.select(scope, "n"), scope)
    df = df.filter(F.col("df") <= F.greatest(F.lit(2.0), 0.6 * F.col("n")))
    right = found.select("_b", scope, "word").join(df, [scope, "word"]).withColumn("idf", F.log(1 + F.col("n") / F.col("df")))
    kind = docs.select(scope, doc).schema.add("word", "string").add("tf", "long").add("idf", "double")
    best = left.groupBy("_b").cogroup(right.select("_b", scope, "word", "idf").groupBy("_b")).applyInArrow(lambda block, own: _best_of_block(block, own, k), kind)
    rows = best.withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    rank = F.row_number().over(Window.partitionBy(scope, doc).orderBy(F.desc("score"), F.desc("word")))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select(scope, doc, "rank", "word", "score")


#: Bytes of text in a block.
TEXT = 16 << 20


def _words_of_block(block):
    """_b, scope, word, k: how many texts of the block (_b, scope, doc, text) have the word."""
    import pyarrow as pa

    total: dict = {}
    for name, t in zip(block.column(1).to_pylist(), block.column(3).to_pylist(), strict=True):
        if name is not None:
            total.setdefault(name, Counter()).update(counted(t).keys())
    names, words, k = ([x for name, c in total.items() for x in part(name, c)] for part in (lambda name, c: [name] * len(c), lambda name, c: c.keys(), lambda name, c: c.values()))
    return pa.table([pa.array([block.column(0)[0].as_py()] * len(words), pa.int64()), pa.array(names, block.schema.field(1).type), pa.array(words, pa.string()), pa.array(k, pa.int64())], names=["_b", block.schema.names[1], "word", "k"])


def _best_of_block(block, own, k: int):
    """scope, doc, word, tf, idf of each text's k best words, and of all that rounding could put before one of them."""
    import pyarrow as pa

    idf: dict = {}
    for name, word, x in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True):
        idf.setdefault(name, {})[word] = x
    at, words, tf, weights = [], [], [], []
    for i, (name, t) in enumerate(zip(block.column(1).to_pylist(), block.column(3).to_pylist(), strict=True)):
        known = idf.get(name)
        if not known:
            continue
        every = [(n * known[w], w, n) for w, n in counted(t).items() if w in known]
        if not every:
            continue
        least, run = heapq.nlargest(k, (x for x, _, _ in every))[-1] - 2e-6, 0
        every = sorted((x for x in every if x[0] >= least), reverse=True)
        for j, (x, w, n) in enumerate(every):
            run = run + 1 if j and every[j - 1][0] == x else 1  # of equal ones the first k are enough
            if run <= k:
                at.append(i)
                words.append(w)
                tf.append(n)
                weights.append(known[w])
    rows, names = pa.array(at, pa.int64()), block.schema.names
    return pa.table([block.column(1).take(rows), block.column(2).take(rows), pa.array(words, pa.string()), pa.array(tf, pa.int64()), pa.array(weights, pa.float64())], names=[names[1], names[2], "word", "tf", "idf"])
