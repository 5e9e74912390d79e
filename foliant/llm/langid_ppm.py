"""Language identification by partial matching.

Each language has a context tree over bytes (contexts of 0 to 3 bytes, A-Z lowered) with frozen counts.  A byte's code
length is that of method C without exclusion: in the longest context that the tree has, -log2(n / (N + D)) for a byte
seen n times there (N bytes, D distinct), else the escape -log2(D / (N + D)) and the next shorter context; after the
empty context, 8 bits.  Contexts that a tree does not have cost nothing.  The language with the least code length of
the whole text wins; the score is its share of 2^-length among all languages.

The counts come from all labelled texts outside the fold: tasks count windows of four bytes, Spark adds them up.  The
trees are as large as the different windows are many (106,106 over 0.1 GB of documents, 54,894 over a fifth of it).  The scoring reads
every text whole and works on arrays of node numbers, so its memory is that of one small batch plus the trees.

Edge cases: null text or one without a letter: `und`, score 0; without any labelled row all texts are `und`; rows with
null lang are only scored; a null doc_id trains nothing and is not held out; ties go to the first language in
alphabetical order; repeated rows and further columns change nothing.  As a filter (`accepted`) each language has a limit
from the code lengths of its own training texts; a language of which none was measured has that of plain bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

ORDER = 3
START = b"\n" * ORDER
LETTER = regex.compile(r"\p{L}")


def held_out(key: str, folds: int, fold: int):
    """Whether crc32 of the identifier as text falls into the fold; false for null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _codes(texts: list[str]) -> np.ndarray:
    """The 4-byte windows that end at each byte of each text, as numbers."""
    x = np.frombuffer(b"".join(START + t.encode().lower() for t in texts), np.uint8).astype(np.uint32)
    if len(x) <= ORDER:
        return np.zeros(0, np.uint32)
    codes = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
    keep = np.ones(len(x), bool)
    at = np.cumsum([0] + [len(t.encode()) + ORDER for t in texts[:-1]])
    for k in range(ORDER):
        keep[at + k] = False
    return codes[keep[ORDER:]]


def grams(rows: DataFrame) -> list[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """lang → its 4-byte windows and their counts, for the two halves of `rows` (lang, text, half)."""

    def run(batches):
        got: dict[tuple, tuple] = {}
        for b in batches:
            keys, texts = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), b.column(2).to_pylist()
            for key in set(keys):
                codes, counts = np.unique(_codes([t for own, t in zip(keys, texts, strict=True) if own == key]), return_counts=True)
                if key in got:
                    old_codes, old = got[key]
                    codes, at = np.unique(np.concatenate([old_codes, codes]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([old, counts])).astype(np.int64)
                got[key] = codes, counts
        for (lang, half), (codes, counts) in got.items():
            # a language without a single byte is one all the same
            codes, counts = (codes.astype(np.int64), counts.astype(np.int64)) if len(codes) else (np.array([-1]), np.array([0]))
            n = len(codes)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, half, np.int32)), pa.array(codes), pa.array(counts)], names=["lang", "half", "code", "n"])

    counted = rows.select("lang", "half", "text").mapInArrow(run, "lang string, half int, code long, n long").groupBy("lang", "half", "code").agg(F.sum("n").alias("n")).toArrow()
    out: list[dict] = [{}, {}]
    names, halves, codes, counts = (counted.column(k).to_numpy() for k in ("lang", "half", "code", "n"))
    for lang in sorted(set(names)):
        for half in (0, 1):
            at = np.flatnonzero((names == lang) & (halves == half))
            if len(at):
                at = at[codes[at] >= 0]
                at = at[np.argsort(codes[at])]
                out[half][lang] = codes[at].astype(np.uint32), counts[at].astype(np.int64)
    return out


def added(halves: list[dict]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The counts of both halves together."""
    out = {}
    for lang in sorted({*halves[0], *halves[1]}):
        parts = [h[lang] for h in halves if lang in h]
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        out[lang] = codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
    return out


class Trees:
    """The context trees of all languages over one numbering of nodes, with code lengths worked out per node."""

    def __init__(self, by_lang: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.counts = sorted(by_lang), by_lang
        count = {4: self._sum({k: by_lang[k] for k in self.langs}, 0)}
        for n in (3, 2, 1):
            # the windows hold the padding before a text as well, so dropping the oldest byte gives all shorter ones
            count[n] = self._sum({k: by_lang[k] for k in self.langs}, 4 - n)
        size = len(self.langs)
        # the context at the start of every text ends no window of its own, but is one
        start = np.uint32(int.from_bytes(START, "big"))
        if start not in count[3][0]:
            at = np.searchsorted(count[3][0], start)
            count[3] = np.insert(count[3][0], at, start), np.insert(count[3][1], at, 0, axis=0)
        total = np.array([c.sum() for _, c in (by_lang[k] for k in self.langs)], float)
        n1 = np.zeros((256, size))
        n1[count[1][0]] = count[1][1]
        d0 = (n1 > 0).sum(0)
        with np.errstate(divide="ignore"):
            cost = np.where(n1 > 0, -np.log2(np.maximum(n1, 1) / (total + d0)), -np.log2(d0 / (total + d0)) + 8)  # by byte
        # the order-1 costs of all pairs
        self.step, self.escape, costs = {}, {}, {1: cost}
        ids = {1: np.arange(256, dtype=np.uint32)}  # codes that have a node, by length
        for n in (2, 3, 4):
            codes, counts = count[n]
            context = codes >> 8
            contexts = ids[n - 1]
            at = np.searchsorted(contexts, context)
            known = (at < len(contexts)) & (contexts[np.minimum(at, len(contexts) - 1)] == context)
            assert known.all(), "every context ends a window"
            sums, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(sums, at, counts)
            np.add.at(kinds, at, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(sums > 0, -np.log2(kinds / (sums + kinds)), 0.0)
                own = -np.log2(np.maximum(counts, 1) / (sums[at] + kinds[at]))
            self.escape[n - 1] = np.vstack([np.zeros((1, size)), escape]).astype(np.float32)
            shorter = codes & np.uint32((1 << 8 * (n - 1)) - 1)
            lower = costs[n - 1][np.searchsorted(ids[n - 1], shorter)]
            costs[n] = np.where(counts > 0, own, escape[at] + lower)
            if n == 2:  # all pairs, seen or not
                full = (escape[:, None, :] + cost[None, :, :]).reshape(65536, size)
                full[codes] = costs[2]
                ids[2], costs[2] = np.arange(65536, dtype=np.uint32), full
                self.pair = full.astype(np.float32)
            else:
                step = np.zeros((len(contexts) + 1, 256), np.int32)
                step[at + 1, codes & 255] = np.arange(1, len(codes) + 1)
                self.step[n] = step.ravel()
                ids[n] = codes
        self.cost = {n: np.vstack([np.zeros((1, size)), costs[n]]).astype(np.float32) for n in (3, 4)}

    @staticmethod
    def _sum(by_lang, drop: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint32((1 << 8 * (4 - drop)) - 1)
        codes = np.unique(np.concatenate([c & mask for c, _ in by_lang.values()]))
        out = np.zeros((len(codes), len(by_lang)))
        for k, (c, n) in enumerate(by_lang.values()):
            np.add.at(out[:, k], np.searchsorted(codes, c & mask), n)
        return codes, out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: a row for each text, a column for each language."""
        sizes = np.array([len(t) for t in texts])
        x = np.frombuffer(START + START.join(texts), np.uint8).astype(np.int32)
        out = np.zeros((len(texts), len(self.langs)))
        if not sizes.sum():
            return out
        pair = x[:-1] * 256 + x[1:]  # at j: the pair that ends at byte j + 1
        three = self.step[3][(pair[:-1] + 1) * 256 + x[2:]]
        four = self.step[4][three[:-1] * 256 + x[3:]]
        starts = np.cumsum(np.concatenate([[0], sizes[:-1] + ORDER]))
        real = np.ones(len(four) + ORDER, bool)
        for k in range(ORDER):
            real[starts + k] = False
        at = np.flatnonzero(real[ORDER:])  # windows that end within a text
        bits = self.cost[4][four[at]]
        odd = np.flatnonzero(four[at] == 0)
        if len(odd):
            j = at[odd]
            rest = self.escape[3][three[j]] + self.cost[3][three[j + 1]]
            low = np.flatnonzero(three[j + 1] == 0)
            rest[low] += self.escape[2][pair[j[low] + 1] + 1] + self.pair[pair[j[low] + 2]]
            bits[odd] += rest
        full = np.flatnonzero(sizes)
        first = np.cumsum(np.concatenate([[0], sizes[full][:-1]]))
        out[full] = np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out


def sampled(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """lang, text, half (0 or 1, by hash): all labelled rows outside the fold."""
    small_batches(df.sparkSession)
    labelled = df.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull() & ~held_out(key, folds, fold))
    share = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    return labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), (share >= 0.5).cast("int").alias("half"))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2) -> Trees | None:
    """Trees from all labelled rows outside the fold; None where nothing is labelled."""
    found = added(grams(sampled(df, key, text, lang, folds, fold)))
    return Trees(found) if found else None


def judged(trees: Trees, texts: list) -> tuple[np.ndarray, ...]:
    """lang_pred, score, bits and n_bytes of each text."""
    raw = [(t or "").encode().lower() for t in texts]
    bits = trees.lengths(raw)
    best = bits.argmin(1)
    least = bits[np.arange(len(best)), best]
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    none = np.array([t is None or LETTER.search(t) is None for t in texts], bool)
    best[none], score[none] = len(trees.langs), 0.0
    return np.array([*trees.langs, "und"], object)[best], score, least, np.array([len(r) for r in raw], np.int64)


def predict(df: DataFrame, trees: Trees | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, bits (code length of the whole text under lang_pred), n_bytes."""
    spark = df.sparkSession
    small_batches(spark)
    kind = dict(df.dtypes)[key]
    if trees is None or not trees.langs:
        return df.select(key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    shared, name = spark.sparkContext.broadcast(trees.counts), uuid.uuid4().hex  # bounded by the different windows

    def run(batches):
        for b in batches:
            names, score, bits, sizes = judged(_built(name, shared.value), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(bits), pa.array(sizes, pa.int64())], names=[key, "lang_pred", "score", "bits", "n_bytes"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, lang_pred string, score double, bits double, n_bytes long")


#: The share of the training fold's texts that a language's limit is above, in bits a byte of their code lengths; what a
#: text may take beside that in all, and for each byte; and the limit where no text of a language was measured.
QUANTILE, FEW_BITS, MARGIN, PLAIN_BITS = 0.999, 64.0, 1.0, 8.0
#: Rates are counted in steps of so many to a bit, so that their quantile needs no more than their histogram.
STEPS = 1 << 12


_held: dict[str, Trees] = {}


def _built(name: str, found: dict) -> Trees:
    """The trees of these counts, built once in a worker: counts are a tenth of the trees that follow from them."""
    if name not in _held:
        _held.clear()
        _held[name] = Trees(found)
    return _held[name]


def limits(rows: DataFrame, found: dict) -> dict[str, float]:
    """Bits a byte above which a text is none of a language, measured on all labelled texts that the trees were not grown
    from: trees of one half of `rows` (`found`, its counts) code the other half.  Few texts are as long as the limit; a
    margin is added."""
    if not found:
        return {}
    name = uuid.uuid4().hex

    def run(batches):
        for b in batches:
            names, _, bits, sizes = judged(_built(name, found), b.column(0).to_pylist())
            some = (sizes > 0) & (names != "und")
            rates = np.minimum(np.maximum(bits[some] - FEW_BITS, 0) / sizes[some], PLAIN_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.string()), pa.array(np.rint(rates * STEPS).astype(np.int64))], names=["lang", "rate"])

    rates = rows.filter("half = 1").select("text").mapInArrow(run, "lang string, rate long").groupBy("lang", "rate").agg(F.count("*").alias("n"))
    at = rates.groupBy("lang").agg(F.percentile("rate", QUANTILE, F.col("n")).alias("rate"))
    return {r.lang: min(r.rate / STEPS + MARGIN, PLAIN_BITS) for r in at.collect()}  # one row a language


def accepted(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `df` whose text is in some language: it has a letter, and the language that codes it best codes it within
    the limit that its own training texts set.

    Each row is judged by its own text and goes through whole, without a join.  Without labelled rows nothing can be
    judged and all rows with a letter stay.
    """
    rows = sampled(df, key, text, lang)
    halves = grams(rows)
    found = added(halves)
    if not found:
        return df.filter(F.col(text).rlike(r"\p{L}"))
    most, at, name = limits(rows, halves[0]), df.columns.index(text), uuid.uuid4().hex

    def run(batches):
        for b in batches:
            names, _, bits, sizes = judged(_built(name, found), b.column(at).to_pylist())
            rates = np.array([most.get(n, PLAIN_BITS) for n in names])
            yield b.filter(pa.array((names != "und") & (bits <= FEW_BITS + rates * sizes)))

    return df.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: rows with crc32(doc_id) mod 4 = 2 are held out."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
