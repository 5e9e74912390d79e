"""The pipeline against a brute-force version of its stages."""

import math
import zlib
from collections import Counter
from statistics import quantiles

import corpus_pipeline
from foliant.llm import langid_ppm, packing

from .test_methods import brute_components


class Plain:
    """Context trees as nested counts, a byte at a time."""

    def __init__(self, rows):
        self.stats, self.langs = {}, sorted({lang for lang, _ in rows})
        for lang, t in rows:
            raw = b"\n\n\n" + t.encode().lower()
            for i in range(3, len(raw)):
                for n in range(4):
                    self.stats.setdefault((lang, raw[i - n : i]), Counter())[raw[i]] += 1
        self.sums = {k: (sum(c.values()), len(c)) for k, c in self.stats.items()}
        self.known = {}

    def bits(self, lang, context, byte):
        key = lang, context, byte
        if key not in self.known:
            seen, shorter = self.stats.get((lang, context)), (lambda: self.bits(lang, context[1:], byte) if context else 8)
            if seen is None:
                self.known[key] = shorter()
            else:
                n, d = self.sums[lang, context]
                self.known[key] = -math.log2(seen[byte] / (n + d)) if byte in seen else -math.log2(d / (n + d)) + shorter()
        return self.known[key]

    def best(self, text):
        """The language that codes a text best, and its bits."""
        raw = b"\n\n\n" + text.encode().lower()
        return min(((sum(self.bits(lang, raw[i - 3 : i], raw[i]) for i in range(3, len(raw))), lang) for lang in self.langs), key=lambda x: x[0])


def brute_accepted(spark, docs):
    """Identifiers of the documents that stay: by plain trees, and limits from the half of the sample that they are not of."""
    sample = [(r.lang, r.text, r.half) for r in langid_ppm.sampled(docs).collect()]
    trees, half = Plain([s[:2] for s in sample]), Plain([s[:2] for s in sample if s[2] == 0])
    rates = {}
    for _, t, h in sample:
        if h and any(c.isalpha() for c in t):
            bits, lang = half.best(t)
            rates.setdefault(lang, []).append(max(bits - langid_ppm.FEW_BITS, 0) / len(t.encode()))
    most = {k: min((quantiles(v, n=1000, method="inclusive")[998] if len(v) > 1 else v[0]) + langid_ppm.MARGIN, langid_ppm.PLAIN_BITS) for k, v in rates.items()}
    kept = set()
    for i, t in docs.select("doc_id", "text").collect():
        if t and any(c.isalpha() for c in t):
            bits, lang = trees.best(t)
            if bits <= langid_ppm.FEW_BITS + most.get(lang, langid_ppm.PLAIN_BITS) * len(t.encode()):
                kept.add(i)
    return kept


def test_texts_that_only_the_model_rejects(spark):
    """Letters they have, but no learned language: random ones, another script; clean and short texts stay."""
    import random

    r = random.Random(1)
    words = {"en": "the river rose again and all the farmers of the valley came to see it".split(), "de": "der fluss stieg wieder und alle bauern aus dem tal kamen um ihn zu sehen".split()}
    said = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(k, said(lang, 40), lang) for k in range(200) for lang in [("en", "de")[k % 2]]]
    odd = ["".join(r.choice("bcdfghjklmnpqrstvwxzBCDFGHJK0123456789+/") for _ in range(400)), "Мы сегодня пошли в школу и учили там язык. " * 8, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(60))]
    clean = [said("en", 30), said("de", 200), "the", "fluss", "a", said("en", 20) + " qzx"]
    docs = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(odd)] + [(2000 + k, t, None) for k, t in enumerate(clean)] + [(3000, "123", None)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in langid_ppm.accepted(docs).collect()}
    assert kept == {k for k in range(200)} | {2000 + k for k in range(len(clean))}
    assert kept == brute_accepted(spark, docs)


def test_a_language_without_measured_texts(spark):
    docs = spark.createDataFrame([(1, "one text and no more", "en"), (2, "ж" * 500, None), (3, "one text", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid_ppm.accepted(docs).collect()} == {1, 3}


def test_stages(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    stay = brute_accepted(spark, table)
    held = {i: t for i, t in docs.items() if i in stay}
    keep = {}
    for i, t in held.items():
        low = t.encode().lower()
        keep[low] = max(keep.get(low, i), i)
    held = {i: held[i] for i in keep.values()}
    near = brute_components(sorted(held.items()))
    held = {i: t for i, t in held.items() if near[i][1] == i}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(held)
    sizes = Counter()
    for t in held.values():
        n = len(t.encode()) + 1
        sizes.update([16384] * (n // 16384) + ([n % 16384] if n % 16384 else []))
    bins = {r.bin_id: r.bin_capacity for r in rows}
    assert sum(map(packing.sequence_cost, bins.values())) == packing.best_packing(sizes).cost


def test_columns_go_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_all_labelled_texts_count(spark):
    trains = [k for k in range(9000) if zlib.crc32(str(k).encode()) % 4 != 2]
    rare = trains[-1]
    rows = [(k, "zyx quvw jklm" if k == rare else f"the same words again {k}", "en") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid_ppm.sampled(docs).count() == len(trains)
    codes, counts = langid_ppm.train(docs).counts["en"]
    assert counts.sum() == sum(len(rows[k][1]) for k in trains) and set(langid_ppm._codes(["zyx quvw jklm"])) <= set(codes)
