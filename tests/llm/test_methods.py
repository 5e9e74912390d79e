"""Operators against libraries, brute force, round trips and held-out rows."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import bpe_transducer, chat_format, components, fast_sketch, hpylm, langid_ppm, merkle_warc, minhash_fss, packing, queries, spotsigs, token_counts

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENCODER, DECODER = bpe_transducer.made(open(BYTE).read())
COUNTER = token_counts.made(open(WORD).read())
BYTE_LIB, WORD_LIB = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
TEXTS = st.text(st.sampled_from("ab th e'srdl  \n\t\x0b\x1c\x85\xa0 é漢字🙂́İΣσς1２Ⅷ_-<|>!?ſẞ"), max_size=60) | st.text(max_size=30)


def ids(raw):
    return memoryview(raw).cast("I").tolist() if raw else []


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_equals_the_library(text):
    want = BYTE_LIB.encode(text, add_special_tokens=False).ids
    assert ids(ENCODER.encode(text)) == want
    assert DECODER.decode(bpe_transducer.pack(want)) == BYTE_LIB.decode(want, skip_special_tokens=False)
    assert COUNTER.count(text) == len(WORD_LIB.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 4000 + "x", "-" * 3000, "=-" * 2000, "the" * 3000, "ab" * 150_000, "<|endoftext|>x <|startoftext|> y", "don't'S we'll 're"])
def test_long_pieces_and_special_strings(text):
    assert ids(ENCODER.encode(text)) == BYTE_LIB.encode(text, add_special_tokens=False).ids
    assert COUNTER.count(text) == len(WORD_LIB.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("middle", ["'re go on", "'ll x", "'ve", " 're", "  're", "\n\n y", "   y", "e\u0301 'd", "!'s", "''ll", "a'b", "1's", "\u3000\u3000x"])
def test_what_stands_on_the_seam_of_segments(middle, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "SEGMENT", 64)
    for before in ("x y ", "word", "'", " ", "\u00e9t\u00e9 "):
        for at in range(-8, 9 + len(middle)):
            text = (before * 64)[: 64 - len(middle) + at] + middle + " tail of the text's own" * 9
            assert [p for part in ENCODER.pieces(text) for p in part] == (ENCODER.ascii if text.isascii() else ENCODER.split).findall(text)
    monkeypatch.undo()
    long = "x y " * 65_535 + "z " + "'re go on"  # 262,142 code points before the contraction
    assert ids(ENCODER.encode(long)) == BYTE_LIB.encode(long, add_special_tokens=False).ids


def test_the_stream_holds_no_more_than_its_window():
    assert ENCODER.table.lookahead < 1000
    text = ("thequick" * 4000).encode()
    fed = []

    def chunks():
        for k in range(0, len(text), 100):
            fed.append(k)
            yield text[k : k + 100]

    seen = 0
    for i in ENCODER.stream(chunks()):
        seen += len(ENCODER.table.spelled[i])
        assert fed[-1] + 100 - seen <= ENCODER.window + bpe_transducer.BLOCK
    assert seen == len(text)


def test_decoding_replaces_broken_bytes():
    raw = [ENCODER.table.first[b] for b in b"a\xff\xe6\xbc\xf0\x9f\x99b"]
    assert DECODER.decode(bpe_transducer.pack(raw)) == BYTE_LIB.decode(raw, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["don't we'll 're!!'s aé漢 word", "  lead and trail  ", "x" * 100 + " y"])
def test_counts_at_every_prefix(text):
    text = token_counts.normalise(text)
    table = COUNTER.table_of(text)
    for n in range(len(text) + 1):
        assert table.count_at(n) == len(WORD_LIB.encode(text[:n], add_special_tokens=False).ids)
    for budget in range(table.total + 2):
        assert table.count_at(table.fit(budget)) <= budget
    assert table.count_at(table.fit(table.total)) == table.total


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    both, x, y = (np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (600, 100, 100))
    a, b = fast_sketch.sketches([np.union1d(both, x), np.union1d(both, y)], 512)
    assert abs((a == b).mean() - 600 / 800) < 0.08
    for n in (1, 2, 7):
        s = fast_sketch.sketches([x[:n]], 256)
        assert (s != fast_sketch.EMPTY).all()


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())
    where, up = {}, {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for g in s for j in where.get(g, ()))
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            where.setdefault(g, []).append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.queries()["op9_minhash_near_dedup"](spark, sf).collect()}
    assert got == brute_components([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_near_duplicates_in_a_drifting_group(spark):
    """Copies that differ more and more: pivots alone do not join them."""
    r = np.random.default_rng(4)
    words, rows = [f"w{k}" for k in range(120)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        at = int(r.integers(0, 119))
        words = [*words[:at], f"n{i}a", *words[at + 1 :]]
    got = {x.doc_id: x.component_id for x in minhash_fss.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def test_a_bucket_of_many_that_resemble_nothing():
    """Members of a mixed bucket without a likely partner are not fetched again; the few that have one are."""
    r = np.random.default_rng(5)
    sketch = r.integers(0, 256, (3000, minhash_fss.SIZE)).astype(np.uint8)
    sketch[:, :100] = sketch[0, :100]  # a shared passage: 39 % of the coordinates
    sketch[2001] = sketch[2000]
    rows = [(k % 2, k, k, s.tobytes()) for k, s in enumerate(sketch)]
    assert minhash_fss.alike(rows) == [2000, 2001]
    assert minhash_fss.alike([(0, k, 7, s.tobytes()) for k, s in enumerate(sketch[:50])]) == []


def test_many_unlinked_documents_of_one_passage(spark):
    """Documents that share over half of their words in one passage: one bucket or more, and no link but the planted one."""
    import random

    rng = random.Random(2)
    passage = " ".join(f"common{k}" for k in range(60))
    texts = [passage + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(45)) for _ in range(3000)]
    texts.append(texts[10] + " more words")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = minhash_fss.near_duplicates(docs).filter("not kept").collect()
    assert [(x.doc_id, x.component_id) for x in got] == [(3000, 10)]


def test_meeting_finds_what_codes_allow():
    sets = [np.unique(np.random.default_rng(k // 2).integers(0, 1 << 63, 50).astype(np.uint64)) for k in range(6)]
    rows = [(0, k, k, minhash_fss.codes(s)) for k, s in enumerate(sets)]
    assert minhash_fss.meeting(rows, 75, True) == {(1, 0), (3, 2), (5, 4)}


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (101, 102), (200, 100)] + [(500, 500)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100, 200: 100}


def plain_packing(lengths, capacities, opening):
    """Best fit on single items, longest first."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= n]
        best = min(fits, key=lambda b: b[0] - b[1], default=None)
        if best is None:
            bins.append(best := [max(opening, min(c for c in capacities if c >= n)), 0])
        best[1] += n
    return sum(packing.sequence_cost(min(c for c in capacities if c >= b[1])) for b in bins), len(bins)


def test_packing_equals_best_fit_on_items():
    r = np.random.default_rng(3)
    for _ in range(20):
        lengths = r.integers(1, 400, r.integers(1, 200)).tolist()
        for opening in (100, 200, 400):
            p = packing.Packing(Counter(lengths), (100, 200, 400), opening)
            cost, bins = plain_packing(lengths, (100, 200, 400), opening)
            assert sum(b[1] for b in p.bins) == bins and math.isclose(p.cost, cost)
        assert packing.best_packing(Counter(lengths), (100, 200, 400)).cost == min(packing.Packing(Counter(lengths), (100, 200, 400), c).cost for c in (100, 200, 400))


def test_packing_is_near_the_least_cost():
    """Against all partitions of six items: never under the least cost, hardly ever above it."""
    r, caps, above, total = random.Random(1), packing.CAPACITIES, 0, [0.0, 0.0]
    for _ in range(60):
        items = [r.choice((r.randrange(1, 2000), r.randrange(1, 9000), r.randrange(1, 16385))) for _ in range(6)]
        sums = [sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(64)]
        costs = [packing.sequence_cost(next(c for c in caps if c >= s)) if s <= caps[-1] else math.inf for s in sums]
        least = [0.0] + [math.inf] * 63
        for m in range(1, 64):
            sub = m
            while sub:
                least[m] = min(least[m], least[m ^ sub] + costs[sub])
                sub = (sub - 1) & m
        got = packing.best_packing(Counter(items)).cost
        assert least[-1] <= got + 1e-6
        above += got > least[-1] + 1e-6
        total = [total[0] + got, total[1] + least[-1]]
    assert above <= 3 and total[0] <= 1.003 * total[1]


def test_packed_documents(spark, sf):
    rows = queries.queries()["op6_best_fit_packing"](spark, sf).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        at = 0
        for m in sorted(members, key=lambda m: m.bin_start):
            assert m.bin_start == at
            at += m.length
        assert at == members[0].bin_used <= members[0].bin_capacity
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        n = len((r.text or "").encode()) + bool(r.text)
        want.update([16384] * (n // 16384) + ([n % 16384] if n % 16384 else []))
    assert Counter(r.length for r in rows if r.length) == want
    assert sum(packing.sequence_cost(m[0].bin_capacity) for m in bins.values() if m[0].bin_capacity) == packing.best_packing(want).cost


def test_language_of_held_out_rows(spark, sf):
    got = queries.queries()["op10_language_ppm"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97


def test_code_lengths_equal_a_plain_model():
    texts = {"a": ["abab abba", "bab"], "b": ["cdcd dc", "abcd"]}
    trees = langid_ppm.Trees({k: np.unique(langid_ppm._codes(v), return_counts=True) for k, v in texts.items()})
    stats = {}
    for lang, own in texts.items():
        for t in own:
            raw = langid_ppm.START + t.encode()
            for i in range(3, len(raw)):
                for n in range(4):
                    stats.setdefault((lang, raw[i - n : i]), Counter())[raw[i]] += 1

    def bits(lang, context, byte):
        seen = stats.get((lang, context))
        if seen is None:
            return bits(lang, context[1:], byte) if context else 8
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / (n + d))
        return -math.log2(d / (n + d)) + (bits(lang, context[1:], byte) if context else 8)

    probes = [b"abba", b"cd ab", b"xyz", b"", b"a", b"dcdcab x"]
    got = trees.lengths(probes)
    for row, t in zip(got, probes, strict=True):
        raw = langid_ppm.START + t
        for k, lang in enumerate(trees.langs):
            assert math.isclose(row[k], sum(bits(lang, raw[i - 3 : i], raw[i]) for i in range(3, len(raw))), abs_tol=1e-3)


def test_language_model_counts_and_gain(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = {i: [*(t or "").encode().lower().split(), 0] for i, t in docs}
    learn = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(learn.values()), len(learn)
    scores = queries.queries()["op3_hpylm"](spark, sf).cache()
    for r in scores.collect():
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in learn for w in ws), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((learn[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    rows = scores.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
    assert 1 < hpylm.perplexity(scores, held_out=False) < hpylm.perplexity(scores)


def test_signatures_cover_texts_without_common_words(spark):
    texts = ["reouti anatha.", "reouti anatha. 19.37.233.111", " ".join(f"w{k}" for k in range(50)), "a " + " ".join(f"w{k}" for k in range(50))]
    signs = [set(r.s) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spotsigs.signatures(F.col("t")).alias("s")).collect()]
    assert [len(s) for s in signs] == [1, 5, 49, 49]
    assert signs[0] < signs[1] and signs[2] == signs[3]


def test_signatures_by_hand(spark):
    text = "The quick fox is a brown animal that jumps over the lazy dog"
    signs = spark.createDataFrame([(text,), (text.upper(),), ("fox",), ("the of",), ("",)], "t string").select(spotsigs.signatures(F.col("t")).alias("s")).collect()
    words, chains = ["", *text.lower().split()], set()
    for k, w in enumerate(words):
        if w == "" or w in spotsigs.ANCHORS:
            rest = [x for x in words[k + 1 :] if x not in spotsigs.ANCHORS]
            if len(rest) >= spotsigs.CHAIN:
                chains.add(" ".join(rest[: spotsigs.CHAIN]))
    assert len(signs[0].s) == len(chains) and signs[0].s == signs[1].s
    assert len(signs[2].s) == len(signs[3].s) == 1 and signs[4].s == []


def test_fingerprints_of_documents(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.queries()["op4_spotsigs"](spark, sf).collect()}
    prints = {}
    for k, (i, text) in enumerate(docs):
        half, after = len(text) // 2, docs[(k + 1) % len(docs)]
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[1][:half]).encode()).hexdigest()
        prints.setdefault(text, set()).add(got[i].fingerprint)
        sets = [{x[j : j + 12] for j in range(0, len(x), 12)} for x in (got[i].fingerprint, got[i].edited_fingerprint, got[after[0]].fingerprint)]
        for near, other in ((got[i].near_edited, sets[1]), (got[i].near_next, sets[2])):
            assert math.isclose(near, len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)
    assert all(len(p) == 1 for p in prints.values())


def test_near_pairs_lose_nothing(spark, sf):
    sets = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("signs")).cache()
    member, pairs = spotsigs.near_pairs(sets, 0.5)
    own = {r.doc_id: frozenset(r.signs) for r in sets.collect()}
    classes = {}
    for i in sorted(own):
        classes.setdefault(own[i], i)
    assert {r.doc_id: r.class_id for r in member.collect()} == {i: classes[s] for i, s in own.items()}
    full = [(i, s) for s, i in classes.items() if s]
    want = {(max(i, j), min(i, j)) for k, (i, s) in enumerate(full) for j, t in full[:k] if len(s & t) >= 0.5 * len(s | t)}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_layouts(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "x", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"other": 1},
    ]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "conv_id long, record string")
    got = {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in chat_format.canonical_json(rows).collect()}
    assert got == {0: [("user", "p"), ("assistant", "c")], 1: [("user", "i"), ("assistant", "o")], 2: [("user", "i\n\nx"), ("assistant", "o")], 3: [("user", "u"), ("assistant", "a")], 4: [("user", "h"), ("assistant", "g")], 5: None}
    typed = spark.createDataFrame([(1, [("gpt", "x"), ("human", None)])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(t) for t in chat_format.canonical(typed).first().turns] == [("assistant", "x"), ("user", "")]
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.canonical(spark.createDataFrame([(1, 2)], "conv_id long, odd long"))


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>", "<|im_start|>user<|im_sep|>x<|im_end|>", "a\n\\n", "", None, "<", "|im_end|>", "\\<|", "[INST]\\[/INST]<s>", "é漢🙂"]


def test_formatting_is_reversible(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(HOSTILE)] + [(2, 1, None, None), (2, None, "user", "first"), (3, 0, "od<|im_sep|>d", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.render(chat_format.canonical(df, fields=["turn", "role", "text"])).cache()
    formatted = {r.conv_id: r for r in out.collect()}
    back = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    assert [t.text for t in back[1].turns] == [t or "" for t in HOSTILE]
    assert [(t.role, t.text) for t in back[2].turns] == [("user", "first"), ("", "")]
    assert [(t.role, t.text) for t in back[3].turns] == [("od<|im_sep|>d", "x")]
    assert back[1].loss_text == "".join(t or "" for t in HOSTILE[1::2])
    assert formatted[1].formatted.count("<|im_end|>") == len(HOSTILE) and "[INST]" not in formatted[1].formatted
    masked = "".join(formatted[1].formatted[s["first"] : s["first"] + s["length"]] for s in formatted[1].loss_spans)
    import re

    assert re.sub(r"(?s)\\(.)", r"\1", masked) == back[1].loss_text


def test_audit_finds_the_damage(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {(r.kind, r.page_id, r.url) for r in queries.queries()["op2_warc_fixity"](spark, sf).collect()}
    fate = {i: zlib.crc32(str(i).encode()) % 97 for i, _, _ in pages}
    kinds = {0: "changed", 1: "missing", 2: "extra"}
    assert got == {(kinds[fate[i]], i, u + "#copy" * (fate[i] == 2)) for i, u, _ in pages if fate[i] in kinds}


def test_audit_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle_warc, "RECORDS", 8)
    monkeypatch.setattr(merkle_warc, "BITS", 1)
    page = lambda k: (k, f"u{k}", f"body {k}", "x", 1, 2)
    schema = "page_id long, url string, html string, digest string, place int, node int"  # names of the operator's own
    odd = [(None, None, None, None, None, None), page(7)]
    first = spark.createDataFrame([page(k) for k in range(100)] + odd, schema)
    rot = lambda k: (*page(k)[:2], "rot", *page(k)[3:])
    second = spark.createDataFrame([rot(k) if k in (13, 77) else page(k) for k in (*range(50), *range(51, 100), *range(200, 230))] + odd, schema)
    a, b = merkle_warc.leaves(first), merkle_warc.leaves(second)
    assert merkle_warc.depths(131) == (5, 6)
    rows = merkle_warc.audit(a, b).collect()
    assert {(r.kind, r.page_id) for r in rows} == {("changed", 13), ("changed", 77), ("missing", 50), *(("extra", k) for k in range(200, 230))} and len(rows) == 33
    # places are those of the replica's own order
    own = sorted((bytes(r.digest), r.page_id, r.length) for r in a.collect())
    for r in rows:
        if r.kind != "extra":
            file = [x for x in own if x[0][0] >> 3 == r.file]
            assert file[r.pos][1] == r.page_id and r.offset == sum(x[2] for x in file[: r.pos]) and r.expected == file[r.pos][0].hex()
    assert {(r.kind, r.page_id) for r in merkle_warc.audit(b, a).collect()} == {("changed", 13), ("changed", 77), ("extra", 50), *(("missing", k) for k in range(200, 230))}
    assert merkle_warc.audit(a, a).count() == 0
    assert merkle_warc.audit(a.limit(0), a.limit(0)).count() == 0
    assert {r.kind for r in merkle_warc.audit(a, a.limit(0)).collect()} == {"missing"} and merkle_warc.audit(a.limit(0), a).count() == 101


def test_the_audit_reads_only_below_nodes_that_differ(spark):
    page = lambda k: (k, f"u{k}", f"body {k}")
    first = merkle_warc.leaves(spark.createDataFrame([page(k) for k in range(600)], "page_id long, url string, html string"))
    second = merkle_warc.leaves(spark.createDataFrame([page(k) if k != 9 else (9, "u9", "rot") for k in range(600)], "page_id long, url string, html string"))
    ours, theirs = merkle_warc.tree(first, 2), merkle_warc.tree(second, 2)
    assert [x.count() for x in ours][:2] == [1, 16]
    assert merkle_warc.descend(ours, theirs).count() == 2  # where the old record was, and where the new one is
    assert merkle_warc.descend(ours, ours) is None


def test_records_with_one_identifier(spark):
    rows = [(1, "u", f"body {k}") for k in range(40)] + [(1, "u", "body 0")] * 3
    first = merkle_warc.leaves(spark.createDataFrame(rows, "page_id long, url string, html string"))
    second = merkle_warc.leaves(spark.createDataFrame(rows[1:], "page_id long, url string, html string"))
    got = merkle_warc.audit(first, second).collect()
    assert [(r.kind, r.page_id) for r in got] == [("changed", 1)]  # a copy less of the record that repeats
