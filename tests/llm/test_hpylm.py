"""The language model against a plain Chinese restaurant process, exact posteriors and its own invariants."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import hpylm

NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def batch_of(texts, held):
    tokens = [hpylm.tokens(t) for t in texts]
    words, at = np.unique(np.concatenate(tokens), return_inverse=True)
    ids = np.arange(len(tokens)).astype(np.uint64)
    return hpylm.Batch(hpylm.pack(*hpylm.ranked(words, at), np.array([len(t) for t in tokens]), np.array(held, np.uint8), np.ones(len(tokens), np.uint8), ids))


class Restaurants:
    """Customers one by one at explicit tables, in restaurants by context, each new table a customer of the parent."""

    def __init__(self, types, seed):
        self.rooms, self.types, self.random = defaultdict(lambda: defaultdict(list)), types, random.Random(seed)

    def chance(self, context, word):
        if context is None:
            return 1 / (self.types + 1)
        d, theta, room = hpylm.D[2 - len(context)], hpylm.THETA[2 - len(context)], self.rooms[context]
        own = room.get(word, [])
        rest = (theta + d * sum(map(len, room.values()))) * self.chance(context[1:] if context else None, word)
        return (sum(own) - d * len(own) + rest) / (theta + sum(map(sum, room.values())))

    def seat(self, context, word):
        if context is None:
            return
        d, theta, room = hpylm.D[2 - len(context)], hpylm.THETA[2 - len(context)], self.rooms[context]
        own, above = room[word], context[1:] if context else None
        x = self.random.random() * (sum(own) - d * len(own) + (theta + d * sum(map(len, room.values()))) * self.chance(above, word))
        for k, n in enumerate(own):
            x -= n - d
            if x < 0:
                own[k] += 1
                return
        own.append(1)
        self.seat(above, word)

    def lift(self, context, word):
        if context is None:
            return
        own = self.rooms[context][word]
        k = self.random.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            if not own:
                del self.rooms[context][word]
            self.lift(context[1:] if context else None, word)


def sampled_one_by_one(docs, types, asked, sweeps, burn):
    plain, seats, out = Restaurants(types, 1), [], np.zeros(len(asked))
    for words in docs:
        for k, w in enumerate(words):
            context = () if k == 0 else (words[k - 2] if k > 1 else "START", words[k - 1])
            seats.append((context, w))
            plain.seat(context, w)
    for k in range(sweeps):
        for context, w in seats:
            plain.lift(context, w)
            plain.seat(context, w)
        if k >= burn:
            out += [plain.chance(c, w) for c, w in asked]
    return out / (sweeps - burn)


def shards_of(batch, hot, n):
    """The words' places are their identifiers less one."""
    batch.triples(np.arange(1, len(batch.words) + 1), hot, n)
    return [hpylm.Shard([blob], s) for s, blob in batch.dealt()]


def root_of(batch, shards, types, seed):
    root = hpylm.Root([hpylm.pack(batch.words, *batch.word_counts())])
    own = root.asked[0]  # the place of each word of the batch
    sent = [(own[np.maximum(s.words - 1, 0)], np.where(s.words > 0, s.tables_of_words(), 0)) for s in shards]
    raw = root.seat(np.random.default_rng(seed), sent, types)
    totals = {"types": types, "customers": int(root.customers.sum()), "tables": int(root.tables.sum())}
    return [hpylm.given(np.where(s.words > 0, raw[place], 0.0), totals) for s, (place, _) in zip(shards, sent, strict=True)]


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [" ".join(r.choices(vocabulary, [2 ** -(k / 2) for k in range(12)], k=r.randint(1, 9))) for _ in range(50)]
    texts += ["w0 w1 w2 w3 w4"] * 20 + ["q w0 z w5 w6 w7"] * 60
    return texts, [k % 5 == 1 for k in range(len(texts))]


def test_probabilities_are_those_of_customers_seated_one_by_one():
    texts, held = corpus()
    docs = [[*t.split(), "END"] for t, h in zip(texts, held, strict=True) if not h]
    types = len({w for d in docs for w in d})
    batch = batch_of(texts, held)
    shards = shards_of(batch, NONE, 3)  # as on a cluster: the root between them
    roots, kept = [s.own_root() for s in shards], [np.zeros(len(s.count)) for s in shards]
    for k in range(110):
        for s, root in zip(shards, roots, strict=True):
            for _ in range(hpylm.BURN):
                s.sweep(root)
        roots = root_of(batch, shards, types, k)
        if k >= 10:
            kept = [out + s.chances(root) for out, s, root in zip(kept, shards, roots, strict=True)]
    ours = np.concatenate([out[s.triple] for out, s in zip(kept, shards, strict=True)]) / 100
    spelled = {hpylm.END: "END"} | {int(hpylm.tokens(w)[0]): w for t in texts for w in t.split()}
    name = ["START", *(spelled[int(h)] for h in batch.words)]
    asked = [((name[u], name[c]), name[w]) for c, w, u in zip(batch.context, batch.word, batch.before, strict=True)]
    plain = sampled_one_by_one(docs, types, asked, 260, 40)
    off = np.log(ours / plain)
    assert (batch.count > hpylm.SMALL / 2).any() and len(off) > 150
    assert abs(off.mean()) < 0.02 and abs(off).mean() < 0.04 and abs(off).max() < 0.3, (off.mean(), abs(off).mean(), abs(off).max())


@pytest.mark.parametrize("hot", [False, True])
def test_probabilities_sum_to_one(hot):
    texts, held = corpus()
    words = sorted({w for t, h in zip(texts, held, strict=True) for w in t.split() if not h})
    n = len(texts)
    texts += [f"w0 w1 {w}" for w in words] + ["w0 w1", "w0 w1 neverseen"]
    batch = batch_of(texts, held + [True] * (len(words) + 2))
    frequent = np.sort(1 + np.searchsorted(batch.words, np.array([hpylm.tokens(w)[0] for w in ("w1", "w0")])))
    shards = shards_of(batch, (frequent, np.array([3, 2])) if hot else NONE, 4)
    types = len(words) + 1
    roots = root_of(batch, shards, types, 0)
    chance = np.concatenate([s.sampled(root, 2, 2)[s.triple] for s, root in zip(shards, roots, strict=True)])
    at = np.full(len(batch.at), -1)
    at[batch.follow] = batch.triple
    total = 0.0
    for k in range(len(words) + 2):  # the third token of each of the last documents
        total += chance[at[batch.starts[n + k] + 2]]
    assert math.isclose(total, 1, rel_tol=1e-9)


@pytest.mark.parametrize("n, weight", [(6, 2.5), (40, 0.3), (300, 2.5), (300, 60.0), (5000, 2.5), (5000, 200.0), (8000, 1000.0)])
def test_the_number_of_tables_is_that_of_the_exact_posterior(n, weight):
    """p(t tables | n customers) is S(n, t) weight^t with generalised Stirling numbers where the weight of a table stays."""
    d = hpylm.D[0]
    logs = np.array([-np.inf, 0.0])  # log S(1, t) weight^t, by t
    for k in range(1, n):
        t = np.arange(k + 2)
        stay = np.r_[logs, -np.inf] + np.log(np.maximum(k - d * t, 1e-300))
        logs = np.logaddexp(stay, np.r_[-np.inf, logs] + math.log(weight))
    p = np.exp(logs - np.logaddexp.reduce(logs))
    t = np.arange(len(p))
    want, wide = (p * t).sum(), math.sqrt((p * t**2).sum() - (p * t).sum() ** 2)
    # a restaurant with so many other tables that its weight does not grow along
    tables = hpylm.draw(np.random.default_rng(2), 0, np.full(4000, n), np.full(4000, 1e9), np.full(4000, weight / 1e9), None)
    assert math.isclose(tables.mean(), want, rel_tol=0.03) and math.isclose(tables.std(), wide, rel_tol=0.1), (tables.mean(), want, tables.std(), wide)


def test_words_are_split_and_lowered_as_asked():
    texts = ["", " a\tB\x0b\x0ca  \r\nÀ\u00a0x ", "a", "A-z" * 3, "\u2003", "b " * 50]
    all_, sizes = hpylm.hashed([t.encode() for t in texts])
    assert sizes.tolist() == [1 + len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    spelled = {}
    for t, own in zip(texts, np.split(all_, np.cumsum(sizes)[:-1]), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + ["END"]
        assert (own == hpylm.tokens(t)).all()
        for w, h in zip(words, own.tolist(), strict=True):
            assert spelled.setdefault(w, h) == h
    assert len(set(spelled.values())) == len(spelled)
    many = [f"w{k}" for k in range(50_000)] + ["ab" * k for k in range(1, 200)]
    assert len(np.unique(hpylm.tokens(" ".join(many)))) == len(many) + 1


def test_arrays_come_back():
    arrays = [np.array([5, 2**63, 7], np.uint64), np.arange(70_000), np.zeros(0, np.int64), np.array([1.5, -2.0]), np.array([0.25], np.float32)]
    for a, b in zip(arrays, hpylm.unpack(hpylm.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_scores_do_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(hpylm, "BATCH", 20_000)
    monkeypatch.setattr(hpylm, "TEXT", 40_000)
    monkeypatch.setattr(hpylm, "SHARD", 20_000)  # so that frequent words are split
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in (4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r.doc_id: r.score for r in hpylm.score(docs.repartition(n)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", asked)
    assert got[0].keys() == got[1].keys() and all(math.isclose(got[0][k], got[1][k], rel_tol=1e-6) for k in got[0])


@pytest.mark.parametrize("rounds", [1, 2])
def test_scores_do_not_depend_on_shards(spark, sf, monkeypatch, rounds):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    hot = [(10_000_000 + k, " ".join(["the"] * (k % 7 + 1) + [f"w{k % 11}", "the", f"v{k}"]) * 20) for k in range(200)]
    docs = docs.unionByName(spark.createDataFrame(hot, "doc_id long, text string"))
    got = []
    for size in (6_000_000, 20_000):  # with small shards, frequent words are in several of them
        monkeypatch.setattr(hpylm, "SHARD", size)
        got.append({r.doc_id: r.score for r in hpylm.score(docs, rounds=rounds).collect()})
    assert got[0].keys() == got[1].keys() and all(math.isclose(got[0][k], got[1][k], rel_tol=1e-12) for k in got[0])


def test_a_restaurant_in_classes_is_one_restaurant():
    texts, held = corpus()
    got = []
    for classes in (1, 3):
        batch = batch_of(texts, held)
        names, words = np.arange(1, len(batch.words) + 1), np.array([hpylm.tokens(w)[0] for w in ("w0", "w1")])
        hot = np.sort(1 + np.searchsorted(batch.words, words))
        batch.triples(names, (hot, np.full(2, classes)), 4)
        shards = [hpylm.Shard([blob], 0, hot if classes > 1 else None) for _, blob in batch.dealt()]
        total = hpylm.start_of(np.full(len(names), hpylm.LEVELS - 1)).sum()  # of small identifiers
        for s in shards:
            s.live(s.own_root(total))
        for word in hot if classes > 1 else ():
            there = [(s, k) for s in shards for k, h in enumerate(s.shared) if s.contexts[h] == word]
            assert len(there) == 3
            sent = [hpylm.pack(s.words[s.word[at]].astype(np.uint64), s.customers[at], s.own_root(total)[s.word[at]]) for s, at in ((s, s.dishes[k]) for s, k in there)]
            hub = hpylm.Hub(int(word), sent, 0, hpylm.BURN + 1)
            for (s, k), reply in zip(there, hub.replies(), strict=True):
                s.hub = {**getattr(s, "hub", {}), k: hpylm.unpack(reply)}
        for s in shards:
            s.told([s.hub[k] for k in range(len(s.shared))])
        asked = zip(batch.context, batch.word, batch.before, strict=True)
        got.append(dict(zip(asked, np.concatenate([s.sampled(s.own_root(total), 1, 2) for s in shards]), strict=True)))
    assert got[0] == got[1]


def test_documents_that_occur_twice_score_higher(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 200").select("doc_id", "text")
    twice = docs.filter("crc32(cast(doc_id as string)) % 5 <> 1 and doc_id % 10 = 3").collect()
    more = spark.createDataFrame([(10_000_000 + k, r.text) for k, r in enumerate(twice)], "doc_id long, text string").filter("crc32(cast(doc_id as string)) % 5 <> 1")
    before = {r.doc_id: r.score / r.n_tokens for r in hpylm.score(docs).collect()}
    after = {r.doc_id: r.score / r.n_tokens for r in hpylm.score(docs.unionByName(more)).collect()}
    copied = [r.doc_id for r in twice if any(m.text == r.text for m in more.collect())]
    gain = [after[i] - before[i] for i in copied]
    rest = [after[i] - before[i] for i in before if i not in set(copied)]
    assert copied and np.median(gain) > np.median(rest) + 0.1
