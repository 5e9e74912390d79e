"""A hierarchical Pitman-Yor language model, sampled as Chinese restaurants.

A restaurant stands for the two words before a word; its parent is that of the one word before, whose parent is the root,
with a uniform base over the training vocabulary and one unknown word.  A word's customers sit at tables, and each table
sends one customer to the parent.  Contexts are exact.  The first word of a document is a customer of the root.

The predictive probabilities need a word's customers and tables in each restaurant, not who sits where, so the state of
the Gibbs sampler is the number of tables of each word ("dish"), and one step draws it for all customers of a dish at
once, given all other dishes: t tables have the weight S(c, t) times the product of (theta + d T) P(word | parent) over
the tables after the first, where T and the parent's customers grow along and S are generalised Stirling numbers.  Half
of the dishes are drawn at a time, then their restaurants' totals are renewed.

Where things are:
1. Documents are cut into batches of about BATCH tokens, kept as word numbers (`homes`).
2. Every batch sends its distinct words with their counts to the shard of the word: the root restaurant.  Back come the
   words' ranks, of which their identifiers are made (small ones for frequent words), and the levels of their counts.
3. Every batch sends its distinct triples of words with their training counts, once each however often they occur, to the
   shard of the middle word: a shard has whole restaurants of two words.  A word with more than its part of all tokens
   is dealt to several shards, in classes of the words before it, by hash; its restaurant stays one.
4. A turn: BURN sweeps over the restaurants of two words, with words' shares by their counts as what lies above them (in
   later turns, what came back).  Then those of one word take the tables as customers and draw theirs, those of frequent
   words at a hub, where their classes meet and from which the classes get customers and tables back.  Tables by word go
   to the root's shards, which draw their own; what the root gives each word goes back.  ROUNDS turns.
5. Shards go through the turns again, the same, and on: BURN sweeps more, then the average of SAMPLES states'
   probabilities for every triple that a batch has asked for.  They go back to the batch, which adds them up by document.
Scores depend on the data alone, neither on the number of shards, which comes from the bytes of text, nor on the cluster's
settings: identifiers come from fixed ranges of hashes; draws go by a key of the dish and the turn; what a shard cannot
know alone, it has from an exchange, also where it happens to have all of it.  Batches, triples and replies are read by
several steps; as partitioned RDDs they are shuffled once, and each step reads the shuffle's files where they are.  Lost
ones are made again, the same.

Edge cases: a null text counts as empty, and an empty text is its end token alone; a null doc_id is not held out and
learns like others; rows that repeat are scored each; a corpus without training rows has N = 0 and the uniform base over
one unknown word (scores of 0 for log10 of 1); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, table

#: Discount and strength of the restaurants of two words, of one word, and of the root.
D, THETA = (0.75, 0.9, 0.7), (0.3, 4.0, 20.0)
#: Exchanges with the root, sweeps after each, samples.
ROUNDS, BURN, SAMPLES = 1, 2, 3
#: Stirling numbers are exact up to SMALL customers, of a few rows up to LARGE and scaled beyond.
SMALL, LARGE = 48, 2048
#: Dishes of more tables are drawn by the mode and width of their weights.
MANY = 64
#: Tokens of a batch, bytes of text for each shard (about a million tokens), and the fewest shards.
BATCH, SHARD, LEAST = 1_000_000, 6_000_000, 8
#: Ranges of the words' hashes: the root's shards have whole ones, and in each the words of a level are numbered.
RANGES = 1024
#: Levels of counts, and the bits of an identifier below the level.
LEVELS, LOW = 256, 40
#: The end token's hash, and the identifier of what stands before a document.
END, START = 0x9E3779B97F4A7C15, 0
#: Bytes of texts that are split at once, and of words that are hashed at once.
TEXT, STRETCH = 1 << 20, 1 << 17

_BASE = 0xD6E8FEB86659FD93
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_OF_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_OF_BYTE[_SPACE] = 0


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    runs = (np.full(n, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    first = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.r_[first, r[1:]], dtype=np.uint64) for r in runs)


def mixed(x: np.ndarray) -> np.ndarray:
    """Another hash of hashes."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' words (A-Z lowered) and of an end after each text; and their number by text."""
    if not raw:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOW[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    words = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # a stretch of whole words at a time: their polynomials, each moved to its start
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + STRETCH)))
        low, high = starts[first], starts[last] if last < len(starts) else len(data)
        powers, back = _powers(1 << int(high - low - 1).bit_length())
        own = starts[first:last] - low
        words[first:last] = mixed(np.add.reduceat(_OF_BYTE[data[low:high]] * powers[: high - low], own) * back[own])
        first = last
    ends = np.cumsum([len(r) + 1 for r in raw])
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0) + 1
    out = np.full(int(sizes.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = words
    return out, sizes


def tokens(text: str | None) -> np.ndarray:
    """The hashes of one text's tokens."""
    return hashed([(text or "").encode()])[0]


def pack(*arrays) -> bytes:
    """Arrays as bytes: whole numbers in as few bytes as they need, hashes as differences, byte planes apart."""
    head, body = [], []
    for a in map(np.asarray, arrays):
        if a.dtype.kind == "i" and a.min(initial=0) >= 0:
            a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        head.append(f"{a.dtype.str}{len(a)};")
        if a.dtype == np.uint64:
            a = np.diff(a, prepend=np.uint64(0))
        body.append(np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).T).tobytes())
    said = "".join(head).encode()
    return zstandard.compress(len(said).to_bytes(4, "little") + said + b"".join(body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for said in raw[4:at].decode().split(";")[:-1]:
        kind, n = np.dtype(said[:3]), int(said[3:])
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if kind == np.uint64 else a)
        at += n * kind.itemsize
    return out


def ranked(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, most frequent first and else in order, and the places `at` among them: both pack well so."""
    order = np.argsort(-np.bincount(at, minlength=len(hashes)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[order], rank[at]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and each value's place among them."""
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    key, place = key[new], np.empty(len(order), np.int32 if len(key) < 1 << 31 else np.int64)
    place[order] = np.cumsum(new, dtype=place.dtype) - 1
    return key, place


def range_of(words: np.ndarray) -> np.ndarray:
    """The range of each hash, in their order."""
    return (words >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)


def root_shard(ranges: np.ndarray, shards: int) -> np.ndarray:
    """The root's shard of each range: whole ranges, in their order."""
    return ranges * min(shards, RANGES) // RANGES


def level_of(counts: np.ndarray) -> np.ndarray:
    """Training counts in steps of a sixth of a doubling."""
    return np.rint(6 * np.log2(1.0 + counts)).astype(np.int64)


def start_of(levels: np.ndarray) -> np.ndarray:
    """What a word weighs in the root before any table is known, about its count to the power of 3/4."""
    return np.exp2(np.arange(LEVELS) / 8)[levels] - 0.5


def identified(ranks: np.ndarray, ranges: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Identifiers of words: those of high levels are the first, those of a level lie close."""
    return (LEVELS - 1 - levels << LOW) + 1 + ranks * RANGES + ranges


def placed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, ranges and levels of identifiers."""
    ranks, ranges = np.divmod((words & (1 << LOW) - 1) - 1, RANGES)
    return ranks, ranges, LEVELS - 1 - (words >> LOW)


def key_of(*parts: np.ndarray) -> np.ndarray:
    """A hash of rows of identifiers."""
    key = np.uint64(0)
    for part in parts:
        key = mixed(key + part.astype(np.uint64))
    return key


def turned(keys: np.ndarray, turn: int) -> np.ndarray:
    """The keys of another turn."""
    return mixed(keys + np.uint64(turn * END % (1 << 64)))


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """A number between 0 and 1 for each key, others for each step."""
    x = keys * np.uint64((step * END | 1) * _BASE % (1 << 64))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x >>= np.uint64(11)
    return (x + 0.5) * 2.0**-53


def runs_of(own: np.ndarray):
    """value, first, last + 1 of each run of equal values."""
    cuts = np.flatnonzero(np.diff(own, prepend=-1)) if len(own) else np.zeros(0, int)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True) if len(cuts) else ():
        yield int(own[lo]), lo, hi


def homes(docs: DataFrame) -> DataFrame:
    """batch, blob: documents in batches, as word numbers.  `docs` has doc_id, held_out, text."""

    def flush(batch, ids, held, parts):
        words, at = distinct(np.concatenate([p[0] for p in parts]))
        some = np.array([i is not None for i in ids])
        blob = pack(*ranked(words, at), np.concatenate([p[1] for p in parts]), np.array(held, np.uint8), some.astype(np.uint8), np.array([i or 0 for i in ids]).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([blob], pa.binary())], names=["batch", "blob"])

    def run(batches):
        from pyspark import TaskContext

        batch, ids, held, parts, raw, n, size = TaskContext.get().partitionId() << 24, [], [], [], [], 0, 0
        for b in batches:
            for i, h, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                held.append(h)
                raw.append(t.encode())
                size += len(raw[-1])
                if size >= TEXT:
                    parts.append(hashed(raw))
                    n, raw, size = n + len(parts[-1][0]), [], 0
                    if n >= BATCH:
                        yield flush(batch, ids, held, parts)
                        ids, held, parts, n, batch = [], [], [], 0, batch + 1
        if ids:
            yield flush(batch, ids, held, [*parts, hashed(raw)])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "batch long, blob binary")


class Batch:
    """The documents of a batch: `words` are sorted hashes, `at` the tokens' places among them."""

    def __init__(self, blob: bytes):
        words, at, sizes, self.held, self.some, self.ids = unpack(blob)
        self.sizes = sizes.astype(np.int64)
        order = np.argsort(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.at = words[order], place[at]
        self.first = np.zeros(len(self.at), bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first[self.starts] = True
        self.learn = np.repeat(self.held == 0, self.sizes)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training tokens and training first tokens of each word."""
        m = len(self.words)
        return np.bincount(self.at[self.learn], minlength=m), np.bincount(self.at[self.learn & self.first], minlength=m)

    def triples(self, names: np.ndarray, hot: tuple[np.ndarray, np.ndarray], shards: int):
        """Finds the distinct triples, in the order of their shards.

        `names`: the identifiers of the words; `hot`: identifiers of words that are dealt in classes, sorted, and their
        classes.  Sets `known` (sorted identifiers), by triple `owner` (its shard), `context` and `part` (its class),
        `word`, `before` (places in `known`) and `count`; and for the tokens `follow` that are no first ones, their
        `triple`."""
        order = np.argsort(names)
        place = np.empty(len(order), np.int32)  # a batch's arrays are long: half the bytes where they do
        place[order] = np.arange(1, len(order) + 1)
        self.known = np.r_[START, names[order]]
        at, m = place[self.at], len(self.known)
        self.follow = follow = np.flatnonzero(~self.first)
        word, last = at[follow], at[follow - 1]
        before = np.where(self.first[follow - 1], np.int32(0), at[np.maximum(follow - 2, 0)])
        parts = np.ones(m, np.int64)
        here = np.flatnonzero(np.isin(hot[0], self.known))
        parts[np.searchsorted(self.known, hot[0][here])] = hot[1][here]
        part, split = np.zeros(len(last), np.int32), np.flatnonzero(parts[last] > 1)
        part[split] = mixed(self.known.astype(np.uint64))[before[split]] % parts[last[split]].astype(np.uint64)
        offset = np.cumsum(parts) - parts  # a number for each class of each word
        every = np.repeat(np.arange(m), parts)
        class_of = np.arange(len(every)) - offset[every]
        owner = (mixed(mixed(self.known[every].astype(np.uint64)) + class_of.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        by_owner = np.argsort(owner, kind="stable")
        rank = np.empty(len(by_owner), np.int64)
        rank[by_owner] = np.arange(len(by_owner))
        context = rank[offset[last] + part]
        del last, part, at
        if len(every) * m * m < 1 << 62:
            context *= m
            context += word
            context *= m
            context += before
            both, self.triple = distinct(context)
            pair, self.before = np.divmod(both, m)
        else:
            pairs, pair = distinct(context * m + word)
            both, self.triple = distinct(pair.astype(np.int64) * m + before)
            pair, self.before = np.divmod(both, m)
            pair = pairs[pair]
        context, self.word = np.divmod(pair, m)
        context = by_owner[context]
        self.owner, self.context, self.part = owner[context], every[context], class_of[context]
        self.count = np.bincount(self.triple[self.learn[follow]], minlength=len(both))

    def dealt(self):
        """shard, blob: what each shard gets of the triples, in their order."""
        ids, seen, place = self.known.astype(np.uint64), np.zeros(len(self.known), bool), np.empty(len(self.known), np.int64)
        for s, lo, hi in runs_of(self.owner):
            new = np.flatnonzero(np.diff(self.context[lo:hi], prepend=-1) | np.diff(self.part[lo:hi], prepend=-1))
            runs = np.diff(np.r_[new, hi - lo])
            word, before = self.word[lo:hi], self.before[lo:hi]
            seen[word], seen[before] = True, True
            use = np.flatnonzero(seen)
            place[use] = np.arange(len(use))
            yield s, pack(ids[self.context[lo:hi][new]], self.part[lo:hi][new], runs, ids[use], place[word], place[before], self.count[lo:hi])
            seen[use] = False


@functools.cache
def stirling(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Customers c of each row, and rows by t of the log of S(c, t) / S(c, t - 1) times d (t - 1).

    S are generalised Stirling numbers.  All c up to SMALL have a row, then some up to LARGE; between and beyond, the
    tables of c customers are c^d times those of one, so that a row at t (c' / c)^d, times (c' / c)^d, serves for c.
    """
    known, rows, at = np.full(LARGE + 2, -np.inf), [], []
    known[1] = 0
    t = np.arange(LARGE + 2)
    for c in range(1, LARGE + 1):
        if c <= SMALL or c >= at[-1] * 1.1 or c == LARGE:
            row = np.full(LARGE + 2, -np.inf)
            row[2 : c + 1] = known[2 : c + 1] - known[1:c] + np.log(d * (t[2 : c + 1] - 1))
            row[1] = 2 * row[2] - row[3] if c > 2 else row[2]
            rows.append(row)
            at.append(c)
        m = c + 1
        known[1 : m + 1] = np.logaddexp(known[:m], known[1 : m + 1] + np.log(np.maximum(c - d * t[1 : m + 1], 1e-300)))
    return np.array(at), np.array(rows)


@functools.cache
def exact_ratios(d: float) -> np.ndarray:
    """S(c, t) / S(c, t - 1) for up to SMALL customers, by t and c."""
    _, rows = stirling(d)
    t = np.arange(2, SMALL + 1)
    out = np.zeros((SMALL + 1, SMALL + 1))
    out[2:, 1:] = (np.exp(rows[:SMALL, 2 : SMALL + 1]) / (d * (t - 1))).T
    return out


def draw(random, level: int, count, strength, reach, room):
    """Numbers of tables for dishes with `count` > 1 customers.  `random`: a key for each dish, or a generator of keys.

    The weight of table j + 1 is (strength + d j) times what the parent gives after j tables: (reach + j) / (room + j),
    or `reach` where there is no room (a parent that does not move).  Tables are added one at a time: the last number of
    tables takes the place of the one drawn so far with its share of the weight up to there.
    """
    if isinstance(random, np.random.Generator):
        random = random.integers(0, 1 << 64, len(count), np.uint64)
    d, out = D[level], np.ones(len(count), np.int64)
    order = np.argsort(-count, kind="stable")
    big = int(np.searchsorted(-count[order], -SMALL))
    if big:
        k = order[:big]
        out[k] = drawn_by_steps(random[k], d, count[k], strength[k], reach[k], None if room is None else room[k])
    order = order[big:]
    random, count, strength, reach = random[order], count[order], strength[order], reach[order]
    room, ratios = None if room is None else room[order], exact_ratios(d)
    total, drawn = np.ones(len(count)), np.ones(len(count), np.int64)
    for t in range(2, SMALL + 1):
        k = int(np.searchsorted(-count, -t, side="right"))
        if not k:
            break
        gives = reach[:k] if room is None else (reach[:k] + (t - 1)) / (room[:k] + (t - 1))
        total[:k] = total[:k] / ((strength[:k] + d * (t - 1)) * gives * ratios[t][count[:k]]) + 1  # of the weights so far, by the last
        drawn[:k][uniform(random[:k], t) * total[:k] < 1] = t
    out[order] = drawn
    return out


def drawn_by_steps(random, d: float, count, strength, reach, room):
    """`draw` for dishes of more than SMALL customers."""
    at, logs = stirling(d)
    row = np.minimum(np.searchsorted(at, count, side="right") - 1, len(at) - 1)
    scale = (at[row] / count) ** d

    def step(k, t):
        """The weight of t tables over that of t - 1, for the dishes k."""
        place = np.minimum(t * scale[k], at[row[k]] - 1e-9)
        low = place.astype(np.int64)
        part = place - low
        log = logs[row[k], low] * (1 - part) + logs[row[k], low + 1] * part
        gives = reach[k] if room is None else (reach[k] + t - 1) / (room[k] + t - 1)
        return np.where(t <= count[k], (strength[k] + d * (t - 1)) * gives * np.exp(log * scale[k]) / (d * np.maximum(t - 1, 1e-9)), 0)

    out = np.ones(len(count), np.int64)
    # dishes of more than MANY tables: the mode and the width there
    wide = np.flatnonzero(count > MANY)
    wide = wide[step(wide, np.full(len(wide), float(MANY))) > 1]
    if len(wide):
        low, high = np.full(len(wide), float(MANY)), count[wide].astype(float)
        for _ in range(50):
            mid = (low + high) / 2
            up = step(wide, mid) > 1
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        h = np.sqrt(low)
        fall = np.log(np.maximum(step(wide, low - h), 1e-300)) - np.log(np.maximum(step(wide, np.minimum(low + h, count[wide])), 1e-300))
        normal = np.sqrt(-2 * np.log(uniform(random[wide], 0))) * np.cos(2 * np.pi * uniform(random[wide], 1))
        out[wide] = np.clip(np.rint(low + normal * np.sqrt(2 * h / np.maximum(fall, 1e-9))), 1, count[wide])
    few = np.ones(len(count), bool)
    few[wide] = False
    active, total, t = np.flatnonzero(few), np.ones(int(few.sum())), 1
    while len(active):
        t += 1
        with np.errstate(divide="ignore", over="ignore"):
            total = total / step(active, np.full(len(active), t)) + 1
        out[active[uniform(random[active], t) * total < 1]] = t
        goes_on = (total < 1e7) & (count[active] > t)
        active, total = active[goes_on], total[goes_on]
    return out


class Parents:
    """Restaurants of one word: customers, tables and keys of their dishes; `house` is the restaurant of each."""

    def __init__(self, keys, house: np.ndarray, houses: int, customers: np.ndarray, tables: np.ndarray | None = None):
        self.house, self.customers, least = house, customers, np.minimum(customers, 1)
        self.tables = least if tables is None else np.clip(tables, least, customers)
        self.seats = np.bincount(house, customers, houses).astype(np.int64)
        self.many = np.flatnonzero(customers > 1)
        self.keys = keys(self.many)
        self._totals()

    def _totals(self):
        self.opened = np.bincount(self.house, self.tables, len(self.seats)).astype(np.int64)

    def sweep(self, root: np.ndarray, turn: int):
        """`root`: what the root gives the word of each dish."""
        keys = turned(self.keys, turn)
        odd = (keys & np.uint64(1)).astype(bool)
        for half in (True, False):
            at = self.many[odd == half]
            self.tables[at] = draw(keys[odd == half], 1, self.customers[at], THETA[1] + D[1] * (self.opened[self.house[at]] - self.tables[at]), root[at], None)
            self._totals()


class Shard:
    """The restaurants of a shard: dishes of two levels, numbered together with what batches only ask for (no customers).

    Restaurants of two words are drawn while those of one word stand still; then these meet the tables' customers and are
    drawn.  So a restaurant of one word may have its customers in several shards (`hot`): they meet at its hub."""

    def __init__(self, blobs: list[bytes], seed: int, hot: np.ndarray | None = None):
        parts = [unpack(b) for b in blobs]
        joined = lambda k: np.concatenate([np.zeros(0, np.int64), *(p[k].astype(np.int64) for p in parts)])
        classes, (contexts, own) = joined(1), distinct(joined(0))
        width = int(classes.max(initial=0)) + 1
        houses, own = distinct(own.astype(np.int64) * width + classes)
        self.contexts = contexts[houses // width]
        self.words, names = distinct(joined(3))
        context = np.repeat(own, joined(2))
        shift = np.repeat(np.cumsum([0, *(len(p[3]) for p in parts[:-1])])[: len(parts)], [len(p[4]) for p in parts])
        word, before = names[joined(4) + shift], names[joined(5) + shift]
        del names, shift
        self.asked = [len(p[4]) for p in parts]
        m = max(1, len(self.words))
        pairs, pair = distinct(context.astype(np.int64) * m + word)
        triples, self.triple = distinct(pair.astype(np.int64) * m + before)
        self.above, before = np.divmod(triples, m)  # the dish of the parent
        self.house, self.word = np.divmod(pairs, m)  # of the parent's dishes
        _, self.room = distinct(self.house[self.above] * m + before)
        self.count = np.bincount(self.triple, joined(6), len(triples)).astype(np.int64)
        self.seats = np.bincount(self.room, self.count).astype(np.int64)
        self.tables = np.minimum(self.count, 1)
        self.many = np.flatnonzero(self.count > 1)
        self.seed, self.turn, self.parents = np.array([seed]), 0, None
        self.keys = key_of(self.seed, self.words[before[self.many]], *self._names(self.above[self.many]))
        self._totals()
        #: the houses that others have parts of, and their dishes
        self.shared = np.flatnonzero(np.isin(self.contexts, hot)) if hot is not None else np.zeros(0, np.int64)
        self.dishes = [slice(*np.searchsorted(self.house, [h, h + 1])) for h in self.shared.tolist()]

    def _names(self, dishes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.contexts[self.house[dishes]], self.words[self.word[dishes]]

    def _totals(self):
        self.opened = np.bincount(self.room, self.tables, len(self.seats)).astype(np.int64)

    def children(self, root: np.ndarray):
        """Draws the restaurants of two words, half of the dishes at a time; `root`: what the root gives each word."""
        keys = turned(self.keys, self._next())
        odd = (keys & np.uint64(1)).astype(bool)
        for half in (True, False):
            at = self.many[odd == half]
            up, own, p = self.above[at], self.tables[at], self.parents
            if p is None:
                reach, room = root[self.word[up]], None
            else:
                met = self.met[at]
                others = p.customers[up] - met
                # with its first table a dish has a customer at the parent, and so a table
                tables = np.maximum(np.minimum(p.tables[up], others), 1)
                house = self.house[up]
                gone = np.where(others > 0, 0, p.tables[up] - 1)
                reach = others - D[1] * tables + (THETA[1] + D[1] * (p.opened[house] - gone)) * root[self.word[up]]
                room = THETA[1] + p.seats[house] - met
            self.tables[at] = draw(keys[odd == half], 0, self.count[at], THETA[0] + D[0] * (self.opened[self.room[at]] - own), reach, room)
            self._totals()

    def _next(self) -> int:
        self.turn += 1
        return self.turn

    def meet(self, root: np.ndarray, sweeps: int, tables: np.ndarray | None = None):
        """The restaurants of one word take the tables' customers and are drawn; `customers` keeps all, of shared ones too."""
        self.met = self.tables.copy()
        self.customers = np.bincount(self.above, self.tables, len(self.house)).astype(np.int64)
        whole = self.customers.copy()
        for at in self.dishes:
            whole[at] = 0
        self.parents = Parents(lambda many: key_of(self.seed, *self._names(many)), self.house, len(self.contexts), whole, tables)
        for _ in range(sweeps):
            self.parents.sweep(root[self.word], self._next())

    def live(self, root: np.ndarray):
        """A turn: what is drawn between two exchanges."""
        for _ in range(BURN):
            self.children(root)
        self.meet(root, BURN)

    def told(self, replies: list[list[np.ndarray]]):
        """Takes what the hubs say of shared restaurants: customers, tables and both totals."""
        for house, at, (customers, tables, totals) in zip(self.shared.tolist(), self.dishes, replies, strict=True):
            self.parents.customers[at], self.parents.tables[at] = customers, tables
            self.parents.seats[house], self.parents.opened[house] = totals

    def sweep(self, root: np.ndarray):
        """A turn of one sweep, which goes on from the tables there are."""
        self.children(root)
        self.meet(root, 1, self.parents and self.parents.tables)

    def tables_of_words(self) -> np.ndarray:
        tables = self.parents.tables if self.parents else np.minimum(np.bincount(self.above, self.tables, len(self.house)), 1)
        return np.bincount(self.word, tables, len(self.words)).astype(np.int64)

    def own_root(self, total: float | None = None) -> np.ndarray:
        """The words' shares before any table is known; `total`: the weight of all words, else that of the shard's."""
        n = start_of(placed(self.words)[2])
        return n / (total or n.sum())

    def chances(self, root: np.ndarray) -> np.ndarray:
        """P(word | two words) of each triple, in the present state."""
        p, house = self.parents, self.house
        seats = THETA[1] + p.seats
        parent = (p.customers - D[1] * p.tables) / seats[house] + ((THETA[1] + D[1] * p.opened) / seats)[house] * root[self.word]
        seats = THETA[0] + self.seats
        return (self.count - D[0] * self.tables) / seats[self.room] + ((THETA[0] + D[0] * self.opened) / seats)[self.room] * parent[self.above]

    def sampled(self, root: np.ndarray, burn: int, samples: int) -> np.ndarray:
        """The average of the samples' probabilities, by triple."""
        if self.parents is None:
            self.live(root)
        out = np.zeros(len(self.triple) and len(self.count))
        for k in range(burn + samples):
            self.children(root)
            if k >= burn:
                out += self.chances(root)
        return out / samples


class Hub:
    """A restaurant of one word whose customers are in several shards, which send their dishes' identifiers, customers and
    what the root gives.  A dish has a place by its identifier, level after level."""

    def __init__(self, word: int, blobs: list[bytes], seed: int, turn: int):
        parts = [unpack(b) for b in blobs]
        self.asked, ends = [p[0].astype(np.int64) for p in parts], np.zeros(LEVELS, np.int64)
        for ids in self.asked:
            np.maximum.at(ends, ids >> LOW, (ids & (1 << LOW) - 1) + 1)
        self.first, every = np.cumsum(ends) - ends, int(ends.sum())
        self.customers, words, root = np.zeros(every, np.int64), np.zeros(every, np.int64), np.zeros(every)
        for ids, (_, n, gives) in zip(self.asked, parts, strict=True):
            at = self._places(ids)
            self.customers[at] += n
            words[at], root[at] = ids, gives
        self.here = np.flatnonzero(self.customers)
        self.words, root = words[self.here], root[self.here]
        key = lambda many: key_of(np.array([seed]), np.full(len(many), word), self.words[many])
        self.parents = Parents(key, np.zeros(len(self.words), np.int64), 1, self.customers[self.here])
        for k in range(BURN):
            self.parents.sweep(root, turn + k)

    def _places(self, ids: np.ndarray) -> np.ndarray:
        return self.first[ids >> LOW] + (ids & (1 << LOW) - 1)

    def replies(self):
        """Customers, tables and both totals, as each shard has asked."""
        tables, p = np.zeros(len(self.customers), np.int64), self.parents
        tables[self.here] = p.tables
        for at in map(self._places, self.asked):
            yield pack(self.customers[at], tables[at], np.array([p.seats[0], p.opened[0]]))


class Root:
    """The root's words of a shard, by ranges of hashes, most frequent first: identifiers, training counts, customers and
    tables."""

    def __init__(self, batches: list[bytes]):
        parts = [unpack(b) for b in batches]
        words, at = distinct(np.concatenate([p[0] for p in parts]))
        self.count, self.customers = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(words)).astype(np.int64) for k in (1, 2))
        ranges = range_of(words)
        order = np.lexsort((-self.count, ranges))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.count, self.customers, ranges = self.count[order], self.customers[order], ranges[order]
        self.levels = level_of(self.count)
        #: a word's rank in its level and range, of which its identifier is made: the same whatever shards there are
        self.blocks = ranges * LEVELS - self.levels
        self.ranks = np.arange(len(ranges)) - np.searchsorted(self.blocks, self.blocks)
        self.words = identified(self.ranks, ranges, self.levels)
        #: the places of each batch's words
        self.asked = np.split(place[at], np.cumsum([len(p[0]) for p in parts])[:-1])
        self.types = int((self.count > 0).sum())

    def places(self, words: np.ndarray) -> np.ndarray:
        ranks, ranges, levels = placed(words.astype(np.int64))
        return np.searchsorted(self.blocks, ranges * LEVELS - levels) + ranks

    def seat(self, random, sent: list[tuple[np.ndarray, np.ndarray]], types: int, opened: list[int] | None = None):
        """Takes the tables of (places, numbers) as customers and draws the tables.  `opened`: all the root's tables before
        each sweep, or None where the root has no other shards."""
        for place, n in sent:
            self.customers += np.bincount(place, n, len(self.customers)).astype(np.int64)
        self.tables = np.minimum(self.customers, 1)
        many = np.flatnonzero(self.customers > 1)
        for k in range(BURN if opened is None else len(opened)):
            if len(many):
                every = self.tables.sum() if opened is None else opened[k]
                keys = random if isinstance(random, np.random.Generator) else turned(key_of(np.array([random]), self.words[many]), k)
                self.tables[many] = draw(keys, 2, self.customers[many], THETA[2] + D[2] * np.maximum(every - self.tables[many], 0), np.full(len(many), 1 / (types + 1)), None)
        return self.customers - D[2] * self.tables


def given(raw: np.ndarray, totals: dict) -> np.ndarray:
    """P(word | root) from the root's customers less the discounts."""
    return (raw + (THETA[2] + D[2] * totals["tables"]) / (totals["types"] + 1)) / (THETA[2] + totals["customers"])


def slot(key: int) -> int:
    """Spreads keys over partitions: batches from 0 on, shards below."""
    return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33


#: Kinds of messages.
HOME, WORDS, NAMES, TRIPLES, TABLES, SHARED, HUBS, GIVEN, TOTAL, LOGS = range(10)


def gathered(rows) -> list[tuple[int, dict]]:
    """The messages (kind, sender, blob) of each key of a partition: key, and by kind (sender, blob) in order."""
    held: dict = defaultdict(lambda: defaultdict(list))
    for key, (kind, sender, blob) in rows:
        held[key][kind].append((sender, blob))
    for key in sorted(held):
        own = held.pop(key)
        yield key, {kind: sorted(x) for kind, x in own.items()}


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(df: DataFrame, folds: int = 5, fold: int = 1, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    small_batches(spark)
    n = max(2, partitions(spark))
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))
    docs = df.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    deal = lambda rdd: rdd.partitionBy(n, slot)  # noqa: E731  shuffled once, read by all steps that follow
    by_key = lambda rdd, work: rdd.mapPartitions(lambda rows: (out for k, own in gathered(rows) for out in work(k, own)))

    kept = deal(homes(docs).rdd.map(lambda r: (r[0], (HOME, 0, bytes(r[1])))))

    shards = max(LEAST, -(-(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // SHARD))

    def words_of(batch, own):
        home = Batch(own[HOME][0][1])
        counts, firsts = home.word_counts()
        for r, lo, hi in runs_of(root_shard(range_of(home.words), shards)):
            yield -1 - r, (WORDS, batch, pack(home.words[lo:hi], counts[lo:hi], firsts[lo:hi]))

    words = deal(by_key(kept, words_of))

    def census(k, own):
        root = Root([b for _, b in own[WORDS]])
        yield np.r_[int(root.count.sum()), np.bincount(level_of(root.count[root.count > 0]), minlength=LEVELS)]

    learnt, *hist = by_key(words, census).fold(np.zeros(1 + LEVELS, np.int64), np.add).tolist()
    types = sum(hist)
    weight = float(np.dot(hist, start_of(np.arange(LEVELS))) + start_of(0))  # of all words and the unknown one

    def frequent(k, own):
        root = Root([b for _, b in own[WORDS]])
        here = root.count * 2 * shards > learnt
        yield from zip(root.words[here].tolist(), root.count[here].tolist(), strict=True)

    # words with more than half of a shard's part of all tokens, fewer than two a shard: dealt in classes
    hot = np.array(sorted(by_key(words, frequent).collect()), np.int64).reshape(-1, 2)
    hot = spark.sparkContext.broadcast((hot[:, 0], -(-hot[:, 1] * 2 * shards // max(1, learnt))))

    def names_of(k, own):
        root = Root([b for _, b in own[WORDS]])
        for (batch, _), place in zip(own[WORDS], root.asked, strict=True):
            yield batch, (NAMES, -1 - k, pack(root.ranks[place], root.levels[place]))

    names = deal(by_key(words, names_of))

    def asked_by(own) -> Batch:
        home = Batch(own[HOME][0][1])
        ranks, levels = (np.concatenate(x).astype(np.int64) for x in zip(*(unpack(b) for _, b in own[NAMES]), strict=True))
        home.triples(identified(ranks, range_of(home.words), levels), hot.value, shards)
        return home

    def triples_of(batch, own):
        for s, blob in asked_by(own).dealt():
            yield -1 - s, (TRIPLES, batch, blob)

    triples = deal(by_key(kept.union(names), triples_of))

    def places_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The root's shard of each identifier, and an order by shards."""
        r = root_shard(placed(words)[1], shards)
        r[words == START] = -1
        return r, np.argsort(r, kind="stable")[int((r < 0).sum()) :]

    def posted(words, n, sender):
        r, order = places_of(words)
        for at, lo, hi in runs_of(r[order]):
            yield -1 - at, (TABLES, sender, pack(words[order][lo:hi].astype(np.uint64), n[order][lo:hi]))

    def lived(own, turns, totals):
        """A shard after so many turns, and what the root gives its words then.  A shard is not kept between exchanges:
        draws go by keys, so it comes to the same tables when its turns are gone through again."""
        shard = Shard([b for _, b in own[TRIPLES]], 0, hot.value[0])
        root, (r, _) = shard.own_root(weight), places_of(shard.words)
        for turn in range(turns):
            shard.live(root)
            if turn < len(totals):
                shard.told([unpack(b) for _, b in own.get((HUBS, turn), [])])
                raw = np.zeros(len(r))
                for sender, blob in own[(GIVEN, turn)]:
                    raw[r == sender] = unpack(blob)[0]
                root = given(raw, totals[turn])
        return shard, root

    def tables_of(turn, totals):
        def work(k, own):
            shard, root = lived(own, turn + 1, totals)
            yield from posted(shard.words, shard.tables_of_words(), -1 - k)
            for house, at in zip(shard.shared.tolist(), shard.dishes, strict=True):
                hub = int(np.searchsorted(hot.value[0], shard.contexts[house]))
                word = shard.word[at]
                # a shard may have several classes of a word, in their order
                yield -1 - shards - hub, ((SHARED, turn), (-1 - k, house), pack(shard.words[word].astype(np.uint64), shard.customers[at], root[word]))

        return work

    def hubs_of(turn):
        def work(k, own):
            sent = own[(SHARED, turn)]
            hub = Hub(int(hot.value[0][-1 - shards - k]), [b for _, b in sent], 0, (turn + 1) * 2 * BURN - BURN + 1)
            yield from posted(hub.words, hub.parents.tables, k)
            for ((s, house), _), blob in zip(sent, hub.replies(), strict=True):
                yield -1 - s, ((HUBS, turn), house, blob)

        return work

    def seat(k, own, opened):
        root = Root([b for _, b in own[WORDS]])
        sent = [(s, root.places(words), n.astype(np.int64)) for s, (words, n) in ((s, unpack(b)) for s, b in own.get(TABLES, []))]
        return root, sent, root.seat(0, [x[1:] for x in sent], types, opened)

    def opened_by(opened):
        def work(k, own):
            yield int(seat(k, own, opened)[0].tables.sum())

        return work

    def seated(turn, opened):
        def work(k, own):
            root, sent, raw = seat(k, own, opened)
            for s, place, _ in sent:
                if s >= 0:  # hubs ask for nothing
                    yield -1 - s, ((GIVEN, turn), -1 - k, pack(raw[place]))
            for (batch, _), place in zip(own[WORDS], root.asked, strict=True):
                yield batch, ((GIVEN, turn), -1 - k, pack(raw[place], root.count[place]))
            yield k, (TOTAL, 0, pack(np.array([root.customers.sum(), root.tables.sum()])))

        return work

    only = lambda rdd, kept: rdd.filter(lambda row: kept(row[0], row[1][0]))
    known, totals = triples, []
    for turn in range(rounds):
        sent = deal(by_key(known, tables_of(turn, list(totals))))
        met = deal(by_key(only(sent, lambda k, kind: kind != TABLES), hubs_of(turn)))
        tables = words.union(only(sent.union(met), lambda k, kind: kind == TABLES))
        opened = [types]
        while len(opened) < BURN:  # each sweep goes by the tables of the whole root
            opened.append(by_key(tables, opened_by(list(opened))).sum())
        replies = deal(by_key(tables, seated(turn, opened)))
        sums = only(replies, lambda k, kind: kind == TOTAL).map(lambda row: unpack(row[1][2])[0].tolist()).fold([0, 0], lambda a, b: [a[0] + b[0], a[1] + b[1]])
        totals.append({"types": types, "customers": sums[0], "tables": sums[1]})
        known = known.union(only(met, lambda k, kind: kind != TABLES)).union(only(replies, lambda k, kind: k < 0 and kind != TOTAL))

    def answered(k, own):
        shard, root = lived(own, rounds, totals)
        logs = np.log10(shard.sampled(root, BURN, SAMPLES)).astype(np.float32)[shard.triple]
        for (batch, _), end, m in zip(own[TRIPLES], np.cumsum(shard.asked), shard.asked, strict=True):
            yield batch, (LOGS, -1 - k, pack(logs[end - m : end]))

    logs = deal(by_key(known, answered))

    def summed(_, own):
        home = asked_by(own)
        raw, counts = (np.concatenate(x) for x in zip(*(unpack(b) for _, b in own[(GIVEN, rounds - 1)]), strict=True))
        each = np.empty(len(home.at))
        each[home.first] = np.log10(given(raw, totals[-1]))[home.at[home.first]]
        each[home.follow] = np.concatenate([np.zeros(0, np.float32), *(unpack(b)[0] for _, b in own.get(LOGS, []))])[home.triple]
        base = np.log10((counts + 0.5) / (learnt + 0.5 * (types + 1)))
        add = lambda x: np.add.reduceat(x, home.starts).tolist()
        ids = [i if some else None for i, some in zip(home.ids.view(np.int64).tolist(), home.some.tolist(), strict=True)]
        yield from zip(ids, (home.held == 1).tolist(), home.sizes.tolist(), add((counts > 0)[home.at].astype(np.int64)), add(base[home.at]), add(each), strict=True)

    back = kept.union(names).union(only(replies, lambda k, kind: k >= 0)).union(logs)
    out = spark.createDataFrame(by_key(back, summed), RESULT, verifySchema=False)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(learnt)).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame, held_out: bool = True) -> float:
    """10 to the minus mean log10 probability of a token."""
    row = scores.filter(F.col("held_out") == held_out).agg(F.sum("score"), F.sum("n_tokens")).first()
    return 10 ** (-row[0] / row[1])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: rows with crc32(doc_id) mod 5 = 1 are held out."""
    return score(table(spark, sf_dir, "documents"))
