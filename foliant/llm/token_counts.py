"""Exact token counts at every prefix, by dynamic programming over prefixes.

A token sequence is the BPE encoding of its bytes exactly when each neighbouring pair is: when merging the bytes of
the two tokens gives the two tokens back.  So the last token of the encoding of a prefix is the only token that ends
there and may follow the last token of the prefix before it, and the count at a prefix is one more than the count
before its last token.  The table of prefixes (`after`) is shared by all words that start alike; the table of a text
holds the running count at the start of each word, so truncation and budget questions are lookups and nothing is
encoded again.  A word of any length takes time in proportion to it, as tokens have a longest length.

Edge cases: a null text counts as empty, with no tokens; an empty budget keeps nothing; repeated rows stay; further
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_core import MEMO, Memo, MergeTable
from .common import small_batches, text_or_empty

# fixed values: the published pattern that splits text before the merges of word-end vocabularies
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: The same for texts of ASCII alone, once in lower case.
ASCII_WORDS = r"""'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"""
#: Bytes from which a word has a table of its own and is not kept.
LONG = 64
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


def normalise(text: str) -> str:
    """NFC, white space as single spaces, lower case character by character (a final sigma is no special case)."""
    text = SPACE.sub(" ", unicodedata.normalize("NFC", text))
    return text.replace("Σ", "σ").lower()


SPACE = regex.compile(r"\s+")


class PrefixTable:
    """Counts at every prefix of one normalised text."""

    def __init__(self, counter: PrefixCounter, words: list[str], starts: list[int], before: list[int]):
        self.counter, self.words, self.starts, self.before = counter, words, starts, before

    @property
    def total(self) -> int:
        return self.before[-1]

    def count_at(self, n: int) -> int:
        """Tokens of the first n code points of the normalised text."""
        k = bisect_right(self.starts, n - 1) - 1 if n > 0 else -1
        if k < 0:
            return 0
        return self.before[k] + self.counter.within(self.words[k], min(n - self.starts[k], len(self.words[k])))

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix that ends with a whole word and has at most `budget` tokens."""
        k = bisect_right(self.before, budget) - 1
        return 0 if k <= 0 else self.starts[k - 1] + len(self.words[k - 1])


class PrefixCounter:
    def __init__(self, table: MergeTable):
        self.table = table
        self.split = regex.compile(WORDS)
        self.ascii = re.compile(ASCII_WORDS)
        self.special = re.compile("(" + "|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) + ")")
        # tokens by their bytes, apart by whether they carry the end mark
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        for token, i in table.vocab.items():
            if token not in table.special:
                end = bool(table.suffix) and token.endswith(table.suffix)
                (self.closed if end or not table.suffix else self.open)[table.raw(token)] = i
        if not table.suffix:
            self.open = self.closed
        for tokens in (self.open, self.closed):  # only tokens that merging their own bytes gives can occur
            closed = tokens is self.closed
            for raw, i in [*tokens.items()]:
                if table.merge(table.symbols(raw, closed)) != [i]:
                    del tokens[raw]
        self.most_open, self.most_closed = (max(map(len, d), default=0) for d in (self.open, self.closed))
        self.fits = Memo(self._fits, 2 * MEMO)
        self.after = Memo(self._after, MEMO)
        self.whole = Memo(lambda word: self.closing(word.encode()))

    def _fits(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        raw = self.table.spelled[b]
        left = self.table.symbols(self.table.spelled[a], closed=False)
        right = self.table.symbols(raw, closed=self.closed.get(raw) == b)
        return self.table.merge(left + right) == [a, b]

    def _after(self, prefix: bytes) -> tuple[int, int]:
        """The count and the last token of the encoding of a prefix that goes on."""
        n, get = len(prefix), self.open.get
        for start in range(max(0, n - self.most_open), n):
            i = get(prefix[start:])
            if i is not None:
                if start == 0:
                    return 1, i
                count, last = self.after[prefix[:start]]
                if self.fits[last << 32 | i]:
                    return count + 1, i
        raise ValueError("the vocabulary does not cover these bytes")

    def long_prefixes(self, word: bytes) -> tuple[list[int], list[int]]:
        """The same table as `after`, by position, for one long word: counts and last tokens of all its prefixes."""
        n, get = len(word), self.open.get
        counts, lasts = [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n):
            for start in range(max(0, end - self.most_open), end):
                i = get(word[start:end])
                if i is not None and (start == 0 or self.fits[lasts[start] << 32 | i]):
                    counts[end], lasts[end] = counts[start] + 1, i
                    break
        return counts, lasts

    def closing(self, word: bytes) -> int:
        """Tokens of a word that ends here, from the counts at its prefixes."""
        n, get = len(word), self.closed.get
        counts, lasts = self.long_prefixes(word) if n > LONG else ((), ())
        for start in range(max(0, n - self.most_closed), n):
            i = get(word[start:])
            if i is not None:
                if start == 0:
                    return 1
                count, last = (counts[start], lasts[start]) if counts else self.after[word[:start]]
                if self.fits[last << 32 | i]:
                    return count + 1
        raise ValueError("the vocabulary does not cover these bytes")

    def within(self, word: str, n: int) -> int:
        """Tokens of the first n code points of a word."""
        if word in self.table.special:
            return 1 if n == len(word) else sum(self.whole[w] for w in self.split.findall(normalise(word[:n])))
        if n < len(word) and word in CONTRACTIONS:  # a cut contraction splits in another way
            return sum(self.whole[w] for w in self.split.findall(word[:n]))
        return self.closing(word[:n].encode()) if n else 0

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its table."""
        total, whole = 0, self.whole.__getitem__
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                total += 1
            elif part.isascii():
                total += sum(map(whole, self.ascii.findall(part.lower())))
            else:
                total += sum(map(whole, self.split.findall(normalise(part))))
        return total

    def table_of(self, text: str) -> PrefixTable:
        words, starts, at = [], [], 0
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                words.append(part)
                starts.append(at)
                at += len(part)
            else:
                part = normalise(part)
                for m in self.split.finditer(part):
                    words.append(m[0])
                    starts.append(at + m.start())
                at += len(part)
        each = (1 if w in self.table.special else self.whole[w] for w in words)
        return PrefixTable(self, words, starts, list(accumulate(each, initial=0)))


_MADE: dict[str, PrefixCounter] = {}


def made(source: str) -> PrefixCounter:
    if source not in _MADE:
        _MADE.clear()
        _MADE[source] = PrefixCounter(MergeTable(source))
    return _MADE[source]


def count_tokens(df: DataFrame, vocabulary: str, budget: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, fit_chars: code points of the normalised text that stay within the budget.

    fit_chars is null where the whole text fits.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the corpus

    def run(batches):
        counter = made(source.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts = [counter.count(t) for t in texts]
            fit = [counter.table_of(t).fit(budget) if n > budget else None for t, n in zip(texts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64()), pa.array(fit, pa.int64())], names=[key, "n_bytes", "n_tokens", "fit_chars"])

    value = text_or_empty(text)
    rows = df.select(F.col(key), value.alias("_v"), F.octet_length(value).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, fit_chars long")
