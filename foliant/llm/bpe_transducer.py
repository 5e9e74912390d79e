"""BPE encoding and decoding as streaming transducers.

Encoding keeps a window of bytes per piece: the merge list's sufficient lookahead (computed from the rules, see
`MergeTable.lookahead`) plus a block.  Once the window is full the merges run over it, every token that ends further
from the window's end than the lookahead is stable and leaves, and only the bytes behind the last stable boundary
stay.  So memory is constant whatever the length of a piece.  Decoding feeds the ids' bytes to an incremental UTF-8
state machine in blocks.

Edge cases: a null text counts as empty; an empty text has no ids; rows that repeat are encoded again, one row each;
further columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_core import Memo, MergeTable
from .common import small_batches, text_or_empty

# fixed values: the published pattern that splits text before byte-level merges
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII alone.
ASCII_PIECES = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Code points that are split into pieces at once.
SEGMENT = 1 << 18
#: Code points of the longest contraction, which decide what a piece is.
LONGEST = 3
#: Bytes added to the lookahead before the window is merged.
BLOCK = 1024
#: Ids decoded at once.
DECODE_BLOCK = 1 << 16


class Encoder:
    """text → ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.split = regex.compile(PIECES)
        self.window = table.lookahead + BLOCK
        special = sorted(table.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.ascii = re.compile(ASCII_PIECES)
        # a piece shorter than the window never fills it: its tokens leave at its end
        self.memo = Memo(lambda piece: pack(table.merge(table.symbols(piece.encode()))))

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that arrives in chunks of bytes, each as soon as it is stable."""
        held = b""
        for chunk in chunks:
            for at in range(0, len(chunk), BLOCK):
                held += chunk[at : at + BLOCK]
                if len(held) >= self.window:
                    done, stable = 0, len(held) - self.table.lookahead - 1
                    for i in self.table.merge(self.table.symbols(held, closed=False)):
                        end = done + len(self.table.spelled[i])
                        if end > stable:
                            break
                        yield i
                        done = end
                    held = held[done:]
        yield from self.table.merge(self.table.symbols(held))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces in lists; a long text goes segment by segment.

        A piece is certain if it ends before the segment does, and if the LONGEST code points from its start, as many as
        an alternative of the pattern looks at beyond a run, are in the segment.  What follows the last certain piece
        waits for the next segment.
        """
        if len(text) <= SEGMENT:
            yield self.ascii.findall(text) if text.isascii() else self.split.findall(text)
            return
        at, step = 0, SEGMENT
        while at < len(text):
            end = min(len(text), at + step)
            found, ahead = self.split.findall(text, at, end), end
            if end < len(text):
                while found and (ahead == end or ahead - len(found[-1]) > end - LONGEST):
                    ahead -= len(found.pop())
                if not found:  # one piece fills the segment
                    step *= 2
                    continue
            yield found
            at, step = ahead, SEGMENT

    def encode(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(pack([self.table.special[part]]))
            elif part:
                for found in self.pieces(part):
                    # long pieces stream and aren't kept
                    if len(part) < BLOCK // 4 or max(map(len, found)) < BLOCK // 4:
                        out += map(self.memo.__getitem__, found)
                    else:
                        out += [self.memo[p] if len(p) < BLOCK // 4 else pack(self.stream([p.encode()])) for p in found]
        return b"".join(out)


def pack(ids: Iterable[int]) -> bytes:
    return struct.pack(f"<{len(ids := list(ids))}I", *ids)


class Decoder:
    """ids → text.  The UTF-8 automaton carries unfinished characters from one block to the next."""

    def __init__(self, table: MergeTable):
        self.spelled = table.spelled

    def stream(self, blocks: Iterable[bytes]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            yield machine.decode(b"".join(map(self.spelled.__getitem__, memoryview(block).cast("I").tolist())))
        yield machine.decode(b"", final=True)

    def decode(self, ids: bytes) -> str:
        return "".join(self.stream(ids[k : k + 4 * DECODE_BLOCK] for k in range(0, len(ids), 4 * DECODE_BLOCK)))


_MADE: dict[str, tuple[Encoder, Decoder]] = {}


def made(source: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder a worker and vocabulary."""
    if source not in _MADE:
        _MADE.clear()
        table = MergeTable(source)
        _MADE[source] = Encoder(table), Decoder(table)
    return _MADE[source]


def _map(df: DataFrame, key: str, value, schema: str, vocabulary: str, work) -> DataFrame:
    """key and the columns that `work(encoder, decoder, list of values)` gives."""
    spark = df.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the corpus

    def run(batches):
        encoder, decoder = made(source.value)
        for b in batches:
            columns = work(encoder, decoder, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *columns.values()], names=[key, *columns])

    return df.select(F.col(key), value.alias("_v")).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {schema}")


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit)."""

    def work(encoder, _, values):
        return {"ids": pa.array([encoder.encode(v) for v in values], pa.binary())}

    return _map(df, key, text_or_empty(text), "ids binary", vocabulary, work)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text; bytes that are no UTF-8 become U+FFFD."""

    def work(_, decoder, values):
        return {"text": pa.array([decoder.decode(v) for v in values], pa.string())}

    return _map(df, key, F.coalesce(F.col(ids), F.lit(b"")), "text string", vocabulary, work)


def round_trip(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, decoded: both transducers in one pass over the rows, the second reading what the first wrote."""

    def work(encoder, decoder, values):
        ids = [encoder.encode(v) for v in values]
        return {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([decoder.decode(i) for i in ids], pa.string())}

    return _map(df, key, text_or_empty(text), "ids binary, decoded string", vocabulary, work)
