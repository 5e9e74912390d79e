"""Byte-pair merge tables: exact merging, sufficient lookahead, token pairs that may stand side by side.

Edge cases: an empty piece has no tokens; of equal pairs in a piece the leftmost merges first; symbols without a rule
stay as they are.
"""

from __future__ import annotations

import heapq
import json
from functools import cached_property

#: Entries a memo may hold before it is emptied; bounds the memory of a worker.
MEMO = 300_000
#: More than the rank of any rule.
NONE = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Memo(dict):
    """A dict that computes what it lacks.  It holds two generations of at most `most` entries; the older one goes
    when the younger is full, so that what is often asked for stays."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class MergeTable:
    """A vocabulary with its merge list, read from the JSON of a byte-level BPE tokenizer.

    `suffix` is the mark that the last byte of a word carries (empty where there is none).
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_alphabet()
        self.first = [self.vocab.get(c, -1) for c in letters]
        self.last = [self.vocab.get(c + self.suffix, -1) for c in letters] if self.suffix else self.first
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: by pair of ids: the rank and the new id, in one integer that sorts by rank
        self.rules: dict[int, int] = {}
        for rank, (u, v) in enumerate(self.merges):
            self.rules[self.vocab[u] << 32 | self.vocab[v]] = rank << 32 | self.vocab[u + v]
        self.letter = {c: b for b, c in enumerate(letters)}

    def raw(self, token: str) -> bytes:
        body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
        return bytes(self.letter[c] for c in body)

    @cached_property
    def spelled(self) -> dict[int, bytes]:
        """The bytes of each id, special tokens included."""
        out = {i: self.raw(t) for t, i in self.vocab.items() if t not in self.special}
        return out | {i: t.encode() for t, i in self.special.items()}

    def symbols(self, word: bytes, closed: bool = True) -> list[int]:
        """Start symbols of a word; `closed`: its last byte carries the end mark."""
        ids = [self.first[b] for b in word]
        if closed and ids:
            ids[-1] = self.last[word[-1]]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges in the order of their ranks, leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get, ids = self.rules.get, list(ids)
        ranks = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NONE:
            k = ranks.index(best)
            ids[k : k + 2] = [best & 0xFFFFFFFF]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], NONE)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n steps."""
        get, n = self.rules.get, len(ids)
        ids, left, right = list(ids), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], right[k] = r & 0xFFFFFFFF, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for p, q in ((left[k], k), (k, right[k])):
                if p >= 0 and q >= 0 and (r := get(ids[p] << 32 | ids[q], NONE)) < NONE:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    @cached_property
    def lookahead(self) -> int:
        """The sufficient lookahead of the merge list, in bytes.

        Run the merges over w and over w followed by anything, rule by rule, and watch the leftmost boundary d on
        which the two runs differ; at first it is the end of w.  Let rule i = (u, v) have made the difference at d:
        one run holds u up to d, the other a token that starts with u at the same place.  Only a later rule
        (u', v') whose v' starts with u can act on one run alone and so move the difference, to d - |u|.  So no
        boundary further from the end than the heaviest chain of such rules can change any more.
        """
        reach: dict[str, int] = {}  # by u: the heaviest chain that ends in a rule with this left side
        most = 0
        for u, v in self.merges:
            behind = max((reach.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
            most = max(most, behind)
            u_len = len(u.removesuffix(self.suffix)) if self.suffix else len(u)
            reach[u] = max(reach.get(u, 0), behind + u_len)
        return most
