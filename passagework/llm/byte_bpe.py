"""Byte-level BPE: encoding with a rank queue on a hierarchical bitmap, and decoding.

Each merge rank has a bucket of positions in the linked list of parts. A two-level bitmap marks the
ranks whose bucket is not empty, so find-first-set gives the next merges; entries that a neighbouring
merge has overtaken are skipped when they come up. The time of a piece of n bytes is about n log n.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.remembered import LENGTH, SIZE

#: Texts that are encoded together.
TEXTS = 2048
BITS = [1 << i for i in range(256)]


#: Texts of these characters only (Latin, Cyrillic, common punctuation) are split by a plainer, faster pattern.
RANGES = (range(9, 14), range(0x20, 0x85), range(0x86, 0x300), range(0x400, 0x530), range(0x2010, 0x2028))
PLAIN = re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in RANGES).replace(" ", "\\x20") + "]*")


def plain_pattern(pattern: str) -> str:
    """``pattern`` with the letters and numbers of ``RANGES`` for their Unicode classes."""
    for kind in "LN":
        chars = "".join(chr(c) for r in RANGES for c in r if unicodedata.category(chr(c))[0] == kind)
        inside = re.sub(r"(?<=\[)([^\]]*)\\p\{%s\}" % kind, lambda m, chars=chars: m[1] + chars, pattern)
        pattern = inside.replace(rf"\p{{{kind}}}", f"[{chars}]")
    return pattern


class RankQueue:
    """Buckets of positions by rank, each a list of arrays. Rank r is bit r % 256 of leaf r // 256, and ``top``
    has a bit for each leaf that is not zero, so the lowest rank is found by two find-first-set steps."""

    def __init__(self) -> None:
        self.buckets, self.leaves, self.top = {}, {}, 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Put positions into the buckets of their ranks; those with a negative rank into none."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        if not len(order):
            return
        ranks, positions = ranks[order], positions[order]
        cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
        for rank, start, end in zip(ranks[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(positions[start:end])
                continue
            self.buckets[rank] = [positions[start:end]]
            block = rank >> 8
            self.leaves[block] = self.leaves.get(block, 0) | BITS[rank & 255]
            self.top |= BITS[block]

    def pop(self) -> tuple[int, np.ndarray]:
        block = (self.top & -self.top).bit_length() - 1
        leaf = self.leaves[block]
        rank = block << 8 | (leaf & -leaf).bit_length() - 1
        self.leaves[block] = leaf & leaf - 1
        if not self.leaves[block]:
            self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, np.concatenate(bucket) if len(bucket) > 1 else bucket[0]


class Merges:
    """Rank of two neighbouring tokens, by one binary search among all splits of all tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = {ranks[token[:i]] << 32 | ranks[token[i:]]: rank for token, rank in ranks.items()
                 for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.codes = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[c] for c in self.codes.tolist()], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(left), -1, np.int32)
        code = left.astype(np.int64) << 32 | right
        spot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[spot] == code, self.ranks[spot], -1)


def _independent(at, rank, owner, token, after, before, merges) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one rank that can merge together, and those that have to wait.

    Of neighbours that overlap every other one merges, from the left. Where merges of a piece, one after the
    other, would at any time make a pair of a lower rank, only the leftmost is done now.
    """
    many = np.arange(len(at))
    chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
    at = at[(many - np.maximum.accumulate(np.where(chained, 0, many))) % 2 == 0]
    left, right = before[at], after[after[at]]
    before_it = np.where(left >= 0, token[left], -1)
    before_it[1:][left[1:] == after[at[:-1]]] = rank
    merged = np.full(len(at), rank)
    lower = np.zeros(len(at), bool)
    for found, there in ((merges.of(before_it, merged), left >= 0),
                         (merges.of(merged, np.where(right >= 0, token[right], -1)), right >= 0)):
        lower |= there & (found >= 0) & (found < rank)
    if not lower.any():
        return at, at[:0]
    first = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
    now = first | ~np.isin(owner[at], owner[at[lower]])
    return at[now], at[~now]


def encode_pieces(pieces: list[bytes], single: np.ndarray, merges: Merges) -> list[np.ndarray]:
    """Ids of pieces: in each, always the lowest rank first, the leftmost among equals.

    All pieces share one queue. Nothing links them, so the bucket of the lowest rank serves all of them at
    once, and all places of a piece where no merge makes a lower rank. ``single`` has the id of each byte.
    """
    codes = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(codes)
    starts = np.cumsum([0, *map(len, pieces)])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), np.diff(starts))
    token, alive = single[codes], np.ones(n, bool)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[starts[1:] - 1] = before[starts[:-1]] = -1
    current = np.full(n, -1, np.int32)
    inner = np.flatnonzero(after >= 0)
    current[inner] = merges.of(token[inner], token[inner + 1])
    queue = RankQueue()
    queue.push(current, np.arange(n, dtype=np.int32))
    while queue.top:
        rank, at = queue.pop()
        at = np.unique(at[current[at] == rank])
        if len(at) > 1 and (owner[at[1:]] == owner[at[:-1]]).any():
            at, later = _independent(at, rank, owner, token, after, before, merges)
            queue.push(np.full(len(later), rank), later)
        if not len(at):
            continue
        gone = after[at]
        right = after[at] = after[gone]
        token[at], alive[gone], current[gone], current[at] = rank, False, -1, -1
        inner = right >= 0
        held, right = at[inner], right[inner]
        before[right] = held
        inner = before[at] >= 0
        left, held_by = before[at[inner]], at[inner]
        new = merges.of(np.concatenate([token[held], token[left]]), np.concatenate([token[right], token[held_by]]))
        spots = np.concatenate([held, left])
        current[spots] = new
        queue.push(new, spots)
    ends = np.searchsorted(np.flatnonzero(alive), starts)
    ids = token[alive].astype("<i4")
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class ByteBpe:
    """Encoder and decoder for a file of ranks, with the pieces that ``pattern`` finds."""

    def __init__(self, path: str, pattern: str, size: int = SIZE) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces, self.size = regex.compile(pattern).findall, size
        self.plain = re.compile(plain_pattern(pattern)).findall if "\\p" in pattern else self.pieces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.merges = Merges(self.ranks)
        self.single = np.array([self.ranks.get(bytes((b,)), -1) for b in range(256)], np.int32)
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.lengths = np.zeros(self.ranks[tokens[-1]] + 1, np.int64)
        self.lengths[[self.ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _learn(self, fresh: set[str]) -> list[str]:
        """Have these pieces in ``known``; the result has those that are too long to stay there."""
        if len(self.known) + len(fresh) > self.size:
            self.known, self.older = {}, self.known
        new = []
        for piece in fresh:
            if piece in self.older:
                self.known[piece] = self.older[piece]
            elif (whole := self.ranks.get(coded := piece.encode())) is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            else:
                new.append((piece, coded))
        if new:
            lists = encode_pieces([coded for _, coded in new], self.single, self.merges)
            for (piece, _), ids in zip(new, lists, strict=True):
                self.known[piece] = ids.tobytes()
        return [x for x in fresh if len(x) > LENGTH]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        get, found, fresh = self.known.get, [], set()
        for text in texts:
            pieces = (self.plain if PLAIN.fullmatch(text) else self.pieces)(text)
            values = [*map(get, pieces, pieces)]  # ids, or the piece itself where it is not known yet
            fresh.update([v for v in values if v.__class__ is str])
            found.append(values)
        long = self._learn(fresh)
        known = self.known
        out = [b"".join([known[v] if v.__class__ is str else v for v in values]) for values in found]
        for piece in long:
            del known[piece]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], np.int32).tolist()

    def decode(self, ids) -> bytes:
        """The bytes of one token after the other, by one gather from all tokens' bytes."""
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        spots = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        spots += np.arange(len(spots))
        return self.bytes[spots].tobytes()


@cache
def codec(path: str, pattern: str) -> ByteBpe:
    """One for each file in each Python worker."""
    return ByteBpe(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Array of ids of each whole text; null and empty texts have an empty array.

    ``path`` names the file of ranks and must be readable on the workers. There are no special
    tokens: their strings are ordinary text. Equal texts have equal ids.
    """
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        packed, found = codec(path, pattern).packed, []
        for at in range(0, len(texts), TEXTS):
            found += packed([x or "" for x in texts.slice(at, TEXTS).to_pylist()])
        ends = np.cumsum([0, *(len(x) // 4 for x in found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for; null and empty arrays give empty bytes, and so does a null among the ids."""
    @F.arrow_udf(T.BinaryType())
    def joined(lists: pa.Array) -> pa.Array:
        bpe = codec(path, pattern)
        return pa.array([bpe.decode(x.values.drop_null().to_numpy()) if x.is_valid else b"" for x in lists], pa.binary())

    return joined(ids)
