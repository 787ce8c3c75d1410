"""N-gram Jaccard self-join: size-banded tiles, hashed bitmaps, exact intersections.

1. Every text becomes a sorted set of hashed word n-grams. Equal sets are one class.
2. Sets that can link meet under some key, for certain. Two sets in a band of sizes differ in at most d
   n-grams. The hash range is cut into more than d parts, so they agree in a whole part, whose sum is the
   key. Parts with fewer than ``STRONG`` n-grams, which unlike sets may share by chance, are passed over
   as long as the number of parts allows for it. Small sets use the sums of the set without any one or two
   of its members instead. Below a threshold of ``PARTED`` percent parts would be too small to tell sets
   apart; there the keys are a set's rarest hashes, as many as it may lack of another set, and one more. How common
   a hash is was counted over all sets; those that no other set has are no keys, so that most sets, which have
   enough of their own, have none and go no further, and a passage that many sets have in common ties none together
   that have more than it. Sets that share keys form clusters; no link leaves a cluster. Clusters by
   single hashes are laid out in tiles of bitmaps first, and only pairs that pass the bound of step 3 stay together.
3. A cluster is laid out in tiles of about ``TILE`` sets at most, by bands of size. Inside a tile, bitmaps of the
   hashes give an upper bound of each overlap, and pairs that pass it are intersected exactly. Pairs that
   other links have joined already need no look, as the result is components.
4. Clusters of several tiles are joined by representatives, and at last every set that is not in the
   cluster's largest component is compared with all tiles of its band. So no link between two components
   is missed, and only sets that stay apart cost more than one tile.

Busy keys and copies of one set never gather in a task: frequent keys are found by Misra-Gries summaries and
settled by a broadcast of bounded size, as in ``exact_dedup``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.lineage import cut
from passagework.llm.remembered import Remembered
from passagework.llm.components import components
from passagework.llm.exact_dedup import COUNTERS, settle
from passagework.llm.places import PLACE, placed

WORDS, PERCENT = 3, 90
#: Sets in a tile, and members of all its sets together.
TILE, MEMBERS = 4096, 4_000_000
#: Bitmaps take about a twentieth of the room of their sets; a tile of them has so many times the sets.
BITS_IN_A_TILE = 4
#: Largest set that is keyed by leaving members out.
SMALL = 27
STRONG = 3
#: Least threshold in percent for keys by parts.
PARTED = 88
#: Sets that an n-gram is in, at least, for each class of common ones, and most bits of the table of the first class.
COMMON, TABLE = (2, 4, 16, 64), 1 << 29
#: Texts and bytes of them that are taken apart together, and hashes that are sorted together.
TEXTS, BYTES, SORTED = 500, 4 << 20, 1 << 22
#: Longest word, in bytes, that is hashed together with others.
LONG = 64

U64 = np.uint64
#: The first so many bytes of eight.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


WORD = Remembered(xxhash.xxh3_64_intdigest)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a few texts; a long text has one of its own."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        most = (sizes[at - 1] if at else 0) + BYTES
        stop = min(at + TEXTS, max(at + 1, int(np.searchsorted(sizes, most, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def word_codes(words: pa.Array) -> np.ndarray:
    """A hash of each word, eight bytes of all words at a time; long words are hashed one by one."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    ends = np.frombuffer(words.buffers()[1], kind)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    data = np.concatenate([data[ends[0]:ends[-1]], np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) - 7, U64, data, strides=(1,))
    at, left = ends[:-1] - ends[0], np.diff(ends)
    codes = mix(left.astype(U64) + U64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(left > LONG)
    codes[long] = [xxhash.xxh3_64_intdigest(data[at[i]:at[i] + left[i]].tobytes()) for i in long.tolist()]
    rows = np.flatnonzero(left <= LONG) if len(long) else np.arange(len(left))
    while len(rows := rows[left[rows] > 0]):
        codes[rows] = mix(codes[rows] ^ (eights[at[rows]] & FIRST[np.minimum(left[rows], 8)]))
        at[rows] += 8
        left[rows] -= 8
    return codes


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of the distinct n-grams of words of each text with A-Z in lower case.

    A text with fewer words has one, all of it; a text without words has none. Words stand between ASCII white space.
    Hashes have 64 bits: two n-grams of one pair of texts collide with a chance of about size squared in 2 ** 64.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = words.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at the ends makes empty words
    hashes = word_codes(flat)[full]
    ends = np.concatenate([[0], np.cumsum(full)])[words.offsets.to_numpy()].tolist()
    whole = grams(hashes, n)
    out = []
    for start, stop in zip(ends, ends[1:]):
        found = np.sort(whole[start:stop - n + 1] if stop - start >= n else grams(hashes[start:stop], max(stop - start, 1)))
        out.append(found[np.concatenate([found[:1] == found[:1], found[1:] != found[:-1]])])
    return out


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD.__getitem__, words), U64, len(words))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words."""
    many = max(len(hashes) - k + 1, 0)
    found = np.full(many, k, U64)
    for i in range(k):
        found = mix(found + hashes[i:i + many])
    return found


def least_overlap(total: int, percent: int) -> int:
    """Smallest overlap o of two sets with ``total`` members together: 100 o >= percent (total - o)."""
    return -(-percent * total // (100 + percent))


class Keys:
    """Keys of a set for a threshold in percent; see the module's text."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        small = SMALL
        while percent >= PARTED and any(t - 2 * least_overlap(t, percent) > 2 for t in range(2, 2 * small + 1)):
            small -= 1
        self.edges = [small]  # the largest size of each band
        self.parts = [(0, 0)]  # number of parts, and of weak ones allowed

    def _grow(self, n: int) -> None:
        while self.edges[-1] < n:
            edge = int(self.edges[-1] * max(1.3, 102 / self.percent)) + 1
            # Members that are in one of two linked sets only: total - 2 overlap, with the total at most 2 edge.
            apart = 2 * edge * (100 - self.percent) // (100 + self.percent)
            weak = apart // 5 + 1
            self.edges.append(edge)
            self.parts.append((apart + 1 + weak, weak))

    def of(self, found: np.ndarray) -> np.ndarray:
        n = len(found)
        if not n:
            return found
        self._grow(int(n * 100 / self.percent) + 2)
        values = mix(found ^ U64(0x9E3779B97F4A7C15))
        keys = []
        band = bisect_left(self.edges, n)
        for tile in (band, band + 1):
            if tile > band and 100 * n < self.percent * (self.edges[band] + 1):
                break
            keys.append(self._small(values) if tile == 0 else self._parts(found, values, tile))
        return np.unique(np.concatenate(keys))

    def _small(self, values: np.ndarray) -> np.ndarray:
        """Sums of all members, of all but one, and of all but two where two can be apart on one side."""
        n, total = len(values), values.sum(keepdims=True)
        out = [total]
        if (n - 1) * 100 >= self.percent * n:
            out.append(total - values)
        if (n - 2) * 100 >= self.percent * n:
            i, j = np.triu_indices(n, 1)
            out.append(total - values[i] - values[j])
        return mix(np.concatenate(out))

    def _parts(self, found: np.ndarray, values: np.ndarray, tile: int) -> np.ndarray:
        parts, weak = self.parts[tile]
        inner = np.array([(j << 64) // parts for j in range(1, parts)], U64)
        ends = np.concatenate([[0], np.searchsorted(found, inner), [len(found)]])
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(values)])
        keys = mix((sums[ends[1:]] - sums[ends[:-1]]) + mix(np.arange(parts, dtype=U64) + U64(tile << 32)))
        strong = np.diff(ends) >= STRONG
        return keys if parts - strong.sum() > weak else keys[strong]


class Classes:
    """How common n-grams are, by bitmaps over the first bits of their hashes, one for each of ``COMMON``.

    Class 0 is for those that are in one set alone, for certain; others may count as more common than they are.
    """

    def __init__(self, maps: list[np.ndarray]) -> None:
        self.maps = maps

    def of(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.uint8)
        for bits in self.maps:
            at = found >> U64(64 - (8 * len(bits) - 1).bit_length())
            out += bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & np.uint8(1)
        return out


def rare_keys(found: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set for a threshold below ``PARTED``: its first hashes by class and hash, as many as it may lack of a
    linked set and one more, without those that no other set has."""
    many = len(found) + percent * -len(found) // 100 + 1 if len(found) else 0
    shared = np.flatnonzero(classes)
    many -= len(found) - len(shared)
    return found[shared[np.argsort(classes[shared], kind="stable")[:many]]] if many > 0 else found[:0]


def _marks(n: int, slices: int):
    """Hashes of the n-grams of each text, by slice of their range, as the 32 bits behind those of the slice."""
    inner = np.array([(j << 64) // slices for j in range(1, slices)], U64)
    bits = U64(slices.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = np.sort(np.concatenate(held))
            held.clear()
            # What is here more often than the last class asks for is in it, whatever other tasks find.
            most = COMMON[-1]
            found = found[np.concatenate([np.ones(min(most, len(found)), bool), found[most:] != found[:-most]])]
            parts = np.split(((found << bits) >> U64(32)).astype(np.uint32), np.searchsorted(found, inner))
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())],
                                             ["slice", "data"])

        many = 0
        for batch in batches:
            for piece in pieces(batch):
                held += shingle_sets(piece.column("text"), n)
                many += sum(map(len, held[-piece.num_rows:]))
                if many >= SORTED:
                    yield from flush()
                    many = 0
        if many:
            yield from flush()

    return run


def _mapped(slices: int, sizes: list[int]):
    """For the marks of a slice: its part of the bitmaps."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        marks = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("data")]))
        first = np.flatnonzero(np.concatenate([marks[:1] == marks[:1], marks[1:] != marks[:-1]]))
        marks, times = marks[first], np.diff(first, append=len(marks))
        maps = []
        for least, size in zip(COMMON, sizes, strict=True):
            on = np.zeros(size // slices, bool)
            on[marks[times >= least].astype(U64) * U64(len(on)) >> U64(32)] = True
            maps.append(np.packbits(on, bitorder="little").tobytes())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "maps": pa.array([maps], pa.list_(pa.binary()))})

    return run


def common_grams(docs: DataFrame, n: int = WORDS) -> Broadcast:
    """``Classes`` of all n-grams of ``docs`` (text): a table of at most ``TABLE`` bits for the first class and an eighth of that for
    each other one. Every n-gram of every text is counted; what travels is four bytes for each."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = min(max(1 << (volume // (32 << 20)).bit_length(), 8), 512)
    size = min(max(1 << (volume // 4).bit_length(), 1 << 16), TABLE)
    sizes = [size] + [size // 8] * (len(COMMON) - 1)
    found = docs.select("text").mapInArrow(_marks(n, slices), "slice int, data binary").groupBy("slice") \
        .applyInArrow(_mapped(slices, sizes), "slice int, maps array<binary>").toArrow()
    maps = [np.zeros(x // 8, np.uint8) for x in sizes]
    for part, own in zip(found.column("slice").to_pylist(), found.column("maps"), strict=True):
        for bits, data in zip(maps, own.values, strict=True):
            width = len(bits) // slices
            bits[part * width:(part + 1) * width] = np.frombuffer(data.as_buffer(), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(Classes(maps))


def bitmap(found: np.ndarray) -> np.ndarray:
    """Bits of the hashes, at least two for each; the width is a power of two, so halves can be folded."""
    width = 64
    while width < 2 * len(found) and width < 1 << 16:
        width *= 2
    on = np.zeros(width, bool)
    on[((found >> U64(40)) % U64(width)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").view(U64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _profiles(n: int, percent: int, common: Broadcast | None):
    """``common`` is from ``common_grams``, for a threshold below ``PARTED``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(percent) if common is None else None
        for whole in batches:
            for batch in pieces(whole):
                sizes, digests, lists, maps = [], [], [], []
                for found in shingle_sets(batch.column("text"), n):
                    own = keys.of(found) if common is None else rare_keys(found, common.value.of(found), percent)
                    sizes.append(len(found))
                    digests.append(digest(found))
                    lists.append(own.view(np.int64))
                    maps.append(None if common is None or not len(own) else bitmap(found).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(lists, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                    ["key", "n", "digest", "keys", "bits"])

    return run


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _frequent_keys(k: int):
    """Misra-Gries over arrays of keys, as in ``exact_dedup``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own, times = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, times]), len(keys)).astype(np.int64)
            if len(keys) > k:
                counts = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["value", "times"])

    return run


def stars(rows: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(a, b): the smallest row of each key with every other. ``rows``: row, keys (array of longs)."""
    busy = cut(rows.select("keys").mapInArrow(_frequent_keys(k), "value long, times long").groupBy("value")
               .agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "value").limit(k).select("value"))
    single = rows.select("row", F.explode("keys").alias("value"))
    # At most k keys of eight bytes, and as many smallest rows: the size of both broadcasts is fixed.
    hot = single.join(F.broadcast(busy), "value")
    first = cut(hot.groupBy("value").agg(F.min("row").alias("first")))
    rest = single.join(F.broadcast(busy), "value", "left_anti") \
        .withColumn("first", F.min("row").over(Window.partitionBy("value")))
    return hot.join(F.broadcast(first), "value").select(F.col("first").alias("a"), F.col("row").alias("b")) \
        .where("a < b").unionByName(rest.where("first < row").select(
            F.col("first").alias("a"), F.col("row").alias("b")))


class Tile:
    """Sets side by side, in order of size. ``sets`` is a list of sorted hash arrays."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        maps = [bitmap(s) for s in sets]
        self._arrange([len(s) for s in sets], maps)
        self.sets = [sets[i] for i in self.order]

    def _arrange(self, sizes: list[int], maps: list[np.ndarray]) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = np.array(sizes, np.int64)[self.order]
        words = min(map(len, maps))
        self.bits = np.array([fold(maps[i], words) for i in self.order])
        self.on = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)

    def may_link(self, i: int, start: int, stop: int) -> np.ndarray:
        """Those of the sets from ``start`` to ``stop`` that set i may link with: each bit that is on in one
        bitmap only stands for at least one member that the other set lacks, which bounds the overlap."""
        both = np.bitwise_count(self.bits[start:stop] & self.bits[i]).sum(axis=1, dtype=np.int64)
        mine, theirs = self.sizes[i], self.sizes[start:stop]
        bound = both + np.minimum(mine - self.on[i], theirs - self.on[start:stop])
        return np.flatnonzero((100 + self.percent) * bound >= self.percent * (mine + theirs)) + start

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        overlap = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * overlap >= self.percent * (len(a) + len(b) - overlap)

    def links(self, apart: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join components. ``apart`` has the component of each set so far; ``sides``, where given,
        is true for sets that are compared with the others only."""
        out, group = [], apart[self.order]
        sides = None if sides is None else sides[self.order]
        stops = np.searchsorted(self.sizes, self.sizes * 100 // self.percent, "right").tolist()
        for i, stop in enumerate(stops):
            if stop == i + 1:
                continue
            for j in self.may_link(i, i + 1, stop).tolist():
                if group[j] != group[i] and (sides is None or sides[j] != sides[i]) and self.linked(i, j):
                    out.append((int(self.order[i]), int(self.order[j])))
                    group[group == group[j]] = group[i]
        return out


class BitTile(Tile):
    """Bitmaps and sizes alone; pairs that pass the bound count as links."""

    def __init__(self, sizes: list[int], maps: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        self._arrange(sizes, maps)

    def linked(self, i: int, j: int) -> bool:
        return True


def _bit_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        tiles: dict[int, list[tuple]] = {}
        columns = [table.column(c).to_pylist() for c in ("tile", "node", "n", "side", "bits")]
        for tile, *rest in zip(*columns, strict=True):
            tiles.setdefault(tile, []).append(rest)
        a, b = [], []
        for rows in tiles.values():
            nodes, sizes, sides, bits = zip(*sorted(rows, key=lambda r: r[0]), strict=True)
            tile = BitTile(list(sizes), [np.frombuffer(x, U64) for x in bits], percent)
            for i, j in tile.links(np.arange(len(nodes)), None if sides[0] is None else np.array(sides)):
                a.append(nodes[i])
                b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def size_band(percent: int) -> Column:
    """Bands of ``n`` that span the threshold: sets of bands that are not neighbours never link."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")


def bounded(sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all sets (node, cluster, n, bits) of a cluster that may link by the bound.

    A cluster of more than ``tile`` sets is cut into tiles of one band each; those of the same or neighbouring
    bands meet in pairs. What moves is a bitmap, of two to four bits for each member of a set.
    """
    sizes = cut(sets.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1"))
    placed = cut(sets.join(sizes, "cluster").withColumn("band", size_band(percent)))
    many = placed.where(F.col("size") <= tile).count() // tile + 1
    side = F.lit(None).cast("boolean").alias("side")
    small = placed.where(F.col("size") <= tile).select(
        F.pmod(F.xxhash64("cluster"), F.lit(many)).alias("task"), F.col("cluster").alias("tile"), "node", "n", side, "bits")
    large = placed.where(F.col("size") > tile)
    counts = cut(large.groupBy("cluster", "band").agg(F.ceil(F.count("*") / tile).alias("slots")))
    dealt = large.join(counts, ["cluster", "band"]).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")))
    tiles = counts.select("cluster", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    one, two = (tiles.select("cluster", F.struct("band", "slot").alias(x)) for x in ("one", "two"))
    # One row per pair of tiles.
    pairs = cut(one.join(two, "cluster").where((F.col("one") <= F.col("two")) & (F.col("two.band") - F.col("one.band") <= 1)))
    sides = pairs.select("cluster", "one", "two", F.explode(F.when(
        F.col("one") == F.col("two"), F.array(F.struct(F.col("one").alias("at"), side)))
        .otherwise(F.array(*(F.struct(F.col(x).alias("at"), F.lit(x == "two").alias("side")) for x in ("one", "two"))))).alias("x"))
    sides = cut(sides.select("cluster", F.xxhash64("cluster", "one", "two").alias("tile"), F.col("x.at.band").alias("band"),
                             F.col("x.at.slot").alias("slot"), F.col("x.side").alias("side")))
    paired = dealt.join(sides, ["cluster", "band", "slot"]).select(F.col("tile").alias("task"), "tile", "node", "n", "side", "bits")
    return small.unionByName(paired).groupBy("task").applyInArrow(_bit_links(percent), "a long, b long")


def _tile_links(percent: int):
    """For sets grouped in tasks: links inside each tile."""
    def run(table: pa.Table) -> pa.Table:
        tiles: dict[tuple, dict[int, tuple]] = {}
        columns = [table.column(c).to_pylist() for c in ("cluster", "tile", "node", "label", "side", "hashes")]
        for cluster, tile, node, label, side, hashes in zip(*columns, strict=True):
            tiles.setdefault((cluster, tile), {}).setdefault((node, side), (label, side, np.frombuffer(hashes, U64)))
        a, b = [], []
        for rows in tiles.values():
            nodes, values = [node for node, _ in rows], list(rows.values())
            labels = np.array([v[0] for v in values])
            sides = None if values[0][1] is None else np.array([v[1] for v in values])
            for i, j in Tile([v[2] for v in values], percent).links(labels, sides):
                a.append(nodes[i])
                b.append(nodes[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _link(sets: DataFrame, percent: int, task: Column) -> DataFrame:
    for name, kind in (("label", "long"), ("side", "boolean")):
        if name not in sets.columns:
            sets = sets.withColumn(name, (F.col("node") if name == "label" else F.lit(None)).cast(kind))
    return sets.select(task.alias("task"), "cluster", "tile", "node", "label", "side", "hashes") \
        .groupBy("task").applyInArrow(_tile_links(percent), "a long, b long")


def _sets(n: int, check):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                texts = batch.column("text").to_pylist()
                found = shingle_sets(batch.column("text"), n)
                same = pa.array([check(t, f) == d for t, f, d in
                                 zip(texts, found, batch.column("digest").to_pylist(), strict=True)])
                hashes = pa.array([f.tobytes() for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cluster"), batch.column("node"), batch.column("tiles"), hashes],
                    ["cluster", "node", "tiles", "hashes"]).filter(same)

    return run


def filled(tile: int, members: int) -> Column:
    """Aggregate: the number of tiles that sets of ``n`` members fill."""
    return F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / members))


def labels_of(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``label``: the component of the node, or itself."""
    return nodes.join(found.select("node", F.col("component").alias("label")), "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))


def join_classes(docs: DataFrame, classes: DataFrame, n: int = WORDS, percent: int = PERCENT,
                 tile: int = TILE, members: int = MEMBERS, check=lambda text, found: digest(found)) -> DataFrame:
    """Links that connect the classes (cluster, node, id, digest, n, tiles) of clusters as all links would.

    ``docs`` (id, text) is read once more, for the texts of these classes alone; ``check`` (text, set) makes
    the digest that tells texts with one id apart. ``tiles`` is the number of tiles that the sets of the cluster
    fill, by ``n``, their sizes or a little more.
    """
    wanted = cut(classes)
    # Classes of clusters are a steady share of all rows, so this join moves texts at any size of the input.
    texts = wanted.hint("merge").join(docs, wanted["id"].eqNullSafe(docs["id"])).select(
        "cluster", "node", "digest", "tiles", "text")
    sets = cut(texts.mapInArrow(_sets(n, check), "cluster long, node long, tiles long, hashes binary")
               .withColumn("large", F.col("tiles") > 1).withColumn("n", (F.length("hashes") / 8).cast("long"))
               .withColumn("band", size_band(percent)))
    load = wanted.where("tiles = 1").agg(F.count("*"), F.sum("n")).first()
    tasks = max(load[0] // tile, (load[1] or 0) // members) * 2 + 1
    small = sets.where("not large").withColumn("tile", F.lit(0).cast("long"))
    links = [cut(_link(small, percent, F.pmod(F.xxhash64("cluster"), F.lit(tasks))))]
    if wanted.where("tiles > 1").isEmpty():
        return links[0]

    def slots(rows: DataFrame, *keys: str) -> DataFrame:
        """Add ``tile``, so that no tile of a cluster has much more than its share of the rows."""
        counts = cut(rows.groupBy(*keys).agg(filled(tile, members).alias("many")))
        slot = F.pmod(F.xxhash64("node"), F.col("many"))
        return rows.join(counts, list(keys)).withColumn(
            "tile", slot if keys == ("cluster",) else F.col("band").cast("long") * (1 << 32) + slot)

    large = sets.where("large")
    nodes = cut(slots(large.select("cluster", "node", "band", "n"), "cluster", "band").drop("many"))
    links.append(cut(_link(large.join(nodes.select("node", "tile"), "node"), percent, F.xxhash64("cluster", "tile"))))
    while True:
        labels = cut(labels_of(nodes, components(reduce(DataFrame.unionByName, links))))
        heads = cut(slots(labels.where("label = node").drop("tile"), "cluster"))
        links.append(cut(_link(large.join(heads.select("node", "tile", "label"), "node"), percent,
                               F.xxhash64("cluster", "tile"))))
        if heads.where("many > 1").isEmpty() or links[-1].isEmpty():
            break
    labels = cut(labels_of(nodes, components(reduce(DataFrame.unionByName, links))))
    main = cut(labels.groupBy("cluster", "label").count().groupBy("cluster")
               .agg(F.max_by("label", F.struct("count", "label")).alias("main")))
    outside = cut(slots(labels.join(main, "cluster").where("label != main").select("cluster", "node", "label", "band", "n"),
                        "cluster").withColumnRenamed("tile", "chunk"))
    if outside.isEmpty():
        return reduce(DataFrame.unionByName, links)
    # Tiles and chunks of a cluster, one row each: what is repeated is a tile's sets, once for each chunk
    # of sets that stayed apart in it and may reach its band.
    chunks = cut(outside.groupBy("cluster", "chunk", "band").agg(F.lit(1).alias("one")))
    tiles = cut(labels.groupBy("cluster", "tile", "band").agg(F.lit(1).alias("one")))
    meets = cut(tiles.join(chunks.select("cluster", "chunk", F.col("band").alias("near")), "cluster")
                .where(F.abs(F.col("band") - F.col("near")) <= 1).select("cluster", "tile", "chunk", "band", "near"))
    one = labels.join(meets.select("cluster", "tile", "chunk").distinct(), ["cluster", "tile"]).select(
        "node", "label", "tile", "chunk", F.lit(False).alias("side"))
    other = outside.withColumnRenamed("band", "near").join(
        meets.select("cluster", "tile", "chunk", "near").distinct(), ["cluster", "chunk", "near"]).select(
        "node", "label", "tile", "chunk", F.lit(True).alias("side"))
    crossed = large.select("cluster", "node", "hashes").join(one.unionByName(other), "node") \
        .withColumn("tile", F.xxhash64("tile", "chunk"))
    links.append(cut(_link(crossed, percent, F.xxhash64("cluster", "tile"))))
    return reduce(DataFrame.unionByName, links)


def similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = WORDS,
            percent: int = PERCENT, tile: int = TILE, members: int = MEMBERS, k: int = COUNTERS,
            place_column: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, first, place.

    Rows link when ``100 * overlap >= percent * union`` of their sets of word n-grams; ``component_id`` is the
    smallest id reachable by links, null only where no row of the component has an id. ``first`` is true for
    one row of each component, one that has that id. Rows without words (null, empty or blank texts) have no
    shingles, link with nothing, and are all first. Rows that repeat an id are rows of their own; ``place`` is
    what ``place_column`` has for them (see ``places``), or null. Other columns are not read; an empty table gives
    an empty table.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    place = (F.lit(None) if place_column is None else F.col(place_column)).cast(PLACE).alias("place")
    key = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"),
                   F.monotonically_increasing_id().alias("row"), place)
    kind = docs.schema[id_column].dataType.simpleString()
    common = common_grams(rows, n) if percent < PARTED else None
    profiles = cut(docs.select(key.alias("key"), F.col(text_column).alias("text")).mapInArrow(
        _profiles(n, percent, common), f"key struct<none: boolean, id: {kind}, row: bigint, place: {PLACE}>, n long, digest binary, "
                               "keys array<long>, bits binary"))
    if common is not None:
        common.destroy()  # profiles are written
    marked = cut(settle(profiles.where("n > 0").select("key", "n", "digest"), k).select(
        "key", "n", "digest", F.col("first.row").alias("node"), F.col("first.id").alias("least")))
    heads = marked.where("key.row = node").select("node", "n", "digest", F.col("least").alias("id"))
    clusters = components(stars(profiles.where("size(keys) > 0").select(F.col("key.row").alias("row"), "keys"), k))
    if percent < PARTED:
        sets = heads.select("node", "n").join(clusters.select("node", F.col("component").alias("cluster")), "node") \
            .join(profiles.select(F.col("key.row").alias("node"), "bits"), "node")
        clusters = components(bounded(sets, percent, BITS_IN_A_TILE * tile))
    classes = cut(heads.join(clusters.select("node", F.col("component").alias("cluster")), "node"))
    sizes = cut(classes.groupBy("cluster").agg(F.count("*").alias("size"), filled(tile, members).alias("tiles"))
                .where("size > 1").drop("size"))
    labels = components(join_classes(rows, classes.join(sizes, "cluster"), n, percent, tile, members))
    # The smallest id of each component: ids and rows of its classes, of which there is at least one.
    named = cut(labels_of(heads.select("node", "id"), labels))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    groups = cut(named.groupBy("label").agg(best.alias("best")))
    final = cut(named.join(groups, "label").select("node", F.col("best.id").alias("component_id"),
                                                   (F.col("best.node") == F.col("node")).alias("leads")))
    linked = marked.join(final, "node").select(
        F.col("key.id").alias(id_column), F.col("n").alias("n_shingles"), "component_id",
        (F.col("leads") & (F.col("key.row") == F.col("node"))).alias("first"), F.col("key.place").alias("place"))
    alone = profiles.where("n = 0").select(
        F.col("key.id").alias(id_column), F.col("n").alias("n_shingles"), F.col("key.id").alias("component_id"),
        F.lit(True).alias("first"), F.col("key.place").alias("place"))
    return linked.unionByName(alone)


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``similar`` finds first in their components, with all their columns."""
    wide = placed(docs)
    texts = wide.select("place", F.col(f"doc.{id_column}").alias("id"), F.col(f"doc.{text_column}").alias("text"))
    dropped = similar(texts, "id", "text", place_column="place", **options).where("not first").select("place")
    return wide.join(dropped, "place", "left_anti").select("doc.*")
