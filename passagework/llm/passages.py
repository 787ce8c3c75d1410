"""Passages that repeat word for word, whatever the line breaks and the text around them.

A window is a run of ``LEAST`` words of a text. Its anchor is the smallest hash among its shorter runs of words, so
equal windows have equal anchors wherever they lie, and neighbouring windows mostly share one. Anchors that are in
one place only are passed over: of their windows none can repeat. The windows of the others are grouped by their own
hash, and those that are not the first of their group are put together again to passages. No repeated window is missed.

Anchors that repeat are told by a table of bits of bounded size, so no text moves; where bits are shared by chance, a
window is hashed in vain. Neighbouring windows with one anchor travel as one row. Busy anchors are cut into windows,
and busy windows are settled by a broadcast, as in ``exact_dedup``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.lineage import cut
from passagework.llm.exact_dedup import COUNTERS
from passagework.llm.jaccard_join import _frequent_keys, mix, split, word_hashes

#: Words of a window. Runs of half as many are candidates for its anchor.
LEAST = 50
#: Bits for each anchor that repeats, and bits at most (as powers of two).
BITS, MOST_BITS = 16, 29
#: Bits that one row of the table holds.
CHUNK = 1 << 15
#: Words that are hashed together.
AT_ONCE = 100_000

U64 = np.uint64
FACTOR = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd factor and of its inverse modulo 2 ** 64, as many as were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            many = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(many - 1, x, U64)]))
                                  for x in (U64(FACTOR), U64(pow(FACTOR, -1, 1 << 64))))


POWERS = Powers()


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words, in time that does not depend on ``k``."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    POWERS.grow(n)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * POWERS.up[:n])])
    return mix((sums[k:] - sums[:-k]) * POWERS.down[:n - k + 1])


def sliding(best: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """The minimum or maximum of every ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x, span = best(x[:-span], x[span:]), 2 * span
    rest = width - span
    return best(x[:len(x) - rest], x[rest:]) if rest else x


def anchors(hashes: np.ndarray, owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchors) of the windows that lie in one text, and the anchors of all places that are one."""
    half = least // 2
    short, width = runs(hashes, half), least - half + 1
    smallest = sliding(np.minimum, short, width)
    inside = owners[:len(smallest)] == owners[least - 1:]
    smallest = np.where(inside, smallest, U64(0))
    around = np.pad(smallest, (width - 1, width - 1))
    place = (sliding(np.maximum, around, width)[:len(short)] == short) & (short > 0)
    starts = np.flatnonzero(inside)
    return starts, smallest[starts], short[place]


def _slices(batches: Iterator[pa.RecordBatch], least: int):
    """(batch, row and hash of every word, texts) for parts of the batches."""
    for whole in batches:
        texts, rows, found, held = whole.column("text").to_pylist(), [], [], 0
        for row, text in enumerate(texts):
            words = split(text)
            if len(words) >= least:
                rows.append((row, len(words)))
                found.append(word_hashes(words))
                held += len(words)
            if found and (held > AT_ONCE or row == len(texts) - 1):
                yield whole, texts, np.repeat(*np.array(rows).T), np.concatenate(found)
                rows, found, held = [], [], 0
        if found:
            yield whole, texts, np.repeat(*np.array(rows).T), np.concatenate(found)


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, owners, hashes in _slices(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(hashes, owners, least)[2].view(np.int64))], ["value"])

    return run


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of ``split``, in code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    edge = np.diff(np.pad((~SPACE[data]).astype(np.int8), 1))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]


def _packed(table: pa.Table) -> pa.Table:
    on = np.zeros(CHUNK, bool)
    on[table.column("bit").to_numpy()] = True
    return pa.table({"chunk": table.column("chunk")[:1], "bits": [np.packbits(on, bitorder="little").tobytes()]})


def _bits(repeated: DataFrame) -> np.ndarray:
    """A bit for every value, told by its lowest binary digits; at most 64 MB on the driver and in each worker."""
    size = CHUNK
    while size < BITS * repeated.count() and size < 1 << MOST_BITS:
        size *= 2
    spot = F.col("value").bitwiseAND(F.lit(size - 1))
    rows = repeated.select((spot / CHUNK).cast("int").alias("chunk"), (spot % CHUNK).cast("int").alias("bit")).distinct() \
        .groupBy("chunk").applyInArrow(_packed, "chunk int, bits binary").toArrow()
    bits = np.zeros((size // CHUNK, CHUNK // 8), np.uint8)
    for chunk, packed in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        bits[chunk] = np.frombuffer(packed, np.uint8)
    return bits.reshape(-1)


def _small(x: np.ndarray) -> bytes:
    """Steps between ascending numbers, one byte each if they fit, else four."""
    steps = np.diff(x)
    return steps.astype(np.uint8 if steps.max(initial=0) < 256 else np.uint32).tobytes()


def _full(first: int, steps: bytes, n: int) -> np.ndarray:
    known = np.frombuffer(steps, np.uint8 if len(steps) == n - 1 else np.uint32)
    return first + np.concatenate([np.zeros(1, np.int64), np.cumsum(known, dtype=np.int64)])


PACKED = "anchor long, at long, n long, start long, end long, opens binary, closes binary, hashes binary"


def _blocks(least: int, shared):
    """Windows in a row with one anchor that may repeat, as one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, texts, owners, hashes in _slices(batches, least):
            starts, smallest, _ = anchors(hashes, owners, least)
            spot = (smallest & U64(8 * len(bits) - 1)).astype(np.int64)
            on = (bits[spot >> 3] >> (spot & 7)) & 1 == 1
            starts, smallest = starts[on], smallest[on]
            if not len(starts):
                continue
            values, rows = runs(hashes, least)[starts], owners[starts]
            first = starts - np.searchsorted(owners, rows)  # in its text
            begin, end = np.zeros((2, len(starts)), np.int64)
            for row in np.unique(rows).tolist():
                a, b = np.searchsorted(rows, [row, row + 1])
                opens, closes = places(texts[row])
                begin[a:b], end[a:b] = opens[first[a:b]], closes[first[a:b] + least - 1]
            edges = np.flatnonzero((np.diff(starts) != 1) | (np.diff(rows) != 0) | (smallest[1:] != smallest[:-1])) + 1
            heads, tails = np.concatenate([[0], edges]), np.concatenate([edges, [len(starts)]])
            spans = list(zip(heads.tolist(), tails.tolist(), strict=True))
            numbers = [smallest[heads].view(np.int64), first[heads], tails - heads, begin[heads], end[heads]]
            packed = [[f(x[a:b]) for a, b in spans] for f, x in ((_small, begin), (_small, end), (np.ndarray.tobytes, values))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(rows[heads])), *map(pa.array, numbers),
                 *(pa.array(x, pa.binary()) for x in packed)],
                ["key", "anchor", "at", "n", "start", "end", "opens", "closes", "hashes"])

    return run


def _unpacked(table) -> tuple[np.ndarray, ...]:
    """(block, hash, at, start, end) of every window."""
    many, at, start, end = (np.array(table.column(c).to_pylist(), np.int64) for c in ("n", "at", "start", "end"))
    block = np.repeat(np.arange(len(many)), many)
    inside = np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many)
    opens, closes = (np.concatenate([_full(x, y, n) for x, y, n in zip(
        one.tolist(), table.column(c).to_pylist(), many.tolist(), strict=True)])
        for one, c in ((start, "opens"), (end, "closes")))
    return block, np.frombuffer(b"".join(table.column("hashes").to_pylist()), U64), at[block] + inside, opens, closes


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2_000):
            part = whole.slice(at, 2_000)
            block, values, *numbers = _unpacked(part)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(block)), pa.array(values.view(np.int64)), *map(pa.array, numbers)],
                ["key", "value", "at", "start", "end"])


def _later(least: int):
    """For whole anchors: runs of windows that are not first, with the places of the first."""
    def run(table: pa.Table) -> pa.Table:
        def plain(x):
            return tuple(x.values()) if isinstance(x, dict) else x

        keys = [(k["none"], plain(k["doc"]), k["row"]) for k in table.column("key").to_pylist()]
        ats = table.column("at").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (*keys[i], ats[i]))
        table = table.take(pa.array(order, pa.int64()))
        block, values, at, start, end = _unpacked(table)
        rows = np.array([keys[i][2] for i in order], np.int64)[block]
        _, first, group, many = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        first, copies = first[group], many[group]
        w = np.flatnonzero((rows != rows[first]) | (at >= at[first] + least))
        f = first[w]
        same = (np.diff(rows[w]) == 0) & (np.diff(at[w]) == 1) & (np.diff(rows[f]) == 0) & (np.diff(at[f]) == 1)
        heads = np.concatenate([np.zeros(min(1, len(w)), np.int64), np.flatnonzero(~same) + 1])
        tails = np.concatenate([heads[1:], [len(w)]])[:len(heads)]
        a, b, last = w[heads], f[heads], w[tails - 1]
        most = np.maximum.reduceat(copies[w], heads) if len(heads) else heads
        docs = pc.struct_field(table.column("key"), "doc")
        return pa.table({
            "row": rows[a], "doc": docs.take(pa.array(block[a])), "at": at[a], "n": tails - heads, "start": start[a],
            "end": end[last], "copies": most, "keep": rows[b], "keep_id": docs.take(pa.array(block[b])),
            "keep_start": start[b], "shift": at[b] - at[a]})

    return run


def _busy(keys: DataFrame, column: str, k: int) -> DataFrame:
    """At most ``k`` values, among them all that are on very many rows."""
    return cut(keys.select(F.array(column).alias("keys")).mapInArrow(_frequent_keys(k), "value long, times long")
               .groupBy("value").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "value").limit(k)
               .select(F.col("value").alias(column)))


#: Windows whose anchors are settled in one task.
TASK = 500_000


def passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST,
             k: int = COUNTERS) -> DataFrame:
    """One row per passage that repeats an earlier one: id, start, end, words, keep_id, keep_start, copies.

    Texts are sequences of words between ASCII white space, with A-Z in lower case. Each run of ``least`` words that
    is also somewhere before, in a text of a smaller id (null last) or in the same text without sharing a word with
    it, is part of a passage, and nothing else is. Runs in a row whose first places are in a row too are one passage;
    passages of a text can overlap. ``start``, ``end`` and ``keep_start`` are code points; ``copies`` is the largest
    number of places of one of its runs. Rows that repeat an id are documents of their own. Other columns are not
    read; an empty table gives an empty table.
    """
    kind, spark = docs.schema[id_column].dataType.simpleString(), docs.sparkSession
    key = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("doc"),
                   F.monotonically_increasing_id().alias("row")).alias("key")
    rows = docs.select(key, F.col(text_column).alias("text"))
    repeated = cut(rows.select("text").mapInArrow(_anchors(least), "value long").groupBy("value")
                   .agg(F.count("*").alias("n")).where("n > 1").select("value"))
    shared = spark.sparkContext.broadcast(_bits(repeated))
    blocks = cut(rows.mapInArrow(_blocks(least, shared), f"key struct<none: boolean, doc: {kind}, row: bigint>, {PACKED}"))
    # All windows of an anchor meet in one task, but for busy anchors, whose windows are dealt by their own hashes.
    anchor = _busy(blocks, "anchor", k)
    windows = cut(blocks.join(F.broadcast(anchor), "anchor").select("key", "at", "n", "start", "end", "opens", "closes", "hashes")
                  .mapInArrow(_windows, f"key struct<none: boolean, doc: {kind}, row: bigint>, value long, at long, "
                                        "start long, end long"))
    tasks = (blocks.agg(F.sum("n")).first()[0] or 0) // TASK + 1
    quiet = blocks.join(F.broadcast(anchor), "anchor", "left_anti") \
        .groupBy(F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task")).applyInArrow(
            _later(least), f"row long, doc {kind}, at long, n long, start long, end long, copies long, keep long, "
                           f"keep_id {kind}, keep_start long, shift long")
    value = _busy(windows, "value", k)
    place = F.struct("key.none", "key.doc", "key.row", "at", "start")
    # At most k values, and as many first places: the size of both broadcasts is fixed but for the ids.
    winners = cut(windows.join(F.broadcast(value), "value").groupBy("value")
                  .agg(F.min(place).alias("first"), F.count("*").alias("copies")))
    group = Window.partitionBy("value")
    rest = windows.join(F.broadcast(value), "value", "left_anti") \
        .withColumn("first", F.min(place).over(group)).withColumn("copies", F.count("*").over(group))
    later = windows.join(F.broadcast(winners), "value").unionByName(rest).where(
        (F.col("key.row") != F.col("first.row")) | (F.col("at") >= F.col("first.at") + least)).select(
        F.col("key.row").alias("row"), "key.doc", "at", F.lit(1).cast("long").alias("n"), "start", "end", "copies",
        F.col("first.row").alias("keep"), F.col("first.doc").alias("keep_id"), F.col("first.start").alias("keep_start"),
        (F.col("first.at") - F.col("at")).alias("shift"))
    pair = ["row", "keep", "shift"]
    before = Window.partitionBy(*pair).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = quiet.unionByName(later).withColumn("island", F.col("at") + F.col("n") - F.sum("n").over(before))
    return islands.groupBy(*pair, "island").agg(
        F.first("doc").alias("doc"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.sum("n") + least - 1).alias("words"), F.first("keep_id").alias("keep_id"),
        F.min("keep_start").alias("keep_start"), F.max("copies").alias("copies")).select(
        F.col("doc").alias(id_column), "start", "end", "words", "keep_id", "keep_start", "copies")


def cut_passages(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the code points of these spans, which may overlap."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:max(at, start)])
        at = max(at, end)
    return "".join([*out, text[at:]])
