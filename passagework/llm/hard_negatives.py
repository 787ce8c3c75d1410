"""Hard-negative mining: for each anchor its nearest rows of the same label, and for each of these the nearest rows
of other labels whose score lies in a window below.

Anchors and candidates meet in tiles of whole numbers, multiplied by Strassen's method. A task keeps a heap for each
anchor, and then one for each window; heaps of tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.lineage import cut
from passagework.llm.strassen import multiply
from passagework.operators.grid import dealt, folded, meet, packed

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Whole numbers beyond this many become it, so that sums of a few thousand products fit a long.
LARGEST = 2 ** 26
#: Anchors and candidates of a tile, and groups of labels whose candidates are kept apart.
ANCHORS, CANDIDATES, GROUPS = 512, 4096, 16
#: Blocks of candidates that a task has on average, at most.
BLOCKS = 32


class Heaps:
    """The best entries of many slots: higher scores first, then smaller ids, then earlier rows."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.slot, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        #: A candidate needs at least this score to enter a full slot.
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        slot, score, id_, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, id_), (self.row, row)))
        by = np.lexsort((row, id_, ~score, slot))  # ~x falls as x rises
        slot, score, id_, row = slot[by], score[by], id_[by], row[by]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.size
        self.slot, self.score, self.id, self.row = slot[keep], score[keep], id_[keep], row[keep]
        full = place[keep] == self.size - 1
        self.least[self.slot[full]] = self.score[full]


def _offer(heaps: Heaps, slots: np.ndarray, scores: np.ndarray, open_: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Candidates of a tile, one line per slot, that may enter it."""
    open_ &= scores >= heaps.least[slots][:, None]
    if scores.shape[1] > heaps.size and np.count_nonzero(open_) > 16 * heaps.size * len(slots):
        # The k-th best of a line bounds what can stay; ties with it stay in.
        line = np.where(open_, scores, np.iinfo(np.int64).min)
        open_ &= scores >= np.partition(line, -heaps.size, axis=1)[:, -heaps.size][:, None]
    i, j = np.nonzero(open_)
    if len(i):
        heaps.add(slots[i], scores[i, j], ids[j], rows[j])


class _Rows:
    """Rows (id, label, row, x) of a block, by length of x."""

    def __init__(self, block: pa.RecordBatch):
        self.id, self.label, self.row = (block.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "row"))
        lists = block.column("x")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.by_length = {}
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            self.by_length[size] = at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)

    def tiles(self, other: "_Rows") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for size, (at, x) in self.by_length.items():
            if size in other.by_length:
                yield at, x, *other.by_length[size]


_FOUND = "anchor_row long, anchor_id long, slot int, score long, id long, row long"
_NAMES = ["anchor_row", "anchor_id", "slot", "score", "id", "row"]


class _Search:
    """Heaps of the slots of a block of anchors."""

    def __init__(self, block: pa.RecordBatch, slots: int, size: int):
        self.anchors, self.slots = _Rows(block), slots
        self.heaps = Heaps(len(self.anchors.id) * slots, size)

    def rows(self) -> Iterator[pa.RecordBatch]:
        h = self.heaps
        at, slot = h.slot // self.slots, h.slot % self.slots
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.anchors.row[at]), pa.array(self.anchors.id[at]), pa.array(slot.astype(np.int32)), pa.array(h.score),
             pa.array(h.id), pa.array(h.row)], _NAMES)


class _Positives(_Search):
    def __init__(self, block: pa.RecordBatch, size: int):
        super().__init__(block, 1, size)

    def add(self, block: pa.RecordBatch) -> None:
        mine, others = self.anchors, _Rows(block)
        for at, x, there, y in mine.tiles(others):
            for label in np.intersect1d(mine.label[at], others.label[there]):
                a, b = mine.label[at] == label, others.label[there] == label
                one, two = at[a], there[b]
                scores = multiply(x[a], y[b].T)
                open_ = mine.row[one][:, None] != others.row[two][None, :]
                _offer(self.heaps, one, scores, open_, others.id[two], others.row[two])


class _Negatives(_Search):
    def __init__(self, block: pa.RecordBatch, slots: int, size: int):
        super().__init__(block, slots, size)
        lists = block.column("windows").to_pylist()
        # Without a positive a slot's window is empty.
        self.low, self.high = np.ones((2, len(lists), slots), np.int64)
        self.high[:] = 0
        for i, scores in enumerate(lists):
            for j, p in enumerate(scores):
                # 50 p <= 100 s <= 95 p in whole numbers
                self.low[i, j], self.high[i, j] = -(-p // 2), p + -p // 20

    def add(self, block: pa.RecordBatch) -> None:
        mine, others = self.anchors, _Rows(block)
        for at, x, there, y in mine.tiles(others):
            scores = multiply(x, y.T)
            strange = mine.label[at][:, None] != others.label[there][None, :]
            for slot in range(self.slots):
                open_ = strange & (scores >= self.low[at, slot][:, None]) & (scores <= self.high[at, slot][:, None])
                _offer(self.heaps, at * self.slots + slot, scores, open_, others.id[there], others.row[there])


def _best(found: DataFrame, size: int) -> DataFrame:
    """Heaps of all tasks merged, with ``rank`` from 1."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry, as longs."""
    most = float(LARGEST)
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(
        F.greatest(F.lit(-most), F.least(F.lit(most), c * scale))).cast("long"))


def mine(vectors: DataFrame, anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding",
         label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
         anchors: int = ANCHORS, candidates: int = CANDIDATES) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    ``anchor`` marks the rows that are anchors; all rows are candidates. Entries become floor(256 x); a score is the
    whole-number inner product. An anchor's positives are its best ``positives`` other rows of its label, a
    positive's negatives the best ``negatives`` rows of other labels with 50 p <= 100 s <= 95 p; ties go to the
    smaller id, then to the row that comes first in the table. All where there are fewer.

    Rows with a null id or label, a null vector or a null or non-finite entry take no part. Only vectors of one length
    meet. Entries beyond 2^18 count as that. Rows that repeat an id are rows of their own, also as anchors and
    each other's positives; other columns are not read; an empty table gives an empty table.
    """
    label = F.col(label) if isinstance(label, str) else label
    entries = F.col(vector_column)
    rows = cut(vectors.select(
        F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"),
        F.monotonically_increasing_id().alias("row"), whole_numbers(entries).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
        .where(F.col(id_column).isNotNull() & label.isNotNull() & entries.isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(
            c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))))
    chosen = rows.where("anchor").drop("anchor")
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int").alias("group")
    # Products cost far more than moving blocks once: all cores get some, and no task more than a few dozen.
    blocks = -(-rows.count() // candidates)
    tasks = max(1, min(blocks, vectors.sparkSession.sparkContext.defaultParallelism), -(-blocks // BLOCKS))
    stored = cut(packed(rows.select("id", "label", "row", "x", group), candidates, key="group").repartition(tasks, "key", "data"))
    # Only groups of labels that an anchor has meet its block.
    queries = cut(packed(chosen.select("id", "label", "row", "x", group).repartition("group", F.pmod("row", F.lit(64))), anchors, key="group").select(
        "key", F.monotonically_increasing_id().alias("number"), F.col("data").alias("query")))
    first = folded(stored.join(queries, "key").select("number", "query", "data"), lambda b: _Positives(b, positives), _FOUND)
    found = cut(_best(first, positives).withColumn("slot", F.col("rank") - 1))
    windows = found.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"])
                                              .alias("windows"))
    wanted = cut(chosen.join(windows, F.col("row") == F.col("anchor_row")).drop("anchor_row"))
    second = folded(meet(stored, *dealt(wanted, "row", anchors)), lambda b: _Negatives(b, positives, negatives), _FOUND)
    return _best(second, negatives).select(
        "anchor_row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        found.select("anchor_row", "slot", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        ["anchor_row", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                       "positive_score", "negative_score")
