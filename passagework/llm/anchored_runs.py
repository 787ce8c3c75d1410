"""Repeated runs of words inside lines or across them, found at places that the words themselves choose.

A word is an anchor where the hash of the three words from it is the least of its surroundings, so a passage has the same
anchors wherever it stands, whatever the line breaks and the text around it. The stretches before and behind an
anchor are compared as wholes; stretches that touch or overlap become one span. Every word is covered by the
surroundings of some anchor, so a passage of 50 words misses all stretches only where it has no anchor inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.lineage import cut
from passagework.llm.jaccard_join import grams, mix, word_hashes

#: An anchor is the least of so many words on either side.
REACH = 10
#: Words of a stretch, and how many of them lie before the anchor in its two stretches.
STRETCH, BEFORE = 32, (22, 10)

U64 = np.uint64
NONE = np.iinfo(U64).max
BASES = U64(0x9E3779B97F4A7C15) | U64(1), U64(0xD1B54A32D192ED03) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def least_around(values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the least value of the ``reach`` places before it, and of those behind it."""
    padded = np.pad(values, reach, constant_values=NONE)
    runs, size = padded, 1
    while size * 2 <= reach:
        runs, size = np.minimum(runs[:-size], runs[size:]), size * 2
    runs = np.minimum(runs[:len(padded) - reach + 1], runs[reach - size:reach - size + len(padded) - reach + 1])
    return runs[:len(values)], runs[reach + 1:reach + 1 + len(values)]


def anchors(hashes: np.ndarray, text: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Indexes of anchors among the words of several texts; ``text`` is the number of each word's text."""
    if len(hashes) < 3:
        return np.zeros(0, np.int64)
    three = np.full(len(hashes), NONE)
    three[:-2] = np.where(text[:-2] == text[2:], grams(hashes, 3), NONE)
    # Texts are set so far apart that none is in another's surroundings.
    at = np.arange(len(hashes)) + (text - text[0]) * reach
    apart = np.full(at[-1] + 1, NONE)
    apart[at] = three
    before, behind = least_around(apart, reach)
    return np.flatnonzero((three < before[at]) & (three <= behind[at]) & (three != NONE))


def run_digests(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Two numbers for each run of ``length`` words: sums of their hashes times powers of odd bases."""
    out = np.empty((2, len(starts)), np.int64)
    for i, base in enumerate(BASES):
        values = mix(hashes + U64(i + 1))
        total = np.zeros(len(starts), U64)
        for j in range(length):
            total = total * base + values[starts + j]
        out[i] = mix(total).view(np.int64)
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of its text, start, end) of each word; places are code points in its text."""
    raw = [t.encode() for t in texts]
    joined = b"\n".join(raw)
    code = np.frombuffer(joined, np.uint8)
    word = ~SPACE[code]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1] if raw else np.zeros(0, np.int64)
    text = np.searchsorted(begins, starts, "right") - 1
    points = np.concatenate([[0], np.cumsum((code & 0xC0) != 0x80)])
    offset = points[begins[text]] if len(text) else np.zeros(0, np.int64)
    return word_hashes(joined.lower().split()), text, points[starts] - offset, points[ends] - offset


def stretches(texts: list[str], reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start, end, digests) of all stretches around anchors."""
    hashes, text, starts, ends = words_of(texts)
    found = anchors(hashes, text, reach)
    # Two anchors may name one stretch.
    first = np.unique(np.concatenate([found - b for b in BEFORE]))
    last = first + STRETCH - 1
    inside = (first >= 0) & (last < len(hashes))
    first, last = first[inside], last[inside]
    inside = text[first] == text[last]
    first, last = first[inside], last[inside]
    return text[first], starts[first], ends[last], run_digests(hashes, first, STRETCH)


def _stretches(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                text, starts, ends, digests = stretches([t or "" for t in batch.column("text").to_pylist()], reach)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(text)), batch.column("doc").take(pa.array(text)), pa.array(starts), pa.array(ends),
                     pa.array(digests[0]), pa.array(digests[1])], ["row", "doc", "start", "end", "d1", "d2"])

    return run


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """One row per repeated run of words: id, start, end (code points), keep_id, copies, kept.

    A run is what repeated stretches of ``STRETCH`` words cover together; it may lie in one line or go over several.
    ``keep_id`` is the smallest id with one of its stretches, ``copies`` the largest number of places of one, and
    ``kept`` tells that it is this document's first place. A null or empty text, and one without repeated stretches, gives no
    row; a null id counts as the largest; rows that repeat an id are documents of their own; other columns are not
    read; an empty table gives an empty table. Letters A-Z count as a-z, and white space only divides words.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    found = cut(rows.mapInArrow(_stretches(reach), f"row long, doc {kind}, start long, end long, d1 long, d2 long"))
    places = found.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("doc").alias("keep"), F.min("row").alias("first"))
    # Copies are counted where they lie first, so a stretch that very many documents share is one row of each task.
    shared = cut(places.where("copies > 1"))
    hits = cut(found.join(shared, ["d1", "d2"]).select("row", "doc", "start", "end", "copies", "keep", "first"))
    order = Window.partitionBy("row").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    spans = hits.withColumn("fresh", fresh.cast("long")).withColumn("span", F.sum("fresh").over(order)).groupBy("row", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("keep").alias("keep"), F.max("copies").alias("copies"),
        F.min("first").alias("first"), F.first("doc").alias("doc"))
    return spans.select(F.col("doc").alias(id_column), "start", "end", F.col("keep").alias("keep_id"), "copies",
                        (F.col("first") == F.col("row")).alias("kept"))
