"""Substring deduplication: paragraphs that repeat, nearly or exactly, in other documents or the same one.

A paragraph is a line with at least ``LEAST`` words. Its word n-grams get MinHash values in bands, tuned so that
pairs at the threshold collide in some band almost surely. Colliding paragraphs form clusters, inside which exact
Jaccard similarities are computed in tiles (see ``jaccard_join``); components of verified links keep their first
paragraph and lose the others.

Repeats that do not fill such lines are found word for word by ``passages``; ``remove_repeats`` cuts both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.lineage import cut
from passagework.llm.components import components
from passagework.llm.exact_dedup import COUNTERS, settle
from passagework.llm.jaccard_join import MEMBERS, TILE, filled, grams, join_classes, labels_of, mix, split, stars, word_hashes
from passagework.llm.passages import cut_passages, passages
from passagework.llm.places import placed

WORDS, PERCENT, LEAST = 5, 80, 25
#: Chance that a pair at the threshold collides, and rows of a band.
RECALL, ROWS = 0.999, 3

U64 = np.uint64


def bands(percent: int, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` values that let a pair at the threshold collide with chance ``recall``."""
    n = 1
    while 1 - (1 - (percent / 100) ** rows) ** n < recall:
        n += 1
    return n


def band_keys(found: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, rows: int = ROWS) -> np.ndarray:
    """A row of ``n`` keys for each run of hashes from a start to its end, from the smallest values of the run
    under ``n * rows`` hash functions."""
    factors = mix(np.arange(1, n * rows + 1, dtype=U64)) | U64(1)
    # Runs are not empty; the added column lets the last one end at the end.
    values = np.pad(found, (0, 1))[None, :] * factors[:, None]
    least = mix(np.minimum.reduceat(values, np.stack([starts, ends], axis=1).reshape(-1), axis=1)[:, ::2])
    keys = np.repeat(np.arange(n, dtype=U64)[:, None], len(starts), axis=1)
    for i in range(rows):
        keys = mix(keys + least.reshape(n, rows, -1)[:, i])
    return keys.T


def paragraphs(text: str | None, least: int = LEAST) -> list[tuple[int, int, int, list[bytes]]]:
    """(index, start, end, words) of the lines with at least ``least`` words; places are code points."""
    out, at = [], 0
    for index, line in enumerate((text or "").split("\n")):
        words = split(line)
        if len(words) >= least:
            out.append((index, at, at + len(line), words))
        at += len(line) + 1
    return out


def sequence_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


#: Words whose n-grams are hashed together.
AT_ONCE = 20_000


def _profiles(n: int, many: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, spans, sizes, digests, keys = [], [], [], [], []
                waiting: list[np.ndarray] = []

                def flush(waiting=waiting, keys=keys) -> None:
                    if waiting:
                        lengths = np.array([len(h) for h in waiting])
                        starts = np.cumsum(lengths) - lengths
                        found = grams(np.concatenate(waiting), n)
                        keys.append(band_keys(found, starts, starts + lengths - n + 1, many))
                        waiting.clear()

                held = 0
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for index, start, end, words in paragraphs(text, least):
                        hashes = word_hashes(words)
                        rows.append(row)
                        spans.append((index, start, end))
                        sizes.append(len(words) - n + 1)
                        digests.append(sequence_digest(hashes))
                        waiting.append(hashes)
                        held += len(words)
                        if held > AT_ONCE:
                            flush()
                            held = 0
                flush()
                columns = [pa.array([s[i] for s in spans], pa.int64()) for i in range(3)]
                flat = np.concatenate([*keys, np.zeros((0, many), U64)]).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * many, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(rows, pa.int64())), *columns, pa.array(sizes, pa.int64()),
                     pa.array(digests, pa.binary()), lists],
                    ["doc", "index", "start", "end", "n", "digest", "keys"])

    return run


def _texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows, indexes, texts = [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    for index, start, end, _ in paragraphs(text, least):
                        rows.append(row)
                        indexes.append(index)
                        texts.append(text[start:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(indexes, pa.int64()),
                     pa.array(texts, pa.string())], ["doc", "index", "text"])

    return run


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = WORDS,
            percent: int = PERCENT, least: int = LEAST, tile: int = TILE, members: int = MEMBERS,
            k: int = COUNTERS) -> DataFrame:
    """One row per paragraph that repeats: id, paragraph, start, end, keep_id, keep_paragraph, copies, kept.

    ``paragraph`` is the index of the line, ``start`` and ``end`` are code points. Paragraphs link when the Jaccard
    similarity of their word ``n``-grams is at least ``percent`` in a hundred; of each component the one with the
    smallest (id, paragraph) is kept, a null id coming last, and ``copies`` is its size. Documents without
    such paragraphs (null and empty ones too) are not in the result. Rows that repeat an id are documents of their
    own. Other columns are not read; an empty table gives an empty table.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    found = cut(rows.mapInArrow(_profiles(n, bands(percent), least),
                                f"doc {kind}, index long, start long, end long, n long, digest binary, keys array<long>")
                .select(F.struct(F.col("doc").isNull().alias("none"), "doc", "index",
                                 F.monotonically_increasing_id().alias("row")).alias("key"),
                        "start", "end", "n", "digest", "keys"))
    marked = cut(settle(found.select("key", "n", "digest"), k).select(
        "key", "n", "digest", "size", "first", F.col("first.row").alias("node")))
    heads = marked.where("key.row = node").select("node", "n", "digest", "size", "first")
    clusters = components(stars(found.select(F.col("key.row").alias("row"), "keys"), k))
    classes = cut(heads.select("node", "n", "digest", F.struct("first.doc", "first.index").alias("id"))
                  .join(clusters.select("node", F.col("component").alias("cluster")), "node"))
    sizes = cut(classes.groupBy("cluster").agg(F.count("*").alias("size"), filled(tile, members).alias("tiles"))
                .where("size > 1").drop("size"))
    lines = rows.mapInArrow(_texts(least), f"doc {kind}, index long, text string").select(
        F.struct("doc", "index").alias("id"), "text")
    labels = components(join_classes(lines, classes.join(sizes, "cluster"), n, percent, tile, members,
                                     lambda text, _: sequence_digest(word_hashes(split(text)))))
    named = cut(labels_of(heads, labels))
    groups = cut(named.groupBy("label").agg(F.min("first").alias("best"), F.sum("size").alias("copies"))
                 .where("copies > 1"))
    final = cut(named.join(groups, "label").select("node", "best", "copies"))
    spans = found.select(F.col("key.row").alias("row"), "start", "end")
    hits = cut(marked.join(final, "node").select("key", "best", "copies", F.col("key.row").alias("row")))
    return hits.join(spans, "row").select(
        F.col("key.doc").alias(id_column), F.col("key.index").alias("paragraph"), "start", "end",
        F.col("best.doc").alias("keep_id"), F.col("best.index").alias("keep_paragraph"), "copies",
        (F.col("key") == F.col("best")).alias("kept"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these lines, each with the line end behind or, at the end of the text, before it."""
    lines, at = [], 0
    gone = {start for start, _ in spans}
    for line in text.split("\n"):
        if at not in gone:
            lines.append(line)
        at += len(line) + 1
    return "\n".join(lines)


def remove_repeats(docs: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs``; paragraphs that ``repeats`` finds and does not keep are cut from the text,
    and of what is left then all ``passages``.

    A text without such paragraphs and passages stays as it is, a null text null.
    """
    wide = placed(docs).withColumnRenamed("place", "row")
    texts = wide.select("row", F.col(f"doc.{text_column}").alias("text"))
    # Documents are told apart by their places here, so of equal paragraphs the first by place stays.
    lines = repeats(texts, "row", "text", **options).where("not kept")
    # Lines are cut before passages are looked for, so that no two of them each rely on the other to stay.
    left = cut(_without(wide.withColumn("text", F.col(f"doc.{text_column}")), lines, cut_out))
    done = _without(left, passages(left, "row", "text"), cut_passages)
    return done.select(*(F.col("text").alias(c) if c == text_column else F.col("doc").getField(c).alias(c)
                         for c in docs.columns))


def _without(rows: DataFrame, found: DataFrame, cutter) -> DataFrame:
    """Rows (doc, row, text) with the spans (row, start, end) cut from their texts."""
    spans = found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    @F.arrow_udf(T.StringType())
    def without(text: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array([x if x is None or not s else cutter(x, [(y["start"], y["end"]) for y in s])
                         for x, s in zip(text.to_pylist(), gone.to_pylist(), strict=True)], pa.string())

    return rows.join(spans, "row", "left").select("doc", "row", without(F.col("text"), F.col("spans")).alias("text"))
