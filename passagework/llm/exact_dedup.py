"""Exact deduplication with a split between frequent and ordinary texts.

A Misra-Gries summary finds the digests that may be frequent. They are counted exactly; the verified
winners are a table of bounded size, so rows of frequent texts are settled where they lie. All other
digests are rare enough for an ordinary shuffle: no group has more than ``2 n / (k + 1)`` of n rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.lineage import cut
from passagework.llm.places import placed

COUNTERS = 4096


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def trim(counts: dict, k: int) -> dict:
    """At most ``k`` counters: all fall by the size of the largest one that has to go."""
    if len(counts) <= k:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    rest = int(np.partition(values, len(values) - k - 1)[len(values) - k - 1])
    return {x: n - rest for x, n in counts.items() if n > rest}


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            for pair in batch.column(0).value_counts():
                digest = pair["values"].as_py()
                counts[digest] = counts.get(digest, 0) + pair["counts"].as_py()
            counts = trim(counts, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["digest", "n"])

    return run


def frequent(digests: DataFrame, k: int) -> DataFrame:
    """At most ``k`` digests, among them every one that is on more than ``2 n / (k + 1)`` rows.

    Summaries of partitions are added up. Each estimate is low by at most n / (k + 1), estimates sum
    to n at most, and so the k largest include all digests of that frequency.
    """
    parts = digests.select("digest").mapInArrow(_summaries(k), "digest binary, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest") \
        .limit(k).select("digest")


def settle(rows: DataFrame, k: int) -> DataFrame:
    """Add ``first`` (the row that stays) and ``size`` to staged rows with a digest and a key."""
    # At most k digests of 32 bytes each: the size of both broadcasts is fixed.
    suspects = cut(frequent(rows, k))
    winners = cut(rows.join(F.broadcast(suspects), "digest").groupBy("digest")
                  .agg(F.min("key").alias("first"), F.count("*").alias("size")))
    heavy = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti") \
        .withColumn("first", F.min("key").over(group)).withColumn("size", F.count("*").over(group))
    return heavy.unionByName(rest)


def _key(doc_id: Column) -> Column:
    """Order of rows with one text: smaller ids first, null last, then as they lie in the table."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"),
                    F.monotonically_increasing_id().alias("row"))


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                k: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows are copies of each other when their texts are equal after ``normalised``; a null text is
    empty. The smallest id stays; among rows that repeat it, one. A null id stays only in a group
    without any other, whose keep_id is then null. An empty table gives an empty table; other
    columns are not read.
    """
    rows = cut(docs.select(_key(F.col(id_column)).alias("key"),
                           F.unhex(F.sha2(normalised(F.col(text_column)), 256)).alias("digest")))
    return settle(rows, k).select(
        F.col("key.id").alias(id_column), F.col("first.id").alias("keep_id"),
        F.col("size").alias("group_size"), (F.col("key") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that ``mark_copies`` keeps, with all their columns.

    Rows are told apart by their places. Text is moved only where Spark finds the list of dropped
    rows too large to broadcast.
    """
    wide, doc_id = placed(docs), F.col(f"doc.{id_column}")
    key = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), "place")
    rows = cut(wide.select(key.alias("key"), F.unhex(F.sha2(normalised(F.col(f"doc.{text_column}")), 256)).alias("digest")))
    dropped = settle(rows, k).where(F.col("key") != F.col("first")).select(F.col("key.place").alias("place"))
    return wide.join(dropped, "place", "left_anti").select("doc.*")
