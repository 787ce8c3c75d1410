"""Dense numbers over a distributed table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.lineage import cut


def running_offsets(counts: DataFrame, key: str, n: str = "n", out: str = "offset") -> DataFrame:
    """Add the sum of ``n`` over all rows with a smaller ``key``.

    Rows are range-partitioned by key, so only the partition totals, one row each, are ever summed
    in a single place; inside a partition a window does the rest. The narrow table is written
    before, because ranges come from a sample that would compute it twice, and after, to pin them.
    """
    ranged = cut(cut(counts.select(key, n)).repartitionByRange(F.col(key))
                 .withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum(n).alias("total"))
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(below), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("local", F.coalesce(F.sum(n).over(before), F.lit(0)))
    # bases has one row per shuffle partition, whatever the size of the table.
    return local.join(F.broadcast(bases), "part").select(
        key, n, (F.col("base") + F.col("local")).alias(out))


def number_by_document(chunks: DataFrame) -> DataFrame:
    """Add ``ordinal`` and ``chunk_id``, counting chunks in (doc_id, chunk_index) order."""
    counts = chunks.where("chunk_index = 0").select(
        "doc_id", F.col("total_chunks").cast("long").alias("n"))
    offsets = running_offsets(counts, "doc_id")
    return _with_ids(chunks.join(offsets.select("doc_id", "offset"), "doc_id"),
                     F.col("offset") + F.col("chunk_index")).drop("offset")


def number_stored(scan: DataFrame, start: int = 0) -> DataFrame:
    """Add ``ordinal`` and ``chunk_id`` to rows read from parquet files, in stored order.

    Ordinal = rows in earlier files + position in the file. The shuffle moves one row per file;
    the rows themselves, with their text, stay where they are. The scan must cover whole files.
    """
    rows = scan.select("*", _file_key().alias("file_name"),
                       F.col("_metadata.row_index").alias("row_index"))
    offsets = running_offsets(rows.groupBy("file_name").agg(F.count("*").alias("n")), "file_name")
    # One row per file of a job's output: bounded by the number of write tasks.
    numbered = rows.join(F.broadcast(offsets.select("file_name", "offset")), "file_name")
    return _with_ids(numbered, F.col("offset") + F.col("row_index") + F.lit(start)).drop(
        "file_name", "row_index", "offset")


def _file_key():
    """Name of a file of a job's output, so that names sort like task numbers of any length."""
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)", 1)
    return F.concat(F.lpad(number, 12, "0"), name)


def _with_ids(df: DataFrame, ordinal) -> DataFrame:
    return df.withColumn("ordinal", ordinal.cast("long")).withColumn(
        "chunk_id", F.concat(F.lit("chunk_"), F.col("ordinal").cast("string")))
