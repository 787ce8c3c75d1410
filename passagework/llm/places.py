"""Telling rows of a table apart without moving or copying them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.lineage import cut

PLACE = "struct<file: bigint, at: bigint>"


def placed(docs: DataFrame) -> DataFrame:
    """(doc, place): each row as a struct, and where it lies; equal rows have different places.

    A row of a parquet scan is known by its file and its position there, each time it is read. Any other table
    is written once, with numbers.
    """
    try:
        return docs.select(F.struct("*").alias("doc"), F.struct(
            F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("place"))
    except AnalysisException:  # no scan of files with positions
        return cut(docs.select(F.struct("*").alias("doc"), F.struct(
            F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias("place")))
