"""Documents to chunks. All narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.chunking import chunk_shape, fixed_windows, recursive_chunks
from passagework.operators.cleaning import clean_documents
from passagework.schemas import Settings


def _with_metadata(docs: DataFrame, chunks: Column, keep_empty: bool) -> DataFrame:
    listed = docs.select(
        "doc_id", chunks.alias("chunks"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized")).alias("category"),
        F.coalesce("filename", F.lit("unknown")).alias("filename"))
    # Before a plain explode Spark would filter on the size of the array and so compute it twice.
    rows = listed.select(
        "doc_id", F.posexplode_outer("chunks").alias("chunk_index", "text"),
        F.array_size("chunks").alias("total_chunks"), "source", "category", "filename",
    ).select("doc_id", "chunk_index", "total_chunks", "text", "source", "category", "filename")
    return rows if keep_empty else rows.where("chunk_index is not null")


def chunk_documents(docs: DataFrame, size: int | None = None, overlap: int | None = None,
                    settings: Settings = Settings(), keep_empty: bool = False) -> DataFrame:
    """Recursive character chunks with their document's metadata, one row each.

    Blank documents give no rows, or with ``keep_empty`` one row with a null chunk: total 0 for a
    document without text, null for one that failed.
    """
    size, overlap = chunk_shape(size, overlap, settings.chunk_size, settings.chunk_overlap)
    return _with_metadata(docs, recursive_chunks(F.col("text"), size, overlap), keep_empty)


def window_documents(docs: DataFrame, size: int | None = None,
                     overlap: int | None = None) -> DataFrame:
    """Fixed-width chunks with their document's metadata, without leaving the JVM."""
    return _with_metadata(docs, fixed_windows(F.col("text"), size, overlap), False)


def process_documents(docs: DataFrame, settings: Settings = Settings(),
                      keep_empty: bool = False) -> DataFrame:
    """Clean, prepare and chunk a document table."""
    return chunk_documents(clean_documents(docs), settings=settings, keep_empty=keep_empty)
