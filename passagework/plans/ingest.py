"""Documents in, stored collection and statistics out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.lineage import cut, stage
from passagework.operators.chunks import process_documents
from passagework.operators.embed import embed, embed_distinct
from passagework.operators.ordinals import number_stored
from passagework.operators.stats import ingest_stats
from passagework.schemas import CHUNK, Settings
from passagework.sources import collection as store
from passagework.sources.documents import split_unreadable

# Rows handed to the embedder at a time.
BATCH_RANGE = (10, 500)
# Fixed value: the message of a finished ingest.
DONE = "Ingestion completed successfully"

_STAGED = T.StructType([*CHUNK.fields, T.StructField("empty", T.BooleanType())])


def stage_chunks(documents: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, str]:
    """Clean and chunk once, written to the shared folder: one row per chunk, and one with
    ``empty`` set per document without chunks. Returns the table and its folder.

    Documents that could not be read (a null text) are skipped.

    Documents are dealt out by ranges of (source, doc_id), so files and the rows in them are in that
    order whatever the number of tasks, and so are the ordinals. The ranges come from a sample of
    these two columns. Numbering and statistics read narrow columns of what is written instead of
    cleaning again, and a lost executor costs a re-read. The folders split empty rows off, so the
    files of real chunks number them without gaps.
    """
    readable, _ = split_unreadable(documents)
    ranged = readable.repartitionByRange("source", "doc_id")
    chunked = process_documents(ranged, settings, keep_empty=True) \
        .withColumn("empty", F.col("chunk_index").isNull())
    # Writing by folder sorts by it anyway; sorting here keeps each document's chunks in order.
    path = stage(chunked.sortWithinPartitions("empty", "source", "doc_id", "chunk_index"), ["empty"])
    return documents.sparkSession.read.schema(_STAGED).parquet(path), path


def numbered_chunks(staged: DataFrame, start: int = 0) -> DataFrame:
    return number_stored(staged.where(~F.col("empty")), start).drop("empty")


def _check_batch(batch_size: int) -> None:
    if not BATCH_RANGE[0] <= batch_size <= BATCH_RANGE[1]:
        raise ValueError(f"batch_size must be between {BATCH_RANGE[0]} and {BATCH_RANGE[1]}")


def ingest(documents: DataFrame, root: str, embedder, settings: Settings = Settings(),
           batch_size: int = 100, distinct: bool = False) -> DataFrame:
    """Rebuild the collection at ``root`` from a document table; returns the statistics row.

    Texts move once, when documents are dealt out: staged chunks are in order, and stay where they are when they are
    numbered, embedded and written. With ``distinct`` the embedder sees equal chunks once, at the price of moving
    chunks by their digest and to their folders.
    """
    _check_batch(batch_size)
    spark = documents.sparkSession
    staged, path = stage_chunks(documents, settings)
    vectors = embed_distinct if distinct else embed
    store.rebuild(vectors(numbered_chunks(staged), embedder, batch_size=batch_size), root, in_order=not distinct)
    report = ingest_stats(staged).withColumn("message", F.lit(DONE))
    # One row, taken now, so that the staged chunks can go.
    report = spark.createDataFrame(report.collect(), report.schema)
    store.remove(spark, path)
    return report


def add_documents(documents: DataFrame, root: str, embedder, settings: Settings = Settings(),
                  replace: bool = False, batch: int | store.Label | None = None,
                  batch_size: int = 100) -> DataFrame:
    """Append documents; ordinals go on after the largest one.

    Returns (filename, category, chunks_added) per document. Adding a source twice keeps both
    copies; with ``replace`` its earlier chunks leave the collection, which is not rewritten for it.
    A ``batch`` label that was added before is not added again; of a stream, (name, number), nothing up to the
    last number is.
    """
    _check_batch(batch_size)
    spark = documents.sparkSession
    staged, path = stage_chunks(documents, settings)
    added = embed(numbered_chunks(staged, store.next_ordinal(spark, root)), embedder, batch_size=batch_size)
    label = str(batch) if isinstance(batch, int) else batch
    store.append(added, root, label, staged.select("source") if replace else None, in_order=True)
    # The first row of a document says how many chunks it has.
    report = cut(staged.where("empty or chunk_index = 0").select(
        "filename", "category", F.coalesce("total_chunks", F.lit(0)).alias("chunks_added")))
    store.remove(spark, path)
    return report
