"""Counts over documents and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.schemas import Settings


def _as_map(keep: Column, key: str, value: str) -> Column:
    """map<key, value> over the rows that ``keep`` selects; the rest collect as nothing."""
    return F.map_from_entries(F.collect_list(F.when(keep, F.struct(key, value))))


def ingest_stats(chunked: DataFrame) -> DataFrame:
    """One row: documents_processed, chunks_created, errors and documents per category.

    ``chunked`` comes from ``process_documents(keep_empty=True)``: every document has its first
    chunk or an empty row, so documents are counted without grouping by document.
    """
    first = F.coalesce(F.col("chunk_index") == 0, F.lit(True))
    failed = F.col("total_chunks").isNull()
    per_category = chunked.groupBy("category").agg(
        F.count_if(first & ~failed).alias("documents"),
        F.count("chunk_index").alias("chunks"),
        F.count_if(failed).alias("errors"))
    # One row per category from here on.
    return per_category.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents_processed"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks_created"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        _as_map(F.col("documents") > 0, "category", "documents").alias("categories"))


def collection_count(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count("*").alias("total_chunks"))


def category_counts(collection: DataFrame) -> DataFrame:
    """Exact number of chunks per category."""
    return _count_by_category(collection)


def sampled_category_counts(collection: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks per category among the first ``settings.stats_sample`` by ordinal."""
    return _count_by_category(
        collection.select("ordinal", "category").orderBy("ordinal").limit(settings.stats_sample))


def _count_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("chunks"))


def collection_stats(collection: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: total, name, category counts of the sample, and the closed category list."""
    total = collection_count(collection).select(
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("long").alias("chunks"),
        "total_chunks")
    sample = sampled_category_counts(collection, settings).withColumn(
        "total_chunks", F.lit(None).cast("long"))
    return total.unionByName(sample).agg(
        F.max("total_chunks").alias("total_chunks"),
        F.lit(settings.collection_name).alias("collection_name"),
        _as_map(F.col("category").isNotNull(), "category", "chunks").alias("categories_sample"),
        F.array(*[F.lit(c) for c in settings.category_ids]).cast("array<string>")
        .alias("available_categories"))
