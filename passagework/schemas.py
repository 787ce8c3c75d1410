"""Record types and settings shared by all operators."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("filename", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("filename", T.StringType()),
])

STORED_CHUNK = T.StructType([
    T.StructField("ordinal", T.LongType()),
    T.StructField("chunk_id", T.StringType()),
    *[f for f in CHUNK.fields if f.name != "category"],
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("category", T.StringType()),
    T.StructField("block", T.LongType()),
])

REQUEST = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
])

MESSAGES = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
]))

CATEGORY = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("description", T.StringType()),
])


@dataclass(frozen=True)
class Settings:
    """Workload constants. Every one can be overridden per job."""

    collection_name: str = "passages"
    dimension: int = 384
    chunk_size: int = 1000
    chunk_overlap: int = 200
    top_k: int = 5
    threshold: float = 0.5
    threshold_candidates: int = 10
    context_chars: int = 4000
    stats_sample: int = 1000
    encode_batch: int = 32
    temperature: float = 0.1
    max_tokens: int = 1024
    # Largest number of queries that is ever broadcast at once.
    query_block: int = 16_384
    # Largest number of ranked hits that is broadcast to fetch their text.
    broadcast_hits: int = 1_000_000
    # The closed list of categories: (id, description).
    categories: tuple[tuple[str, str], ...] = ()

    @property
    def category_ids(self) -> tuple[str, ...]:
        return tuple(c for c, _ in self.categories)

    @classmethod
    def from_env(cls, prefix: str = "PASSAGEWORK_", **overrides) -> "Settings":
        """Defaults, then environment values named ``prefix + FIELD``, then ``overrides``."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None and f.name != "categories":
                found[f.name] = type(f.default)(raw)
        return replace(cls(**found), **overrides)


def category_dimension(spark, settings: Settings):
    """The closed category list as a table."""
    return spark.createDataFrame(list(settings.categories), CATEGORY)
