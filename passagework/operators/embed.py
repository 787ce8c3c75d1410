"""Vectors for text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.embedding import embedding
from passagework.functions.text import is_blank
from passagework.functions.vectors import cosine
from passagework.lineage import cut
from passagework.schemas import Settings

#: A text on more than one row in so many is common; there are fewer such texts than this.
COMMON = 4096


def embed(df: DataFrame, provider, text: str = "text", out: str = "embedding",
          batch_size: int = Settings.encode_batch) -> DataFrame:
    """Add the vector of ``text``; the provider sees at most ``batch_size`` texts at a time. Narrow: no shuffle."""
    return df.withColumn(out, embedding(F.col(text), provider, batch_size))


def embed_distinct(df: DataFrame, provider, text: str = "text", out: str = "embedding",
                   batch_size: int = Settings.encode_batch, common: int = COMMON) -> DataFrame:
    """Like ``embed``, with the same vectors, but the provider sees each distinct text once.

    For providers that cost more than moving a text. Copies are dropped where they lie before texts move, texts of
    similar length share a batch, and vectors come back by the text's digest: those of common texts go to their rows,
    others are on few rows, which move. Rows with a blank text get zeros and do not move. ``df`` is read twice.
    """
    key, count = "_text_key", "_text_rows"
    keyed = df.drop(out).withColumn(key, F.unhex(F.sha2(F.col(f"`{text}`"), 256)))
    said = keyed.where(~F.coalesce(is_blank(F.col(f"`{text}`")), F.lit(True)))
    blank = keyed.where(F.coalesce(is_blank(F.col(f"`{text}`")), F.lit(True)))
    distinct = said.groupBy(key).agg(F.any_value(f"`{text}`").alias("_text"), F.count("*").alias(count)) \
        .sortWithinPartitions(F.char_length("_text"))
    vectors = cut(distinct.select(key, count, embedding(F.col("_text"), provider, batch_size).alias(out)))
    total = vectors.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * common > total
    near = said.join(F.broadcast(vectors.where(hot).drop(count)), key)
    far = said.join(F.broadcast(vectors.where(hot).select(key)), key, "left_anti").join(vectors.where(~hot).drop(count), key)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), provider.dimension)
    return near.unionByName(far).unionByName(blank.withColumn(out, zeros)).select(*(f"`{c}`" for c in df.columns if c != out), out)


def text_similarity(df: DataFrame, provider, left: str, right: str,
                    out: str = "similarity", batch_size: int = Settings.encode_batch) -> DataFrame:
    """Add the cosine similarity of two text columns."""
    both = df.withColumn("_a", embedding(F.col(left), provider, batch_size)) \
        .withColumn("_b", embedding(F.col(right), provider, batch_size))
    return both.withColumn(out, cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
