"""Parts of names looked up by their trigrams, so that ``contains`` reads only folders that can have a match.

The index is a table of postings: (gram, place), where a place is a folder of the stored rows, such as
(category, block) of a collection. A row that contains a part contains all trigrams of the part, so its folder
is among those that have every one of them; the exact test follows on the rows of these folders alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of postings: those of a part's grams are in at most as many of them as it has grams.
BUCKETS = 64
GRAM = 3
PLACES = ("category", "block")


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_grams(rows: DataFrame, path: str, column: str, places: Sequence[str] = PLACES) -> None:
    """Write the postings of ``column`` to ``path``.

    Equal names of a place are taken once, then equal grams, both before anything is shuffled in full, so a source
    with a third of all rows gives no more postings than any other. Null and shorter names have no grams.
    """
    names = rows.select(column, *places).distinct().where(F.char_length(column) >= GRAM)
    grams = names.select(*places, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.char_length(column) - (GRAM - 1)),
        lambda i: F.substring(F.col(column), i, F.lit(GRAM))))).alias("gram")).distinct()
    grams.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket").sortWithinPartitions("bucket", "gram") \
        .write.partitionBy("bucket").parquet(path)


def open_grams(spark: SparkSession, path: str, rows: DataFrame, places: Sequence[str] = PLACES) -> DataFrame:
    """The postings at ``path``, with the places of ``rows`` in their types."""
    kinds = ", ".join(f"`{p}` {rows.schema[p].dataType.simpleString()}" for p in places)
    return spark.read.schema(f"{kinds}, gram string, bucket int").parquet(path)


def grams_of(part: str) -> list[str]:
    return sorted({part[i:i + GRAM] for i in range(len(part) - GRAM + 1)})


def places_with(grams: DataFrame, part: str, places: Sequence[str] = PLACES) -> DataFrame:
    """The places whose names have all grams of ``part``, which must have at least one."""
    wanted = grams_of(part)
    spark = grams.sparkSession
    # As many rows as the part has grams; their buckets are computed as in the table.
    buckets = {r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string")
               .select(_bucket(F.col("gram"))).collect()}
    found = grams.where(F.col("bucket").isin(*buckets) & F.col("gram").isin(*wanted))
    return found.groupBy(*places).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(*places)


def where_contains(rows: DataFrame, grams: DataFrame, column: str, part: str,
                   places: Sequence[str] = PLACES) -> DataFrame:
    """The rows whose ``column`` contains ``part``, as a plain filter gives them.

    ``rows`` is stored in folders by ``places``; Spark reads those that the index names. A part of fewer than three
    characters has no gram and is looked for in all rows. Null names contain nothing; places must not be null.
    """
    exact = rows.where(F.col(column).contains(part))
    if len(part) < GRAM:
        return exact
    # One row for each folder of the stored rows at most.
    return exact.join(F.broadcast(places_with(grams, part, places)), list(places), "left_semi")
