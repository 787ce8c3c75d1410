"""Cleaning and section extraction over document tables. All narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions import text as tx

# How a heading starts, and its length limit. A number, two capitals (the second may
# be a space) or a roman numeral with a dot, and at least one more character.
HEADING = rf"(?s)\A(?:\p{{Nd}}|[A-Z][A-Z{tx.WS}]|[IVX]\.)."
HEADING_LIMIT = 100
OPENING_SECTION = "Introduction"


def clean_documents(docs: DataFrame, text: str = "text", for_embedding: bool = True) -> DataFrame:
    """Replace ``text`` by its cleaned form, ready to be chunked."""
    cleaned = tx.clean_text(F.col(text))
    return docs.withColumn(text, tx.clean_for_embedding(cleaned) if for_embedding else cleaned)


def extract_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section: (key, section_no, heading, content).

    Lines are stripped and blank ones skipped. A heading opens a section, what precedes the first
    heading belongs to an opening section, and sections without a body are dropped. Everything
    happens inside the row, so a document with very many lines moves nowhere.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda line: tx.strip(line)),
                     lambda line: line != "")
    found = docs.select(key, lines.alias("lines")).withColumn(
        "starts", F.filter(
            F.transform("lines", lambda line, i: F.when(
                line.rlike(HEADING) & (F.char_length(line) < HEADING_LIMIT), i + 1)),
            lambda at: at.isNotNull()))
    # Each section spans from its heading line (0: none) up to the next heading.
    spans = F.zip_with(
        F.concat(F.array(F.lit(0)), F.col("starts")),
        F.concat(F.col("starts"), F.array(F.size("lines") + 1)),
        lambda start, stop: F.struct(start.alias("start"), stop.alias("stop")))
    bodies = F.filter(spans, lambda s: s["stop"] - s["start"] > 1)
    sections = F.transform(bodies, lambda s: F.struct(
        F.when(s["start"] == 0, F.lit(OPENING_SECTION))
        .otherwise(F.get("lines", s["start"] - 1)).alias("heading"),
        F.array_join(F.slice("lines", s["start"] + 1, s["stop"] - s["start"] - 1), "\n")
        .alias("content")))
    # Before a plain explode Spark would filter on the size of the array and so compute it twice.
    return found.select(key, F.posexplode_outer(sections).alias("section_no", "section")) \
        .where("section_no is not null") \
        .select(key, "section_no", "section.heading", "section.content")
