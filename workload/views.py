"""Views derived from the given tables. One SQL text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.schemas import Settings

CATEGORIES = (("en", "English texts"), ("fr", "French texts"), ("de", "German texts"),
              ("es", "Spanish texts"))
SETTINGS = Settings(categories=CATEGORIES)

NBSP, ZWSP, BEL = " ", "​", "\u0007"

VIEWS = {
    # Documents with a two-level folder, so that the two category rules differ.
    "corpus": """
        select doc_id, text, lang as category,
               'doc_' || cast(doc_id as string) || '.txt' as filename,
               '/data/raw/' || lang || '/' || source || '/doc_' || cast(doc_id as string) || '.txt'
                   as source
        from {documents}""",
    # The same texts with known dirt; each kind hits an eighth of the documents.
    "dirty": f"""
        select doc_id, lang as category, 'doc_' || cast(doc_id as string) || '.txt' as filename,
               '/data/raw/' || lang || '/' || source || '/doc_' || cast(doc_id as string) || '.txt'
                   as source,
               case doc_id % 8
                 when 0 then 'Page ' || cast(doc_id % 50 as string) || ' of 50' || chr(10) || text
                     || chr(10) || '  ' || cast(doc_id as string) || '  '
                 when 1 then text || chr(10) || ' - 12 - ' || chr(10) || 'CONFIDENTIAL'
                 when 2 then '© 2024 Somebody' || chr(10) || text
                 when 3 then replace(text, ' ', '  ' || chr(9)) || '   '
                 when 4 then 'see https://ex.org/a?b=1 now ' || text || ' mail a.b@ex.org, ok'
                 when 5 then replace(text, chr(10), chr(10) || ' ' || chr(10) || chr(10) || chr(10))
                 when 6 then 'oﬃce ﬁle ‘a’ “b” –—… x{NBSP}y{ZWSP}z ' || text
                 else 'wait......' || '{BEL}' || ' -------- ' || text end as text
        from {{documents}}""",
    # The corpus after some documents changed and some became empty; the rest stayed.
    "revised": """
        select doc_id, case when doc_id % 3 = 0 then 'Second edition. ' || text
                            when doc_id % 3 = 1 and doc_id % 5 = 0 then '' else text end as text,
               lang as category, 'doc_' || cast(doc_id as string) || '.txt' as filename,
               '/data/raw/' || lang || '/' || source || '/doc_' || cast(doc_id as string) || '.txt'
                   as source
        from {documents}""",
    # Long lines broken up and headings put in between, for section extraction.
    "sectioned": """
        select doc_id, case doc_id % 4
                 when 0 then '1. Soil' || chr(10) || text || chr(10) || 'II.' || chr(10) || 'USDA'
                     || chr(10) || replace(text, '. ', '.' || chr(10) || ' ')
                 when 1 then replace(text, '. ', chr(10) || 'A farmer plants' || chr(10))
                 when 2 then 'Rice' || chr(10) || chr(10) || '  12 ' || chr(10) || text || chr(10) || '1'
                 else text end as text
        from {documents}""",
    # Conversations as paged documents; some pages are blank, some documents entirely.
    "paged": """
        select conv_id as doc, turn as page,
               case when (conv_id + turn) % 7 = 0 or conv_id % 10 = 3 then '  ' else text end as text
        from {conversations}""",
    # A document table in which some files could not be read.
    "partly_read": """
        select doc_id, lang as category, case when doc_id % 9 = 4 then null else text end as text
        from {documents}""",
    # User turns as requests, some of them invalid.
    "requests": """
        select conv_id * 1000 + turn as query_id,
               case when (conv_id * 1000 + turn) % 11 = 0 then 'ab'
                    when (conv_id * 1000 + turn) % 13 = 0 then repeat(text, 1000)
                    else text end as question,
               case (conv_id * 1000 + turn) % 5 when 0 then null when 1 then 'en' when 2 then 'fr'
                    when 3 then 'nope' else 'de' end as category,
               cast((conv_id * 1000 + turn) % 23 as int) as top_k
        from {conversations} where role = 'user'""",
    # Stored vectors with a filter column.
    "vectors": """
        select vec_id as ordinal, 'chunk_' || cast(vec_id as string) as chunk_id, embedding,
               cast(label as string) as category
        from {embeddings}""",
    # Every stored vector as a query, with its own filter and number of hits.
    "vector_requests": """
        select vec_id as query_id, embedding,
               case when vec_id % 3 = 0 then null else cast(label as string) end as category,
               cast(vec_id % 8 as int) as top_k
        from {embeddings}""",
    # Groups of documents as ranked hits of a question, long enough to overflow a context.
    "document_hits": """
        select cast(floor(doc_id / 6) as bigint) as query_id, cast(doc_id % 6 + 1 as int) as rank,
               text as content,
               'folder/' || source as source, lang as category, source || '.txt' as filename,
               0 as chunk_index, 1 as total_chunks,
               cast(0.9 - (doc_id % 6) / 10.0 as double) as score
        from {documents}""",
    # Their questions; every seventh question has no hits.
    "hit_questions": """
        select distinct case when doc_id % 7 = 0 then -1 - doc_id
                             else cast(floor(doc_id / 6) as bigint) end as query_id,
               'What about {question} number ' || cast(case when doc_id % 7 = 0 then -1 - doc_id
                             else cast(floor(doc_id / 6) as bigint) end as string) || '?'
                   as question
        from {documents}""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the parquet files of ``sf_dir``."""
    sql, table = VIEWS[name], next(t for t in ("documents", "conversations", "embeddings")
                                   if "{" + t + "}" in VIEWS[name])
    source = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return spark.sql(sql.replace("{question}", "{{question}}"), **{table: source})


def sql_view(name: str) -> str:
    """``name as (...)`` for a WITH clause over the registered tables."""
    sql = VIEWS[name]
    for table in ("documents", "conversations", "embeddings"):
        sql = sql.replace("{" + table + "}", table)
    return f"{name} as ({sql})"
