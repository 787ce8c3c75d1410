"""Every registered query with its SQL counterpart, by area.

Each query reads whole tables. ``QUERIES[name] = (function(spark, sf_dir), sql or None)``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions import chunking, paths
from passagework.functions import text as tx
from passagework.functions.embedding import HashEmbedder
from passagework.functions.prompts import clipped_excerpt, excerpt, plain_prompt, system_and_user
from passagework.lineage import cut, shared_folder, widen
from passagework.operators import cell_index, completion, context, filters, name_index, requests, search, stats
from passagework.operators.chunks import chunk_documents, process_documents, window_documents
from passagework.operators.cleaning import extract_sections
from passagework.operators.embed import embed, embed_distinct, text_similarity
from passagework.operators.ordinals import number_by_document
from passagework.plans import ask as asking
from passagework.plans import ingest as ingesting
from passagework.schemas import DOCUMENT
from passagework.sources import collection as store
from passagework.sources.documents import assemble_pages, describe_files, scan_texts, single_documents, \
    split_unreadable
from passagework.sources.listing import open_filesystem
from passagework.streaming.append import replace_stream
from workload import sql_parts as sq
from workload.views import SETTINGS, spark_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

EMBEDDER = HashEmbedder(SETTINGS.dimension)


def register(name: str, sql: str | None):
    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _points(x: str):
    """A number with four decimals as a whole number, alike in both engines."""
    return F.round(F.col(x) * 10000).cast("bigint")


def _points_sql(x: str) -> str:
    return f"cast(round({x} * 10000) as bigint)"


# --- sources -------------------------------------------------------------------------------------

@register("corpus_scan", f"""{sq.with_views('corpus')}
    select doc_id, text, source, string_split(source, '/')[-2] as category,
           string_split(source, '/')[-1] as filename from corpus""")
def corpus_scan(spark, sf):
    files = spark_view(spark, sf, "corpus").select("doc_id", "text", F.col("source").alias("path"))
    return describe_files(files, "/data/raw").select(
        "doc_id", "text", "source", "category", "filename")


@register("page_assembly", f"""{sq.with_views('paged')}
    select doc, coalesce(string_agg(text, chr(10) || chr(10) order by page)
           filter (where regexp_matches(text, '[^{sq.WS}]')), '') as text from paged group by doc""")
def page_assembly(spark, sf):
    return assemble_pages(spark_view(spark, sf, "paged"))


@register("unreadable_documents", f"""{sq.with_views('partly_read')}
    select doc_id, category, case when text is null then 'unreadable' else 'readable' end as side,
           coalesce(length(text), 0)::bigint as n from partly_read""")
def unreadable_documents(spark, sf):
    good, bad = split_unreadable(spark_view(spark, sf, "partly_read"))
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n")
    return good.select("doc_id", "category", F.lit("readable").alias("side"), n).unionAll(
        bad.select("doc_id", "category", F.lit("unreadable").alias("side"), n))


_FILES_SQL = """files as (select doc_id, root, root || case doc_id % 3 when 0 then ''
        when 1 then '/' || lang else '/' || lang || '/' || source end || '/' || doc_id || '.txt'
        as path from (select *, case doc_id % 2 when 0 then '/data/raw' else '/data/files' end
        as root from documents))"""


def _files(spark, sf):
    """Paths at three depths under two roots."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").withColumn(
        "root", F.expr("case doc_id % 2 when 0 then '/data/raw' else '/data/files' end"))
    return documents.select("doc_id", "root", F.concat(
        F.col("root"), F.expr("case doc_id % 3 when 0 then '' when 1 then '/' || lang "
                              "else '/' || lang || '/' || source end"),
        F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


def _folder(name: str, value: str | None) -> str:
    """A folder named as Spark names those of a partition."""
    if not value:
        return f"{name}=__HIVE_DEFAULT_PARTITION__"
    return f"{name}=" + re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{[\]^]""", lambda c: f"%{ord(c[0]):02X}", value)


def _write_texts(root: str):
    """Tasks that write rows (text, lang, doc_id), sorted by the latter, as lines of one file in a folder for each.
    No task commits files on the driver, one by one; one that is repeated writes the same files."""
    def run(batches):
        where, prefix = open_filesystem(root)
        base, open_, out = root[len(prefix):], None, None
        where.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        try:
            for batch in batches:
                for text, *place in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "doc_id"))):
                    if place != open_:
                        if out:
                            out.close()
                        open_, folder = place, f"{base}/{_folder('lang', place[0])}/{_folder('doc_id', place[1])}"
                        where.create_dir(folder, recursive=True)
                        out = where.open_output_stream(f"{folder}/{name}")
                    out.write(f"{text or ''}\n".encode())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
        finally:
            if out:
                out.close()

    return run


@register("scanned_texts", """select 'doc_id=' || doc_id as category, text || chr(10) as text,
    'part' as filename from documents""")
def scanned_texts(spark, sf):
    """The documents as files, one each, and read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    root = re.sub(r"\Afile:/+", "/", folder)
    rows.select("text", F.col("lang").cast("string"), F.col("doc_id").cast("string")).mapInArrow(_write_texts(root), "n long") \
        .write.format("noop").mode("overwrite").save()
    return scan_texts(spark, folder).select("category", "text", F.substring("filename", 1, 4).alias("filename"))


# Names of which Spark's readers pass over half, and empty files among the others.
_NAMED = ["case doc_id % 4 when 0 then '.' when 1 then '_' else '' end || doc_id || '.txt' as filename",
          "case doc_id % 4 when 3 then '' else coalesce(text, '') end as text"]


def _write_files(root: str):
    """Tasks that write each row of (folder, filename, text) as a file."""
    def run(batches):
        where, prefix = open_filesystem(root)
        for batch in batches:
            for folder, name, text in zip(*(batch.column(c).to_pylist() for c in ("folder", "filename", "text"))):
                place = f"{root[len(prefix):]}/{folder}"
                where.create_dir(place, recursive=True)
                with where.open_output_stream(f"{place}/{name}") as out:
                    out.write(text.encode())
            yield batch.select(["filename"])

    return run


@register("every_text", f"select source as category, {', '.join(_NAMED)} from documents")
def every_text(spark, sf):
    """The documents as files of any name, listed and read by tasks."""
    folder = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    files = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat_ws('/', lang, source) as folder", *_NAMED)
    root = re.sub(r"\Afile:/+", "/", folder)
    files.mapInArrow(_write_files(root), "filename string").write.format("noop").mode("overwrite").save()
    return scan_texts(spark, folder, every=True).select("category", "filename", "text")


@register("single_documents", f"""{sq.with_views('corpus')}
    select text, source, category, filename from corpus where doc_id % 2 = 0
    union all select text, source, 'given' as category, filename from corpus where doc_id % 2 = 1""")
def single_document_rows(spark, sf):
    files = spark_view(spark, sf, "corpus").select("doc_id", "text", F.col("source").alias("path"))
    columns = ["text", "source", "category", "filename"]
    return single_documents(files.where("doc_id % 2 = 0")).select(columns).unionAll(
        single_documents(files.where("doc_id % 2 = 1"), "given").select(columns))


@register("folder_category", f"""with {_FILES_SQL}
    select doc_id, case when path = root || '/' || doc_id || '.txt' then 'uncategorized'
        else string_split(path, '/')[-2] end as category from files""")
def folder_category(spark, sf):
    return _files(spark, sf).select(
        "doc_id", paths.folder_category(F.col("path"), F.col("root")).alias("category"))


@register("path_category", f"""with {_FILES_SQL},
    parts as (select doc_id, string_split(path, '/') as p from files)
    select doc_id, case when list_contains(p, 'raw') then p[list_position(p, 'raw') + 1]
        else p[-2] end as category from parts""")
def path_category(spark, sf):
    return _files(spark, sf).select(
        "doc_id", paths.path_category(F.col("path")).alias("category"))


@register("file_names", f"""{sq.with_views('corpus')}
    select doc_id, string_split(source, '/')[-1] as filename from corpus""")
def file_names(spark, sf):
    return spark_view(spark, sf, "corpus").select(
        "doc_id", paths.basename(F.col("source")).alias("filename"))


# --- text ----------------------------------------------------------------------------------------

def _text_query(name: str, function, sql, view: str = "dirty") -> None:
    register(name, f"{sq.with_views(view)} select doc_id, {sql('text')} as text from {view}")(
        lambda spark, sf: widen(spark_view(spark, sf, view), "doc_id").select(
            "doc_id", function(F.col("text")).alias("text")))


_text_query("normalize_unicode", tx.normalize_unicode, sq.nfkc)
_text_query("fix_encoding", tx.fix_encoding, sq.fix_encoding)
_text_query("drop_furniture_lines", tx.drop_furniture_lines, sq.drop_furniture)
_text_query("normalize_whitespace", tx.normalize_whitespace, sq.whitespace)
_text_query("strip_control", tx.strip_control, sq.strip_control)
_text_query("strip_ends", tx.strip, sq.strip)
_text_query("strip_urls", tx.strip_urls, sq.urls)
_text_query("strip_emails", tx.strip_emails, sq.emails)
_text_query("collapse_punctuation", tx.collapse_punctuation, sq.punctuation)


@register("clean_text", f"""{sq.with_views('dirty')}, {sq.clean_steps('dirty', 'cleaned', 'doc_id')}
    select doc_id, text from cleaned_2""")
def clean_text(spark, sf):
    return widen(spark_view(spark, sf, "dirty"), "doc_id").select(
        "doc_id", tx.clean_text(F.col("text")).alias("text"))


@register("clean_for_embedding",
          f"""{sq.with_views('dirty')}, {sq.clean_steps('dirty', 'cleaned', 'doc_id')}
    select doc_id, text from cleaned""")
def clean_for_embedding(spark, sf):
    return widen(spark_view(spark, sf, "dirty"), "doc_id").select(
        "doc_id", tx.clean_for_embedding(tx.clean_text(F.col("text"))).alias("text"))


@register("sections", f"""{sq.with_views('sectioned')},
    parts as (select doc_id, string_split(text, chr(10)) as lines from sectioned),
    placed as (select doc_id, unnest(lines) as raw, generate_subscripts(lines, 1) as i from parts),
    lines as (select doc_id, i, {sq.strip('raw')} as line from placed),
    marked as (select *, regexp_matches(line,
            '^(?:(?:\\p{{Nd}}+\\.?[{sq.WS}]*)+|[A-Z][A-Z{sq.WS}]+:?|[IVX]+\\.)(?s:.+)$')
            and length(line) < 100 as heading from lines where line <> ''),
    grouped as (select *, sum(heading::int) over (partition by doc_id order by i) as part
            from marked),
    bodies as (select doc_id, part, coalesce(max(line) filter (where heading), 'Introduction')
            as heading, string_agg(line, chr(10) order by i) filter (where not heading) as content
            from grouped group by doc_id, part)
    select doc_id, (row_number() over (partition by doc_id order by part) - 1)::int as section_no,
           heading, content from bodies where content is not null""")
def sections(spark, sf):
    return extract_sections(widen(spark_view(spark, sf, "sectioned"), "doc_id"))


# --- chunks --------------------------------------------------------------------------------------

@register("chunk_estimate", """select doc_id, (case when length(text) <= 1000 then 1 else
    greatest(1, floor((length(text) - 200) / 800.0) + 1) end)::int as n from documents""")
def chunk_estimate(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", chunking.estimated_chunks(F.col("text")).alias("n"))


_WINDOWS_SQL = """counted as (select *, case when length(text) <= 1000 then 1 else
        greatest(1, floor((length(text) - 200) / 800.0) + 1) end::int as n from corpus),
    windows as (select doc_id, unnest(range(n))::int as chunk_index, n as total_chunks, text as t,
        source, category, filename from counted),
    chunks as (select doc_id, chunk_index, total_chunks, substr(t, chunk_index * 800 + 1, 1000)
        as text, source, category, filename from windows)"""


@register("fixed_windows", f"{sq.with_views('corpus')}, {_WINDOWS_SQL} select * from chunks")
def fixed_windows(spark, sf):
    return window_documents(widen(spark_view(spark, sf, "corpus"), "doc_id"))


@register("recursive_chunks", f"""{sq.with_views('corpus').replace('with', 'with recursive', 1)},
    {sq.recursive_chunks('corpus', 'chunks')}
    select c.doc_id, chunk_index, total_chunks, c.text, source, category, filename
    from chunks c join corpus d on c.doc_id = d.doc_id""")
def recursive_chunks(spark, sf):
    return chunk_documents(widen(spark_view(spark, sf, "corpus"), "doc_id"))


@register("small_chunks", f"""{sq.with_views('dirty').replace('with', 'with recursive', 1)},
    {sq.recursive_chunks('dirty', 'chunks', 120, 30)}
    select c.doc_id, chunk_index, total_chunks, c.text, source, category, filename
    from chunks c join dirty d on c.doc_id = d.doc_id""")
def small_chunks(spark, sf):
    return chunk_documents(widen(spark_view(spark, sf, "dirty"), "doc_id"), 120, 30)


_PROCESSED_SQL = (f"{sq.with_views('dirty').replace('with', 'with recursive', 1)}, "
                  f"{sq.clean_steps('dirty', 'cleaned', 'doc_id, source, category, filename')}, "
                  f"{sq.recursive_chunks('cleaned', 'chunks')}")


@register("processed_documents", f"""{_PROCESSED_SQL}
    select c.doc_id, chunk_index, total_chunks, c.text, source, category, filename
    from chunks c join dirty d on c.doc_id = d.doc_id""")
def processed_documents(spark, sf):
    return process_documents(widen(spark_view(spark, sf, "dirty"), "doc_id"))


@register("chunk_ordinals", f"""{sq.with_views('corpus')}, {_WINDOWS_SQL},
    numbered as (select *, row_number() over (order by doc_id, chunk_index) - 1 as ordinal
        from chunks)
    select doc_id, chunk_index, ordinal::bigint as ordinal, 'chunk_' || ordinal as chunk_id
    from numbered""")
def chunk_ordinals(spark, sf):
    chunks = window_documents(widen(spark_view(spark, sf, "corpus"), "doc_id")).drop("text")
    return number_by_document(chunks).select("doc_id", "chunk_index", "ordinal", "chunk_id")


# --- vectors -------------------------------------------------------------------------------------

@register("hash_vectors", f"""{sq.with_views('corpus')},
    {sq.hash_vectors('corpus', 'vectors', 'doc_id')},
    cells as (select doc_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as cell
        from vectors)
    select doc_id, cell::int as cell, cast(round(x::double * 1000000) as bigint) as weight
    from cells where x <> 0""")
def hash_vectors(spark, sf):
    vectors = embed(widen(spark_view(spark, sf, "corpus"), "doc_id"), EMBEDDER)
    return vectors.select("doc_id", F.posexplode_outer("embedding").alias("cell", "x")).where("x <> 0") \
        .select("doc_id", "cell",
                F.round(F.col("x").cast("double") * 1000000).cast("bigint").alias("weight"))


@register("blank_vectors", f"""{sq.with_views('paged')},
    {sq.hash_vectors('paged', 'vectors', 'doc, page')}
    select doc, page, len(embedding)::int as dimension,
           len(list_filter(embedding, lambda x: x <> 0))::int as cells,
           {_points_sql('sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))')}
               as length from vectors""")
def blank_vectors(spark, sf):
    vectors = embed(spark_view(spark, sf, "paged"), EMBEDDER)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0),
                                lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select(
        "doc", "page", F.size("embedding").alias("dimension"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("cells"),
        F.round(length * 10000).cast("bigint").alias("length"))


@register("turn_similarity", f"""with turns as (select conv_id, turn, text from conversations),
    {sq.hash_vectors('turns', 'v', 'conv_id, turn')}
    select a.conv_id, a.turn, {_points_sql('''coalesce(
        list_sum(list_transform(list_zip(a.embedding, b.embedding),
            lambda p: p[1]::double * p[2]::double))
        / nullif(sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double)))
        * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))), 0), 0)''')}
        as similarity
    from v a join v b on a.conv_id = b.conv_id and a.turn + 1 = b.turn""")
def turn_similarity(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("said")).join(
        turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered")),
        ["conv_id", "turn"])
    return text_similarity(pairs, EMBEDDER, "said", "answered").select(
        "conv_id", "turn", _points("similarity").alias("similarity"))


# --- filters -------------------------------------------------------------------------------------

def _filter_query(name: str, condition: str, **given) -> None:
    register(name, f"{sq.with_views('corpus')} "
                   f"select doc_id, category, source, filename from corpus where {condition}")(
        lambda spark, sf: filters.where(
            spark_view(spark, sf, "corpus"), filters.metadata_filter(SETTINGS, **given)).select(
            "doc_id", "category", "source", "filename"))


_filter_query("category_filter", "category = 'fr'", category="fr")
_filter_query("source_filter", "contains(source, '/src1')", source="/src1")
_filter_query("filename_filter", "contains(filename, '7.')", filename="7.")
_filter_query("combined_filter",
              "category = 'en' and contains(source, 'src1') and contains(filename, '3')",
              category="en", source="src1", filename="3")


def _indexed_query(name: str, condition: str, column: str, part: str) -> None:
    """The same through a trigram index of rows that are stored in folders."""
    def run(spark, sf):
        root = f"{shared_folder(spark).rstrip('/')}/names-{uuid.uuid4().hex}"
        # Folders by source, as ordinals follow the sources in a collection.
        rows = spark_view(spark, sf, "corpus").select("doc_id", "source", "filename", "category").withColumn(
            "block", F.pmod(F.xxhash64(F.regexp_replace("source", r"/[^/]*\z", "")), F.lit(16)))
        rows.hint("rebalance", "category", "block").write.partitionBy("category", "block").parquet(f"{root}/rows")
        stored = spark.read.schema(rows.schema).parquet(f"{root}/rows")
        name_index.write_grams(stored, f"{root}/grams", column)
        grams = name_index.open_grams(spark, f"{root}/grams", stored)
        return name_index.where_contains(stored, grams, column, part).select("doc_id", "category", "source", "filename")

    register(name, f"{sq.with_views('corpus')} "
                   f"select doc_id, category, source, filename from corpus where {condition}")(run)


_indexed_query("source_by_grams", "contains(source, '/src1')", "source", "/src1")
_indexed_query("filename_by_grams", "contains(filename, '77.')", "filename", "77.")
_filter_query("empty_filter", "true", category="", source=None)


@register("unknown_categories", f"""{sq.with_views('requests')}
    select query_id, category from requests
    where category is not null and category not in ({sq.category_list()})""")
def unknown_categories(spark, sf):
    return filters.unknown_categories(spark_view(spark, sf, "requests"), SETTINGS).select(
        "query_id", "category")


@register("category_descriptions", f"""{sq.with_views('requests')}, {sq.categories()}
    select query_id, r.category, coalesce(description, 'Unknown category') as description
    from requests r left join categories c on r.category = c.category""")
def category_descriptions(spark, sf):
    return filters.describe_categories(spark_view(spark, sf, "requests"), SETTINGS).select(
        "query_id", "category", "description")


@register("category_list", f"""with {sq.categories()}
    select category, description, count(doc_id) as documents
    from categories left join documents on lang = category group by category, description""")
def category_list(spark, sf):
    counts = spark.read.parquet(f"{sf}/documents.parquet").groupBy(
        F.col("lang").alias("category")).agg(F.count("*").alias("documents"))
    return filters.list_categories(spark, SETTINGS).join(counts, "category", "left").select(
        "category", "description", F.coalesce("documents", F.lit(0)).alias("documents"))


# --- search --------------------------------------------------------------------------------------

@register("nearest_vectors", f"""{sq.with_views('vectors')},
    queries as (select ordinal as query_id, embedding, null::varchar as category, 5 as top_k
        from vectors), {sq.ranked('queries', 'vectors', 'hits')}
    select query_id, rank, ordinal, {_points_sql('distance')} as distance,
           {_points_sql(sq.score('distance'))} as score from hits""")
def nearest_vectors(spark, sf):
    vectors = spark_view(spark, sf, "vectors")
    queries = vectors.select(F.col("ordinal").alias("query_id"), "embedding")
    return search.search(queries, vectors, SETTINGS).select(
        "query_id", "rank", "ordinal", _points("distance").alias("distance"),
        _points("score").alias("score"))


@register("nearest_in_category", f"""{sq.with_views('vectors', 'vector_requests')},
    {sq.ranked('vector_requests', 'vectors', 'hits')}
    select query_id, rank, h.ordinal, chunk_id, category, {_points_sql(sq.score('distance'))}
           as score from hits h join vectors v on h.ordinal = v.ordinal""")
def nearest_in_category(spark, sf):
    vectors = spark_view(spark, sf, "vectors")
    hits = search.search(spark_view(spark, sf, "vector_requests"), vectors, SETTINGS)
    return hits.join(vectors.select("ordinal", "chunk_id"), "ordinal").select(
        "query_id", "rank", "ordinal", "chunk_id", "category", _points("score").alias("score"))


@register("nearest_to_one", f"""{sq.with_views('vectors')},
    pivot_vector as (select max_by(embedding, ordinal) as v from vectors)
    select ordinal, chunk_id, category, {_points_sql(sq.score(sq.squared_l2('embedding', 'v')))}
        as score from vectors, pivot_vector
    order by {sq.squared_l2('embedding', 'v')}, ordinal limit 5""")
def nearest_to_one(spark, sf):
    vectors = spark_view(spark, sf, "vectors")
    vector = vectors.agg(F.max_by("embedding", "ordinal")).first()[0]
    return search.nearest_to(vectors, vector, settings=SETTINGS).select(
        "ordinal", "chunk_id", "category", _points("score").alias("score"))


@register("hit_defaults", f"""{sq.with_views('vectors')},
    queries as (select ordinal as query_id, embedding, category, 3 as top_k from vectors),
    {sq.ranked('queries', 'vectors', 'hits')}
    select query_id, rank, 'unknown' as source, v.category, 'unknown' as filename,
           0 as chunk_index, 1 as total_chunks, {_points_sql(sq.score('distance'))} as score
    from hits h join vectors v on h.ordinal = v.ordinal""")
def hit_defaults(spark, sf):
    vectors = spark_view(spark, sf, "vectors")
    queries = vectors.select(F.col("ordinal").alias("query_id"), "embedding", "category",
                             F.lit(3).alias("top_k"))
    return search.search(queries, vectors.drop("chunk_id"), SETTINGS).select(
        "query_id", "rank", "source", "category", "filename", "chunk_index", "total_chunks",
        _points("score").alias("score"))


@register("search_above_threshold", f"""{sq.with_views('vectors')},
    queries as (select ordinal as query_id, embedding, null::varchar as category, 10 as top_k
        from vectors), {sq.ranked('queries', 'vectors', 'hits')}
    select query_id, rank, ordinal, {_points_sql(sq.score('distance'))} as score
    from hits where {sq.score('distance')} >= 0.4""")
def search_above_threshold(spark, sf):
    vectors = spark_view(spark, sf, "vectors")
    queries = vectors.select(F.col("ordinal").alias("query_id"), "embedding")
    return search.search_above(queries, vectors, 0.4, settings=SETTINGS).select(
        "query_id", "rank", "ordinal", _points("score").alias("score"))


_HASHER = search.HyperplaneHasher(64, 16, 4, 11)
_PLANES = ", ".join(f"[{', '.join(repr(float(x)) for x in p)}]" for t in _HASHER.planes for p in t)


@register("search_approximately", f"""{sq.with_views('vectors')},
    planes as (select i, planes[i + 1] as p from (select [{_PLANES}] as planes), range(64) r(i)),
    codes as (select ordinal, i // 4 as hash_table, sum(case when list_dot_product(
        embedding::double[], p::double[]) > 0 then 1 << (i % 4) else 0 end) as code
        from vectors, planes group by all),
    pairs as (select distinct a.ordinal as query_id, b.ordinal from codes a join codes b
        on a.hash_table = b.hash_table and a.code = b.code),
    measured as (select query_id, p.ordinal, {sq.squared_l2('q.embedding', 'c.embedding')} as distance
        from pairs p join vectors q on query_id = q.ordinal join vectors c on p.ordinal = c.ordinal),
    placed as (select *, (row_number() over (partition by query_id order by distance, ordinal))::int
        as rank from measured)
    select query_id, rank, ordinal, {_points_sql(sq.score('distance'))} as score from placed
    where rank <= 5""")
def search_approximately(spark, sf):
    vectors = spark_view(spark, sf, "vectors")
    queries = vectors.select(F.col("ordinal").alias("query_id"), "embedding")
    return search.search_approximately(queries, vectors, 64, settings=SETTINGS).select(
        "query_id", "rank", "ordinal", _points("score").alias("score"))


def _indexed(spark, sf):
    vectors = spark_view(spark, sf, "vectors")
    return vectors, cell_index.build_index(vectors, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")


@register("indexed_nearest", f"""{sq.with_views('vectors')},
    queries as (select ordinal as query_id, embedding, null::varchar as category, 5 as top_k
        from vectors), {sq.ranked('queries', 'vectors', 'hits')}
    select query_id, rank, ordinal, {_points_sql(sq.score('distance'))} as score from hits""")
def indexed_nearest(spark, sf):
    vectors, index = _indexed(spark, sf)
    queries = vectors.select(F.col("ordinal").alias("query_id"), "embedding")
    return cell_index.search_exactly(queries, vectors, index, SETTINGS).select(
        "query_id", "rank", "ordinal", _points("score").alias("score"))


@register("indexed_range", f"""{sq.with_views('vectors')},
    queries as (select ordinal as query_id, embedding, null::varchar as category, 10 as top_k
        from vectors), {sq.ranked('queries', 'vectors', 'hits')}
    select query_id, rank, ordinal, {_points_sql(sq.score('distance'))} as score
    from hits where {sq.score('distance')} >= 0.4""")
def indexed_range(spark, sf):
    vectors, index = _indexed(spark, sf)
    queries = vectors.select(F.col("ordinal").alias("query_id"), "embedding")
    return cell_index.search_range(queries, vectors, index, 0.4, settings=SETTINGS).select(
        "query_id", "rank", "ordinal", _points("score").alias("score"))


# Which rows an approximate search finds depends on fitted centres; how many it must find does not.
@register("indexed_recall", f"""{sq.with_views('vectors')}
    select count(*) as queries, count(*) * 5 as hits, true as found_enough from vectors""")
def indexed_recall(spark, sf):
    vectors, index = _indexed(spark, sf)
    queries = vectors.select(F.col("ordinal").alias("query_id"), "embedding")
    near = cell_index.search_cells(queries, vectors, index, settings=SETTINGS).select("query_id", "ordinal")
    true = search.rank_hits(queries, vectors, SETTINGS)[0].select("query_id", "ordinal", F.lit(1).alias("true"))
    both = near.withColumn("near", F.lit(1)).join(true, ["query_id", "ordinal"], "full")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("true").alias("hits"),
                    (F.count_if(F.col("near") + F.col("true") == 2) >= 0.9 * F.count("true")).alias("found_enough"))


# --- statistics ----------------------------------------------------------------------------------

def _flat_map(x: str):
    """A map as text in key order."""
    entries = F.array_sort(F.map_entries(x))
    return F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


@register("ingest_statistics", f"""{_PROCESSED_SQL},
    per as (select category, count(*) as n from dirty group by category)
    select (select count(*) from dirty) as documents_processed,
           (select count(*) from chunks) as chunks_created, 0::bigint as errors,
           (select string_agg(category || '=' || n, ';' order by category) from per) as categories
    """)
def ingest_statistics(spark, sf):
    staged = process_documents(widen(spark_view(spark, sf, "dirty"), "doc_id"), keep_empty=True)
    return stats.ingest_stats(staged).withColumn("categories", _flat_map("categories"))


def _numbered_windows(spark, sf):
    return number_by_document(window_documents(widen(spark_view(spark, sf, "corpus"), "doc_id")).drop("text"))


_NUMBERED_SQL = (f"{sq.with_views('corpus')}, {_WINDOWS_SQL}, numbered as (select *, "
                 "row_number() over (order by doc_id, chunk_index) - 1 as ordinal from chunks), "
                 "sample as (select category, count(*) as chunks from numbered "
                 "where ordinal < 1000 group by category)")


@register("collection_count", f"{_NUMBERED_SQL} select count(*) as total_chunks from numbered")
def collection_count(spark, sf):
    return stats.collection_count(window_documents(widen(spark_view(spark, sf, "corpus"), "doc_id")))


@register("category_counts",
          f"{_NUMBERED_SQL} select category, count(*) as chunks from numbered group by category")
def category_counts(spark, sf):
    return stats.category_counts(window_documents(widen(spark_view(spark, sf, "corpus"), "doc_id")))


@register("sampled_category_counts", f"{_NUMBERED_SQL} select * from sample")
def sampled_category_counts(spark, sf):
    return stats.sampled_category_counts(_numbered_windows(spark, sf), SETTINGS)


@register("collection_stats", f"""{_NUMBERED_SQL}
    select (select count(*) from numbered) as total_chunks, 'passages' as collection_name,
           (select string_agg(category || '=' || chunks, ';' order by category) from sample)
               as categories_sample, 'en;fr;de;es' as available_categories""")
def collection_stats(spark, sf):
    return stats.collection_stats(_numbered_windows(spark, sf), SETTINGS).withColumn(
        "categories_sample", _flat_map("categories_sample")).withColumn(
        "available_categories", F.array_join("available_categories", ";"))


# --- context and prompts -------------------------------------------------------------------------

_HITS_SQL = f"{sq.with_views('document_hits', 'hit_questions')}, {sq.summary('document_hits', 's')}"


def _summary(spark, sf):
    return context.summarise_hits(spark_view(spark, sf, "document_hits"), SETTINGS)


@register("filenames_per_question", f"{_HITS_SQL} select query_id, filename_count from s")
def filenames_per_question(spark, sf):
    return _summary(spark, sf).select("query_id", F.col("filename_count").cast("bigint"))


@register("context_entries", f"""{sq.with_views('document_hits')}
    select query_id, rank, '[Source: ' || filename || ']' || chr(10) || content as entry
    from document_hits""")
def context_entries(spark, sf):
    return spark_view(spark, sf, "document_hits").select(
        "query_id", "rank",
        context.context_entry(F.col("filename"), F.col("content")).alias("entry"))


@register("packed_entries", f"{_HITS_SQL} select query_id, rank, kept as entry from s_k")
def packed_entries(spark, sf):
    hits = spark_view(spark, sf, "document_hits")
    return context.pack_entries(hits, SETTINGS.context_chars).select("query_id", "rank", "entry")


@register("packed_context", f"{_HITS_SQL} select query_id, context from s")
def packed_context(spark, sf):
    return _summary(spark, sf).select("query_id", "context")


@register("source_lists", f"""{_HITS_SQL}
    select q.query_id, coalesce(source_list, 'No sources found.') as source_list
    from hit_questions q left join s on q.query_id = s.query_id""")
def source_lists(spark, sf):
    summary = _summary(spark, sf).select("query_id", "source_list")
    return spark_view(spark, sf, "hit_questions").join(summary, "query_id", "left").select(
        "query_id", context.sources_text(F.col("source_list")).alias("source_list"))


def _messages_sql(several: bool) -> str:
    count = "filename_count" if several else "1"
    return f"""{_HITS_SQL}, j as (select q.query_id, question, context, source_list,
            documents_retrieved, {count} as filename_count
            from hit_questions q left join s on q.query_id = s.query_id)
        select query_id, {sq.text(sq.Templates().system)} as system, {sq.user_message()} as user
        from j"""


def _messages(spark, sf, include_sources):
    built = context.build_messages(spark_view(spark, sf, "hit_questions"), _summary(spark, sf),
                                   include_sources=include_sources)
    return built.select("query_id", F.col("messages")[0]["content"].alias("system"),
                        F.col("messages")[1]["content"].alias("user"))


@register("messages", _messages_sql(True))
def messages(spark, sf):
    return _messages(spark, sf, True)


@register("messages_without_sources", _messages_sql(False))
def messages_without_sources(spark, sf):
    return _messages(spark, sf, False)


@register("plain_prompts", f"""{_HITS_SQL}
    select s.query_id, {sq.render(sq.Templates().grounded, question='question', context='context')}
        as prompt from hit_questions q join s on q.query_id = s.query_id""")
def plain_prompts(spark, sf):
    joined = spark_view(spark, sf, "hit_questions").join(
        _summary(spark, sf).select("query_id", "context"), "query_id")
    return joined.select(
        "query_id", plain_prompt(F.col("question"), F.col("context")).alias("prompt"))


@register("system_user_messages", """select conv_id, turn, 'system: Be brief.' || chr(10)
    || 'user: ' || text as messages from conversations""")
def system_user_messages(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    built = system_and_user("Be brief.", F.col("text"))
    return turns.select("conv_id", "turn", F.array_join(F.transform(
        built, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


# --- requests, answers ---------------------------------------------------------------------------

@register("excerpts", """select doc_id, case when length(text) > 200
    then substr(text, 1, 200) || '...' else text end as excerpt from documents""")
def excerpts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", excerpt(F.col("text")).alias("excerpt"))


@register("clipped_excerpts",
          "select doc_id, substr(text, 1, 200) || '...' as excerpt from documents")
def clipped_excerpts(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", clipped_excerpt(F.col("text")).alias("excerpt"))


_VALID_SQL = (f"valid as (select * from requests where length(question) between 3 and 1000 "
              f"and top_k between 1 and 20 and (category is null or category in "
              f"({sq.category_list()})))")


@register("request_validation", f"""{sq.with_views('requests')}
    select query_id, concat_ws(';',
        case when length(question) < 3 then 'question too short' end,
        case when length(question) > 1000 then 'question too long' end,
        case when top_k not between 1 and 20 then 'top_k out of range' end,
        case when category not in ({sq.category_list()}) then 'unknown category' end) as reasons
    from requests""")
def request_validation(spark, sf):
    checked = requests.validate_requests(spark_view(spark, sf, "requests"), SETTINGS)
    return checked.select("query_id", F.array_join("reject_reason", ";").alias("reasons"))


@register("accepted_requests", f"""{sq.with_views('requests')}, {_VALID_SQL}
    select query_id, question, category, top_k from valid""")
def accepted_requests(spark, sf):
    return requests.accepted(
        requests.validate_requests(spark_view(spark, sf, "requests"), SETTINGS))


_TIES = ("doc_id", "chunk_index")
_STORED_SQL = (f"{_PROCESSED_SQL}, {sq.hash_vectors('chunks', 'chunk_vectors', 'doc_id, chunk_index')}, "
               "stored as (select c.doc_id, c.chunk_index, c.total_chunks, c.text, d.source, "
               "d.category, d.filename, v.embedding from chunks c join dirty d "
               "on c.doc_id = d.doc_id join chunk_vectors v "
               "on c.doc_id = v.doc_id and c.chunk_index = v.chunk_index)")
_VIEW_REQUESTS = sq.sql_view("requests")
_ASKED_SQL = (f"{_STORED_SQL}, {_VIEW_REQUESTS}, {_VALID_SQL}, "
              f"{sq.hash_vectors('valid', 'question_vectors', 'query_id', 'question')}, "
              "asked as (select r.*, v.embedding from valid r join question_vectors v "
              "on r.query_id = v.query_id)")


def _hits_sql(k: str = "top_k", threshold: float | None = None) -> str:
    keep = "" if threshold is None else f"where {sq.score('distance')} >= {threshold}"
    return (f"{_ASKED_SQL}, {sq.ranked('asked', 'stored', 'best', 'doc_id, chunk_index', k=k)}, "
            f"hits as (select b.query_id, b.rank, s.doc_id, s.chunk_index, s.total_chunks, "
            f"s.text as content, s.source, s.category, s.filename, {sq.score('distance')} as score "
            f"from best b join stored s on b.doc_id = s.doc_id and b.chunk_index = s.chunk_index "
            f"{keep})")


def _response_sql(hits: str, clip: str, threshold: float | None) -> str:
    found = "documents_retrieved is not null"
    system = sq.text(sq.Templates().system)
    user = sq.user_message()
    if threshold is not None:
        system, user = (f"case when {found} then {x} end" for x in (system, user))
    answer = "null::varchar" if threshold is None else \
        f"case when documents_retrieved is null then {sq.text(sq.Templates().apology)} end"
    used = "" if threshold is None else f", {threshold}::double as threshold_used"
    return f"""{hits}, {sq.summary('hits', 's')},
        cited as (select query_id, string_agg({clip} || '|' || source || '|' || category || '|'
            || filename || '|' || {_points_sql('score')}, chr(10) order by rank) as sources
            from hits group by query_id),
        j as (select q.query_id, question, category, context, source_list, documents_retrieved,
            filename_count, sources from valid q left join s on q.query_id = s.query_id
            left join cited c on q.query_id = c.query_id)
        select query_id, {answer} as answer, coalesce(sources, '') as sources, question,
            category as category_filter, coalesce(documents_retrieved, 0)::int
            as documents_retrieved, {system} as system, {user} as user{used} from j"""


_EXCERPT_SQL = "case when length(content) > 200 then substr(content, 1, 200) || '...' else content end"


def _valid_requests(spark, sf):
    return requests.accepted(
        requests.validate_requests(spark_view(spark, sf, "requests"), SETTINGS))


def _stored_chunks(spark, sf):
    """The chunks of the dirty documents with their vectors, written once."""
    chunks = process_documents(widen(spark_view(spark, sf, "dirty"), "doc_id"))
    return cut(embed(chunks, EMBEDDER, batch_size=256))


_VECTORS_SQL = f"""{_STORED_SQL}
    select doc_id, chunk_index, len(list_filter(embedding, lambda x: x <> 0))::int as cells,
        cast(round(list_sum(list_transform(embedding, lambda x, i: x::double * i)) * 1000) as bigint)
        as weighted from stored"""


def _vector_digest(vectors):
    # A sum in index order with the position as weight depends on every cell.
    placed = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    return vectors.select(
        "doc_id", "chunk_index", F.size(F.filter("embedding", lambda x: x != 0)).alias("cells"),
        F.round(F.aggregate(placed, F.lit(0.0), lambda s, x: s + x) * 1000).cast("bigint")
        .alias("weighted"))


@register("chunk_vectors", _VECTORS_SQL)
def chunk_vectors(spark, sf):
    chunks = process_documents(widen(spark_view(spark, sf, "dirty"), "doc_id"))
    return _vector_digest(embed(chunks.select("doc_id", "chunk_index", "text"), EMBEDDER, batch_size=256))


@register("distinct_vectors", _VECTORS_SQL)
def distinct_vectors(spark, sf):
    chunks = process_documents(widen(spark_view(spark, sf, "dirty"), "doc_id"))
    return _vector_digest(embed_distinct(chunks.select("doc_id", "chunk_index", "text"), EMBEDDER, batch_size=256))


def _flat_response(response: DataFrame) -> DataFrame:
    line = F.transform("sources", lambda s: F.concat_ws(
        "|", s["content"], s["source"], s["category"], s["filename"],
        F.round(s["score"] * 10000).cast("bigint").cast("string")))
    return response.withColumn("sources", F.array_join(line, "\n")) \
        .withColumn("system", F.col("messages")[0]["content"]) \
        .withColumn("user", F.col("messages")[1]["content"]).drop("messages", "rejected")


@register("answers", _response_sql(_hits_sql(), _EXCERPT_SQL, None))
def answers(spark, sf):
    return _flat_response(asking.ask(
        _valid_requests(spark, sf), _stored_chunks(spark, sf), EMBEDDER, settings=SETTINGS,
        ties=_TIES))


@register("answers_above_threshold", _response_sql(
    _hits_sql("ten", 0.35).replace("select r.*, v.embedding", "select r.*, 10 as ten, v.embedding"),
    "substr(content, 1, 200) || '...'", 0.35))
def answers_above_threshold(spark, sf):
    return _flat_response(asking.ask_above(
        _valid_requests(spark, sf), _stored_chunks(spark, sf), EMBEDDER, threshold=0.35,
        settings=SETTINGS, ties=_TIES))


@register("search_results", f"""{_hits_sql()},
    nested as (select query_id, string_agg(rank || '|' || filename || '|' || chunk_index || '|'
        || total_chunks || '|' || {_points_sql('score')}, ';' order by rank) as results from hits
        group by query_id)
    select v.query_id, question as query, category as category_filter,
        coalesce(results, '') as results from valid v left join nested n
        on v.query_id = n.query_id""")
def search_results(spark, sf):
    found = asking.search_only(_valid_requests(spark, sf), _stored_chunks(spark, sf), EMBEDDER,
                               SETTINGS, _TIES)
    line = F.transform("results", lambda h, i: F.concat_ws(
        "|", (i + 1).cast("string"), h["filename"], h["chunk_index"].cast("string"),
        h["total_chunks"].cast("string"),
        F.round(h["score"] * 10000).cast("bigint").cast("string")))
    return found.withColumn("results", F.array_join(line, ";")).drop("rejected")


@register("refused_questions", f"""{sq.with_views('requests')}
    select query_id, category as category_filter,
        case when category not in ({sq.category_list()}) then 'unknown category' end as rejected,
        category is null or category in ({sq.category_list()}) as asked
    from requests where length(question) between 3 and 1000 and top_k between 1 and 20""")
def refused_questions(spark, sf):
    questions = spark_view(spark, sf, "requests").where(
        "length(question) between 3 and 1000 and top_k between 1 and 20")
    return asking.ask(questions, _stored_chunks(spark, sf), EMBEDDER, settings=SETTINGS, ties=_TIES).select(
        "query_id", "category_filter", "rejected", F.col("messages").isNotNull().alias("asked"))


def _echo(messages, temperature, max_tokens):
    """Stands in for a model: says how much it was given, and fails on long prompts."""
    size = len(messages[1]["content"])
    if size > 4000:
        raise ValueError("prompt too long")
    return f"{len(messages)} messages, {size} characters, {temperature}, {max_tokens}"


_COMPLETED_SQL = f"""{_HITS_SQL}, j as (select q.query_id, question, context,
        source_list, documents_retrieved, filename_count from hit_questions q
        left join s on q.query_id = s.query_id),
    u as (select query_id, {sq.user_message()} as user from j)
    select query_id, case when length(user) > 4000
        then 'Error generating response: prompt too long'
        else '2 messages, ' || length(user) || ' characters, 0.1, 1024' end as answer from u"""


@register("completed_answers", _COMPLETED_SQL)
def completed_answers(spark, sf):
    from passagework.operators.completion import complete
    built = context.build_messages(spark_view(spark, sf, "hit_questions"), _summary(spark, sf))
    return built.select("query_id", complete(F.col("messages"), _echo).alias("answer"))


@register("answered_once", _COMPLETED_SQL)
def answered_once(spark, sf):
    """Asked in rounds and read from the table of answers; the second run calls nobody."""
    built = context.build_messages(spark_view(spark, sf, "hit_questions"), _summary(spark, sf))
    answers = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    completion.complete_once(built, _echo, answers, concurrency=4, retries=0)
    # What failed, long prompts, would be asked again; all else is known.
    return completion.complete_once(built, _echo, answers, retries=0).select("query_id", "answer")


# --- ingest --------------------------------------------------------------------------------------

def _new_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/collection-{uuid.uuid4().hex}"


@register("rebuilt_collection", f"""{_PROCESSED_SQL}
    select c.doc_id, chunk_index, total_chunks, c.text, source, category, filename
    from chunks c join dirty d on c.doc_id = d.doc_id""")
def rebuilt_collection(spark, sf):
    root = _new_root(spark)
    ingesting.ingest(spark_view(spark, sf, "dirty"), root, EMBEDDER, SETTINGS)
    return store.open_collection(spark, root).select(
        "doc_id", "chunk_index", "total_chunks", "text", "source", "category", "filename")


@register("ingest_report", f"""{_PROCESSED_SQL},
    per as (select category, count(*) as n from dirty group by category)
    select (select count(*) from dirty) as documents_processed,
           (select count(*) from chunks) as chunks_created, 0::bigint as errors,
           (select string_agg(category || '=' || n, ';' order by category) from per) as categories,
           'Ingestion completed successfully' as message""")
def ingest_report(spark, sf):
    report = ingesting.ingest(spark_view(spark, sf, "dirty"), _new_root(spark), EMBEDDER, SETTINGS)
    return report.withColumn("categories", _flat_map("categories"))


@register("readable_report", """
    select count(*) as documents_processed, 0::bigint as errors,
           (select string_agg(category || '=' || n, ';' order by category) from (select lang as category,
            count(*) as n from documents where doc_id % 9 <> 4 group by lang)) as categories
    from documents where doc_id % 9 <> 4""")
def readable_report(spark, sf):
    docs = spark_view(spark, sf, "partly_read").withColumns(
        {"source": F.col("doc_id").cast("string"), "filename": F.col("doc_id").cast("string")})
    report = ingesting.ingest(docs, _new_root(spark), EMBEDDER, SETTINGS)
    return report.select("documents_processed", "errors", _flat_map("categories").alias("categories"))


@register("stored_vectors", _VECTORS_SQL)
def stored_vectors(spark, sf):
    root = _new_root(spark)
    ingesting.ingest(spark_view(spark, sf, "dirty"), root, EMBEDDER, SETTINGS)
    return _vector_digest(store.open_collection(spark, root))


@register("stored_ordinals", f"""{_PROCESSED_SQL},
    numbered as (select c.doc_id, chunk_index, row_number() over (order by d.source, c.doc_id, chunk_index) - 1
        as ordinal from chunks c join dirty d on c.doc_id = d.doc_id)
    select doc_id, chunk_index, ordinal, 'chunk_' || ordinal as chunk_id from numbered""")
def stored_ordinals(spark, sf):
    root = _new_root(spark)
    ingesting.ingest(spark_view(spark, sf, "dirty"), root, EMBEDDER, SETTINGS)
    return store.open_collection(spark, root).select("doc_id", "chunk_index", "ordinal", "chunk_id")


@register("appended_documents", f"""{_PROCESSED_SQL},
    added as (select doc_id, count(*) as n from chunks group by doc_id)
    select d.filename, 'inbox' as category, coalesce(n, 0)::int as chunks_added
    from dirty d left join added a on d.doc_id = a.doc_id where d.category <> 'en'""")
def appended_documents(spark, sf):
    root, docs = _new_root(spark), spark_view(spark, sf, "dirty")
    ingesting.ingest(docs.where("category = 'en'"), root, EMBEDDER, SETTINGS)
    rest = docs.where("category <> 'en'").withColumn("category", F.lit("inbox"))
    return ingesting.add_documents(rest, root, EMBEDDER, SETTINGS)


@register("appended_ordinals", f"""{_PROCESSED_SQL},
    parts as (select d.category <> 'en' as added, count(*) as n from chunks c
        join dirty d on c.doc_id = d.doc_id group by added)
    select added, min(lo)::bigint as first_ordinal, min(lo + n - 1)::bigint as last_ordinal,
        min(n)::bigint as chunks from (select added, n, case when added then
        (select n from parts where not added) else 0 end as lo from parts) group by added""")
def appended_ordinals(spark, sf):
    root, docs = _new_root(spark), spark_view(spark, sf, "dirty")
    ingesting.ingest(docs.where("category = 'en'"), root, EMBEDDER, SETTINGS)
    ingesting.add_documents(docs.where("category <> 'en'"), root, EMBEDDER, SETTINGS)
    return store.open_collection(spark, root).groupBy(
        (F.col("category") != "en").alias("added")).agg(
        F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"),
        F.count_distinct("ordinal").alias("chunks"))


_REVISED_SQL = f"""{sq.with_views('revised').replace('with', 'with recursive', 1)},
    {sq.clean_steps('revised', 'cleaned', 'doc_id, source, category, filename')},
    {sq.recursive_chunks('cleaned', 'chunks')}
    select doc_id, chunk_index, total_chunks, text, doc_id % 3 = 0 as later from chunks"""


def _with_later(spark, root: str, first: int):
    """Stored chunks, and whether they came after the first ``first``."""
    return store.open_collection(spark, root).select(
        "doc_id", "chunk_index", "total_chunks", "text", (F.col("ordinal") >= first).alias("later"))


@register("replaced_documents", _REVISED_SQL)
def replaced_documents(spark, sf):
    """All documents, then those that changed once more in place of their earlier text."""
    root = _new_root(spark)
    ingesting.ingest(spark_view(spark, sf, "corpus"), root, EMBEDDER, SETTINGS)
    first = store.next_ordinal(spark, root)
    changed = spark_view(spark, sf, "revised").where("doc_id % 3 = 0 or doc_id % 3 = 1 and doc_id % 5 = 0")
    ingesting.add_documents(changed, root, EMBEDDER, SETTINGS, replace=True)
    return _with_later(spark, root, first)


@register("latest_deliveries", _REVISED_SQL)
def latest_deliveries(spark, sf):
    """All documents delivered to a stream, and after a restart all of them again, some of them changed."""
    root, inbox = _new_root(spark), f"{shared_folder(spark).rstrip('/')}/inbox-{uuid.uuid4().hex}"
    ingesting.ingest(spark.createDataFrame([], DOCUMENT), root, EMBEDDER, SETTINGS)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in DOCUMENT)}, arrived timestamp"
    first = 0
    for hour, view in enumerate(("corpus", "revised")):
        spark_view(spark, sf, view).withColumn("arrived", F.timestamp_seconds(F.lit(3600 * hour))) \
            .write.mode("append").parquet(inbox)
        first = store.next_ordinal(spark, root)
        stream = replace_stream(spark.readStream.schema(schema).parquet(inbox), root, EMBEDDER, f"{inbox}-progress", SETTINGS)
        stream.awaitTermination()
    return _with_later(spark, root, first)
