"""Document tables from folders of text files, from page rows, or from any binary format."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.paths import basename, folder_category, path_category, plain_path
from passagework.functions.text import is_blank
from passagework.sources.listing import list_files, read_files

PageReader = Callable[[bytes], Iterable[str]]


def _load(spark: SparkSession, directory: str, suffix: str, recursive: bool, every: bool) -> DataFrame:
    """(path, content) of the files."""
    root = directory.rstrip("/")
    place = qualified_root(spark, root)
    if place is None:
        raise FileNotFoundError(f"no such folder: {directory}")
    # Folders that Spark's reader would list on the driver, keeping every name there, are listed in tasks.
    if every or recursive and place.startswith("/") and not re.search(r"[*?\[\]{}\\]", place + suffix):
        return read_files(list_files(spark, place, suffix, recursive, every), place)
    below = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}") \
        .option("recursiveFileLookup", "true")
    try:
        files = below.load(root) if recursive else spark.read.format("binaryFile").load(f"{root}/*{suffix}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = below.load(root).limit(0)
    return files.select(plain_path(F.col("_metadata.file_path")).alias("path"), "content")


def qualified_root(spark: SparkSession, path: str) -> str | None:
    """The absolute path as ``plain_path`` writes it, or None where there is nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return re.sub(r"\Afile:/+", "/", fs.makeQualified(where).toString()) if fs.exists(where) else None


def describe_files(files: DataFrame, root: str | Column, path: str = "path") -> DataFrame:
    """Add source, category (bulk rule) and filename from a path column."""
    return files.withColumn("source", F.col(path)) \
        .withColumn("category", folder_category(F.col(path), root)) \
        .withColumn("filename", basename(F.col(path)))


def scan_texts(spark: SparkSession, directory: str, recursive: bool = True,
               suffix: str = ".txt", every: bool = False) -> DataFrame:
    """One document per text file: (doc_id, text, source, category, filename).

    ``doc_id`` is a hash of the path, so it does not depend on how the files are split into tasks. A file
    that is not UTF-8 has a null text, like any document that cannot be read. Spark passes over files of
    zero bytes and files whose names begin with a dot or an underscore; with ``every`` none is passed over. Tasks list and
    read the files then (see ``sources.listing``), on file systems that pyarrow knows, and without ``every`` those
    below local and mounted folders; elsewhere Spark's reader lists on the driver.
    """
    text = F.col("content").cast("string")
    files = _load(spark, directory, suffix, recursive, every).select(
        "path", F.when(F.is_valid_utf8(text), text).alias("text"))
    described = describe_files(files, qualified_root(spark, directory))
    return described.select(F.xxhash64("path").alias("doc_id"), "text", "source", "category",
                            "filename")


def scan_pages(spark: SparkSession, directory: str, read_pages: PageReader, suffix: str = ".pdf",
               recursive: bool = True, every: bool = False) -> DataFrame:
    """Page rows (path, page, text) of binary files, read by a function bytes -> page texts.

    A file that cannot be read gives one row with a null text and the reason in ``problem``. With ``every``
    no file is passed over for its name or for being empty, as in ``scan_texts``.
    """
    files = _load(spark, directory, suffix, recursive, every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    if not content.is_valid:
                        raise FileNotFoundError(f"cannot open {path}")
                    texts, problem = list(read_pages(content.as_py())), None
                    if not texts:
                        texts = [""]
                except Exception as error:
                    texts, problem = [None], str(error)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(texts)), pa.array(range(len(texts)), pa.int32()),
                     pa.array(texts, pa.string()),
                     pa.array([problem] * len(texts), pa.string())],
                    ["path", "page", "text", "problem"])

    return files.mapInArrow(run, "path string, page int, text string, problem string")


def assemble_pages(pages: DataFrame, key: str = "doc", page: str = "page", text: str = "text",
                   block: int = 256) -> DataFrame:
    """One row per document: its pages that are not blank, in order, a blank line between them.

    A document whose pages are all blank stays, with empty text. Pages are joined in blocks of
    consecutive pages first, so a document with very many pages is put together by many tasks and
    only its finished blocks meet in one.
    """
    kept = F.when(~is_blank(F.col(text)), F.col(text)).alias("kept")
    rows = pages.select(key, F.col(page).alias("page"), kept,
                        F.floor(F.col(page) / block).alias("part"))
    parts = rows.groupBy(key, "part").agg(
        F.expr(r"listagg(kept, '\n\n') within group (order by page)").alias("kept"))
    return parts.groupBy(key).agg(
        F.expr(r"coalesce(listagg(kept, '\n\n') within group (order by part), '')").alias(text))


def documents_from_pages(pages: DataFrame, directory: str) -> DataFrame:
    """Documents of ``scan_pages`` rows; files that could not be read are left out."""
    texts = assemble_pages(pages.where("problem is null"), "path")
    return describe_files(texts, qualified_root(pages.sparkSession, directory)).select(
        F.xxhash64("path").alias("doc_id"), "text", "source", "category", "filename")


def split_unreadable(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(readable, unreadable) documents: a null text marks a file that could not be read."""
    return docs.where(F.col(text).isNotNull()), docs.where(F.col(text).isNull())


def single_documents(files: DataFrame, category: str | None = None) -> DataFrame:
    """Documents to be added one by one: (path, text) with the path rule or a given category."""
    chosen = F.lit(category) if category else path_category(F.col("path"))
    return files.select(F.xxhash64("path").alias("doc_id"), "text", F.col("path").alias("source"),
                        chosen.alias("category"), basename(F.col("path")).alias("filename"))
