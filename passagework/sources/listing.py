"""Files found folder by folder in tasks, and read by tasks, whatever their names and sizes.

Spark's own file sources list on the driver and pass over files of zero bytes and names that begin with a dot
or an underscore. Here the folders of one depth are the rows of a table; tasks list them, files are kept and
the folders found are the next table. Only the number of rounds, the depth of the tree, meets the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.lineage import shared_folder

LISTED = "path string, length long, folder boolean"
#: Rows of a listing, and bytes of contents, that a task holds at a time; bytes of files that a task reads.
NAMES, HELD, READ = 10_000, 32 << 20, 64 << 20


def open_filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and what stands before its own paths in the paths of files."""
    if root.startswith("/"):
        return fs.LocalFileSystem(), ""
    known = root.replace("s3a://", "s3://", 1)
    found, path = fs.FileSystem.from_uri(known)
    return found, root[:len(root) - len(known) + known.rindex(path)]


def _entries(where: fs.FileSystem, folder: str, follow: bool) -> Iterator[tuple[str, int, bool]]:
    """(path, length, is a folder) of what lies in a folder. Links to folders are not followed unless asked for, so that
    no folder is met twice; links to files are files."""
    if isinstance(where, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir(follow_symlinks=follow):
                    yield entry.path, 0, True
                elif entry.is_file():
                    yield entry.path, entry.stat().st_size, False
        return
    for entry in where.get_file_info(fs.FileSelector(folder)):
        if entry.type in (fs.FileType.File, fs.FileType.Directory):
            yield entry.path, entry.size or 0, entry.type == fs.FileType.Directory


def _passed_over(path: str) -> bool:
    """Whether Spark's readers pass over a file or folder for its name."""
    name = path[path.rindex("/") + 1:]
    return name.startswith(".") or name.endswith("._COPYING_") or \
        name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))


def _list(root: str, suffix: str, recursive: bool, every: bool):
    def batch(rows: list[tuple[str, int, bool]], prefix: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([prefix + r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.bool_())], ["path", "length", "folder"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, prefix = open_filesystem(root)
        rows = []
        for folders in batches:
            for folder in folders.column("path").to_pylist():
                for entry in _entries(where, folder[len(prefix):], follow=not every):
                    if not every and (_passed_over(entry[0]) or not entry[2] and not entry[1]):
                        continue
                    # A name that is no text in UTF-8 cannot be a value of a table.
                    if (recursive if entry[2] else entry[0].endswith(suffix)) and _is_text(entry[0]):
                        rows.append(entry)
                    if len(rows) == NAMES:
                        yield batch(rows, prefix)
                        rows = []
        yield batch(rows, prefix)

    return run


def _is_text(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def list_files(spark: SparkSession, root: str, suffix: str = "", recursive: bool = True, every: bool = True) -> DataFrame:
    """(path, length) of every file below ``root``, an absolute path or a URI, whose name ends in ``suffix``.

    Without ``every`` of those that Spark's readers see: no empty files, no names that begin with a dot or an underscore, and
    what lies in folders that are links.

    One job per depth of the tree. Each level is written to the shared folder, so a lost task lists its folders
    again and no others. The files of one folder are listed by one task, ``NAMES`` at a time on local and
    mounted folders; other file systems that pyarrow knows give a folder's files at once. An empty folder has no rows.
    """
    tasks = spark.sparkContext.defaultParallelism
    levels = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    frontier, depth = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), 0
    while True:
        level = f"{levels}/depth={depth}"
        # The names on the way are hashed, so the folders of a large parent are dealt over all tasks.
        frontier.select("path").repartition(tasks if depth else 1, "path") \
            .mapInArrow(_list(root, suffix, recursive, every), LISTED).write.parquet(level)
        frontier, depth = spark.read.schema(LISTED).parquet(level).where("folder"), depth + 1
        if not recursive or frontier.isEmpty():
            break
    return spark.read.schema(LISTED).parquet(*[f"{levels}/depth={d}" for d in range(depth)]) \
        .where(~F.col("folder")).select("path", "length")


def _read(root: str):
    def batch(paths: list[str], contents: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())],
                                          ["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, prefix = open_filesystem(root)
        paths, contents, held = [], [], 0
        for files in batches:
            for path in files.column("path").to_pylist():
                try:
                    with where.open_input_stream(path[len(prefix):]) as stream:
                        content = stream.read()
                except (FileNotFoundError, PermissionError):
                    content = None  # for good; other errors repeat the task
                paths.append(path)
                contents.append(content)
                held += len(content or b"")
                if held >= HELD:
                    yield batch(paths, contents)
                    paths, contents, held = [], [], 0
        yield batch(paths, contents)

    return run


def read_files(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of the files of ``list_files``; null where a file is gone or may not be read.

    Files are dealt out by their paths to tasks of about ``READ`` bytes.
    """
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ))
    return files.select("path").repartition(tasks, "path").mapInArrow(_read(root), "path string, content binary")
