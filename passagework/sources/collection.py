"""The stored passage collection: parquet folders and a manifest.

Layout: ``root/snapshot=N/batch=M/category=.../block=.../*.parquet`` and ``root/manifest/V.json``. The manifest
with the largest number names the current snapshot, its batches in order with their ordinals, the last number of
every stream and the labels that callers gave, and tables of replaced sources. It is written once and never
changed, so a change of the collection is the appearance of one file: readers see the state before or after it,
data that no manifest names does not exist, and no time stamps matter. Opening a collection lists one small folder.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.schemas import STORED_CHUNK

#: Manifests and snapshots that stay behind the current one, for readers that began earlier.
KEPT = 1
#: Consecutive ordinals that share a folder, so that a few hits are fetched from a few folders.
BLOCK_ROWS = 1_000_000

#: What names a batch: a text of the caller's, or a stream and the number of its micro-batch.
Label = str | tuple[str, int]


@dataclass
class Manifest:
    version: int = -1
    snapshot: int = -1
    batches: list[dict] = field(default_factory=list)  # label, folder, first, rows
    labels: list[str] = field(default_factory=list)
    replaced: list[str] = field(default_factory=list)  # folders of (source, below)
    marks: dict[str, int] = field(default_factory=dict)  # stream -> its last micro-batch

    def has(self, label: Label) -> bool:
        """Whether a batch of this label was added. Micro-batches of a stream come in order, so its last tells."""
        if isinstance(label, tuple):
            return label[1] <= self.marks.get(label[0], -1) or f"{label[0]}-{label[1]}" in self.labels
        return label in self.labels

    def note(self, label: Label) -> None:
        if isinstance(label, tuple):
            self.marks[label[0]] = label[1]
        else:
            self.labels.append(label)

    @property
    def next_ordinal(self) -> int:
        return max((b["first"] + b["rows"] for b in self.batches), default=0)


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def _manifest_folder(root: str) -> str:
    return f"{root.rstrip('/')}/manifest"


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, where = _path(spark, _manifest_folder(root))
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, root: str) -> Manifest | None:
    """The current manifest, or None where there is no collection."""
    versions = _versions(spark, root)
    if not versions:
        return None
    fs, where = _path(spark, f"{_manifest_folder(root)}/{versions[-1]}.json")
    stream = fs.open(where)
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Publish the next version; an error if another writer has published it before."""
    manifest.version += 1
    folder = _manifest_folder(root)
    fs, draft = _path(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    final = jvm.Path(f"{folder}/{manifest.version}.json")
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
    # Fails if the file exists, unlike FileSystem.rename on some file systems.
    jvm.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(draft), fs.makeQualified(final), none)
    for version in _versions(spark, root):
        if version < manifest.version - KEPT:
            fs.delete(jvm.Path(f"{folder}/{version}.json"), False)


def snapshot_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/snapshot={number}"


def open_collection(spark: SparkSession, root: str) -> DataFrame:
    """The current collection; an empty one of the same schema where there is none.

    One scan over all batches; filters on category and block prune folders. Chunks of replaced sources are
    left out by a join with the replaced sources alone.
    """
    manifest = read_manifest(spark, root)
    if manifest is None or not manifest.batches:
        return spark.createDataFrame([], STORED_CHUNK)
    snapshot = snapshot_path(root, manifest.snapshot)
    rows = spark.read.schema(STORED_CHUNK).option("basePath", snapshot) \
        .parquet(*[f"{snapshot}/{b['folder']}" for b in manifest.batches]).select(*STORED_CHUNK.fieldNames())
    if manifest.replaced:
        old = spark.read.schema("source string, below long").parquet(*[f"{snapshot}/{r}" for r in manifest.replaced]) \
            .groupBy("source").agg(F.max("below").alias("below"))
        rows = rows.join(old.withColumnRenamed("source", "old"), (F.col("source") == F.col("old"))
                         & (F.col("ordinal") < F.col("below")), "left_anti")
    return rows


def write_batch(chunks: DataFrame, path: str, in_order: bool = False) -> None:
    """Rows go to the folders of their category and block. Spark moves them there and splits large folders over
    tasks, so neither a busy category nor many small ones make too many or too large files.

    With ``in_order`` tasks hold runs of ordinals: each has rows of few blocks as it is and writes one file for
    each of its categories, and nothing is moved.
    """
    placed = chunks.withColumn("block", F.floor(F.col("ordinal") / BLOCK_ROWS).cast("long")) \
        .select(*STORED_CHUNK.fieldNames())
    if not in_order:
        placed = placed.hint("rebalance", "category", "block")
    placed.write.mode("overwrite").partitionBy("category", "block").parquet(path)


def _write(chunks: DataFrame, root: str, snapshot: int, label: Label | None, first: int, in_order: bool) -> dict:
    """Write a batch under a name of its own, so that a repeated attempt never touches what is in use."""
    folder = f"batch={uuid.uuid4().hex}"
    path = f"{snapshot_path(root, snapshot)}/{folder}"
    write_batch(chunks, path, in_order)
    # Ordinals have no gaps, so the largest tells the number of rows; an empty batch has no files to ask.
    last = chunks.sparkSession.read.schema(STORED_CHUNK).parquet(path).agg(F.max("ordinal")).first()[0]
    return {"label": label, "folder": folder, "first": first, "rows": 0 if last is None else last + 1 - first}


def rebuild(chunks: DataFrame, root: str, in_order: bool = False) -> int:
    """Write a new snapshot, publish it and drop what lies behind the previous one. Returns its number.

    For ``in_order`` see ``write_batch``. What was added stays known, so a micro-batch that is delivered again after a
    rebuild is not added.
    """
    spark = chunks.sparkSession
    old = read_manifest(spark, root) or Manifest()
    number = old.snapshot + 1
    batch = _write(chunks, root, number, None, 0, in_order)
    _commit(spark, root, Manifest(old.version, number, [batch], old.labels, marks=old.marks))
    if number - KEPT - 1 >= 0:
        remove(spark, snapshot_path(root, number - KEPT - 1))
    return number


def append(chunks: DataFrame, root: str, label: Label | None = None, replaced: DataFrame | None = None,
           in_order: bool = False) -> bool:
    """Add a batch to the current snapshot. A label that was added before is not added again: returns whether it was new.

    ``chunks`` have the ordinals from ``next_ordinal`` on. With ``replaced`` (source), earlier chunks of these
    sources leave the collection with the same commit; they are listed, not rewritten.
    """
    spark = chunks.sparkSession
    manifest = _existing(spark, root)
    if label is not None and manifest.has(label):
        return False
    first = manifest.next_ordinal
    batch = _write(chunks, root, manifest.snapshot, label, first, in_order)
    if replaced is not None:
        folder = f"replaced/{uuid.uuid4().hex}"
        replaced.select("source", F.lit(first).cast("long").alias("below")).distinct() \
            .write.parquet(f"{snapshot_path(root, manifest.snapshot)}/{folder}")
        manifest.replaced.append(folder)
    manifest.batches.append(batch)
    if label is not None:
        manifest.note(label)
    _commit(spark, root, manifest)
    return True


def _existing(spark: SparkSession, root: str) -> Manifest:
    manifest = read_manifest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"no collection at {root}")
    return manifest


def next_ordinal(spark: SparkSession, root: str) -> int:
    """One more than the largest ordinal ever given in the current snapshot."""
    manifest = read_manifest(spark, root)
    return 0 if manifest is None else manifest.next_ordinal


def has_label(spark: SparkSession, root: str, label: Label) -> bool:
    return _existing(spark, root).has(label)
