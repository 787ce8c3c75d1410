"""Adding documents as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from passagework.functions.paths import plain_path
from passagework.lineage import stage
from passagework.plans.ingest import add_documents
from passagework.schemas import DOCUMENT, Settings
from passagework.sources import collection as store
from passagework.sources.documents import single_documents


def watch_texts(spark: SparkSession, directory: str, suffix: str = ".txt",
                category: str | None = None, files_per_batch: int = 10_000) -> DataFrame:
    """A stream of documents, one per new text file, with the single-file category rule."""
    files = (spark.readStream.format("text").option("wholetext", "true")
             .option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
             .option("maxFilesPerTrigger", files_per_batch).load(directory.rstrip("/")))
    return single_documents(files.select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")),
        category)


def _start(rows: DataFrame, write, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_stream(documents: DataFrame, root: str, embedder, checkpoint: str,
                  settings: Settings = Settings(), name: str = "stream",
                  once: bool = True) -> StreamingQuery:
    """Write each micro-batch as one batch of the collection at ``root``.

    The batch is labelled by the stream's name and the micro-batch's number, both of which outlive
    a restart, and the collection remembers the last of each stream even when it is rebuilt. Spark may hand over a
    micro-batch again after a failure; one that was added is skipped, so each file counts once. Documents do not depend on
    each other, so the stream keeps no state and needs no watermark.
    """

    def write(rows: DataFrame, number: int) -> None:
        session, label = rows.sparkSession, (name, number)
        if not store.has_label(session, root, label):
            add_documents(rows, root, embedder, settings, batch=label)

    return _start(documents, write, checkpoint, once)


#: Large states live on the executors' disks there, with changes under the checkpoint.
_STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Latest(StatefulProcessor):
    """For each source, the digest and the time of the content that was let through last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "arrived long, digest string")

    def handleInputRows(self, key, rows, timerValues):
        newest = None  # one row in memory, however often a source is delivered
        for row in rows:
            if newest is None or (row.arrived, row.digest) > (newest.arrived, newest.digest):
                newest = row
        last = self.last.get() if self.last.exists() else None
        if last is None or newest.arrived >= last[0]:
            self.last.update((newest.arrived, newest.digest))
            if last is None or newest.digest != last[1]:
                yield newest


def changed_documents(deliveries: DataFrame) -> DataFrame:
    """Of a stream of documents with the time they ``arrived``, those that are new or differ from their source's last.

    State is a digest and a time for each source, for as long as the stream lives. Of several deliveries of a source in
    one micro-batch the last counts, of equal times the one with the larger digest; a delivery older than the
    last one let through is left out. The digest covers text, category and file name. Rows with a null text, source or time
    give nothing and change nothing; an empty text is a content like others. Other columns are not read.
    """
    columns = DOCUMENT.fieldNames()
    known = deliveries.where("text is not null and source is not null and arrived is not null").select(
        *columns, F.unix_micros("arrived").alias("arrived"),
        F.sha2(F.to_json(F.struct("text", "category", "filename")), 256).alias("digest"))
    return known.groupBy("source").transformWithState(
        _Latest(), known.schema, outputMode="append", timeMode="none").select(*columns)


def replace_stream(deliveries: DataFrame, root: str, embedder, checkpoint: str,
                   settings: Settings = Settings(), name: str = "changes", once: bool = True) -> StreamingQuery:
    """Keep the collection at ``root`` at the last content of every source that is delivered.

    A source that comes again unchanged is skipped before anything is cleaned or embedded; a changed one replaces its
    chunks, and one that became empty loses them. Each micro-batch is one commit under the stream's name and its number,
    and the state goes back with a failed micro-batch, so one that is handed over again has the same effect once. After a
    rebuild from other documents, begin with a new checkpoint and name: the state tells what was delivered, not what is stored.
    """

    def write(rows: DataFrame, number: int) -> None:
        session, label = rows.sparkSession, (name, number)
        # Written once, though what follows reads it several times; and written even where the batch is known, as the
        # state of a micro-batch counts only when its rows were computed.
        path = stage(rows)
        if not store.has_label(session, root, label):
            add_documents(session.read.schema(DOCUMENT).parquet(path), root, embedder, settings, replace=True, batch=label)
        store.remove(session, path)

    conf = deliveries.sparkSession.conf
    before = conf.get(_STATE_STORE[0])
    conf.set(*_STATE_STORE)
    try:  # a query takes its settings along when it starts
        return _start(changed_documents(deliveries), write, checkpoint, once)
    finally:
        conf.set(_STATE_STORE[0], before)
