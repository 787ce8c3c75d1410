"""Two tables met block by block: rows of one, in blocks, against all rows of the other.

Blocks are rows of a table, each an Arrow stream, so Spark deals them out, joins, spills and repeats them like any
others; nothing goes through the driver. Spark broadcasts the blocks of a small table and shuffles both sides
otherwise. Tasks keep a running result for a block of queries, so pairs of rows never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.lineage import cut

#: Rows and bytes of a block, and running results that a task holds at once.
ROWS, BYTES, HELD = 8192, 4 << 20, 16
#: Bytes of query blocks that are broadcast.
BROADCAST = 16 << 20


class Running(Protocol):
    """The result of a block of queries so far; results of several tasks must be mergeable."""

    def add(self, block: pa.RecordBatch) -> None: ...

    def rows(self) -> Iterator[pa.RecordBatch]: ...


def _stream(batch: pa.RecordBatch, codec: str | None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _packer(rows: int, bytes_: int, key: str | None, codec: str | None):
    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, min(rows, int(bytes_ * batch.num_rows / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)

    def by_key(table: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
        if not key:
            yield 0, table.combine_chunks().to_batches()[0]
            return
        table = table.sort_by(key).combine_chunks()
        for value in table.column(key).unique().to_pylist():
            yield value, table.filter(pa.compute.field(key) == value).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for value, whole in by_key(pa.Table.from_batches(held)):
                for block in blocks(whole):
                    # A copy, or the stream would hold the buffers of all rows that the block is a part of.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([value], pa.int32()), pa.array([_stream(pa.concat_batches([block]), codec)], pa.binary())], ["key", "data"])
            held.clear()

        # With a key, several blocks' rows are divided at once, so that blocks of one key are not too small.
        many = 8 if key else 1
        for whole in batches:
            for batch in blocks(whole):
                held.append(batch)
                if sum(b.num_rows for b in held) >= rows * many or sum(b.nbytes for b in held) >= bytes_ * many:
                    yield from flush()
        if held:
            yield from flush()

    return run


def packed(table: DataFrame, rows: int = ROWS, bytes_: int = BYTES, key: str | None = None, codec: str | None = None) -> DataFrame:
    """(key, data): blocks of rows of a partition, and of one value of the integer column ``key`` if given.

    With a ``codec`` of Arrow's, blocks that will be copied to several places are compressed once, where they are made.
    """
    return table.mapInArrow(_packer(rows, bytes_, key, codec), "key int, data binary")


def dealt(queries: DataFrame, by: str, limit: int, count: int | None = None, codec: str | None = None) -> tuple[DataFrame, int]:
    """(part, number, query) blocks of a staged table, written, and how many parts they are dealt out to.

    Rows go to parts by the hash of column ``by``; a part that gets more rows than ``limit`` has several blocks.
    """
    count = queries.count() if count is None else count
    parts = max(1, -(-count // limit))
    blocks = packed(queries.repartition(parts, by), limit, BYTES * 4, codec=codec)
    return cut(blocks.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("number"),
                             F.col("data").alias("query"))), parts


def gathered(blocks: DataFrame, parts: int, several: int) -> tuple[DataFrame, int, int]:
    """Blocks from ``dealt`` with up to ``several`` parts made one, as far as a task holds all blocks of it at once; how
    many parts that leaves, and the slices for ``meet``: 0 where the blocks are few enough to be broadcast."""
    tally = blocks.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("query")).alias("bytes")) \
        .agg(F.max("n"), F.sum("bytes")).first()
    if several > 1 and parts > 1:
        several = max(1, min(several, HELD // (tally[0] or 1)))
        blocks, parts = blocks.withColumn("part", F.floor(F.col("part") / several).cast("int")), -(-parts // several)
    if (tally[1] or 0) <= BROADCAST:
        return blocks, parts, 0
    # Every core has a pair of part and slice to work on.
    return blocks, parts, max(1, -(-2 * blocks.sparkSession.sparkContext.defaultParallelism // parts))


def meet(stored: DataFrame, queries: DataFrame, parts: int, slices: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(number, query, data): each block of ``stored`` with each block of queries from ``dealt``.

    With ``slices`` blocks of ``stored`` are dealt out to so many, and query blocks are copied to each of them, so that one
    part's work is divided; with 0 query blocks are broadcast. With ``wanted`` (key, part), a small table, a block goes
    only to the parts that want its key.
    """
    if wanted is None:
        everywhere = stored.select("data", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    else:
        everywhere = stored.join(F.broadcast(wanted), "key").select("data", "part")
    if not slices:
        return everywhere.join(queries if slices is None else F.broadcast(queries), "part").select("number", "query", "data")
    everywhere = everywhere.withColumn("slice", F.pmod(F.xxhash64("data"), F.lit(slices)).cast("int"))
    copied = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return everywhere.join(copied.hint("merge"), ["part", "slice"]).select("number", "query", "data")


def folded(met: DataFrame, opened: Callable[[pa.RecordBatch], Running], schema) -> DataFrame:
    """Rows of the running results of all blocks of queries, to be merged over tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Running] = {}
        last, block = None, None  # a stored block comes with one block of queries after the other
        for batch in batches:
            for number, query, data in zip(*(batch.column(c) for c in ("number", "query", "data")), strict=True):
                key, data = number.as_py(), data.as_buffer()
                if last is None or not data.equals(last):
                    last, block = data, unpacked(data)
                running = held.pop(key, None) or opened(unpacked(query.as_buffer()))
                if len(held) >= HELD:
                    yield from held.pop(next(iter(held))).rows()
                held[key] = running  # the last one used is the last to go
                running.add(block)
        for running in held.values():
            yield from running.rows()

    return met.mapInArrow(run, schema)
