"""An inverted-file index of stored vectors: folders of cells around fitted centres, with distances to pivots.

Centres come from distributed k-means over a sample; every vector is in the index. A search reads the folders of a few
cells near each query (approximate, with a recall measured when the index is built), or of all cells that the
triangle inequality does not rule out (exact). Distances to pivots are plain columns, sorted inside a file, so that a
range search skips row groups before any vector is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.knn import HITS, QueryBlock, RunningHits, matrix
from passagework.functions.vectors import radius_of
from passagework.lineage import cut
from passagework.operators.grid import dealt, folded, gathered, meet, packed, unpacked
from passagework.operators.search import CODEC, TOGETHER, fetch_hits, found_schema, normalised, rank_hits, ranked_hits, vectors_of
from passagework.schemas import Settings

#: Most cells of an index; centres are kept by the driver and sent to tasks, so this bounds them.
CELLS = 4096
#: About so many rows, chosen by a hash of their keys, fit the centres; so many more measure the recall.
SAMPLE, AUDIT = 65_536, 256
ROUNDS, PIVOTS = 8, 3
#: Asked of the audited rows, so that 0.9 of all rows' neighbours are found.
RECALL = 0.93
#: Room for rounding where a bound decides that a cell cannot hold a hit.
SLACK = 1e-6


@dataclass
class CellIndex:
    """What the driver knows of an index: a row for each cell, the pivots, and how many cells a search reads."""

    root: str
    schema: str
    centres: np.ndarray  # (cells, dimension)
    rows: np.ndarray
    radius: np.ndarray  # largest distance of a vector from its centre
    low: np.ndarray  # (cells, pivots): least and largest distance of a cell's vectors from each pivot
    high: np.ndarray
    pivots: np.ndarray
    cells: np.ndarray  # their numbers; cells without rows are left out
    probes: int
    recall: float

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.root}/vectors")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``; a few rows at a time, as ``b`` is bounded."""
    out = np.empty((len(a), len(b)))
    b = b.astype(np.float64)
    size = (b * b).sum(axis=1)
    for at in range(0, len(a), 2048):
        part = a[at:at + 2048].astype(np.float64)
        out[at:at + 2048] = np.sqrt(np.maximum((part * part).sum(axis=1)[:, None] + size[None, :] - 2 * part @ b.T, 0))
    return out


def table_of(rows: list, kind=np.float64) -> np.ndarray:
    """Rows of one length as a matrix, also where there are none."""
    return np.array(rows, kind).reshape(len(rows), len(rows[0]) if rows else 0)


def _partial_sums(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = matrix(batch.column("embedding"))
            cell = distances(x, centres).argmin(axis=1)
            np.add.at(sums, cell, x)
            counts += np.bincount(cell, minlength=len(centres))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))],
                                         ["cell", "n", "sums"])

    return run


def _added(parts: pa.Table) -> pa.Table:
    sums = np.sum(parts.column("sums").to_pylist(), axis=0)
    return pa.table({"cell": pa.array([parts.column("cell")[0].as_py()], pa.int64()),
                     "n": pa.array([sum(parts.column("n").to_pylist())], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})


def fit_centres(vectors: DataFrame, keys: Sequence[str], cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of k-means over about ``sample`` rows, chosen by a hash of their keys. Tasks add up their own rows."""
    number = F.xxhash64(*keys)
    count = vectors.count()
    chosen = cut(vectors.select("embedding", number.alias("h"))
                 .where(F.pmod("h", F.lit(max(1, count))) < sample))
    first = chosen.orderBy("h").limit(cells).collect()
    centres = table_of([r.embedding for r in first], np.float32)
    for _ in range(rounds if len(centres) else 0):
        parts = chosen.select("embedding").mapInArrow(_partial_sums(centres), "cell long, n long, sums array<double>") \
            .groupBy("cell").applyInArrow(_added, "cell long, n long, sums array<double>").collect()
        before = centres.copy()
        for r in parts:
            centres[r.cell] = np.array(r.sums) / r.n
        if np.array_equal(before, centres):
            break
    return centres


def spread(points: np.ndarray, many: int) -> np.ndarray:
    """Some of the points, each as far as possible from those before it."""
    chosen = [0] if len(points) else []
    while len(chosen) < min(many, len(points)):
        chosen.append(int(distances(points, points[chosen]).min(axis=1).argmax()))
    return points[chosen]


def _placed(centres: np.ndarray, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            apart = distances(x, centres)
            cell = apart.argmin(axis=1)
            far = distances(x, pivots)
            columns = [pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(x)), cell]), *map(pa.array, far.T)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, "cell", "apart", *(f"pivot_{i}" for i in range(len(pivots)))])

    return run


def build_index(collection: DataFrame, root: str, cells: int | None = None, ties: Sequence[str] = ("ordinal",),
                pivots: int = PIVOTS, sample: int = SAMPLE, recall: float = RECALL, top_k: int = 5) -> CellIndex:
    """Write an index of all vectors of ``collection`` to the folder ``root``, which must be new.

    By default the number of cells is the root of the number of rows, at most ``CELLS``. The number of cells that a
    search reads is the smallest that finds ``recall`` of the ``top_k`` nearest rows of about ``AUDIT`` stored vectors,
    compared with an exact search. A cell of very many equal vectors is written by several tasks.
    """
    spark, ties = collection.sparkSession, list(ties)
    vectors = vectors_of(collection, ties)
    count = vectors.count()
    cells = max(1, min(cells or round(count ** 0.5), CELLS, max(count, 1)))
    centres = fit_centres(vectors, ties, cells, sample)
    chosen = spread(centres, pivots)
    names = [f"pivot_{i}" for i in range(len(chosen))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) \
        + ", cell int, apart double" + "".join(f", {n} double" for n in names)
    by = ["cell", *names[:1]]
    vectors.mapInArrow(_placed(centres, chosen), schema).hint("rebalance", "cell").sortWithinPartitions(*by) \
        .write.partitionBy("cell").parquet(f"{root}/vectors")
    stored = spark.read.schema(schema).parquet(f"{root}/vectors")
    bounds = stored.groupBy("cell").agg(
        F.count("*").alias("rows"), F.max("apart").alias("radius"),
        F.array(*(F.min(n) for n in names)).cast("array<double>").alias("low"),
        F.array(*(F.max(n) for n in names)).cast("array<double>").alias("high")).orderBy("cell").collect()
    cells_rows = [(r.cell, centres[r.cell].tolist(), r.rows, r.radius, r.low, r.high) for r in bounds]
    index = _index(root, schema, cells_rows, chosen, 0, 0.0)
    index.probes, index.recall = _audited(index, stored, ties, recall, top_k, count)
    spark.createDataFrame(cells_rows, "cell int, centre array<float>, rows long, radius double, low array<double>, high array<double>") \
        .coalesce(1).write.parquet(f"{root}/cells")
    spark.createDataFrame([(index.probes, index.recall, [p.tolist() for p in chosen], schema)],
                          "probes int, recall double, pivots array<array<float>>, schema string") \
        .coalesce(1).write.parquet(f"{root}/about")
    return index


def _index(root: str, schema: str, rows: list, pivots: np.ndarray, probes: int, recall: float) -> CellIndex:
    return CellIndex(root, schema, table_of([r[1] for r in rows], np.float32), np.array([r[2] for r in rows], np.int64),
                     np.array([r[3] for r in rows], np.float64), table_of([r[4] for r in rows]), table_of([r[5] for r in rows]), pivots,
                     np.array([r[0] for r in rows], np.int32), probes, recall)


def open_index(spark: SparkSession, root: str) -> CellIndex:
    about = spark.read.parquet(f"{root}/about").first()
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/cells").orderBy("cell").collect()]
    return _index(root, about.schema, rows, table_of(about.pivots, np.float32), about.probes, about.recall)


def _audited(index: CellIndex, stored: DataFrame, ties: list[str], recall: float, top_k: int, count: int) -> tuple[int, float]:
    """(cells to read, recall there), from the places that the cells of true neighbours have in each query's order."""
    if not count:
        return 1, 1.0
    number = F.xxhash64(*ties)
    queries = cut(stored.where(F.pmod(number, F.lit(count)) < AUDIT).select(
        F.monotonically_increasing_id().alias("query_id"), "embedding"))
    found, _ = rank_hits(queries, stored.select(*ties, "embedding"), Settings(top_k=top_k), ties)
    where = found.join(stored.select(*ties, "cell"), list(ties)).join(queries, "query_id")
    centres, cells = index.centres, index.cells

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(distances(matrix(batch.column("embedding")), centres), axis=1, kind="stable")
            there = cells[order] == batch.column("cell").to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(there.argmax(axis=1))], ["place"])

    tally = where.select("embedding", "cell").mapInArrow(places, "place long").groupBy("place").count().orderBy("place").collect()
    total, seen = sum(r["count"] for r in tally), 0
    for r in tally:
        seen += r["count"]
        if seen >= recall * total:
            return r.place + 1, seen / total
    return 1, 1.0


def _reads(block: QueryBlock, index: CellIndex, probes: int | None) -> Iterator[np.ndarray]:
    """For some queries of the block after the other, whether they read each cell: the nearest ``probes``, or all that may
    hold a vector within the squared distance ``reach`` of the query."""
    for at in range(0, len(block.ids), 1024):
        x = block.vectors[at:at + 1024]
        apart = distances(x, index.centres)
        if probes is not None:
            wanted = np.zeros(apart.shape, bool)
            np.put_along_axis(wanted, np.argsort(apart, axis=1, kind="stable")[:, :probes], True, axis=1)
        else:
            reach = np.sqrt(np.maximum(block.reach[at:at + 1024], 0))
            bound = apart - index.radius
            for j, far in enumerate(distances(x, index.pivots).T):
                bound = np.maximum(bound, np.maximum(index.low[:, j] - far[:, None], far[:, None] - index.high[:, j]))
            wanted = bound <= (reach + SLACK * (1 + np.where(np.isfinite(reach), reach, 0)))[:, None]
        yield wanted


class CellHits(RunningHits):
    """Like ``RunningHits`` for blocks of rows of one cell each: only the queries that read a cell meet its vectors."""

    def __init__(self, queries: pa.RecordBatch, default_k: int, ties: list[str], index: CellIndex, probes: int | None, radius: float):
        super().__init__(queries, default_k, ties, None, radius)
        self.place = {cell: i for i, cell in enumerate(index.cells.tolist())}
        # A bit for each cell and query.
        self.reads = [np.concatenate([np.packbits(r.T, axis=1) for r in _reads(t.block, index, probes)], axis=1) for t in self.tops]

    def among(self, number: int, stored: pa.RecordBatch) -> np.ndarray:
        bits = self.reads[number][self.place[stored.column("cell")[0].as_py()]]
        return np.unpackbits(bits, count=len(self.tops[number].block.ids)).astype(bool)


def _hits_in_cells(wanted: DataFrame, count: int, index: CellIndex, ties: list[str], settings: Settings, most: int,
                   probes: int | None = None, radius: float = float("inf"), only=None) -> DataFrame:
    """Ranked hits of queries (query_id, embedding, category, top_k[, reach]) among the vectors of the cells they read.

    Blocks of queries meet blocks of cells; which queries of a block read a cell is found where they meet, so that no
    query is copied for each of its cells. The driver sees no more than which cells a part of the queries reads.
    """
    if not len(index.cells):
        return wanted.sparkSession.createDataFrame([], found_schema(ties)).select(
            "query_id", F.lit(1).alias("rank"), *ties, "distance")
    limit = max(1, min(settings.query_block, HITS // max(most, 1)))
    blocks, parts, slices = gathered(*dealt(wanted, "query_id", limit, count, CODEC), TOGETHER)
    default_k = settings.top_k

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, query in zip(batch.column("part").to_pylist(), batch.column("query"), strict=True):
                block = QueryBlock.from_arrow(pa.Table.from_batches([unpacked(query.as_buffer())]), default_k)
                some = np.zeros(len(index.cells), bool)
                for reads in _reads(block, index, probes):
                    some |= reads.any(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(index.cells[some], pa.int32()), pa.array([part] * int(some.sum()), pa.int32())],
                                                 ["key", "part"])

    # At most CELLS rows for each part.
    pairs = cut(blocks.mapInArrow(reading, "key int, part int").distinct())
    stored = index.vectors(wanted.sparkSession)
    stored = stored if only is None else stored.where(only)
    # Numbers of cells, at most CELLS of them: Spark reads their folders alone.
    cells = pairs.where("key >= 0").select(F.col("key").alias("cell")).distinct()
    stored = stored.join(F.broadcast(cells), "cell", "left_semi").select(*ties, "category", "embedding", "cell")
    met = meet(packed(stored, key="cell", codec=CODEC), blocks, parts, slices, pairs)
    found = folded(met, lambda block: CellHits(block, default_k, ties, index, probes, radius), found_schema(ties))
    return ranked_hits(found, ties, most)


def _wanted(queries: DataFrame, settings: Settings) -> tuple[DataFrame, int, int, int]:
    """Queries, written, how many there are, how many hits they want together, and the most that one wants."""
    wanted = cut(normalised(queries).where("embedding is not null").withColumn("embedding", F.col("embedding").cast("array<float>")))
    k = F.greatest(F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(settings.top_k)), F.lit(0)).cast("long")
    count, bound, most = wanted.agg(F.count("*"), F.sum(k), F.max(k)).first()
    return wanted, count, bound or 0, max(most or 0, 1)


def search_cells(queries: DataFrame, collection: DataFrame, index: CellIndex, probes: int | None = None,
                 settings: Settings = Settings(), ties: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Like ``search``, in the ``probes`` cells nearest to each query (as many as the index was measured with).
    Scores are exact; hits in other cells are missed. A folder is read once, whatever the number of queries."""
    wanted, count, bound, most = _wanted(queries, settings)
    ranked = _hits_in_cells(wanted, count, index, list(ties), settings, most, probes or index.probes)
    return fetch_hits(ranked, bound, collection, settings, ties)


def search_range(queries: DataFrame, collection: DataFrame, index: CellIndex, threshold: float | None = None,
                 max_results: int | None = None, settings: Settings = Settings(), ties: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Like ``search_above``, with the same rows, from the cells and row groups that may hold a vector near enough.

    A vector within r of a query is within r of the query's distance from every pivot. Spark pushes that, for the
    queries at hand together, into the scan; cells are chosen for each query.
    """
    threshold = settings.threshold if threshold is None else threshold
    limit, radius = max_results or settings.threshold_candidates, radius_of(threshold)
    wanted, count, bound, most = _wanted(queries.withColumn("top_k", F.lit(limit)), settings)
    only = pivot_bounds(wanted, index, radius) if np.isfinite(radius) else None
    ranked = _hits_in_cells(wanted.withColumn("reach", F.lit(radius)), count, index, list(ties), settings, most, None, radius, only)
    return fetch_hits(ranked, bound, collection, settings, ties, threshold)


def pivot_bounds(wanted: DataFrame, index: CellIndex, radius: float):
    """A condition on the pivot columns that every vector within the squared distance ``radius`` of some query meets."""
    pivots = index.pivots

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("embedding")), pivots)
            if len(d):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(d.shape[1])), pa.array(d.min(axis=0)), pa.array(d.max(axis=0))], ["pivot", "low", "high"])

    rows = wanted.select("embedding").mapInArrow(far, "pivot long, low double, high double") \
        .groupBy("pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    reach, condition = radius ** 0.5 * (1 + SLACK) + SLACK, F.lit(True)
    for r in rows:
        condition &= F.col(f"pivot_{r.pivot}").between(r.low - reach, r.high + reach)
    return condition


def search_exactly(queries: DataFrame, collection: DataFrame, index: CellIndex, settings: Settings = Settings(),
                   ties: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Like ``search``, with the same rows: the nearest cells give each query a distance that its hits cannot exceed,
    and then all cells are read that may hold a vector so near."""
    ties = list(ties)
    wanted, count, bound, most = _wanted(queries, settings)
    first = _hits_in_cells(wanted, count, index, ties, settings, most, max(1, min(index.probes, len(index.cells) // 8)))
    full = F.greatest(F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(settings.top_k)), F.lit(0))
    last = first.groupBy("query_id").agg(F.max("distance").alias("last"), F.count("*").alias("found"))
    reach = F.when(F.col("found") >= full, F.col("last")).otherwise(F.lit(float("inf")))
    bounded = cut(wanted.join(last, "query_id", "left").withColumn("reach", reach).drop("last", "found"))
    return fetch_hits(_hits_in_cells(bounded, count, index, ties, settings, most), bound, collection, settings, ties)
