"""Near-duplicate vectors: a navigable small-world graph per shard, every shard searched, exact cosines.

Equal vectors of a label are one class. The classes of a label are dealt over shards of bounded size, and
each shard gets a graph, written once. Every shard is searched by itself and, where a label has several, in rounds:
a block of shards of bounded size is broadcast, and the vectors of all later shards of its labels are searched
in its graphs. So every vector meets every shard once, and no table of pairs of shards is ever written. Each search
audits its recall against all pairs of a part of its queries, of more where few pairs are seen, and widens until the
audit passes; found pairs are verified in double precision.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.lineage import cut, shared_folder, stage
from passagework.llm.components import Forest, components
from passagework.llm.exact_dedup import COUNTERS, settle
from passagework.llm.hnsw import BATCH, BEAM, LINKS, Graph, build
from passagework.operators.ordinals import running_offsets

COSINE = 0.98
#: Classes in a shard.
SHARD = 8192
#: Each so-manieth query is audited, then the ones beside them until so many pairs are seen or no query is left.
#: An audit passes from this recall on.
AUDIT, ENOUGH, RECALL = 16, 256, 0.995
#: Bytes of graphs that are broadcast in a round, about.
ROUND = 64 << 20


def unit(values: list | None) -> np.ndarray | None:
    """The vector with length one in double precision, or None if it has no direction: it is null, empty or
    zero, or has components that are null or not finite."""
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or not np.isfinite(v).all() or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [unit(x) for x in batch.column("vector").to_pylist()]
        raw = [None if u is None else u.tobytes() for u in units]
        label = batch.column("label").to_pylist()
        digest = [None if r is None or k is None else hashlib.sha256(f"{k}|".encode() + r).digest()
                  for r, k in zip(raw, label, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(raw, pa.binary()),
                                          pa.array(digest, pa.binary())], ["key", "label", "unit", "digest"])


def _graphs(table: pa.Table) -> pa.Table:
    """One row: the graph of a shard."""
    rows = sorted(zip(table.column("node").to_pylist(), table.column("unit").to_pylist(),
                      table.column("size").to_pylist(), strict=True))
    vectors = np.array([np.frombuffer(u, np.float64) for _, u, _ in rows])
    graph = build(vectors.astype(np.float32))
    return pa.table({
        "family": table.column("family")[:1], "shard": table.column("shard")[:1], "entry": [graph.entry],
        "nodes": [np.array([r[0] for r in rows], np.int64).tobytes()], "units": [vectors.tobytes()],
        "sizes": [np.array([r[2] for r in rows], np.int64).tobytes()],
        "links": [[x.astype(np.int32).tobytes() for x in graph.links]]})


GRAPH = "family string, shard long, entry long, nodes binary, units binary, sizes binary, links array<binary>"
OTHER = "nodes: binary, units: binary, sizes: binary, entry: bigint, links: array<binary>"


class Shard:
    def __init__(self, row: dict) -> None:
        self.nodes, self.sizes = (np.frombuffer(row[x], np.int64) for x in ("nodes", "sizes"))
        self.units = np.frombuffer(row["units"], np.float64).reshape(len(self.nodes), -1)
        self.near = self.units.astype(np.float32)
        links = [np.frombuffer(x, np.int32).reshape(len(self.nodes), -1).astype(np.int64) for x in row["links"]]
        self.graph = Graph(self.near, links, row["entry"])

    def audit(self, other: Shard, cosine: float, beam: int, slack: float) -> tuple[int, int]:
        """Pairs that the search finds, and all pairs, of the audited queries. A vector's match with itself is none."""
        true = hits = 0
        for start in range(AUDIT):
            audited = np.arange(start, len(other.units), AUDIT)
            for a in range(0, len(audited), BATCH):
                some = audited[a:a + BATCH]
                truth = other.units[some] @ self.units.T >= cosine
                if other is self:
                    truth[np.arange(len(some)), some] = False
                # Queries without a pair tell nothing about recall, so they need not be searched.
                asked = np.flatnonzero(truth.any(axis=1))
                if not len(asked):
                    continue
                truth = truth[asked]
                found = np.zeros_like(truth)
                for q, p in self.graph.blocks(other.near[some[asked]], cosine - 1e-5, beam, slack):
                    found[q, p] = True
                true += int(truth.sum())
                hits += int((found & truth).sum())
            if true >= ENOUGH:
                break
        return hits, true

    def width(self, other: Shard, cosine: float) -> tuple[int, float]:
        """Beam and slack of a search whose recall in the audit is at least ``RECALL``, or a beam as wide as the shard."""
        beam, slack = BEAM, 0.02
        while beam < len(self.nodes):
            hits, true = self.audit(other, cosine, beam, slack)
            if hits >= RECALL * true:
                break
            beam, slack = min(4 * beam, len(self.nodes)), 2 * slack
        return beam, slack

    def search(self, other: Shard, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(own point, point of ``other``) of all pairs found, a block of queries after another."""
        for q, p in self.graph.blocks(other.near, cosine - 1e-5, *self.width(other, cosine)):
            exact = np.concatenate([np.einsum("kd,kd->k", other.units[q[a:a + 65_536]], self.units[p[a:a + 65_536]])
                                    for a in range(0, len(q), 65_536)])
            yield p[exact >= cosine], q[exact >= cosine]


class Pairs:
    """Pairs of a shard with itself that were seen, as bits: each counts once, from whichever side it was found."""

    def __init__(self, n: int) -> None:
        self.bits = np.zeros((n, -(-n // 8)), np.uint8)

    def new(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.minimum(p, q)[p != q], np.maximum(p, q)[p != q]
        key = np.unique(low * len(self.bits) + high)
        low, high = key // len(self.bits), key % len(self.bits)
        bit = np.left_shift(1, high & 7).astype(np.uint8)
        fresh = (self.bits[low, high >> 3] & bit) == 0
        np.bitwise_or.at(self.bits, (low[fresh], high[fresh] >> 3), bit[fresh])
        return low[fresh], high[fresh]


def _searched(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one = Shard(row)
                same = row["other"] is None
                two = one if same else Shard(row["other"])
                seen = Pairs(len(one.nodes)) if same else None
                weight_a, weight_b = np.zeros(len(one.nodes), np.int64), np.zeros(len(two.nodes), np.int64)
                # The component of every point so far; those of ``two`` follow those of ``one``.
                forest, shift = Forest(), 0 if same else len(one.nodes)
                root = np.arange(shift + len(two.nodes))
                a, b = [], []
                for p, q in one.search(two, cosine):
                    if same:
                        p, q = seen.new(p, q)
                    weight_a += np.bincount(p, two.sizes[q], len(one.nodes)).astype(np.int64)
                    weight_b += np.bincount(q, one.sizes[p], len(two.nodes)).astype(np.int64)
                    low, high = np.minimum(root[p], root[q + shift]), np.maximum(root[p], root[q + shift])
                    # One pair for each two components that meet.
                    apart = np.flatnonzero(low != high)
                    apart = apart[np.unique(low[apart] * len(root) + high[apart], return_index=True)[1]]
                    for i, x, y in zip(apart.tolist(), low[apart].tolist(), high[apart].tolist(), strict=True):
                        if forest.join(x, y):
                            a.append(one.nodes[p[i]])
                            b.append(two.nodes[q[i]])
                    if len(apart):
                        root = np.array([forest.root(x) for x in range(len(root))])
                for nodes, weight in ((one.nodes, weight_a), (two.nodes, weight_b)):
                    on = weight > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[on]), pa.array(weight[on]), pa.nulls(int(on.sum()), pa.int64())],
                        ["node", "weight", "linked"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(np.zeros(len(a), np.int64)), pa.array(b, pa.int64())],
                    ["node", "weight", "linked"])

    return run


FOUND = "node long, weight long, linked long"


def _rounds(graphs: DataFrame, round_bytes: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The graphs of labels with several shards, in folders by round, and for each round the last one that its
    labels reach. A label's shards follow each other, so a round reads the folders from its own to that one alone."""
    place = F.concat_ws("|", "family", F.lpad(F.col("shard").cast("string"), 20, "0")).alias("place")
    several = graphs.select("family", "shard").groupBy("family").agg(F.count("*").alias("n")).where("n > 1").select("family")
    sizes = graphs.select("family", place, (F.octet_length("nodes") + F.octet_length("units")
                                            + F.octet_length("nodes") * LINKS).alias("bytes")).join(several, "family")
    offsets = cut(running_offsets(sizes, "place", "bytes").select(
        "place", F.floor(F.col("offset") / round_bytes).cast("long").alias("round")))
    placed = graphs.withColumn("place", place).join(offsets, "place").drop("place")
    path = stage(placed, ["round"])
    stored = graphs.sparkSession.read.schema(f"{GRAPH}, round long").parquet(path)
    ends = Window.partitionBy("family")
    reach = stored.select("family", "round").distinct().withColumn("last", F.max("round").over(ends)) \
        .groupBy("round").agg(F.max("last").alias("last")).orderBy("round")
    return stored, [(r["round"], r["last"]) for r in reach.toLocalIterator()]


def _all_found(graphs: DataFrame, spark: SparkSession, cosine: float, round_bytes: int) -> DataFrame:
    """Weights and links that the searches of all shards found.

    Disk holds each graph twice, whatever the number of pairs of shards. A round joins its broadcast block,
    about ``round_bytes`` and one shard large, with a scan of later shards, and rows of two graphs go straight to the search.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    alone = graphs.withColumn("other", F.lit(None).cast(f"struct<{OTHER}>"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    alone.repartition(tasks, "family", "shard").mapInArrow(_searched(cosine), FOUND).write.parquet(folder)
    stored, rounds = _rounds(graphs, round_bytes)
    for number, last in rounds:
        block = stored.where(F.col("round") == number).select("family", F.col("shard").alias("next"), F.struct(
            "nodes", "units", "sizes", "entry", "links").alias("other"))
        later = stored.where(F.col("round").between(number, last)).drop("round")
        later.join(F.broadcast(block), "family").where("shard > next").drop("next") \
            .mapInArrow(_searched(cosine), FOUND).write.mode("append").parquet(folder)
    return spark.read.schema(FOUND).parquet(folder)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                    label_column: str = "label", cosine: float = COSINE, shard: int = SHARD,
                    k: int = COUNTERS, round_bytes: int = ROUND) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Two rows link when their labels are equal and not null and their cosine is at least ``cosine``. Rows
    with a null label and vectors without a direction (see ``unit``) or of another length link with nothing.
    ``n_links`` counts the other rows linked directly, copies too; ``component_id`` is the smallest id
    reachable, null only where none has an id; ``kept`` is whether it is the row's own id. Other columns are
    not read; an empty table gives an empty table. Pairs below ``cosine`` never link; a pair above it may be
    missed with the small chance that the audits leave.
    """
    kind = {c: vectors.schema[c].dataType.simpleString() for c in (id_column, label_column)}
    key = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"),
                   F.monotonically_increasing_id().alias("row"))
    rows = cut(vectors.select(key.alias("key"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
               .mapInArrow(_units, f"key struct<none: boolean, id: {kind[id_column]}, row: bigint>, "
                                   f"label {kind[label_column]}, unit binary, digest binary"))
    marked = cut(settle(rows.where("digest is not null").select("key", "digest"), k).select(
        "key", "size", F.col("first.row").alias("node"), F.col("first.id").alias("least")))
    heads = cut(marked.where("key.row = node").select("node", "size", "least"))
    family = F.concat_ws("|", F.length("unit").cast("string"), F.col("label").cast("string")).alias("family")
    classes = heads.join(rows.select(F.col("key.row").alias("node"), family, "unit"), "node")
    parts = cut(rows.where("digest is not null").select(family).groupBy("family")
                .agg(F.ceil(F.count("*") / shard).alias("parts")))
    dealt = classes.join(parts, "family").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("parts")))
    graphs = cut(dealt.select("family", "shard", "node", "unit", "size").groupBy("family", "shard")
                 .applyInArrow(_graphs, GRAPH))
    found = _all_found(graphs, vectors.sparkSession, cosine, round_bytes)
    counts = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    groups = components(found.where("linked is not null"), "node", "linked")
    named = cut(heads.join(groups.withColumnRenamed("component", "label"), "node", "left")
                .withColumn("label", F.coalesce("label", "node")))
    least = cut(named.groupBy("label").agg(F.min("least").alias("component_id")))
    final = cut(named.join(least, "label").join(counts, "node", "left").select(
        "node", "component_id", F.coalesce("weight", F.lit(0)).alias("weight")))
    linked = marked.join(final, "node").select(
        F.col("key.id").alias(id_column), (F.col("weight") + F.col("size") - 1).alias("n_links"), "component_id")
    rest = rows.where("digest is null").select(
        F.col("key.id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("key.id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
