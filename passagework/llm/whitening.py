"""Whitening of embeddings: principal components with unit variance, from exact whole-number statistics.

Entries become whole numbers. Equal vectors are one vector with a multiplicity, which is its weight in the fit,
or one; a weighted product of centred matrices gives the covariance, each distinct vector is whitened once, and
its result is joined back to the rows that have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.lineage import cut
from passagework.llm.exact_dedup import COUNTERS, frequent

#: x = floor(SCALE * entry) + SHIFT
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this many become it; beyond it a double has no fraction to floor.
LARGEST = 2.0 ** 46
#: Components with less than this part of the largest eigenvalue have no spread but rounding.
FLAT = 1e-12
#: Vectors handled at once.
AT_ONCE = 4096


def matrix(lists: pa.Array, kind=np.int64) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(kind, copy=False)


def _integers(id_column: str, vector_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(np.clip(values, -LARGEST, LARGEST) * SCALE).astype(np.int64) + SHIFT
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            digests = [hashlib.sha256(x[a:b].tobytes()).digest() for a, b in zip(ends - np.diff(ends, prepend=0), ends, strict=True)]
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x)), pa.array(digests, pa.binary())],
                ["id", "x", "digest"])

    return run


def integers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, x, digest): whole-number vectors of the rows whose vector has no null and non-finite entry."""
    kind = vectors.schema[id_column].dataType.simpleString()
    vector = F.col(vector_column).cast("array<double>")
    return vectors.select(F.col(id_column).alias("id"), vector.alias("v")) \
        .where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(
            "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))) \
        .mapInArrow(_integers("id", "v"), f"id {kind}, x array<long>, digest binary")


def totals(distinct: DataFrame, weight: str) -> tuple[int, list[int]]:
    """Sum of weights and, for each dimension, the weighted sum: one row of the table's width."""
    row = distinct.select(F.posexplode("x").alias("i", "c"), F.col(weight).alias("w")) \
        .groupBy("i").agg(F.sum("w").alias("n"), F.sum(F.col("c") * F.col("w")).alias("s")).orderBy("i").collect()
    return (row[0]["n"], [r["s"] for r in row]) if row else (0, [])


def product(table: DataFrame, column: str, weight: str, centre) -> np.ndarray:
    """Weighted sum of the outer products of centred rows. ``centre(matrix)`` gives the centred rows.

    Each task adds up its own rows with matrix products; only sums of tasks, a square of the dimension, are
    shuffled, cell by cell.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows = centre(matrix(part.column(0), None))
                weights = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                add = (rows * weights[:, None]).T @ rows
                total = add if total is None else total + add
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["cell", "v"])

    cells = table.select(column, F.col(weight).cast("long")).mapInArrow(run, "cell long, v double") \
        .groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    side = round(len(cells) ** 0.5)
    return np.array([c["v"] for c in cells]).reshape(side, side)


class Centre:
    """x - S / n without rounding of large numbers: whole parts are taken off first."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        whole = [divmod(s, n) for s in sums]
        self.whole = np.array([q for q, _ in whole], np.int64)
        self.left = np.array([r for _, r in whole], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.left / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each row the sum of (n x - S)^2, exactly."""
        gap = x - self.whole
        most = int(np.abs(gap).max(initial=0)) + 1
        if (most * self.n) ** 2 * x.shape[1] < 2 ** 63:
            off = gap * self.n - self.left
            return (off * off).sum(axis=1).tolist()
        left = [int(r) for r in self.left]
        return [sum((self.n * c - r) ** 2 for c, r in zip(row, left, strict=True)) for row in gap.tolist()]


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling; the largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    spread = values > FLAT * max(float(values[0]), 0.0)
    values, vectors = values[spread][:most], vectors[:, spread][:, :most]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] if vectors.size else np.ones(0)
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def _whitened(centre: Centre, projection: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                x = matrix(part.column("x"))
                out = centre(x) @ projection
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), part.column("w"), pa.array([str(d) for d in centre.deviations(x)], pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))],
                    ["digest", "w", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
           most: int = COMPONENTS, weights: str = "one", k: int = COUNTERS) -> DataFrame:
    """One row per row with a whole vector and component up to ``most``: id, component, n, deviation, whitened,
    explained, identity_error.

    Entries c become x = floor(64 c) + 1000000. The fit covers every distinct x vector, weighted by its ``"count"``
    or ``"one"``; n is the sum of weights and ``deviation`` the exact sum of (n x - S)^2 as a decimal. ``whitened``
    is the centred vector's part along the component over the root of its eigenvalue, ``explained`` the
    eigenvalue's part of the trace, ``identity_error`` the largest absolute entry of the whitened fit's covariance
    minus the identity.

    Rows whose vector is null, empty or has a null or non-finite entry are left out; so are components without
    spread, all of them where all vectors are equal. Entries beyond 2^46 count as that. Vectors of unlike lengths
    are an error. Rows that repeat an id stay, null ids too; other columns are not read; an empty table gives an
    empty table.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be one or count")
    rows = cut(integers(vectors, id_column, vector_column))
    # The vector itself is part of the key, so equal digests alone never join vectors.
    distinct = cut(rows.groupBy("digest", "x").agg(F.count("*").alias("count")).withColumn("one", F.lit(1).cast("long")))
    lengths = distinct.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors have {lengths[0]} to {lengths[1]} entries")
    n, sums = totals(distinct, weights)
    centre = Centre(max(n, 1), sums)
    covariance = product(distinct, "x", weights, centre) / max(n, 1)
    values, axes = components(covariance, most) if n else (np.zeros(0), np.zeros((0, 0)))
    projection = axes / np.sqrt(values)
    explained = values / np.trace(covariance) if n else values
    done = distinct.select("digest", "x", F.col(weights).alias("w")).mapInArrow(
        _whitened(centre, projection), "digest binary, w long, deviation string, whitened array<double>")
    done = cut(done.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")))
    error = identity_error(done, n) if len(values) else None
    named = done.withColumn("parts", F.transform("whitened", lambda c, i: F.struct(
        (i + 1).cast("int").alias("component"), c.alias("whitened"),
        F.element_at(F.array(*map(F.lit, explained.tolist())) if len(explained) else F.array(F.lit(None).cast("double")),
                     (i + 1).cast("int")).alias("explained"))))
    joined = _joined(rows.select("id", "digest"), named.select("digest", "deviation", "parts"), k)
    return joined.select(F.col("id").alias(id_column), F.lit(n).cast("long").alias("n"), "deviation", F.inline("parts")) \
        .select(id_column, "component", "n", "deviation", "whitened", "explained",
                F.lit(error).cast("double").alias("identity_error"))


def identity_error(done: DataFrame, n: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, under the weights of the fit."""
    sums = done.select(F.posexplode("whitened").alias("i", "c"), "w").groupBy("i") \
        .agg(F.sum(F.col("c") * F.col("w")).alias("s")).orderBy("i").collect()
    means = np.array([r["s"] for r in sums]) / n
    found = product(done, "whitened", "w", lambda x: x - means) / n
    return float(np.abs(found - np.eye(len(found))).max())


def _joined(rows: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Each row with the result of its vector. Results of frequent vectors, at most ``k`` of them, go to the rows;
    other vectors are on few rows, which move."""
    hot = cut(frequent(rows, k))
    common = results.join(F.broadcast(hot), "digest")
    near = rows.join(F.broadcast(common), "digest")
    far = rows.join(F.broadcast(hot), "digest", "left_anti").join(results, "digest")
    return near.unionByName(far)
