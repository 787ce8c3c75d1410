"""Connected components of a table of links, by stars.

A union-find in each task first thins a bounded number of links to a forest. As long as there are several
tasks, rounds follow: each links every node to its smallest neighbour and to that one's own smallest. A round
is an aggregation, two joins on staged tables (so Spark may split the links of a busy node) and a distinct.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.lineage import cut

#: Links that one task holds together.
LINKS = 1_000_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            z = up.get(y, y)
            up[x] = z
            x = z
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up.setdefault(low, low)
        self.up[high] = low
        return True


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = [x for x in forest.up if forest.root(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([forest.root(x) for x in part], pa.int64()),
                                          pa.array(part, pa.int64())], ["lo", "hi"])


def _thin(links: DataFrame) -> tuple[DataFrame, int]:
    """At most one link for each node and task, and the number of tasks. ``links`` is staged."""
    tasks = links.count() // LINKS + 1
    return links.coalesce(tasks).mapInArrow(_thinned, "lo long, hi long"), tasks


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Links are pairs of longs in either order, repeated or not; links of a node with itself and links
    with null count for nothing, and so do nodes without another. An empty table gives an empty table.
    """
    links = cut(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
                .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") < F.col("hi"))).distinct())
    while True:
        thinned, tasks = _thin(links)
        stars = cut(thinned if tasks == 1 else thinned.distinct())
        if tasks == 1 or _settled(stars):
            break
        parents = cut(stars.groupBy("hi").agg(F.min("lo").alias("parent"), F.count("*").alias("n")))
        up = parents.select(F.col("hi").alias("lo"), F.col("parent").alias("above"))
        # A node's neighbours below it hang from the smallest of them; then all move up by one.
        raised = cut(stars.join(up, "lo", "left")).select(F.coalesce("above", "lo").alias("lo"), "hi")
        hung = cut(stars.join(parents.where("n > 1"), "hi")).where("lo != parent").select(
            F.col("parent").alias("lo"), F.col("lo").alias("hi"))
        links = cut(raised.unionByName(hung).distinct())
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs from one other at most, and none hangs from a node that hangs itself."""
    ends = stars.select(F.col("hi").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        stars.select(F.col("lo").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")) \
        .where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()
