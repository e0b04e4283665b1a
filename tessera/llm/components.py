"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import reliable

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class Forest:
    """Union-find over any integers; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition to a forest with the same components: one edge for each node but the roots."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            forest.join(u, v)
    nodes = list(forest.up)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([forest.root(x) for x in part], pa.int64())], schema=EDGE)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (large star) or the smaller (small star) neighbours of every node to its least one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    own = both if large else both.where("v < u")
    least = own.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    linked = own.where("v > u") if large else own
    moved = linked.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    edges has long columns u and v. Null ends and self-loops are ignored; no edge gives no row. contracted: each partition
    of edges is a forest already."""
    links = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    links = reliable((links if contracted else links.mapInArrow(contract, "u bigint, v bigint")).distinct())
    before = None
    while True:
        links = reliable(_star(_star(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    rooted = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.union(rooted.select(F.col("root").alias("node"), "root").distinct())


def to_planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints of one or more words: plane b holds bit b of every one, 64 to a machine word."""
    prints = prints.reshape(len(prints), -1)
    padded = np.zeros((-(-len(prints) // 64) * 64, prints.shape[1]), np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
