"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftworks.llm.common import staged, temporaries


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours link to its least neighbour (or itself); small: its smaller ones and itself do."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # edges hold a > b; for the small star only the smaller neighbours (b) of a count
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    rows = both.join(least, "a")
    if large:
        out = rows.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = rows.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def contracted(up: dict, links: Iterable[tuple[int, int]]) -> None:
    """Takes links into a forest: up gives each node that is no root the least node that it reaches."""

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    for x in list(up):
        up[x] = root(x)


def _contracted(batches):
    """The links of one task, each node linked to the least node that it reaches by them."""
    up: dict = {}
    for batch in batches:
        contracted(up, zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (up.keys(), up.values())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) of every node that has a link; edges are pairs (a, b) of longs.

    Loops and repeated or reversed pairs do not matter; no edges give no rows. The edges stay spread over the cluster; only the
    number of them and a checksum, which stop changing at the end, reach the driver."""
    with temporaries():
        edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges, last = staged(edges.mapInArrow(_contracted, edges.schema).distinct()), None
        while True:
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == last or not now[0]:
                return staged(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), keep=True)
            last = now
            edges = staged(_star(_star(edges, True), False))
