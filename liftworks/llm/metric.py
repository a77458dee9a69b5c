"""Near-duplicate vectors by an exact metric range join on the angles between them.

Pivots, a hashed sample of the vectors, part the sphere: each vector's home is the cell of its nearest pivot, in its core (within half
the range of the pivot) or its rim. By the triangle inequality all vectors of a core are in range of each other, so these links are
counted, not compared; a vector can reach another cell's core only from within one and a half ranges of its pivot, and its rim only if
its distance to the plane between the two pivots is within range. There it is copied to: of two cells, to one of the two, so that each
pair meets once. Cells join independently, large ones in blocks, and give per vector a count of links and one link of a forest, never
the pairs themselves.

Equal vectors are one, with a count. Without structure in the vectors (angles all near 90 degrees) no partition of this kind can prune:
a vector then visits about half of all cells, and the work is that of comparing all blocks once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of different
lengths with each other; rows alike in vec_id are vectors of their own; a row without vec_id links like others, and the component of
such rows alone has no id; repeated rows link with each other; an empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.llm.common import small_batches, staged, table, temporaries
from liftworks.llm.components import components

#: Least cosine of a link.
COSINE = 0.9
#: Components (of 8 bytes) of a block of vectors, of all pivots, and of the sample that they are chosen from, at most.
BLOCK, PIVOTS, SAMPLE = 1 << 20, 1 << 20, 1 << 22
#: Cells where all vectors would fit a few blocks.
LEAST_CELLS = 16
#: Rows of a block that are compared at once, and cosines with pivots that are held at once, about.
TILE, HELD = 512, 1 << 20
#: What bounds on angles and distances are widened by: far above the rounding of a double, far below any difference of interest.
SLACK = 1e-6


def distinct(vectors: DataFrame) -> DataFrame:
    """k1, k2 (128 bits of the vector), v, m (rows that have it): the vectors that can link, each once."""
    return keyed(vectors).where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.any_value("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("vec_id"))


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, v, k1, k2 of every row; the keys are null where the vector links with nothing."""
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & F.exists(v, lambda c: c != 0)
    v = F.when(F.coalesce(good, F.lit(False)), v)
    key = lambda seed: F.when(v.isNotNull(), F.xxhash64(F.lit(seed), v))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), key(1).alias("k1"), key(2).alias("k2"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists are all of one length, in double precision."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Cells:
    """The partition of the sphere by pivots (rows of unit vectors) for links of a least cosine."""

    def __init__(self, pivots: np.ndarray, cosine: float):
        self.pivots, reach = pivots, math.acos(cosine)
        self.core = math.cos(reach / 2 - SLACK)
        self.far = math.cos(1.5 * reach + SLACK)
        self.width = math.sin(reach) + SLACK

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Home pivot, whether in its core, and the cells visited (2 x pivot for its rim, 1 more for its core) of each row of x."""
        cos = x @ self.pivots.T
        home, rows = cos.argmax(axis=1), np.arange(len(x))
        top = cos[rows, home]
        core = top >= self.core
        at = np.arange(len(self.pivots))
        gap = np.sqrt(np.maximum(2 - 2 * self.pivots[home] @ self.pivots.T, 0))  # between the home's pivot and each other one
        turn = (home[:, None] > at) == ((home[:, None] + at) % 2 == 0)  # of two cells, who visits whom
        other = turn & (at != home[:, None])
        rim = other & (top[:, None] - cos <= self.width * gap + SLACK)
        near = other & (cos >= self.far)
        own = (at == home[:, None]) & ~core[:, None]
        rim |= own  # rims compare within themselves
        near |= own & (cos >= self.far)
        seen = np.stack([rim, near], axis=2).reshape(len(x), -1)
        return home, core, [np.flatnonzero(r) for r in seen]


def chosen(units: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """At most `most` rows, in order, none in link with one before."""
    kept = np.empty((0, units.shape[1]))
    for at in range(0, len(units), TILE):
        block = units[at : at + TILE]
        free = np.flatnonzero((block @ kept.T < cosine).all(axis=1)) if len(kept) else np.arange(len(block))
        for i in free:
            if len(kept) >= most:
                return kept
            if not len(kept) or (kept @ block[i] < cosine).all():
                kept = np.vstack([kept, block[i]])
    return kept


def linked(ids: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, units: np.ndarray, own: np.ndarray, cosine: float) -> list[tuple[int, int, int]]:
    """(id, links, least id of its part of the forest) of all rows in a link between `left` and `right` (places in the other arrays).

    own: whether a right row also stands on the left; the pair then comes twice, and counts for its left row alone."""
    names, at = np.unique(ids, return_inverse=True)
    least, count = np.arange(len(names)), np.zeros(len(names), np.int64)
    y = units[right].T
    for start in range(0, len(left), TILE):
        some = left[start : start + TILE]
        hit = units[some] @ y >= cosine
        if own.any():
            hit &= ids[some][:, None] != ids[right]
        rows = np.flatnonzero(hit.any(axis=1))
        some, hit = some[rows], hit[rows]
        if not len(rows):
            continue
        count += np.bincount(at[some], hit @ weight[right], len(names)).astype(np.int64)
        count += np.bincount(at[right], np.where(own[right], 0, weight[some] @ hit), len(names)).astype(np.int64)
        for i in range(len(rows)):
            parts = np.unique(least[np.append(at[right[hit[i]]], at[some[i]])])
            if len(parts) > 1:
                least[np.isin(least, parts)] = parts[0]
    found = np.flatnonzero((count > 0) | (least < np.arange(len(names))))
    return list(zip(names[found].tolist(), count[found].tolist(), names[least[found]].tolist(), strict=True))


def links(nodes: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """From node (long, no two alike), v (all of one length), m: counts (node, n: rows in link with it, its own copies left out) and edges (a, b) of a forest."""
    spark = nodes.sparkSession
    n, width = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block = max(BLOCK // width, 1)
    most = max(min(max(LEAST_CELLS, n // block), PIVOTS // width), 1)
    # A sample of at most SAMPLE components, those with the least hashes, reaches the driver.
    sample = nodes.orderBy(F.xxhash64("v"), "node").limit(max(min(8 * most, SAMPLE // width), 1)).select("v").toArrow()
    cells = Cells(chosen(matrix(sample.column("v")), most, cosine), cosine) if n else None

    def settle(batches):
        for b in batches:
            if b.num_rows:
                rows = max(HELD // len(cells.pivots), 1)
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    home, core, seen = cells.homes(matrix(part.column("v")))
                    cell = pa.array((2 * home + core).astype(np.int32))
                    visits = pa.array([s.astype(np.int32) for s in seen], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("v"), part.column("m"), cell, visits], ["node", "v", "m", "cell", "visits"])

    kind = nodes.schema["v"].dataType.simpleString()
    settled = staged(nodes.select("node", "v", "m").mapInArrow(settle, f"node long, v {kind}, m long, cell int, visits array<int>"))
    guests = settled.select("node", "v", "m", F.explode("visits").alias("cell"), F.col("cell").alias("home"))
    # One row for each cell: at most two for each pivot.
    size = lambda rows, name: rows.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.lit(1)).cast("int").alias(name))
    sizes = staged(size(settled, "lefts").join(size(guests.select("cell"), "rights"), "cell"))
    groups = sizes.agg(F.sum(F.col("lefts").cast("long") * F.col("rights"))).first()[0] or 1
    part = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    names = ["cell", "i", "j", "node", "v", "m", "left", "own"]
    lefts = settled.drop("visits").join(F.broadcast(sizes), "cell").select("*", part(1, "lefts").alias("i"), F.lit(True).alias("left"), F.lit(False).alias("own")).select("*", every("rights").alias("j")).select(names)
    rights = guests.join(F.broadcast(sizes), "cell").select("*", part(2, "rights").alias("j"), F.lit(False).alias("left"), (F.col("home") == F.col("cell")).alias("own")).select("*", every("lefts").alias("i")).select(names)

    def compare(rows: pa.Table) -> pa.Table:
        side, ids = rows.column("left").to_numpy(), rows.column("node").to_numpy()
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        got = linked(ids, left, right, rows.column("m").to_numpy(), matrix(rows.column("v")), rows.column("own").to_numpy(), cosine) if len(left) and len(right) else []
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*got, strict=True) if got else [[]] * 3)], names=["node", "n", "link"])

    # Few groups of much work: they are dealt out as they are, not put together by their bytes.
    dealt = lefts.unionByName(rights).repartition(groups + 3 * min(groups, 100), "cell", "i", "j")
    found = staged(dealt.groupBy("cell", "i", "j").applyInArrow(compare, "node long, n long, link long"))
    # The cores: in one, all are in link with all. One row for each.
    cores = settled.where("cell % 2 = 1").groupBy("cell").agg(F.sum("m").alias("whole"), F.min("node").alias("link"))
    near = settled.where("cell % 2 = 1").join(F.broadcast(cores), "cell").select("node", (F.col("whole") - F.col("m")).alias("n"), "link")
    rows = found.unionByName(near)
    return rows.groupBy("node").agg(F.sum("n").alias("n")), rows.where("node <> link").select(F.col("node").alias("a"), F.col("link").alias("b"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding): links from a cosine on, between 0 and 1."""
    if not 0 < cosine < 1:
        raise ValueError(f"metric: a cosine between 0 and 1 is needed, not {cosine}")
    spark = vectors.sparkSession
    small_batches(spark)
    with temporaries():
        nodes = staged(distinct(vectors).withColumn("node", F.monotonically_increasing_id()))
        counts, edges = None, None
        for (size,) in nodes.select(F.size("v")).distinct().orderBy(F.size("v")).collect():  # one run for each length of vectors
            c, e = links(nodes.where(F.size("v") == size), cosine)
            counts, edges = (c, e) if counts is None else (counts.unionByName(c), edges.unionByName(e))
        told = nodes.select("k1", "k2", "node", "m", "vec_id")
        if counts is None:
            told = told.select("k1", "k2", "m", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component"))
        else:
            parts = components(edges)
            told = told.join(counts, "node", "left").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
            told = staged(told.select("k1", "k2", "m", F.coalesce("n", F.lit(0)).alias("n"), "root", "vec_id"))
            least = told.groupBy("root").agg(F.min("vec_id").alias("component"))
            told = told.join(least, "root").select("k1", "k2", "m", "n", "component")
        rows = keyed(vectors).select("vec_id", "k1", "k2").join(told, ["k1", "k2"], "left")
        alone = F.col("m").isNull()
        rows = rows.select("vec_id", F.when(alone, 0).otherwise(F.col("n") + F.col("m") - 1).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
        return staged(rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), keep=True)


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: vec_id, n_links, component_id, kept. Edge cases as the module states."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
c AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT c.vec_id, l.b FROM c JOIN l ON l.a = c.other),
k AS (SELECT vec_id, min(other) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id::BIGINT AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, k.component_id::BIGINT AS component_id, e.vec_id = k.component_id AS kept
FROM embeddings e JOIN k USING (vec_id) LEFT JOIN n ON n.a = e.vec_id"""
