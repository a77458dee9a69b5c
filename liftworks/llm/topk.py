"""Exact top-k search by inner product, MaxScore over vectors of whole numbers.

A query's dimensions are its terms. In a stretch of a shard, a term adds at least its least contribution and at most its bound more.
Terms are ordered by bound. The last ones whose bounds together cannot lift a vector to the query's k-th best score so far, theta,
are non-essential: the essential ones are traversed for all vectors of the stretch, the others probed in turn, only for vectors that
stay competitive. theta starts with the k-th best score among a small seed of vectors, rises from stretch to stretch, and moves the
essential line with it. Each vector goes to one shard, once; the queries stream past every shard, and the shards' best rows are merged
by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftworks.llm.common import small_batches, table

K, QUERY_STEP = 5, 50
#: Components (of 8 bytes) of a shard's vectors, about: they bound what a task holds, with a batch of queries. Where there is less,
#: shards have LEAST vectors at least and are as many as SPREAD x the cores.
SHARD, LEAST, SPREAD = 1 << 22, 2048, 2
#: Vectors of a shard gone through before theta is raised, terms probed between two looks at who is still competitive, and components
#: of the seed that gives the first theta.
STRETCH, PROBE, SEED = 4096, 8, 1 << 15
#: Sums of products below these are exact in float64 and in int64, with the bounds added to them on the way; beyond, Python's whole numbers.
EXACT, LONG = 2.0**50, 2.0**60


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and v, each component floor(256 x) as long; vectors that are null, empty or hold null or non-finite components are left out.

    A finite component too large for a long fails the query. Rows without a vec_id are left out; other columns play no part."""
    scaled = lambda c: F.lit(256.0) * c.cast("double")
    large = F.raise_error(F.lit("topk: 256 times a component does not fit a long")).cast("long")
    x = F.transform("embedding", lambda c: F.when(F.abs(scaled(c)) < 2.0**63, F.floor(scaled(c))).otherwise(large))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).where("vec_id IS NOT NULL")


def in_exact_numbers(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64, int64 or Python's whole numbers: the first kind in which every sum on the way is exact."""
    size = lambda x: np.abs(x.astype(np.float64)).max(axis=0)
    peak = float(size(vectors) @ size(queries))
    kind = np.float64 if peak < EXACT else np.int64 if peak < LONG else object
    return vectors.astype(kind), queries.astype(kind)


def leading(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if score.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if len(ids) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Shard:
    """Vectors in stretches, each with its terms' least and largest values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.stretches = []
        for at in range(0, len(ids), STRETCH):
            v = vectors[at : at + STRETCH]
            self.stretches.append((ids[at : at + STRETCH], np.ascontiguousarray(v.T), v.min(axis=0), v.max(axis=0)))

    def best(self, q: int, w: np.ndarray, theta, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the query's k best vectors of the shard, its own id left out; those under theta (if any) may lack."""
        top_ids, top = np.empty(0, np.int64), np.empty(0, w.dtype)
        for ids, columns, lo, hi in self.stretches:
            at_lo, at_hi = w * lo, w * hi
            least = np.minimum(at_lo, at_hi)
            bound = np.maximum(at_lo, at_hi) - least
            terms = np.argsort(-bound, kind="stable")
            left = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], np.zeros(1, w.dtype)])  # what the terms from here on can still add
            base = least.sum()
            essential = len(terms) if theta is None else int((base + left >= theta).sum())
            if not essential:
                continue  # all terms together do not reach theta
            some = terms[:essential]
            score, rows = base - least[some].sum() + w[some] @ columns[some], None
            for at in range(essential, len(terms) + PROBE, PROBE):
                if theta is not None:
                    keep = np.flatnonzero(score + left[min(at, len(terms))] >= theta)
                    rows, score = keep if rows is None else rows[keep], score[keep]
                some = terms[at : at + PROBE]
                if not len(score) or not len(some):
                    break
                score = score - least[some].sum() + w[some] @ (columns[some] if rows is None else columns[np.ix_(some, rows)])
            found = ids if rows is None else ids[rows]
            other = found != q
            top_ids, top = np.concatenate([top_ids, found[other]]), np.concatenate([top, score[other]])
            first = leading(top_ids, top, k)
            top_ids, top = top_ids[first], top[first]
            if len(top) == k and (theta is None or top[-1] > theta):
                theta = top[-1]
        return top_ids, top


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of all other vectors (all, if fewer), ties to the smaller vec_id.

    Both frames hold vec_id and v (arrays of long without nulls, as `whole` makes them); rows where either is null take no part, nor do
    other columns. Shorter vectors count as zero beyond their end. Rows
    alike in vec_id are candidates each of their own; as queries they share one list and leave out all of that id. No queries or no
    vectors give no rows. A score that does not fit a long is an error."""
    spark = vectors.sparkSession
    small_batches(spark)
    vectors, queries = (x.select("vec_id", "v").where("vec_id IS NOT NULL AND v IS NOT NULL") for x in (vectors, queries))
    n, d = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(d, queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0], 1)
    shards = max(-(-n * width // SHARD), min(SPREAD * spark.sparkContext.defaultParallelism, n // LEAST), 1)

    def padded(rows: pa.ChunkedArray) -> np.ndarray:
        c = rows.combine_chunks()
        flat, ends = c.flatten().to_numpy(zero_copy_only=False), c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if (ends == width).all():
            return flat.reshape(len(ends), width)
        out = np.zeros((len(ends), width), np.int64)
        out[np.arange(width) < ends[:, None]] = flat
        return out

    def thresholds(seed_ids: np.ndarray, seed: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> list[int | None]:
        """k-th best score of each query among the seed."""
        v, w = in_exact_numbers(seed, queries)
        out = []
        for q, x in zip(query_ids, w, strict=True):
            s = np.sort((v @ x)[seed_ids != q])
            out.append(int(s[-k]) if len(s) >= k else None)
        return out

    # At most SEED components: those with the least hashes reach the driver and go to the tasks.
    chosen = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(max(2 * k, SEED // width)).toArrow()
    seed_ids, seed = chosen.column("vec_id").to_numpy(), padded(chosen.column("v"))

    v = vectors.select("*", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"))
    q = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"))

    def found(shard: dict, rows: pa.RecordBatch, vectors: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        query_ids, queries = rows.column("vec_id").to_numpy(), padded(pa.chunked_array([rows.column("v")]))
        first = thresholds(seed_ids, seed, query_ids, queries) if len(seed_ids) else [None] * len(query_ids)
        whole, queries = in_exact_numbers(vectors, queries)
        if whole.dtype not in shard:
            shard[whole.dtype] = Shard(ids, whole)
        out = []
        for q, w, theta in zip(query_ids.tolist(), queries, first, strict=True):
            for i, s in zip(*shard[whole.dtype].best(q, w, theta, k), strict=True):
                if abs(s) >= 1 << 63:
                    raise OverflowError(f"topk: a score of query {q} does not fit a long")
                out.append((q, int(i), int(s)))
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    def run(batches):
        """Of each shard first its vectors come, which are held, then the queries in batches."""
        at, held, ready, ids, vectors = None, [], {}, None, None
        for b in batches:
            keys, is_query = b.column("shard").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (is_query[1:] != is_query[:-1])) + 1 if len(keys) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi == lo:
                    continue
                rows = b.slice(lo, hi - lo)
                if keys[lo] != at:
                    at, held, ready, vectors = keys[lo], [], {}, None
                if not is_query[lo]:
                    held.append(rows)
                elif held:
                    if vectors is None:
                        table_ = pa.Table.from_batches(held)
                        ids, vectors = table_.column("vec_id").to_numpy(), padded(table_.column("v"))
                    yield found(ready, rows, vectors, ids)

    # Few shards of much work: they are dealt out as they are, not put together by their bytes.
    dealt = v.unionByName(q).repartition(shards + 3 * min(shards, 100), "shard").sortWithinPartitions("shard", "query", "vec_id")
    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every embedding whose vec_id is divisible by 50: query_id, rank, vec_id, score."""
    vectors = whole(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e d ON d.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id::BIGINT AS query_id, rank, vec_id::BIGINT AS vec_id, score FROM r WHERE rank <= {K}"""
