"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets form one class; a class is a node. Each node has a signature, cut into TREES sorted orders of
DEPTH values. In each order, a node's candidates are its next NEIGHBOURS nodes that share at least half of these values, so the
depth adapts to how crowded a region is. Candidates whose signatures agree enough are checked on their full sets: first each node's
most promising ones, then all others that would still join two components. Regions (nodes alike in half of an order's values) more
crowded than NEIGHBOURS, whose nodes did not all come together, are gone through exactly: nodes outside a region's main component meet
all of that component's and the region's nodes on their full sets. Which of these nodes can have a link to another component at all is
settled first, by prefix, length and positional filters over shingles in an order of frequency; only those that can meet, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftworks.llm.common import mix, shingle_set, small_batches, staged, table, temporaries, utf8
from liftworks.llm.components import components, contracted

SHINGLE, TREES, DEPTH, NEIGHBOURS = 5, 16, 4, 8
HASHES = TREES * DEPTH
#: Links need 100 * intersection >= LINK * union.
LINK = 75
#: Signature values (of HASHES, compared by 4 bits each) that must agree for a check of the full sets: over five standard
#: deviations under what a pair at the link threshold shows.
AGREE = 30
#: Candidates of a node that are checked first.
FIRST = 6
#: Nodes of a block in the exact pass over crowded regions.
REGION_BLOCK = 512
#: Buckets of hashed shingle counts, by which shingles are ordered: their number bounds what the driver and each task hold of them.
BUCKETS = 1 << 20
_SEEDS = np.random.default_rng(2025).integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima (32 bits each) of a non-empty set."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 2048):
        part = (mix(shingles[i : i + 2048]) >> np.uint64(32)).astype(np.uint32)
        out = np.minimum(out, (part[:, None] * _SEEDS).min(axis=0))
    return out


def key_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def described(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (16 bytes of the shingle set; null if empty), sig (HASHES x 4 bytes), md5 (of the text)."""
    small_batches(documents.sparkSession)

    def run(batches):
        for b in batches:
            n, keys, sigs = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, SHINGLE)
                n.append(len(s))
                keys.append(key_of(s) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), b.column("md5")], ["doc_id", "n_shingles", "key", "sig", "md5"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).withColumn("md5", F.md5("text")).mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary, md5 string")


def forest(nodes: DataFrame) -> DataFrame:
    """A row per node and tree: tree, hi and lo (its DEPTH values in two longs that sort alike), id, bits (4 of each value), n."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(b), HASHES)
            low = ((sig >> np.uint32(9)) & 15).astype(np.uint8)
            bits = pa.array([x.tobytes() for x in (low[:, ::2] << 4) | low[:, 1::2]], pa.binary())
            wide = sig.astype(np.uint64)
            pairs = ((wide[:, ::2] << np.uint64(32)) | wide[:, 1::2]).view(np.int64)
            for t in range(TREES):
                hi, lo = (pa.array(np.ascontiguousarray(pairs[:, t * DEPTH // 2 + k])) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t, np.int32)), hi, lo, b.column("id"), bits, b.column("n")], ["tree", "hi", "lo", "id", "bits", "n"])

    return nodes.select("id", "sig", "n").mapInArrow(run, "tree int, hi long, lo long, id long, bits binary, n long")


_EQUAL4 = np.array([[((a >> 4) == (b >> 4)) + ((a & 15) == (b & 15)) for b in range(256)] for a in range(256)], np.uint8).ravel()


def _compared(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Candidate pairs (a > b, agreeing values) among rows in sorted order: each with the next NEIGHBOURS rows of its region."""
    tree, hi, _, ids, bits, n = rows
    out = []
    for step in range(1, NEIGHBOURS + 1):
        at = np.flatnonzero((hi[step:] == hi[:-step]) & (tree[step:] == tree[:-step]))
        x, y = ids[at], ids[at + step]
        ok = (x != y) & (100 * np.minimum(n[at], n[at + step]) >= LINK * np.maximum(n[at], n[at + step]))
        at = at[ok]
        agree = np.zeros(len(at), np.int32)
        for i in range(0, len(at), 20_000):
            k = at[i : i + 20_000]
            agree[i : i + 20_000] = _EQUAL4[bits[k].astype(np.uint16) * 256 + bits[k + step]].sum(axis=1)
        near = agree >= AGREE
        x, y = ids[at[near]], ids[at[near] + step]
        out.append(np.array([np.maximum(x, y), np.minimum(x, y), agree[near]], np.int64))
    return list(np.concatenate(out, axis=1))


_ROW, _PAIR = "tree int, hi long, lo long, id long, bits binary, n long", "a long, b long, agree long"
_NAMES = ["tree", "hi", "lo", "id", "bits", "n"]


def _arrays(b: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of forest rows; bits as a matrix."""
    raw = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(len(b), HASHES // 2)
    return [raw if c == "bits" else b.column(c).to_numpy() for c in _NAMES]


def _batch(rows: list[np.ndarray] | None, pairs: list[np.ndarray] | None) -> pa.RecordBatch:
    """Forest rows or pairs, the other columns null."""
    n = len(rows[0]) if rows else len(pairs[0])
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    own = [pa.array([x.tobytes() for x in c], k) if c.ndim == 2 else pa.array(c, k) for c, k in zip(rows, kinds, strict=True)] if rows else [pa.nulls(n, k) for k in kinds]
    return pa.RecordBatch.from_arrays([*own, *([pa.array(c) for c in pairs] if pairs else [pa.nulls(n, pa.int64())] * 3)], [*_NAMES, "a", "b", "agree"])


def candidates(trees: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a > b) of all sorted orders, with the signature values on which they agree.

    Partitions are ranges of the sorted orders. What ends one and begins the next (NEIGHBOURS rows each) is compared in a second,
    small pass whose size depends on the number of partitions alone."""
    spark = trees.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "hi", "lo", "id"]
    ranged = trees.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        last, first = None, 0
        for b in batches:
            if not len(b):
                continue
            now = _arrays(b)
            if first < NEIGHBOURS:
                yield _batch([c[: NEIGHBOURS - first] for c in now], None)
                first += min(len(b), NEIGHBOURS - first)
            rows = [np.concatenate(x) for x in zip(last, now, strict=True)] if last else now
            yield _batch(None, _compared(rows))
            last = [c[-NEIGHBOURS:] for c in rows]
        if last:
            yield _batch(last, None)

    got = staged(ranged.mapInArrow(run, f"{_ROW}, {_PAIR}"))

    def edge(batches):
        last = None
        for b in batches:
            if len(b):
                now = _arrays(b)
                rows = [np.concatenate(x) for x in zip(last, now, strict=True)] if last else now
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _compared(rows)], ["a", "b", "agree"])
                last = [c[-NEIGHBOURS:] for c in rows]

    edges = got.where("tree IS NOT NULL").select(*_NAMES).distinct().coalesce(1).sortWithinPartitions(*order).mapInArrow(edge, _PAIR)
    return got.where("a IS NOT NULL").select("a", "b", "agree").unionByName(edges).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, set (sorted 8-byte shingles) of the wanted nodes (id, key, doc_id of one of their documents)."""
    small_batches(documents.sparkSession)

    def run(batches):
        for b in batches:
            ids, sets = [], []
            for t, i, k in zip(b.column("text").to_pylist(), b.column("id").to_pylist(), b.column("key").to_pylist(), strict=True):
                s = shingle_set(t, SHINGLE)
                if len(s) and key_of(s) == k:  # of rows alike in doc_id, only those of the node's own set
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    found = rows.join(wanted, "doc_id").select("text", "id", "key").mapInArrow(run, "id long, set binary")

    def keyed(batches):
        for b in batches:
            sets = [s for t in b.column("text").to_pylist() if len(s := shingle_set(t, SHINGLE))]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "set"])

    # Nodes all of whose rows lack an id are found by their set's key.
    nameless = rows.where("doc_id IS NULL").select("text").mapInArrow(keyed, "key binary, set binary").join(wanted.where("doc_id IS NULL").select("id", "key"), "key")
    return found.unionByName(nameless.select("id", "set")).dropDuplicates(["id"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets meet the link threshold."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = common(x, y)
                keep.append(100 * n >= LINK * (len(x) + len(y) - n))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def stragglers(trees: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For crowded regions (over NEIGHBOURS + 1 nodes alike in hi, the values that candidates must share): (main, id), a region's main
    component (most members, then least root) and the members outside it; and (main, id) of all that they have to meet: the main
    components' nodes and the stragglers themselves."""
    at = ["tree", "hi"]
    regions = staged(trees.groupBy(*at).agg(F.count("*").alias("m")).where(F.col("m") > NEIGHBOURS + 1).select(*at))
    members = trees.select(*at, "id").join(regions, at).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = staged(members)
    sizes = members.groupBy(*at, "root").agg(F.count("*").alias("m"))
    mains = staged(sizes.groupBy(*at).agg(F.max_by("root", F.struct(F.col("m"), -F.col("root"))).alias("main")))
    outside = staged(members.join(mains, at).where(F.col("root") != F.col("main")).select("main", "id").distinct())
    held = outside.select("main").distinct()
    whole = members.select("id", "root").distinct().join(held.withColumnRenamed("main", "root"), "root").select(F.col("root").alias("main"), "id")
    return outside, whole.unionByName(outside).distinct()


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many of the sets have a shingle of each of BUCKETS hash buckets."""

    def run(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for s in b.column("set").to_pylist():
                np.add.at(n, (np.frombuffer(s, np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    rows = sets.select("set").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, seen: np.ndarray) -> DataFrame:
    """token, id, size, most: the first shingles of each set (id, set), rarest first, of which two sets in link share one at least.

    most: the largest size of a set that could link with this one if the token is the first that they share."""
    seen = sets.sparkSession.sparkContext.broadcast(seen)  # BUCKETS numbers

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for i, raw in zip(b.column("id").to_pylist(), b.column("set").to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                order = np.lexsort((s, seen.value[(s % np.uint64(BUCKETS)).astype(np.int64)]))
                n = len(s)
                first = order[: n + 1 - (LINK * n + 99) // 100]
                left = n - np.arange(len(first))  # shingles from there on: a link needs LINK / (100 + LINK) of both sizes
                for c, x in zip(out, (s[first].view(np.int64), np.full(len(first), i), np.full(len(first), n), (100 + LINK) * left // LINK - n), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], ["token", "id", "size", "most"])

    return sets.select("id", "set").mapInArrow(run, "token long, id long, size long, most long")


def reachable(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """id of the nodes among the sets (id, set) that the filters leave with a possible link to a node of another component (id, root).

    Of all that share a token and are of one size, the two components of the largest `most` say whether there is one: so a list of any
    length is summed up before it is shuffled, and what meets it are its sizes, not its nodes."""
    rows = staged(prefixes(sets, frequencies(sets)).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    tops = rows.groupBy("token", "size", "root").agg(F.max("most").alias("most"))
    w = Window.partitionBy("token", "size").orderBy(F.desc("most"), "root")
    tops = tops.withColumn("_n", F.row_number().over(w)).where("_n <= 2").drop("_n")
    # Sizes in link lie within a ratio of 3 to 4, so in the same band of that width or the next ones.
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(100.0 / LINK)) + 1e-9).cast("int")
    lists = tops.select("token", F.struct("size", "most", "root").alias("x"), F.explode(F.array(*[band + d for d in (-1, 0, 1)])).alias("band"))
    lists = lists.groupBy("token", "band").agg(F.collect_set("x").alias("xs"), F.min("x.root").alias("lo"), F.max("x.root").alias("hi")).where("lo <> hi").select("token", "band", "xs")
    e, t = rows.withColumn("band", band).alias("e"), lists.alias("t")
    fits = lambda x: (x["root"] != F.col("e.root")) & (x["size"] <= F.col("e.most")) & (x["most"] >= F.col("e.size"))
    met = (F.col("e.token") == F.col("t.token")) & (F.col("e.band") == F.col("t.band")) & F.exists(F.col("t.xs"), fits)
    return e.join(t, met, "left_semi").select("id").distinct()


def met(outside: DataFrame, whole: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between stragglers and what they have to meet, in blocks, by products of 0/1 matrices over shared shingles.

    A block gives no more links than it has nodes: each node's link to another that it reaches inside the block."""
    blocks = whole.groupBy("main").agg(F.expr(f"1 + count(*) div {REGION_BLOCK}").alias("blocks"))
    strips = outside.groupBy("main").agg(F.expr(f"1 + count(*) div {REGION_BLOCK}").alias("strips"))
    grid = staged(blocks.join(strips, "main"))
    part = lambda n: F.pmod(F.xxhash64("id"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = outside.join(grid, "main").withColumn("strip", part(F.col("strips"))).withColumn("block", each("blocks"))
    right = whole.join(grid, "main").withColumn("block", part(F.col("blocks"))).withColumn("strip", each("strips"))
    names = ["main", "block", "strip", "id", "set"]
    left, right = (x.join(sets, "id").select(*[F.col(c).alias(c + side) for c in names]) for x, side in ((left, "_l"), (right, "_r")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ks, ms = left.column("id_l").to_pylist(), right.column("id_r").to_pylist()
        a, b = [[np.frombuffer(x, np.uint64) for x in c.to_pylist()] for c in (left.column("set_l"), right.column("set_r"))]
        forest: dict = {}
        if a and b:
            every, n = np.unique(np.concatenate([np.unique(np.concatenate(a)), *b]), return_counts=True)
            shared = every[n > 1]
            size_b = np.array([len(x) for x in b])
            for i in range(0, len(a), 256):
                own = a[i : i + 256]
                words = np.intersect1d(np.concatenate(own), shared)
                m = np.zeros((len(own), len(words)), np.float32)
                for r, x in enumerate(own):
                    at = np.searchsorted(words, x)
                    at[at == len(words)] = 0
                    if len(words):
                        m[r, at[words[at] == x]] = 1
                size_a = np.array([len(x) for x in own])
                for j in range(0, len(b), 256):
                    other = np.zeros((len(b[j : j + 256]), len(words)), np.float32)
                    for r, x in enumerate(b[j : j + 256]):
                        at = np.searchsorted(words, x)
                        at[at == len(words)] = 0
                        if len(words):
                            other[r, at[words[at] == x]] = 1
                    both = m @ other.T
                    union = size_a[:, None] + size_b[None, j : j + 256] - both
                    at_a, at_b = np.nonzero(100 * both >= LINK * union)
                    contracted(forest, ((ks[i + r], ms[j + c]) for r, c in zip(at_a.tolist(), at_b.tolist(), strict=True)))
        return pa.table([pa.array(list(c), pa.int64()) for c in (forest.keys(), forest.values())], names=["a", "b"])

    keys = ["main", "block", "strip"]
    return left.groupBy(*[k + "_l" for k in keys]).cogroup(right.groupBy(*[k + "_r" for k in keys])).applyInArrow(run, "a long, b long")


def _classes(documents: DataFrame, described_: DataFrame) -> DataFrame:
    """key, component (a number), component_id (least doc_id; null if no row of it has one) of every distinct shingle set."""
    with temporaries():
        nodes = described_.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n"))
        nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()))  # written once: the numbers stay
        trees = staged(forest(nodes))
        pairs = staged(candidates(trees))
        ids = nodes.select("id", "key", "doc_id")
        inside = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = staged(sets_of(documents, inside.join(ids, "id")))
        ends = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("end"))
        w = Window.partitionBy("end").orderBy(F.desc("agree"), "a", "b")
        first = ends.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= FIRST).select("a", "b").distinct()
        roots = components(confirmed(first, sets))

        def apart(pairs: DataFrame) -> DataFrame:
            """Pairs of different components, with these components."""
            a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
            rows = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b"))
            return rows.where(F.col("ra") != F.col("rb"))

        def joined(links: DataFrame) -> DataFrame:
            """The components once these links are in: only the components they touch are gone through again."""
            rows = apart(links).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
            over = components(rows).select(F.col("node").alias("root"), F.col("root").alias("over"))
            seen = roots.select("node", "root").unionByName(rows.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")))
            return staged(seen.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root")))

        more = staged(confirmed(apart(pairs), sets))
        if not more.isEmpty():
            roots = joined(more)
        outside, whole = stragglers(trees, roots.withColumnRenamed("node", "id"))
        if not outside.isEmpty():
            whole = staged(whole)
            inside = staged(whole.select("id").distinct())
            extra = staged(inside.join(sets.select("id"), "id", "left_anti"))
            if not extra.isEmpty():
                sets = sets.unionByName(staged(sets_of(documents, extra.join(ids, "id"))))
            can = staged(reachable(sets.join(inside, "id", "left_semi"), roots.withColumnRenamed("node", "id")))
            more = staged(met(staged(outside.join(can, "id", "left_semi").select("main", "id")), staged(whole.join(can, "id", "left_semi").select("main", "id")), sets))
            if not more.isEmpty():
                roots = joined(more)
        classes = staged(ids.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
        least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return staged(classes.join(least, "root").select("key", F.col("root").alias("component"), "component_id"), keep=True)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Texts that are null, empty or without words have no shingles and link with nothing; exact copies share a class; rows alike in
    doc_id but not in text are each classified by their own text; rows without a doc_id take part, and a component without any doc_id
    has a null component_id. kept: the row's doc_id is its component's. Other columns play no part; an empty table gives no rows."""
    described_ = staged(described(documents))
    rows = described_.select("doc_id", "n_shingles", "key")
    done = rows.where("key IS NOT NULL").join(_classes(documents, described_), "key").select("doc_id", "n_shingles", "component_id")
    none = rows.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each component, in its own columns: that of the least doc_id (nulls last), then of the least hash of the text, then of the
    first other columns. Texts without words are components of their own, one for each doc_id and text."""
    with temporaries():
        described_ = staged(described(documents).select("doc_id", "key", "n_shingles", "sig", "md5"))
        classes = _classes(documents, described_)
        best = described_.join(classes, "key").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("md5"))).alias("x")).select("x.doc_id", "x.md5")
        keep = staged(best.unionByName(described_.where("key IS NULL").select("doc_id", "md5").distinct()), keep=True)
    # The documents' own columns go along in one struct: no name of theirs can clash.
    d = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"), F.col("doc_id").cast("long").alias("id"), F.md5(utf8()).alias("md5")).alias("a")
    rows = d.join(keep.alias("k"), F.col("a.id").eqNullSafe(F.col("k.doc_id")) & (F.col("a.md5") == F.col("k.md5")), "left_semi")
    others = F.to_json(F.struct(*[F.col("d").getField(c).alias(c) for c in documents.columns if c != "text"]))
    one = rows.groupBy("id", "md5").agg(F.min_by("d", others).alias("d"))
    return one.select(*[F.col("d").getField(c).alias(c) for c in documents.columns])


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id, count(g)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
reach(doc_id, other) AS (SELECT a, b FROM l UNION SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(other), n.doc_id))::BIGINT AS component_id, n.doc_id <= coalesce(min(other), n.doc_id) AS kept
FROM n LEFT JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n"""
