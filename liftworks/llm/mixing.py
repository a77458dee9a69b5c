"""Mixing sources to target weights by a low-discrepancy schedule.

Targets come from weights by water-filling under each source's cap. The mix is cut into slots of equal words; slot m draws the
golden-ratio point frac(m * GOLDEN), and the source whose share of the targets holds that point gets the slot. Each source's
documents stand in a keyed random order, twice over, cut into blocks of as many words as a slot; the r-th slot of a source takes
its r-th block, so every prefix of the mix is close to the targets. DataFrame functions only.

Defined cases: a null source is one source, last in order; null or empty texts have size 0 and take 0; repeated rows each have
their own place; an empty table or one without words has targets 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftworks.llm.common import WORD, staged, table

GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
#: Words of the mix, and most words taken from a source, as multiples of its words.
SHARE, MOST = 1.5, 2
#: Words of a slot at least; there are about SLOTS slots where the mix is larger.
LEAST_BLOCK, SLOTS = 64, 1 << 20
#: Slots ranked in one task, and cells of [0, 1) by which slots find their source.
CHUNK, CELLS = 1024, 4096
#: Documents of a part of a source's shuffled order, about, and hexadecimal digits of their hash that make a part, at least and at most.
PART, DIGITS = 1024, (3, 7)
#: Sources whose targets are worked out in one task, at most: beyond it the mix fails rather than slow down unseen.
MOST_SOURCES = 1_000_000


def _key() -> Column:
    return F.concat(F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.lit("=")), F.coalesce("source", F.lit("")))


def _seed() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix:17")).cast("binary"))


def _tie() -> Column:
    """128 bits of the text: with id and source they tell rows apart."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def sized(documents: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), _tie().alias("tie"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: key, index, source_size, target (double), words (rounded target), lo and hi (its share of [0, 1)), total."""
    rows = sizes.groupBy(_key().alias("key"), "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("index", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("index") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    rows = rows.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "index")
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("before", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    rows = rows.withColumn("all", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    level = (SHARE * F.col("all") - F.col("capped")) / (F.col("weights") - F.col("before"))
    rows = rows.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    rows = rows.withColumn("level", F.max("level").over(every))  # at the first source that stays under its cap; it falls from there on
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    rows = rows.withColumn("target", target).withColumn("words", F.round("target").cast("long"))
    hi = F.sum("words").over(Window.orderBy("index").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hi_words", hi).withColumn("total", F.sum("words").over(every))
    part = lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col("total").cast("double")), F.lit(0.0))
    block = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("total") / F.lit(float(SLOTS)))).cast("long")
    return rows.select("key", "source", "index", "source_size", "target", "words", part(F.col("hi_words") - F.col("words")).alias("lo"), part(F.col("hi_words")).alias("hi"), "total", block.alias("block"), "rows")


def schedule(sources: DataFrame) -> DataFrame:
    """One row per slot: source index, its rank within the source (from 0), words of a slot, slot (its place in the mix, from 0)."""
    spark = sources.sparkSession
    one = sources.select("total", "block").limit(1).collect()  # two numbers
    total, block = (one[0][0] or 0, one[0][1]) if one else (0, LEAST_BLOCK)
    n = -(-total // block)
    slots = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    held = sources.where("hi > lo").select("index", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    drawn = slots.join(held, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    drawn = drawn.select("index", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    per = drawn.groupBy("index", "chunk").agg(F.count("*").alias("n"))
    before = per.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("index").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("index", "chunk").orderBy("slot")))
    return ranked.join(before, ["index", "chunk"]).select("index", (F.col("base") + F.col("_n") - 1).alias("rank"), F.lit(block).cast("long").alias("block"), "slot")


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its place in its source's shuffled order: the running sum of sizes, by parts of a hashed order."""
    n, most = sources.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()  # two numbers
    if n > MOST_SOURCES:
        raise ValueError(f"mixing: {n} sources, more than {MOST_SOURCES}")
    digits = min(DIGITS[1], max(DIGITS[0], math.ceil(math.log(max(most, 1) / PART, 16))))  # parts keep about their size; the order stays the same
    rows = sizes.withColumn("key", _key()).join(sources.select("key", "index", "source_size", "target", "block"), "key")
    rows = rows.withColumn("h", _seed()).withColumn("part", F.substring("h", 1, digits))
    parts = sizes.groupBy(_key().alias("key"), F.substring(_seed(), 1, digits).alias("part")).agg(F.sum("size").alias("n"))
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("key", "part").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(base, ["key", "part"]).withColumn("at", F.col("base") + F.col("_in")).drop("_in", "base", "h", "part")


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document (and source, index, tie, at), slot and slot_2: where in the mix its words
    begin, and where they begin again; null where they are not taken, or not twice."""
    sizes = staged(sized(documents))
    sources = staged(targets(sizes))
    placed = staged(streams(sizes, sources))
    first, words = F.col("at") + F.col("copy") * F.col("source_size"), F.col("size")
    blocks = placed.where("size > 0").select("index", "at", "size", "source_size", "block", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("copy"))
    blocks = blocks.select("index", "at", "copy", first.alias("first"), (first + words).alias("end"), "block", F.explode(F.sequence(F.floor(first / F.col("block")), F.floor((first + words - 1) / F.col("block")))).alias("rank"))
    slots = schedule(sources)
    got = blocks.join(slots.drop("block"), ["index", "rank"])
    lo, hi = F.greatest("first", F.col("rank") * F.col("block")), F.least("end", (F.col("rank") + 1) * F.col("block"))
    taken = got.groupBy("index", "at").agg(F.sum(hi - lo).alias("taken"), F.min(F.when(F.col("copy") == 0, F.col("slot"))).alias("slot"), F.min(F.when(F.col("copy") > 0, F.col("slot"))).alias("slot_2"))
    empty = placed.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), **{c: F.lit(None).cast("long") for c in ("slot", "slot_2")}})
    rows = placed.where("size > 0").join(taken, ["index", "at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    names = ["doc_id", "size", "source_size", "target", "taken", "slot", "slot_2", "source", "index", "tie", "at"]
    return rows.select(*names).unionByName(empty.select(*names))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: doc_id, size, source_size, target, taken, slot (where in the mix its words begin; null if none are taken)."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slot")


def mixed(documents: DataFrame, slot: str | None = None) -> DataFrame:
    """The mix as documents, in their own columns: a document stands once for each time its words are taken, the last copy cut after
    its last taken word; what is not taken is left out. Rows alike in id, source and text are one row that takes the sum.

    Null and empty texts take nothing and are left out. Columns of any name are carried along. slot: a further column of this name says
    where in the mix a copy begins; read in this order, every part of the mix from the start on is close to the targets."""
    takes = mix(documents).groupBy("doc_id", "source", "size", "tie").agg(F.sum("taken").alias("taken"), F.min("slot").alias("slot"), F.min("slot_2").alias("slot_2")).where("taken > 0")
    # The documents' own columns go along in one struct: no name of theirs can clash.
    d = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("d"), "doc_id", F.col("source").cast("string").alias("source"), _tie().alias("tie"))
    d = d.dropDuplicates(["doc_id", "source", "tie"]).alias("a")
    t = takes.alias("t")
    same = F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("a.tie") == F.col("t.tie")) & F.col("a.source").eqNullSafe(F.col("t.source"))
    rows = d.join(t, same).select("d", "taken", "size", "slot", "slot_2", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))).alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("d.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), words), "")
    rows = rows.select("d", F.when(words < F.col("size"), cut).otherwise(F.col("d.text")).alias("text"), F.when(F.col("copy") == 1, F.col("slot")).otherwise(F.coalesce("slot_2", "slot")).alias("slot"))
    own = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType)
    return rows.select(*[own.get(c, F.col("d").getField(c)).alias(c) for c in documents.columns], *([F.col("slot").alias(slot)] if slot else []))


SQL = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(text, '') AS text FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS index FROM s GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(index - 1) % {len(WEIGHTS)} + 1] AS weight, {MOST} * source_size AS cap FROM g),
f AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS capped, coalesce(sum(weight) OVER o, 0) AS earlier, (SELECT sum(source_size) FROM w) AS everything, (SELECT sum(weight) FROM w) AS weights
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(level) AS level FROM (SELECT weight, cap, ({SHARE}::DOUBLE * everything::DOUBLE - capped::DOUBLE) / (weights - earlier)::DOUBLE AS level FROM f) WHERE cap::DOUBLE >= level * weight),
t AS (SELECT source, index, source_size, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM w, l),
u AS (SELECT *, round(target)::BIGINT AS words, (sum(round(target)::BIGINT) OVER (ORDER BY index))::BIGINT AS hi_words, (SELECT sum(round(target)::BIGINT) FROM t)::BIGINT AS total FROM t),
v AS (SELECT *, (hi_words - words)::DOUBLE / nullif(total, 0)::DOUBLE AS lo, hi_words::DOUBLE / nullif(total, 0)::DOUBLE AS hi, greatest({LEAST_BLOCK}, ceil(total / {float(SLOTS)}))::BIGINT AS block FROM u),
slots AS (SELECT m, m * CAST('{GOLDEN}' AS DOUBLE) - floor(m * CAST('{GOLDEN}' AS DOUBLE)) AS x FROM (SELECT unnest(range((SELECT max((total + block - 1) // block) FROM v))) AS m)),
drawn AS (SELECT index, m, row_number() OVER (PARTITION BY index ORDER BY m) - 1 AS rank FROM slots JOIN v ON x >= lo AND x < hi),
given AS (SELECT index, count(*)::BIGINT AS n FROM drawn GROUP BY index),
p AS (SELECT doc_id, size, source_size, target, block, v.index, coalesce(n, 0) AS n,
        coalesce(sum(size) OVER (PARTITION BY v.index ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':mix:17'), doc_id, size, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source LEFT JOIN given USING (index))
SELECT doc_id, size, source_size, target,
  (greatest(0, least(pos + size, n * block) - pos) + greatest(0, least(pos + source_size + size, n * block) - pos - source_size))::BIGINT AS taken, CASE WHEN size > 0 THEN m END::BIGINT AS slot
FROM p LEFT JOIN drawn ON drawn.index = p.index AND drawn.rank = pos // block"""
