"""Merkle manifest of a dataset by concatenated-level strings.

Each group's leaves stand in order, in aligned blocks of 2^LEVELS. A block keeps each level of its tree as one string of hex digests;
fixed-width substrings of it are the pairs whose hashes make the level above, and the substrings that flank a leaf's path are its
siblings. The blocks' roots are the leaves of the next tree in the same group, until one root is left; the groups' roots are the
leaves of one last tree. No task holds more than a block, however many leaves a group has.

Defined cases: rows without doc_id come last in their group, repeated ids are ordered by their leaves, and rows alike in all stand side
by side, each with a place of its own; a null lang is a group, first in order; texts are hashed whole; an empty table has no rows and
no root; a lone leaf is its group's root and its own proof is the hash of nothing. Columns other than the five play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftworks.llm.common import staged, table, temporaries

#: What a leaf's hash covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block's tree: a block has 2^LEVELS leaves at most, its strings 64 characters for each node.
LEVELS = 8
#: Hexadecimal digits of a digest, and what stands in a path where a node has no sibling.
WIDTH, NONE = 64, " " * 64
#: Rows whose id's crc32 this divides are tampered with, to show that their proofs fail.
TAMPER = 7


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and changed (the leaf as it is after tampering, or the same)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    plus = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), *[F.col(c).alias(f"_{c}") for c in FIELDS], hit.alias("_hit"))
    return plus.select(
        "doc_id", "lang", digest(*[field(F.col(f"_{c}")) for c in FIELDS]).alias("leaf"),
        F.when(F.col("_hit"), digest(*[field(F.col(f"_{c}") + 1 if c == "n_chars" else F.col(f"_{c}")) for c in FIELDS])).alias("changed"),
    ).withColumn("changed", F.coalesce("changed", "leaf"))


def placed(rows: DataFrame, group: Column, *order: Column) -> DataFrame:
    """The rows with `grp` and `pos`, their place in the group from 0, and `total`, the group's rows.

    Rows are dealt out in order over all tasks, so no group passes through one; a place is the place in the task and the rows of the
    tasks before. The number of the tasks times that of the groups bounds what is summed up in order."""
    spread = F.monotonically_increasing_id()  # parts rows alike in all
    dealt = rows.withColumn("grp", group).withColumn("_spread", spread).repartitionByRange(F.col("grp"), *order, F.col("_spread"))
    dealt = staged(dealt.sortWithinPartitions("grp", *order, "_spread").drop("_spread").withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_task", F.shiftrightunsigned("_at", 33))
    parts = dealt.groupBy("grp", "_task").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before, whole = Window.partitionBy("grp").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("grp")
    bases = parts.select("grp", "_task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"), F.sum("n").over(whole).alias("total")).alias("b")
    same = F.col("d.grp").eqNullSafe(F.col("b.grp")) & (F.col("d._task") == F.col("b._task"))
    return dealt.alias("d").join(bases, same).select("d.*", "b.total", (F.col("_at") + F.col("base")).alias("pos")).drop("_at", "_task")


def _levels(first: Column, height: Column) -> Column:
    """The level strings of a block, from the leaves' up to the one of `height` levels above."""

    def above(s: Column, _: Column) -> Column:
        below = F.element_at(s, -1).cast("binary")
        n = (F.octet_length(below) / WIDTH).cast("int")
        up = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: F.sha2(F.substring(below, i * (2 * WIDTH) + 1, F.lit(2 * WIDTH)), 256))
        return F.concat(s, F.array(F.array_join(up, "")))

    return F.when(height > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(height, F.lit(1))), F.array(first), above)).otherwise(F.array(first))


def _sibling(level: Column, node: Column) -> Column:
    return F.rpad(F.substring(level.cast("binary"), (node.bitwiseXOR(F.lit(1)) * WIDTH + 1).cast("int"), F.lit(WIDTH)).cast("string"), WIDTH, " ")


def _ceil_log2(n: Column) -> Column:
    """Levels above n leaves until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of grp, pos, total, leaf (and further columns) with `path`, and the groups' roots (grp, root).

    A path is the leaf's siblings from its own level up to the group's root, WIDTH characters each, blank where there is none. Each
    level of blocks is one grouping of at most 2^LEVELS rows a key; the blocks above are fewer by that factor."""
    spark, extra = nodes.sparkSession, [c for c in nodes.columns if c not in ("grp", "pos", "total", "leaf")]
    size = 1 << LEVELS
    block = nodes.groupBy("grp", "total", F.shiftright("pos", LEVELS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "leaf", *extra))).alias("rows"))
    height = F.when(F.col("total") > size, F.lit(LEVELS)).otherwise(_ceil_log2(F.col("total")))
    block = block.withColumn("levels", _levels(F.array_join(F.transform("rows", lambda x: x["leaf"]), ""), height))

    def own(x: Column, i: Column) -> Column:
        return F.struct(x.alias("row"), F.array_join(F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), lambda level, k: _sibling(level, F.call_function("shiftright", i, k))), "").alias("path"))

    block = staged(block.select("grp", "total", "block", F.element_at("levels", -1).alias("root"), F.transform("rows", own).alias("rows")))
    roots, more = block.select("grp", "root"), block.agg(F.max("total")).first()[0]
    rows = block.select("grp", "total", "block", F.explode("rows").alias("x")).select("grp", "total", "block", "x.row.*", "x.path")
    if more is not None and more > size:
        above = block.select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("root").alias("leaf"))
        upper, roots = paths(above)
        upper = upper.select("grp", F.col("pos").alias("block"), F.col("path").alias("rest")).alias("u")
        rows = rows.alias("r").join(upper, F.col("r.grp").eqNullSafe(F.col("u.grp")) & (F.col("r.block") == F.col("u.block")))
        rows = rows.select("r.grp", "r.total", "r.pos", "r.leaf", *[f"r.{c}" for c in extra], F.concat("r.path", "u.rest").alias("path"))
    return rows.select("grp", "total", "pos", "leaf", *extra, "path"), roots


def folded(leaf: Column, path: Column, pos: Column) -> Column:
    """The root that a leaf and its siblings give: a node on an odd place has its sibling to the left."""

    def up(s: Column, k: Column) -> Column:
        other = F.trim(F.substring(path, k * WIDTH + 1, F.lit(WIDTH)))
        odd = F.call_function("shiftright", pos, k).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(odd, F.sha2(F.concat(other, s).cast("binary"), 256)).otherwise(F.sha2(F.concat(s, other).cast("binary"), 256))

    steps = (F.length(path) / WIDTH).cast("int")
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), leaf, up)).otherwise(leaf)


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, changed, pos, subroot, langpos, path (to the subroot), upper (from there to the root), root of every row."""
    rows, subroots = paths(placed(leaves(documents), F.col("lang"), F.col("doc_id").asc_nulls_last(), F.col("leaf")))
    langs, roots = paths(placed(subroots.withColumnRenamed("root", "leaf").withColumnRenamed("grp", "lang"), F.lit(0), F.col("lang").asc_nulls_first()))
    top = langs.join(roots.select("grp", "root"), "grp").select("lang", F.col("pos").alias("langpos"), F.col("leaf").alias("subroot"), F.col("path").alias("upper"), "root").alias("t")
    rows = rows.alias("r").join(top, F.col("r.grp").eqNullSafe(F.col("t.lang")))
    return rows.select("r.doc_id", "t.lang", "r.leaf", "r.changed", "r.pos", "r.path", "t.langpos", "t.upper", "t.subroot", "t.root")


def verified(rows: DataFrame) -> DataFrame:
    """The manifest's rows with proof_sha256, folded_root (from `changed` and the siblings) and verified."""
    whole = F.concat("path", "upper")
    rows = rows.withColumn("proof_sha256", F.sha2(F.replace(whole, F.lit(" "), F.lit("")).cast("binary"), 256))
    rows = rows.withColumn("folded_root", folded(folded(F.col("changed"), F.col("path"), F.col("pos")), F.col("upper"), F.col("langpos")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Edge cases as the module states."""
    with temporaries():
        rows = verified(manifest(table(spark, sf_dir, "documents")))
        return staged(rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), keep=True)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_BAD = "sha256(" + " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
#: crc32 of the characters of a decimal number, bit by bit: 8 steps for each.
_CRC = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT + 1000, 0, 0, 0, 0, 0, 0, 0]))), lambda x, y: CASE WHEN xor(x, greatest(y - 1000, 0)) & 1 = 1 THEN xor(xor(x, greatest(y - 1000, 0)) >> 1, 3988292384) ELSE xor(x, greatest(y - 1000, 0)) >> 1 END)"


def _tree(name: str, source: str) -> str:
    """Levels of the trees of (g, pos, h), and each first node's siblings, as recursive SQL that knows no blocks."""
    return f"""
{name}_l AS (SELECT g, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY g) AS n FROM {source}
  UNION ALL SELECT g, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name}_l WHERE n > 1 GROUP BY g, lvl, pos // 2),
{name}_r AS (SELECT g, h AS root FROM {name}_l WHERE n = 1),
{name}_p AS (SELECT b.g, b.pos, string_agg(s.h, '' ORDER BY s.lvl) AS sibs FROM {source} b JOIN {name}_l s ON s.g IS NOT DISTINCT FROM b.g AND s.n > 1 AND s.pos = xor(b.pos >> s.lvl, 1) GROUP BY b.g, b.pos)"""


def _fold(name: str, source: str, start: str) -> str:
    return f"""
{name} AS (SELECT g, pos, 0 AS lvl, {start} AS h FROM {source}
  UNION ALL SELECT f.g, f.pos, f.lvl + 1, sha256(CASE WHEN (f.pos >> f.lvl) & 1 = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END)
    FROM {name} f JOIN (SELECT DISTINCT g, lvl FROM {source}_t_l WHERE n > 1) m ON m.g IS NOT DISTINCT FROM f.g AND m.lvl = f.lvl
    LEFT JOIN {source}_t_l s ON s.g IS NOT DISTINCT FROM f.g AND s.lvl = f.lvl AND s.pos = xor(f.pos >> f.lvl, 1)),
{name}_end AS (SELECT g, pos, arg_max(h, lvl) AS h FROM {name} GROUP BY g, pos)"""


SQL = f"""
WITH RECURSIVE d AS (SELECT *, {_LEAF} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({_CRC.format("doc_id::VARCHAR")}, 4294967295) % {TAMPER} = 0 THEN {_BAD} END AS bad FROM documents),
b AS (SELECT doc_id, lang AS g, leaf AS h, coalesce(bad, leaf) AS bad, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM d),
{_tree("b_t", "b")},
u AS (SELECT 0 AS g, g AS lang, root AS h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM b_t_r),
{_tree("u_t", "u")},
{_fold("b_f", "b", "bad")},
v AS (SELECT f.g AS lang, f.pos AS ord, f.h AS start, u.pos AS langpos FROM b_f_end f JOIN u ON u.lang IS NOT DISTINCT FROM f.g),
w AS (SELECT lang, ord, langpos AS pos, 0 AS lvl, start AS h FROM v
  UNION ALL SELECT w.lang, w.ord, w.pos, w.lvl + 1, sha256(CASE WHEN (w.pos >> w.lvl) & 1 = 1 THEN coalesce(s.h, '') || w.h ELSE w.h || coalesce(s.h, '') END)
    FROM w JOIN (SELECT DISTINCT lvl FROM u_t_l WHERE n > 1) m ON m.lvl = w.lvl LEFT JOIN u_t_l s ON s.lvl = w.lvl AND s.pos = xor(w.pos >> w.lvl, 1)),
w_end AS (SELECT lang, ord, arg_max(h, lvl) AS folded FROM w GROUP BY lang, ord)
SELECT b.doc_id, b.h AS leaf, u.h AS subroot, (SELECT root FROM u_t_r) AS root, sha256(coalesce(p.sibs, '') || coalesce(q.sibs, '')) AS proof_sha256, e.folded AS folded_root, e.folded = (SELECT root FROM u_t_r) AS verified
FROM b JOIN u ON u.lang IS NOT DISTINCT FROM b.g LEFT JOIN b_t_p p ON p.g IS NOT DISTINCT FROM b.g AND p.pos = b.pos LEFT JOIN u_t_p q ON q.pos = u.pos
JOIN w_end e ON e.lang IS NOT DISTINCT FROM b.g AND e.ord = b.pos"""
