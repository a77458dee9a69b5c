"""Repeated passages by a sparse suffix array.

Of each window of PASSAGE words, the least hashed ANCHOR-word gram is its minimiser; only the suffixes at these positions are kept.
They are sorted in three steps, each spread over the cluster by ranges of its order, and compared with their neighbours:

1. by their first block, the hash of the leading gram, then by the hash of all the words that their windows hold. A suffix whose gram no
   neighbour shares is no part of a repeat; one whose whole context a neighbour shares is a repeat as it stands, and one of these
   stands for all.
2. by their words, in suffix order. The common prefix with a neighbour is measured word by word and extended to the left word by word:
   windows that this covers are repeats. Longer common prefixes than with the neighbours there are none, so windows that would
   need one are none.
3. What then remains, windows that only a suffix further away may share, is sorted by window and compared with its neighbours.

So the result is the union of all windows of PASSAGE words that stand at two or more places of the corpus. Equality is by words in step
2, by 128 bits in the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftworks.llm.common import HASHES, mix, setting, small_batches, staged, table, temporaries, utf8, window_hashes

#: Words of a passage (repeats of this length or more are found) and of an anchor's leading gram.
PASSAGE, ANCHOR = 50, 8
#: Suffixes of a partition, some hundred bytes each, that the driver sees to part the ranges of suffix order.
SAMPLED = 20
_A = np.uint64(0x9E3779B97F4A7C15)
#: A suffix's windows as one number: (first window * 64 + further windows) * 64 + words from the first window's start to the suffix.
_SPAN = 64


def anchors(text: bytes, passage: int = PASSAGE, anchor: int = ANCHOR) -> tuple[np.ndarray, ...] | None:
    """Of a text: for each kept suffix its gram's hash, the two halves of its context's hash, and its span; None if too short."""
    words = text.lower().split()
    if len(words) < passage:
        return None
    low, high = HASHES.both(words)
    grams, whole = window_hashes(low, anchor), (window_hashes(low, passage), window_hashes(high, passage))
    width = passage - anchor + 1
    at = np.argmin(np.lib.stride_tricks.sliding_window_view(grams, width), axis=1) + np.arange(len(grams) - width + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    pos = at[first]
    shape = mix(((pos - first) * _SPAN + last - first).astype(np.uint64))
    return grams[pos], *(mix(w[first] * _A + w[last]) + shape for w in whole), (first * _SPAN + last - first) * _SPAN + pos - first


def suffixes(documents: DataFrame) -> DataFrame:
    """gram, c1 and c2 (its context), doc_id, span of every kept suffix."""
    small_batches(documents.sparkSession)
    names = ["gram", "c1", "c2", "doc_id", "span"]

    def run(batches):
        for b in batches:
            parts = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if found := anchors(t):
                    gram, c1, c2, span = found
                    parts.append((gram.view(np.int64), c1.view(np.int64), c2.view(np.int64), np.full(len(gram), d, np.int64), span))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).where("doc_id IS NOT NULL").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _sorted(df: DataFrame, *order: str) -> DataFrame:
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)


def _with_neighbours(batches) -> Iterator[tuple[list, list | None, list | None]]:
    """The columns of each batch, with the last row before it and the first one after it (None at the partition's ends)."""
    held = before = None
    for b in batches:
        if len(b):
            now = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            if held is not None:
                yield held, before, [c[0] for c in now]
                before = [c[-1] for c in held]
            held = now
    if held is not None:
        yield held, before, None


def _alike(cols: list[np.ndarray], before: list | None, after: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row equals the one before it, and the one after it, in these columns."""
    same = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
    up, down = (x is not None and all(v == c[at] for v, c in zip(x, cols, strict=False)) for x, at in ((before, 0), (after, -1)))
    return np.concatenate([[up], same]), np.concatenate([same, [down]])


def neighbours(rows: DataFrame) -> DataFrame:
    """doc_id and span of the suffixes that share their gram with a neighbour in sorted order, with `kind`: 1 a neighbour shares the whole
    context, 2 the first of such a run (it stands for it from here on), 0 still open."""

    def run(batches):
        for cols, before, after in _with_neighbours(batches):
            keep = np.logical_or(*_alike(cols[:1], before, after))
            up, down = _alike(cols[:3], before, after)
            if before is None:  # what stands across the partition's ends is unknown: such rows stay open
                keep[0] = True
            if after is None:
                keep[-1] = True
            kind = np.where(up, 1, np.where(down, 2, 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cols[3][keep]), pa.array(cols[4][keep]), pa.array(kind[keep])], ["doc_id", "span", "kind"])

    return _sorted(rows, "gram", "c1", "c2", "doc_id", "span").mapInArrow(run, "doc_id long, span long, kind int")


def in_words(documents: DataFrame, found: DataFrame) -> DataFrame:
    """suffix and before (the words of the context from the suffix on, and before it), doc_id, span of the suffixes that are open or stand for others."""
    small_batches(documents.sparkSession)
    spans = found.where("kind <> 1").groupBy("doc_id").agg(F.collect_set("span").alias("spans"))  # of one document, bounded by its length
    names = ["suffix", "before", "doc_id", "span"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            for d, t, spans_ in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words, out = t.lower().split(), []
                for s in spans_:
                    first, more, back = s // _SPAN**2, s // _SPAN % _SPAN, s % _SPAN
                    end = first + more + PASSAGE
                    if end <= len(words):  # of rows alike in doc_id, some may be shorter
                        out.append((b" ".join(words[first + back : end]), b" ".join(words[first : first + back]), d, s))
                if out:  # a document's contexts are a few times its text
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).join(spans, "doc_id")
    return rows.mapInArrow(run, "suffix binary, before binary, doc_id long, span long")


def common_prefix(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Suffix:
    """A suffix in suffix order. A window that begins o words before it needs PASSAGE - o words from it on."""

    def __init__(self, suffix: bytes, before: bytes, doc_id: int, span: int):
        self.right, self.left, self.doc_id = suffix.split(b" "), before.split(b" ")[::-1] if before else [], doc_id
        self.first, more, back = span // _SPAN**2, span // _SPAN % _SPAN, span % _SPAN
        self.least, self.most = back - more, back  # of o
        self.reach, self.up, self.down = 0, (1, 0), (1, 0)  # longest common prefix, and windows shared with the row before and after

    def meet(self, after: _Suffix) -> None:
        """Measure the common prefix with the next suffix, and extend it to the left."""
        r, l = common_prefix(self.right, after.right), common_prefix(self.left, after.left)  # noqa: E741
        self.reach, after.reach = max(self.reach, r), max(after.reach, r)
        self.down = after.up = max(self.least, after.least, PASSAGE - r), min(self.most, after.most, l)

    def rows(self) -> Iterator[tuple[int | None, int | None, int, int, int, bool]]:
        """(h1, h2, doc_id, start, windows, sure): windows to be looked up, and those known to be shared with the row before (no hash)."""
        lo, hi = self.up
        if lo <= hi:
            yield None, None, self.doc_id, self.first + self.most - hi, hi - lo + 1, True
        wanted = [o for o in range(max(self.least, PASSAGE - self.reach), self.most + 1) if not lo <= o <= hi]
        if wanted:
            h1, h2 = (window_hashes(h, PASSAGE).view(np.int64) for h in HASHES.both(self.left[::-1] + self.right))
            for o in wanted:
                at = self.most - o
                yield int(h1[at]), int(h2[at]), self.doc_id, self.first + at, 1, self.down[0] <= o <= self.down[1]


_WINDOW = {"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "n": pa.int64(), "sure": pa.bool_()}


def compared(contexts: DataFrame) -> DataFrame:
    """h1, h2, doc_id, start, n, sure: what suffix order tells. Runs of n windows without hash are repeats; single windows with one are
    to be looked up, whether sure to be repeats already or not."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _WINDOW.values(), strict=True)], list(_WINDOW))

    def run(batches):
        prev, out = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                now = _Suffix(*row)
                if prev is None:
                    now.reach = PASSAGE  # what stands across the partition's ends is unknown
                else:
                    prev.meet(now)
                    out += prev.rows()
                prev = now
            if out:
                yield batch(out)
                out = []
        if prev is not None:
            prev.reach = PASSAGE
            if out := list(prev.rows()):
                yield batch(out)

    return _sorted(contexts, "suffix", "before", "doc_id", "span").mapInArrow(run, "h1 long, h2 long, doc_id long, start long, n long, sure boolean")


def repeated(windows: DataFrame) -> DataFrame:
    """doc_id, start of the windows that are sure or equal a neighbour in sorted order; those at partition ends are compared once more."""

    def run(batches):
        for cols, before, after in _with_neighbours(batches):
            same = np.logical_or(*_alike(cols[:2], before, after))
            edge = np.zeros(len(same), bool)
            edge[0] |= before is None
            edge[-1] |= after is None
            keep = same | edge | cols[4]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in cols[:4]), pa.array((same | cols[4])[keep]), pa.array(edge[keep])], ["h1", "h2", "doc_id", "start", "same", "edge"])

    got = staged(_sorted(windows.select("h1", "h2", "doc_id", "start", "sure"), "h1", "h2", "doc_id", "start").mapInArrow(run, "h1 long, h2 long, doc_id long, start long, same boolean, edge boolean"))
    ends = got.where("edge")  # at most two of each partition; rows alike over several partitions end each of them
    again = ends.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return got.where("same").select("doc_id", "start").unionByName(ends.where("NOT same").join(again, ["h1", "h2"]).select("doc_id", "start"))


def merged(spans: DataFrame) -> DataFrame:
    """The union of spans (doc_id, start, end) as disjoint, ordered ones; spans that touch are one. A document's spans are bounded by its length."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "_run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("_run").withColumn("n_words", F.col("end_word") - F.col("start_word"))


def repeats(documents: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words of every maximal stretch whose windows of PASSAGE words all stand elsewhere too.

    Words are compared with A-Z lower-cased. Null and shorter texts and rows without a doc_id hold none; repeated rows repeat each other; texts
    of several rows alike in doc_id share its list of stretches; very long texts are read whole; other columns play no part; an empty
    table gives no rows."""
    with temporaries():
        with temporaries():
            found = staged(neighbours(staged(suffixes(documents))), keep=True)
        with temporaries(), setting(documents.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", SAMPLED):
            told = staged(compared(in_words(documents, found)), keep=True)
        first = F.floor(F.col("span") / _SPAN**2)
        sure = found.where("kind > 0").select("doc_id", first.alias("start"), (first + F.floor(F.col("span") / _SPAN) % _SPAN + PASSAGE).alias("end"))
        sure = sure.unionByName(told.where("h1 IS NULL").select("doc_id", "start", (F.col("start") + F.col("n") - 1 + PASSAGE).alias("end")))
        more = repeated(told.where("h1 IS NOT NULL")).select("doc_id", "start", (F.col("start") + PASSAGE).alias("end"))
        return staged(merged(sure.unionByName(more).distinct()), keep=True)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents: doc_id, start_word, end_word, n_words."""
    return repeats(table(spark, sf_dir, "documents"))
