"""Best-fit packing with large-item matching.

Documents are tokenised and only those over CAPACITY are cut. Lengths are whole numbers up to CAPACITY, so a histogram of
them (at most CAPACITY rows, whatever the corpus) decides the packing: pieces over a third of the capacity are matched
greedily, at most two in a sequence, longest first with the longest partner that fits; shorter pieces then go, longest first,
to the fullest sequence that still holds them. The plan says, for each length, which ranks go to which run of sequences;
pieces find their rank within their length, and so their sequence and place, by a join with the plan.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftworks.llm.common import CACHE_WORDS, small_batches, staged, table

CAPACITY = 2048
#: Pieces of one length that are ranked in one task.
RANK_CHUNK = 500
#: Rows of a plan for each unit of capacity, at most: what is broadcast stays within it (checked).
PLAN_ROWS = 64


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257 and so on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}
#: Letters from here on go through the whole tokenizer, whose tables may be of another Unicode version than Python's.
_PLAIN_LETTERS = "\u0530"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer never joins text across white space, so words between spaces and line breaks are encoded once and remembered, up to
    CACHE_WORDS; so are the letters of words that are letters and then marks, which go to the tokenizer's model at once. A worker keeps
    its encoder from task to task."""

    _kept: tuple[str, Encoder] | None = None

    def __init__(self, definition: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.stems: dict[str, bytes] = {}

    @classmethod
    def of(cls, definition: str) -> Encoder:
        if cls._kept is None or cls._kept[0] != definition:
            cls._kept = definition, cls(definition)
        return cls._kept[1]

    def _stem(self, letters: str) -> bytes:
        raw = self.stems.get(letters)
        if raw is None:
            if len(self.stems) >= CACHE_WORDS:
                self.stems.clear()
            ids = [x.id for x in self.tokenizer.model.tokenize(letters.encode().decode("latin-1").translate(_ALPHABET))]
            self.stems[letters] = raw = struct.pack(f"<{len(ids)}I", *ids)
        return raw

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        stem = word.rstrip(_MARKS)
        # Letters whose lower case is letters too, in normal form: only then do letters and marks stay apart in the tokenizer.
        if stem and len(word) <= 100 and stem.isalpha() and max(stem) < _PLAIN_LETTERS and unicodedata.is_normalized("NFC", stem) and (low := stem.lower()).isalpha() and "\u03a3" not in stem:
            raw = self._stem(low) + (self[word[len(stem) :]] if stem != word else b"")
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            raw = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 200:
            self[word] = raw
        return raw

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids (a final id 0 each; null text: empty).

    Very long texts are cut into pieces like all others, a text at a time in memory; a null doc_id stays null; repeated rows are cut each;
    other columns play no part; an empty table gives none."""
    small_batches(documents.sparkSession)
    definition = Path(path or tokenizer_path()).read_text()  # on the driver; its text goes to the tasks

    def run(batches):
        encoder = Encoder.of(definition)
        for b in batches:
            out = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = encoder.encode(t) + b"\0\0\0\0"
                n = len(raw) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    own = raw[4 * at : 4 * (at + capacity)]
                    out.append((d, k, at, len(own) // 4, zlib.crc32(own)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces in each sequence, offset of the first of them).

    Ranks first + j*each + i go to sequence `first sequence + j`, at `offset + i*length`."""
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    runs: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), by gap

    def put(length: int, first: int, sequences: int, each: int, offset: int) -> None:
        n = sequences * each
        out.append((length, rank[length], rank[length] + n, first, each, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= a and a + b <= capacity and left[b] > (b == a)), 0)
            n = (left[a] // 2 if b == a else min(left[a], left[b])) if b else left[a]
            put(a, bins, n, 1, 0)
            if b:
                put(b, bins, n, 1, a)
            if a + b < capacity:
                insort(runs, (capacity - a - b, bins, n))
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(runs, (s, -1, 0))
            if i == len(runs):
                runs.append((capacity, bins, -(-left[s] // (capacity // s))))
                bins += runs[-1][2]
                continue
            gap, first, n = runs.pop(i)
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, first, full, each, capacity - gap)
                if gap - each * s:
                    insort(runs, (gap - each * s, first, full))
            rest = left[s] if full < n else 0
            if rest:
                put(s, first + full, 1, rest, capacity - gap)
                insort(runs, (gap - rest * s, first + full, 1))
            if (keep := n - full - bool(rest)) > 0:
                insort(runs, (gap, first + full + bool(rest), keep))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. Repeated rows are pieces each of their own, null ids among them; ties in length go by
    doc_id (nulls first), piece and start; an empty table gives none."""
    spark = cut.sparkSession
    cut = staged(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    # The plan's size depends on the capacity alone, whatever the corpus: broadcasting it is safe.
    if len(histogram) > capacity or len(rows) > PLAN_ROWS * capacity:
        raise ValueError(f"packing: a plan of {len(rows)} rows for {len(histogram)} lengths of at most {capacity}")
    steps = spark.createDataFrame([(a, lo, hi, f, e, o) for a, lo, hi, f, e, o in rows], "length long, lo long, hi long, first long, each long, at long")
    sizes = spark.createDataFrame([(n, 1 + c // RANK_CHUNK) for n, c in histogram.items()], "length long, chunks long")
    ranked = cut.join(F.broadcast(sizes), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "chunks"))
    each = staged(ranked.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    before = each.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    w = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = ranked.withColumn("_n", F.row_number().over(w)).join(before, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("_n") - 1)
    hit = ranked.alias("r").join(F.broadcast(steps).alias("s"), (F.col("r.length") == F.col("s.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return hit.select("doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32", (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("each")) * F.col("r.length")).cast("long").alias("offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(table(spark, sf_dir, "documents")))
