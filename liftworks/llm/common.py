"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from itertools import repeat
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.sources.scratch import setting, shared_dir, staged, temporaries  # noqa: F401  for the operators

#: Entries that a worker keeps of a word cache; it starts anew beyond this.
CACHE_WORDS = 400_000
#: Seed of the words' hashes.
SEED = 7
#: Rows of text handed to a Python worker at once, so that long texts stay within its memory.
BATCH_ROWS = 1000

#: Words as in most contracts here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts holds (only lowers the session's setting), and let workers find this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def utf8(name: str = "text") -> Column:
    """The column as UTF-8 bytes; Python then splits and lower-cases ASCII only, at C speed."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary").alias(name)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHash(dict):
    """128-bit hashes of words, remembered for about CACHE_WORDS of them; a word's place in the two arrays of halves is its value here."""

    def __init__(self):
        super().__init__()
        self.low, self.high = np.empty(CACHE_WORDS, np.uint64), np.empty(CACHE_WORDS, np.uint64)

    def __missing__(self, word: bytes) -> int:
        h = self.digest(word)
        self[word] = at = len(self)
        self.low[at], self.high[at] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        return at

    @staticmethod
    def digest(word: bytes) -> int:
        return xxhash.xxh3_128_intdigest(word, SEED)

    def _places(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > len(self.low):
            self.clear()
        if len(words) > len(self.low):
            self.low, self.high = np.empty(len(words), np.uint64), np.empty(len(words), np.uint64)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def both(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = self._places(words)
        return self.low[at], self.high[at]


HASHES = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The lower halves of the words' hashes, without a memory: where texts hold many different words, hashing each is the faster way."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words, repeat(SEED))), ">u8")[1::2].astype(np.uint64)


_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words (empty if there are fewer), by doubling."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    g, m = mix(words), 1
    while 2 * m <= k:
        g = mix(g[:-m] * _A + g[m:])
        m *= 2
    d = k - m
    return mix(g[: len(g) - d] * _A + g[d:]) if d else g


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a lower-cased text; a shorter text is one shingle, an empty one none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    g = np.sort(window_hashes(word_hashes(words), min(k, len(words))))
    return g[np.concatenate([[True], g[1:] != g[:-1]])]
