"""Quality by hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into BUCKETS. Two multinomials are counted: one over every document of the corpus, one over
a bounded sample of trusted documents (quality 1). A document's score is the mean, over its n-grams, of the log ratio of the
two; it fails under a threshold of that score. Texts are dealt into FOLDS by content, and each is scored by the trusted documents of
the other folds only: no score, and so no threshold, rests on the text that it judges. Beside it stand plain base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.llm.common import mix, small_batches, staged, table, utf8, window_hashes, word_hashes

#: Hash buckets of the n-grams: the counts held by the driver and each worker are bounded by this.
BUCKETS = 1 << 16
#: Trusted rows that the target multinomial is fitted on, at most (those with the least hashed ids; documented bound), and parts of them.
SAMPLE_ROWS, FOLDS = 20_000, 8
#: Weight of the raw multinomial in the trusted one, as a share of the trusted n-grams.
SMOOTH = 0.05
#: Trusted documents that the threshold may turn away, as a share of all labelled ones, and the step in which it is sought.
TRUSTED_LOSS, STEP = 0.01, 1e-3
_SYMBOLS = b"#*$%&|<>"
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of all words and all pairs of neighbours."""
    h = word_hashes(words)
    pairs = mix(h[:-1] * _PAIR + h[1:])
    return (np.concatenate([mix(h), pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def base_measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    chars = sum(map(len, words))
    joined = b"".join(words)
    if not joined.isascii():
        chars = len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    repeat = 0
    if len(words) > 8:
        g = window_hashes(word_hashes(words), 8)
        _, where, n = np.unique(g, return_inverse=True, return_counts=True)
        twice = n[where] > 1
        if twice.any():
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 8, -1)
            repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(words), chars, symbols, dup, repeat


def fold(text: Column) -> Column:
    """Which of FOLDS models judges a text: by its content, so that copies are judged alike and by a model that saw none of them."""
    return F.pmod(F.xxhash64(text, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _known(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("quality").cast("int").alias("_y")).where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1)).distinct()


def counts(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts: raw (of all documents) and, a row per fold, trusted (of sampled rows of quality 1). Each partition sums its own
    buckets, Spark sums them by bucket and fold; at most BUCKETS x (FOLDS + 1) rows reach the driver."""
    small_batches(documents.sparkSession)

    def run(batches):
        n = np.zeros((FOLDS + 1, BUCKETS), np.int64)
        for b in batches:
            every, trusted = [], [[] for _ in range(FOLDS)]
            for t, y, f in zip(b.column("text").to_pylist(), b.column("_y").to_pylist(), b.column("_f").to_pylist(), strict=True):
                if words := t.split():
                    every.append(buckets(words))
                    if y == 1:
                        trusted[f].append(every[-1])
            for k, own in enumerate([*trusted, every]):
                if own:
                    n[k] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        k, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(n[k, at])], ["k", "b", "n"])

    ids = F.broadcast(_known(labels).where("_y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))  # bounded
    rows = documents.select("doc_id", utf8()).withColumn("_f", fold(F.col("text"))).join(ids, "doc_id", "left").select("text", "_y", "_f")
    got = rows.mapInArrow(run, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((FOLDS + 1, BUCKETS))
    n[got.column("k").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    return n[FOLDS], n[:FOLDS]


def ratio(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket, both smoothed towards the raw multinomial."""
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    strength = SMOOTH * trusted.sum() + 1
    q = (trusted + strength * p) / (trusted.sum() + strength)
    return (np.log(q) - np.log(p)).astype(np.float64)


def ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """A row per fold: the ratios by the trusted rows of all other folds."""
    return np.array([ratio(raw, trusted.sum(axis=0) - own) for own in trusted])


def measure(documents: DataFrame, llr: np.ndarray) -> DataFrame:
    """doc_id, the base measures and the length-normalised score of every row's whole text under its fold's ratios (null: empty, score 0)."""
    small_batches(documents.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            base, score = [], []
            for t, f in zip(b.column("text").to_pylist(), b.column("_f").to_pylist(), strict=True):
                base.append(base_measures(t))
                words = t.split()
                score.append(float(llr[f][buckets(words)].mean()) if words else 0.0)
            cols = [pa.array(x, pa.int64()) for x in (zip(*base, strict=True) if base else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(score, pa.float64())], ["doc_id", *names, "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).withColumn("_f", fold(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", score double")


def threshold(trusted: np.ndarray, poor: np.ndarray, at: np.ndarray) -> float:
    """The score under which a document fails, of labelled rows counted (trusted, poor) by score `at` (ascending): where the two classes
    part best, but at most TRUSTED_LOSS of the trusted are lost. Without trusted rows nothing fails; without poor ones the loss decides."""
    if not trusted.sum():
        return -np.inf
    lost = (np.cumsum(trusted) - trusted) / trusted.sum()  # with a cut at this score
    caught = (np.cumsum(poor) - poor) / max(1, poor.sum())
    fits = np.flatnonzero(lost <= TRUSTED_LOSS)
    return float(at[fits[-1] if not poor.sum() else fits[int(np.argmax((caught - lost)[fits]))]])


def failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rate(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base measures, score, base_failed and kept of every row.

    Each text is scored by ratios whose trusted rows hold neither it nor a copy of it (FOLDS parts by content), so labelled and other
    documents are scored alike; the threshold is set on all labelled rows that pass the base rules, by their scores in steps of STEP.
    Null and empty texts have score 0 and fail the base rules; scores at the threshold are kept; repeated rows are scored alike, each;
    labels that contradict each other count on both sides; very long texts are read whole, one at a time; other columns play no part;
    without labels only the base rules fail a row; an empty table gives no rows."""
    llr = ratios(*counts(documents, labels))
    rows = staged(measure(documents, llr)).withColumn("base_failed", failed())
    step = F.floor(F.col("score") / STEP).cast("long").alias("at")
    # Ratios lie within log(BUCKETS x corpus): some thousand steps, whatever the corpus.
    seen = rows.where("NOT base_failed").join(_known(labels), "doc_id").groupBy(step).agg(F.sum("_y").alias("good"), F.sum(1 - F.col("_y")).alias("poor")).orderBy("at").toArrow()
    least = threshold(*(seen.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("good", "poor", "at")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("score") / STEP) >= F.lit(least)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rated: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept."""
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
