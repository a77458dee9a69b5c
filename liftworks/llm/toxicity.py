"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary windows, one on the passages that mark toxic documents
(words whose document frequency is far higher under label 1, copies counted once). Each window of a text is compressed
twice, with the ordinary dictionary alone and with the toxic dictionary in front of it; what the second saves is the
distance. A document's score is a logistic function of its windows' savings, calibrated on the training rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from liftworks.llm.common import small_batches, staged, table, utf8

#: Bytes of a window; level and bytes of the ordinary dictionary and of the toxic one.
WINDOW, LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 64, 5, 8192, 1024
#: Labelled rows of each class that the model is fitted on, at most, drawn from those whose text has at most so many bytes; each is
#: read whole (documented bound of the training sample: 2 x SAMPLE_ROWS x SAMPLE_BYTES bytes reach the driver at most).
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 1 << 16
#: A word marks toxic text from this z-score of its document frequencies on.
MARK_Z = 6.0
THRESHOLD = 0.3
#: Letters and digits in lower case; other ASCII characters separate words.
_WORDS = bytes(c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def windows(words: list[bytes], size: int) -> Iterator[bytes]:
    """The words in order, joined by spaces, cut between words into windows of at most size bytes (longer words are split)."""
    run, n = [], 1
    for w in words:
        for i in range(0, len(w), size):
            part = w[i : i + size] if len(w) > size else w
            if n + len(part) + 1 > size and run:
                yield b" " + b" ".join(run) + b" "
                run, n = [], 1
            run.append(part)
            n += len(part) + 1
    if run:
        yield b" " + b" ".join(run) + b" "


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    prior: float

    def distances(self):
        """A function from a text's bytes to what the toxic dictionary saves in each of its windows."""

        def sizer(raw: bytes):
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(raw), source_size=WINDOW, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

        a, b = sizer(self.ordinary), sizer(self.toxic + self.ordinary)
        return lambda text: np.array([len(a(w)) - len(b(w)) for w in windows(text.translate(_WORDS).split(), WINDOW)], float)

    def score(self, saved: np.ndarray) -> float:
        if not len(saved):
            return self.prior
        z = float(np.dot(features(saved), self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(saved: np.ndarray) -> np.ndarray:
    """Of all windows of a text: a constant, mean saving, share of windows with a clear saving, their number, the largest one."""
    clear = int((saved >= 3).sum())
    return np.array([1.0, max(-1.0, min(4.0, saved.mean())), clear / len(saved), math.log1p(clear), min(12.0, saved.max()) / 4])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression of weighted rows by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ w)
    return w


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary as raw content, its header (some 130 bytes) included; of too few samples, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=8).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


def fit(rows: list[tuple[bytes, int]], totals: tuple[int, int] | None = None) -> Model:
    """Train on (text, label) rows in the given order; totals: rows of each class that they were drawn from, so that scores
    are calibrated to the classes' true shares and not to those of the sample."""
    kept = list(dict.fromkeys(rows))  # copies count once
    words = [(t.translate(_WORDS).split(), y) for t, y in kept]
    n = [max(1, sum(y == k for _, y in words)) for k in (0, 1)]
    of = totals or n
    weights = np.array([of[k] / n[k] for k in (0, 1)]) * sum(n) / sum(of)
    seen = [Counter(w for d, y in words if y == k for w in set(d)) for k in (0, 1)]

    def z(w: bytes) -> float:
        p = (seen[0][w] + seen[1][w]) / (n[0] + n[1])
        return (seen[1][w] / n[1] - seen[0][w] / n[0]) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-9)

    marks = {w for w in seen[1] if z(w) >= MARK_Z}
    toxic = [x for d, y in words if y == 1 for x in windows([w for w in d if w in marks], WINDOW)]
    ordinary = [x for d, y in words if y == 0 for x in windows(d, WINDOW)]
    model = Model(_dictionary(ordinary[:: max(1, len(ordinary) // 20_000)], ORDINARY_BYTES), _dictionary(toxic, TOXIC_BYTES), [0.0] * 5, of[1] / sum(of))
    saved, y = model.distances(), []
    x = []
    for t, label in kept:
        if len(s := saved(t)):
            x.append(features(s))
            y.append(label)
    if x:
        model.weights = logistic(np.array(x), np.array(y, float), weights[y]).tolist()
    return model


def remainder(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on at most SAMPLE_ROWS labelled rows of each class (those with the smallest hash of their id), never on held-out ones.

    Rows over SAMPLE_BYTES are not drawn; those drawn are read whole. Without a row of both classes there is no model (None)."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("_y")).where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & (remainder(F.col("doc_id")) != 2)).distinct()
    short = documents.where(F.octet_length(utf8()) <= SAMPLE_BYTES)
    rows = staged(rows.join(short.select("doc_id"), "doc_id", "left_semi"))
    n = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # two rows
    h = F.xxhash64("doc_id")
    parts = [rows.where(F.col("_y") == y).orderBy(h, "doc_id").limit(SAMPLE_ROWS) for y in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 x SAMPLE_ROWS ids
    got = short.select("doc_id", utf8().alias("_t")).join(sample, "doc_id").groupBy("doc_id", "_y").agg(F.min("_t").alias("_t")).orderBy("doc_id", "_y").collect()
    if len({r["_y"] for r in got}) < 2:
        return None
    return fit([(bytes(r["_t"]), r["_y"]) for r in got], (n[0], n[1]))


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1) of every row's whole text. Null, empty or wordless texts get the training rows' share of label 1; without a model all scores are 0. Repeated rows get equal scores; other columns play no part."""
    small_batches(documents.sparkSession)

    def run(batches):
        saved = model.distances() if model else None
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                if model is None:
                    out.append(0.0)
                    continue
                out.append(model.score(saved(t)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted. Null, empty and wordless texts get the training rows' share of label 1; a row without
    doc_id is not held out; repeated rows get equal scores; without training rows of both classes all scores are 0; no rows give none."""
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, in their own columns, whose score stays under THRESHOLD."""
    small_batches(documents.sparkSession)
    model = train(documents, labels)
    if model is None:
        return documents
    names = documents.columns
    flag = "_toxic_score"
    while flag in names:
        flag += "_"
    schema = StructType([*documents.schema.fields, StructField(flag, DoubleType())])

    def run(batches):
        saved = model.distances()
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            s = [model.score(saved(t or b"")) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, flag])

    return documents.mapInArrow(run, schema).where(F.col(flag) < THRESHOLD).select(*names)
