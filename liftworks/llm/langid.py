"""Language of web pages by Bayesian evidence fusion.

Text likelihood: multinomials over hashed byte 3-grams, counted over all documents of known language. Declared markup
language and host come in as further evidence: how often each declaration goes with each language, and a prior of the host
that is smoothed towards its address suffix and that towards all pages, all from grouped aggregations of the pages' own text
likelihoods; a page's own vote is left out of its priors.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.llm.common import small_batches, staged, table, utf8

BUCKETS = 1 << 15
#: Every language present is taken. The model (languages x BUCKETS numbers) is held by the driver and each worker; with more
#: languages than this (256 MiB) the query fails rather than leave some out.
MOST_LANGUAGES = 1024
#: 3-grams of a page looked up at once.
LOOKED_UP = 4096
#: 3-grams of a page count as at most this many independent pieces of evidence.
EVIDENCE = 30.0
#: A host with more than this share of all pages is dealt out: there are no more such hosts than its inverse, and each takes as many parts.
HOT = 1 / 1000
#: Parts that the hosts of a suffix are dealt out to.
SUFFIX_PARTS = 64
#: Pages' worth of the level above in a suffix's and a host's prior, and of uniform declarations.
SMOOTH, DECLARED_SMOOTH = 5.0, 1.0
_DROP = re.compile(r"<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_NOT_LETTERS = re.compile(r"[^\w]+|[\d_]+")


def grams(text: str) -> np.ndarray:
    """Buckets of the byte 3-grams of the lower-cased letters of a text, each run of other characters one space."""
    raw = np.frombuffer(b" %b " % _NOT_LETTERS.sub(" ", text.lower()).strip().encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    g = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((g * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def visible(page: str) -> str:
    """What a page shows: without comments, scripts, styles, navigation and tags."""
    return markup.unescape(_DROP.sub(" ", page))


def languages(documents: DataFrame) -> list[str]:
    rows = documents.where("lang IS NOT NULL").select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"documents.lang holds more than {MOST_LANGUAGES} languages; none may be left out, and the model of all does not fit")
    return sorted(r["lang"] for r in rows)


def likelihoods(documents: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-probability of each bucket under each language, counted over all documents of these languages."""
    small_batches(documents.sparkSession)
    at = {x: i for i, x in enumerate(langs)}

    def run(batches):
        n: dict[int, np.ndarray] = {}
        for b in batches:
            found: dict[int, list[np.ndarray]] = {}
            for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if x in at:
                    found.setdefault(at[x], []).append(grams(t.decode("utf-8", "replace")))
            for k, own in found.items():
                n[k] = n.get(k, 0) + np.bincount(np.concatenate(own), minlength=BUCKETS)
        for k, own in n.items():
            g = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g, pa.int32()), pa.array(own[g])], ["k", "g", "n"])

    rows = documents.select("lang", utf8()).mapInArrow(run, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(langs), BUCKETS))
    n[rows.column("k").to_numpy(), rows.column("g").to_numpy()] = rows.column("n").to_numpy()
    n += 0.05
    return np.log(n / n.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """page_id, host, suffix, declared and t: for each language, its tempered text posterior under equal priors."""
    small_batches(pages.sparkSession)
    table_ = np.ascontiguousarray(model.T)

    def run(batches):
        for b in batches:
            rows = []
            for h in b.column("html").to_pylist():
                g = grams(visible(h.decode("utf-8", "replace")))
                s = np.zeros(len(langs))
                for i in range(0, len(g), LOOKED_UP):
                    s += table_[g[i : i + LOOKED_UP]].sum(axis=0)
                if len(g):
                    s *= min(EVIDENCE, len(g)) / len(g)
                s = np.exp(s - s.max())
                rows.append(s / s.sum())
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(langs))
            t = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.empty(0)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "declared")), t], ["page_id", "host", "declared", "t"])

    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    lang = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), lang.alias("declared"), utf8("html"))
    return rows.mapInArrow(run, "page_id long, host string, declared string, t array<double>").withColumn("suffix", F.substring_index("host", ".", -1))


def fuse(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang and its posterior confidence.

    A page without text, declaration or host rests on what evidence it has (pages without a host count as one host); ties go to the first
    language by name."""
    evidence = evidence.withColumn("declared", F.when(F.col("declared").isin(*langs, ""), F.col("declared")).otherwise("other"))
    sums = F.array(*[F.sum(F.get("t", F.lit(k))) for k in range(len(langs))])
    totals = {r["declared"]: np.array(r["d"]) for r in evidence.groupBy("declared").agg(sums.alias("d")).collect()}  # at most a row per language and two
    every = sum(totals.values(), np.zeros(len(langs))) + 1.0
    share = F.lit([float(x) for x in every / every.sum()])
    # P(declaration | language); the empty declaration says nothing.
    kinds = sorted({*langs, "other"} - {""})
    said = np.array([totals.get(d, np.zeros(len(langs))) + DECLARED_SMOOTH for d in kinds])
    said = {**dict(zip(kinds, said / said.sum(axis=0), strict=True)), "": np.ones(len(langs))}
    says = evidence.sparkSession.createDataFrame([(d, p.tolist()) for d, p in said.items()], "declared string, says array<double>")
    suffixes = staged(evidence.groupBy("suffix").agg(sums.alias("s")))
    hosts = staged(evidence.groupBy("host").agg(sums.alias("h"), F.count("*").alias("n")))
    # Half of all hosts may share a suffix: they meet it by suffix and part.
    suffixes = suffixes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SUFFIX_PARTS - 1))))
    hosts = hosts.withColumns({"suffix": F.substring_index("host", ".", -1), "_part": F.pmod(F.xxhash64("host"), F.lit(SUFFIX_PARTS)).cast("int")})
    hosts = staged(hosts.join(suffixes, ["suffix", "_part"]).drop("_part"))
    # Pages meet their host by host and part, so that no task gets all pages of one host.
    pages = hosts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(hosts.where(F.col("n") > HOT * pages).select("host", F.ceil(F.col("n") / F.lit(max(1.0, HOT * pages))).cast("int").alias("parts")))  # at most 1 / HOT rows
    dealt = lambda df: df.join(hot, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    hosts = dealt(hosts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("host", "part", "h", "s")
    rows = dealt(evidence).withColumn("part", F.pmod(F.xxhash64("page_id", "t"), F.col("parts")).cast("int")).join(hosts, ["host", "part"]).join(F.broadcast(says), "declared")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    times = lambda x, y: F.zip_with(x, y, lambda a, b: a * b)

    def prior(sums: str, above: Column) -> Column:
        """What the others of the group say, smoothed towards the level above."""
        others = F.zip_with(sums, "t", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.zip_with(others, above, lambda a, b: a + SMOOTH * b)

    def shares(name: str) -> Column:
        return F.transform(name, lambda x: x / F.col("_all"))

    rows = rows.withColumn("_s", prior("s", share)).withColumn("_all", total("_s")).withColumn("_s", shares("_s"))
    rows = rows.withColumn("_h", prior("h", F.col("_s"))).withColumn("_all", total("_h")).withColumn("_h", shares("_h"))
    rows = rows.select("page_id", "host", "suffix", "declared", F.col("t").alias("_t"), times(times("t", "says"), "_h").alias("_p"))
    names = F.lit(langs)
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return rows.select("page_id", "host", "suffix", "declared", best("_t").alias("text_lang"), best("_p").alias("lang"), F.try_divide(F.array_max("_p"), total("_p")).alias("confidence"))


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, confidence of every page row.

    Null or empty markup has no text: its text posterior is even. Null or malformed urls have the host "". Very long pages are read whole, a
    page at a time; repeated rows and pages alike in page_id are pages of their own, and vote for each other; other columns play no part; without a document
    of known language all languages are null; an empty table gives no rows."""
    langs = languages(documents)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *[none.alias(n) for n in ("host", "suffix", "declared", "text_lang", "lang")], F.lit(None).cast("double").alias("confidence"))
    return fuse(staged(text_evidence(pages, langs, likelihoods(documents, langs))), langs)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language: page_id, host, suffix, declared, text_lang, lang, confidence."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
