"""Grouping of spelling variants by PartEnum signatures.

A word's letters are a multiset, that is a binary vector with one place for the k-th of each letter. One inserted, deleted or replaced
letter changes at most two places. The letters are parted into PARTS classes; vectors at most DIFFER places apart agree in all but
DIFFER classes, so for some choice of PARTS - DIFFER classes they agree in all of those. Each choice gives a word one signature, the
hash of its letters in the chosen classes; words with a signature in common meet in an equi-join and are verified by edit distance.
A signature that more than CROWD words share is refined without loss: one edit leaves the front or the back half of the shorter word in
its place, so its words meet by signature and half.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the checksum; texts are read whole; repeated
rows count each; of near words with equal counts the first in code-point order is the form; no words give no rows. Columns other than
doc_id and text play no part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.llm.common import lower_ascii, staged, table, temporaries

#: Letters of a word, its least length and count.
LETTERS, LEAST, COUNT = r"A-Za-zÀ-ÿ", 5, 3
#: A run loses a letter where this divides its checksum.
ERRORS = 97
#: A word's form occurs at least this many times as often.
TIMES = 2
#: Classes of letters, and places in which near words' vectors differ at most.
PARTS, DIFFER = 7, 2
#: Words of a signature from which on it is refined.
CROWD = 256


def occurrences(documents: DataFrame) -> DataFrame:
    """word of every occurrence of LEAST letters and more, as the checksum leaves it."""
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))  # a shorter run gives no word, with or without its letter
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % ERRORS == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST)


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n of the words that occur COUNT times at least."""
    return occurrences(documents).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)


def signed(words: DataFrame) -> DataFrame:
    """word, n, sig: a row for each signature of each word."""
    letters = F.array_sort(F.split("word", ""))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.array_join(F.filter(letters, lambda c: F.pmod(F.ascii(c), F.lit(PARTS)) == p), ""))
    rows = words.select("word", "n", parts.alias("parts"))
    chosen = combinations(range(PARTS), PARTS - DIFFER)
    sigs = F.array(*[F.xxhash64(F.lit(k), *[F.col("parts")[p] for p in some]) for k, some in enumerate(chosen)])
    return rows.select("word", "n", F.explode(sigs).alias("sig"))


def _halves(word: Column) -> Column:
    """What a word of a crowded signature meets others by: the front and the back half of the shorter of two words, itself or one letter shorter."""
    size = F.length(word)
    front = lambda n: F.substring(word, F.lit(1), F.floor(n / 2).cast("int"))
    back = lambda n: F.substring(word, (size - (n - F.floor(n / 2)) + 1).cast("int"), size)
    return F.array(*[F.concat(F.lit(side), n.cast("string"), F.lit(":"), half(n)) for n in (size, size - 1) for side, half in (("<", front), (">", back))])


def near(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of all pairs of words (a before b) one edit apart; words are distinct."""
    rows = signed(words)
    crowded = rows.groupBy("sig").count().where(F.col("count") > CROWD).select("sig", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, "sig", "left").select("word", "n", "sig", F.explode(F.when(F.col("crowded"), _halves(F.col("word"))).otherwise(F.array(F.lit("")))).alias("half"))
    a, b = (rows.select("sig", "half", F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    return a.join(b, ["sig", "half"]).where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b", "n_a", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form reached. Counts at least double with each step, so a way of 2^k steps ends after k + 1 rounds."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = staged(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not then.where("moved").limit(1).count():
            return now
        now = then.drop("moved")


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    with temporaries():
        words = staged(vocabulary(documents))
        pairs = staged(near(words))
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
        rows = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
        true = -F.col("best.m") >= TIMES * F.col("n")
        rows = staged(rows.select("word", F.when(true, F.col("best.other")).alias("form"), "n", "n_near", F.when(true, -F.col("best.m")).alias("form_n")))
        last = roots(rows.where("form IS NOT NULL"))
        out = rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return staged(out, keep=True)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of all words of the documents: word, form, root, n, n_near, form_n. Edge cases as the module states."""
    return variants(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT d, run, count(*) AS n, hex(encode(d || ':' || run)) AS x FROM r GROUP BY d, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM g, crc),
o AS (SELECT CASE WHEN h % {ERRORS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {COUNT}),
del AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
one AS (SELECT DISTINCT del.word AS a, w.word AS b, del.n AS na, w.n AS nb FROM del JOIN w ON w.word = del.rest),
near AS (SELECT DISTINCT x.word, y.word AS other, y.n AS m FROM del x JOIN del y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word UNION SELECT a, b, nb FROM one UNION SELECT b, a, na FROM one),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {TIMES} * w.n THEN b.other END AS form, CASE WHEN b.m >= {TIMES} * w.n THEN b.m END AS form_n FROM w LEFT JOIN best b ON b.word = w.word AND b.k = 1),
way AS (SELECT word, word AS spot, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.spot WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(spot, k) AS root FROM way GROUP BY word)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends USING (word)"""
