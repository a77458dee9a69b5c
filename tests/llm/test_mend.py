"""Rows that earlier forms lost or left in clear."""

import math
import os
import random
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from liftworks.llm import common, minhash, mixing, pii, queries, topk, toxicity

CLASH = ("a29685295 word", "a32060020 word")


def test_mix_keeps_texts_of_equal_checksum(spark):
    assert zlib.crc32(CLASH[0].encode()) == zlib.crc32(CLASH[1].encode())
    docs = spark.createDataFrame([(None, t, "s") for t in CLASH], "doc_id long, text string, source string")
    got = Counter(r["text"] for r in mixing.mixed(docs).collect())
    assert got == {t: 2 for t in CLASH}  # the mix is one slot, larger than both texts twice over


def test_mix_of_many_rows_without_id(spark):
    docs = spark.range(200_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('w', id, ' x') AS text", "'s' AS source")
    got = mixing.mixed(docs).groupBy("text").count().where("text LIKE '% x'").selectExpr("count(*)", "max(count)").first()
    assert got[1] <= 2 and got[0] >= 199_000  # the last in order may be left out: the mix takes half of them twice


#: One finding of every kind, with nothing else in the text.
ALONE = {
    "email": "ann@example.org", "secret": "deadbeef" * 4, "ip": "10.20.30.40", "date": "2021-03-14", "slashed": "2021/03/14", "dotted": "14.03.2021",
    "phone": "(212) 555-0187", "abroad": "+44 20 7946 0958", "social": "123-45-6789", "account": "4111111111111111",
}


def test_no_finding_depends_on_the_rest_of_the_text(spark):
    assert set(ALONE) == set(pii.PATTERNS)
    texts = [f for token in ALONE.values() for f in (token, f"about {token} here", f"about {token} here 7")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r for r in pii.replaced(docs, key="k").orderBy("doc_id").collect()]
    assert [r["n_found"] for r in out] == [1] * len(texts)
    for k, token in enumerate(ALONE.values()):
        alone, within, beside = (r["text"] for r in out[3 * k : 3 * k + 3])
        assert alone != token and within == f"about {alone} here" and beside == f"about {alone} here 7"


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def a_date(y, m, d):
    try:
        return bool(date(int(y), int(m), int(d)))
    except ValueError:
        return False


def findings(text):
    """The findings of a text by hand: the patterns' shapes written anew, tried at each place in order of precedence."""
    n, at, out = len(text), 0, []
    local = lambda c: c.isalpha() or c in "0123456789._%+-"

    def tries(i):
        before = text[i - 1] if i else ""
        if before.isascii() and before.isalnum() and text[i] not in "0123456789+(":
            return  # within a word nothing begins
        if not (before and local(before)) and i < n and local(text[i]):
            j = i
            while j < n and local(text[j]):
                j += 1
            m = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match(text, j)
            if m:
                yield m.end(), True
        alnum = before and before.isascii() and before.isalnum()
        m = re.compile(r"[0-9a-fA-F]+").match(text, i)
        if m and not alnum and 32 <= m.end() - i <= 64 and not (m.end() < n and text[m.end()].isascii() and text[m.end()].isalnum()):
            yield m.end(), True
        digit, behind = before.isascii() and before.isdigit(), lambda e, more: e < n and text[e] in "0123456789" + more
        m = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})").match(text, i)
        if m and not digit and before != "." and not behind(m.end(), "") and not re.compile(r"\.[0-9]").match(text, m.end()):
            yield m.end(), all(int(x) <= 255 for x in m.groups())
        for sep in "-/":
            m = re.compile(rf"((?:19|20)[0-9]{{2}}){sep}([0-9]{{2}}){sep}([0-9]{{2}})").match(text, i)
            if m and not digit and before != sep and not behind(m.end(), sep):
                yield m.end(), a_date(*m.groups())
        m = re.compile(r"([0-9]{2})\.([0-9]{2})\.((?:19|20)[0-9]{2})").match(text, i)
        if m and not digit and before != "." and not behind(m.end(), ""):
            yield m.end(), a_date(*m.groups()[::-1])
        for shape in (r"\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}", r"\+[0-9]{1,3}[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}", r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"):
            m = re.compile(shape).match(text, i)
            if m and not digit and not behind(m.end(), ""):
                yield m.end(), True
        m = re.compile(r"\+[0-9]{1,3}(?:[ .-][0-9]{2,5}){2,5}(?![0-9])").match(text, i)
        if m:
            yield m.end(), True
        m = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})").match(text, i)
        if m and not digit and before != "-" and not behind(m.end(), "-"):
            a, g, s = map(int, m.groups())
            yield m.end(), 0 < a < 900 and a != 666 and g > 0 and s > 0
        for shape in (r"[0-9]{13,19}", r"[0-9]{4}(?:[ -][0-9]{4}){3}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"):
            m = re.compile(shape).match(text, i)
            if m and not digit and not behind(m.end(), ""):
                yield m.end(), luhn(re.sub("[^0-9]", "", m[0]))

    while at < n:
        first = next(tries(at), None)
        if first is None:
            at += 1
        else:
            out += [text[at : first[0]]] * first[1]
            at = first[0]
    return out


def hostile(rng):
    parts = [*ALONE.values(), "ab" * 16, "f" * 65, "999.1.1.1", "1.2.3.4.5", "2021-02-30", "2020-02-29-1", "31.04.2021", "000-12-3456", "666-01-0001", "4111111111111112", "4111 1111 1111 1111", "3782-822463-10005",
             "+1 (212) 555-0187", "212.555.0187", "é@x.org", "a@b", "a@b.c@d.e", "x" * 40, "12345678901234567890", "@", ".", "-", "7", " ", "and"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", " ", ",", "-", "."]) for _ in range(rng.randrange(1, 8)))


def test_findings_against_patterns_by_hand(spark):
    rng = random.Random(11)
    texts = [hostile(rng) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_found"] for r in pii.replaced(docs, key="k").collect()}
    assert [(t, got[k]) for k, t in enumerate(texts) if got[k] != len(findings(t))] == []


def test_findings_of_the_test_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = spark.read.parquet(path).select("doc_id", "text")
    want = {r["doc_id"]: len(findings(r["text"] or "")) for r in rows.collect()}
    assert {r["doc_id"]: r["n_found"] for r in pii.replaced(rows, key="k").collect()} == want and sum(want.values()) > 50


def test_a_missing_key_is_told(spark):
    with pytest.warns(UserWarning, match="key"):
        assert pii.key_of(spark) == pii.KEY


# --- crowded regions ---------------------------------------------------------------------------------------------------------------


def linkable(a, b):
    n = len(a & b)
    return 100 * n >= 75 * (len(a) + len(b) - n)


@pytest.mark.parametrize("buckets", [1 << 20, 7])
def test_filters_leave_every_node_with_a_link(spark, monkeypatch, buckets):
    """Random sets of all sizes around the threshold: whoever has a link to another component is left, whatever the order of shingles."""
    monkeypatch.setattr(minhash, "BUCKETS", buckets)
    rng, sets = random.Random(buckets), []
    for _ in range(40):
        base = [rng.randrange(1 << 62) for _ in range(rng.choice([1, 2, 3, 4, 7, 8, 20, 41, 160]))]
        for _ in range(rng.randrange(1, 7)):
            s = [x for x in base if rng.random() > 0.1] + [rng.randrange(1 << 62) for _ in range(rng.randrange(1 + len(base) // 6))]
            if s:
                sets.append(frozenset(s))
    roots = {k: rng.randrange(0, k + 1, 1) if rng.random() < 0.3 else k for k in range(len(sets))}
    want = {a for a in range(len(sets)) for b in range(len(sets)) if roots[a] != roots[b] and linkable(sets[a], sets[b])}
    frame = spark.createDataFrame([(k, bytearray(np.sort(np.array(list(s), np.uint64)).tobytes())) for k, s in enumerate(sets)], "id long, set binary")
    left = {r["id"] for r in minhash.reachable(frame, spark.createDataFrame(list(roots.items()), "id long, root long")).collect()}
    assert want <= left and len(want) > 20


def templated(rng, n, own, size=120):
    """Pages of one template, each with `own` words changed: pairwise under the threshold for 4 and more."""
    base, out = [f"t{k}" for k in range(size)], []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(4, size - 5, 5), own):
            w[at] = f"y{rng.randrange(10**9)}"
        out.append(w)
    return out


def test_work_in_a_crowded_region_grows_with_its_nodes(spark, monkeypatch):
    """Pages of one template, pairwise some 0.7 alike: nearly none has to meet another, however many there are."""
    monkeypatch.setattr(minhash, "REGION_BLOCK", 64)
    seen, own = [], minhash.met

    def counted(outside, whole, sets):
        seen.append((outside.count(), whole.count()))
        return own(outside, whole, sets)

    monkeypatch.setattr(minhash, "met", counted)
    for n in (300, 1200):
        docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(templated(random.Random(1), n, 4))], "doc_id long, text string")
        assert minhash.near_duplicates(docs).where("NOT kept").count() == 0
    (a, b), (c, d) = seen
    assert a + b <= 30 and c + d <= 4 * max(a + b, 30)


# --- top-k -------------------------------------------------------------------------------------------------------------------------


def test_vectors_move_once_to_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    rng = np.random.default_rng(8)
    data = [(int(rng.integers(60)), [float(x) for x in rng.normal(0, 0.3, 16)]) for _ in range(150)]
    df = topk.whole(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    out = topk.search(df, df.where("vec_id % 3 = 0"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # of the queries: a vector's row is never repeated
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in data]
    want = []
    for q in {i for i, _ in whole if i % 3 == 0}:
        scores = sorted((-int(w @ v), i) for j, w in whole if j == q for i, v in whole if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


# --- the order of the mix ------------------------------------------------------------------------------------------------------------


def test_every_tenth_of_the_mix_is_close_to_the_targets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join("w" * rng.randrange(5, 120)), rng.choice("aaaabbbccd")) for k in range(3000)]
    docs = spark.createDataFrame([(k, t.replace("", " "), s) for k, t, s in rows], "doc_id long, text string, source string")
    out = mixing.mixed(docs, "at").select("source", "at", F.regexp_count("text", F.lit(r"\S+")).alias("n")).orderBy("at").collect()
    every, so_far, done, next_at = Counter(), Counter(), 0, 1
    for r in out:
        every[r["source"]] += r["n"]
    total = sum(every.values())
    for r in out:
        so_far[r["source"]] += r["n"]
        done += r["n"]
        if done >= total * next_at / 10:
            assert all(abs(so_far[s] / done - n / total) < 0.02 for s, n in every.items()), (next_at, so_far, every)
            next_at += 1
    assert next_at == 11
    slots = [r["slot"] for r in mixing.mix(docs).where("taken > 0").select("slot").collect()]
    assert None not in slots and min(slots) < 3


# --- toxicity --------------------------------------------------------------------------------------------------------------------------


def score_by_hand(model, text):
    """The score of a text from the stored dictionaries and weights alone: words, windows, compressions and the logistic written anew."""
    words, word = [], b""
    for c in text.lower() + b" " if text.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in text) + b" ":
        if c >= 0x80 or chr(c).isalnum():
            word += bytes([c])
        elif word:
            words += [word[i : i + 64] for i in range(0, len(word), 64)]
            word = b""
    runs, now = [], b" "
    for w in words:
        if len(now) + len(w) + 1 > 64 and now != b" ":
            runs.append(now)
            now = b" "
        now += w + b" "
    runs += [now] if now != b" " else []
    if not runs:
        return model.prior

    def size(window, raw):
        p = zstandard.ZstdCompressionParameters.from_level(5, dict_size=len(raw), source_size=64, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    saved = [size(w, model.ordinary) - size(w, model.toxic + model.ordinary) for w in runs]
    clear = sum(s >= 3 for s in saved)
    x = [1.0, max(-1.0, min(4.0, sum(saved) / len(saved))), clear / len(saved), math.log1p(clear), min(12.0, max(saved)) / 4]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_scores_from_stored_dictionaries(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, " .,! "), (9004, "y" * 300 + " ÉTÉ été Ab1")], "doc_id long, text string"))
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]] == pytest.approx(score_by_hand(model, (r["text"] or "").encode()), abs=1e-9), r["doc_id"]


# --- what queries leave behind -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op6_mixing", "op7_quality", "op12_manifest", "op13_spelling"])
def test_a_query_leaves_its_rows_alone(spark, name):
    path = common.shared_dir(spark).removeprefix("file:")
    held = lambda: set(os.listdir(path)) if os.path.isdir(path) else set()
    before = held()
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(held() - before) == 1 and rows.count() > 0
