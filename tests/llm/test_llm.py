"""The training-data operators on awkward rows and against brute force."""

import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftworks.llm import langid, licenses, minhash, mixing, packing, pii, quality, suffix, topk, toxicity
from liftworks.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_found long, key string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base, shared = words(rng, 150), words(rng, 70)
    out = [(0, None), (1, ""), (2, "   \n\t "), (3, "one two"), (4, "One  TWO"), (5, base), (6, base), (5, base), (7, base + " extra"), (8, words(rng, 60) + " " + shared + " " + words(rng, 40)), (9, shared + " " + words(rng, 90))]
    for k in range(10, 40):  # near copies, some under the link threshold
        w = base.split()
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((k, " ".join(w)))
    out += [(50, "z" * 30_000), (51, words(rng, 30_000, 50_000)), (None, base)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 3 == 0 else f"s{(i or 0) % 3}", len(t or ""), 7, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_against_all_pairs(docs, rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[root(a)] = root(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least[root(k)], i)
    want = Counter((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect())
    assert got == want


def test_near_duplicates_keep_one(docs, empty):
    kept = minhash.without_near_duplicates(docs.where("doc_id IS NOT NULL"))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 6 not in ids
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(docs).count() == docs.count()


def test_crowded_regions_lose_no_link(spark):
    """Copies of one text, each with edits of its own: most pairs stay under the threshold, each but links to the original."""
    rng = random.Random(1)
    base = words(rng, 120, 10**6).split()
    texts = [base]
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(0, 120, 6), 3):
            w[at] = f"y{rng.randrange(10**9)}"
        texts.append(w)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {0}


def test_regions_crowded_at_half_depth_lose_no_link(spark):
    """Pages of one template, pairwise under the threshold, and a true pair with nothing in common but the template."""
    rng = random.Random(3)
    base = words(rng, 200, 10**6).split()

    def edited(n):
        w = list(base)
        for at in rng.sample(range(2, 198, 5), n):
            w[at] = f"y{rng.randrange(10**9)}"
        return w

    def drawn(w):
        s = minhash.shingle_set(" ".join(w).encode(), minhash.SHINGLE)
        return s, minhash.signature(s).reshape(minhash.TREES, minhash.DEPTH)

    texts = [edited(7) for _ in range(1000)]
    while len(texts) < 1002:
        (a, p), (b, q) = drawn(x := edited(3)), drawn(y := edited(2))
        alike, both = p == q, minhash.common(a, b)
        if alike[:, :2].all(axis=1).any() and not alike.all(axis=1).any() and 100 * both >= minhash.LINK * (len(a) + len(b) - both):
            texts += [x, y]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got[1000] == got[1001] and len(set(got.values())) > 900


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 99), (99, 99), (100, 99)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {**dict.fromkeys(range(31), 0), 99: 99, 100: 99}
    assert components(edges.limit(0)).count() == 0


def test_repeats_against_all_windows(docs, rows, empty):
    tokens = [(i, (t or "").encode().lower().split()) for i, t in rows if i is not None]
    seen = Counter(tuple(w[k : k + 50]) for _, w in tokens for k in range(len(w) - 49))
    cover = defaultdict(set)
    for i, w in tokens:
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] > 1:
                cover[i] |= set(range(k, k + 50))
    got = defaultdict(set)
    for r in suffix.repeats(docs).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert got == cover and 9 in got and 51 not in got
    assert suffix.repeats(empty).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(k, [float(x) for x in rng.normal(0, 0.2, 16)]) for k in range(130)]
    data += [(130, data[0][1]), (131, None), (132, [float("nan")] * 16), (133, [None] * 16), (134, [float("inf")] * 16), (135, [])]
    df = topk.whole(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in data[:131]}
    got = defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 50, 100):
        want = sorted(((int(whole[q] @ v), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert got[q] == [(i, s) for s, i in want]
    assert topk.search(df.limit(0), df).count() == 0
    few = df.where("vec_id < 3")
    assert topk.search(few, few).count() == 6


def test_topk_keeps_large_components(spark):
    data = [(0, [3 / 256, 1.0]), (1, [2e15, 1.0]), (2, [2e15, 2.0]), (3, [-5e15, 1.0]), (4, [1.0, 1.0])]
    df = topk.whole(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = [(r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    want = [(i, sum(int(256 * x) * int(256 * y) for x, y in zip(v, data[0][1], strict=True))) for i, v in data[1:]]
    assert got == sorted(want, key=lambda r: (-r[1], r[0]))
    for bad in ([(0, [1e17]), (1, [1.0])], [(0, [1e15]), (1, [1e15])]):
        df = topk.whole(spark.createDataFrame(bad, "vec_id long, embedding array<double>"))
        with pytest.raises(Exception, match="does not fit a long"):
            topk.search(df, df).collect()


def test_toxicity_parts_classes(spark, empty):
    rng = random.Random(2)
    text = lambda bad: " ".join(("dreadful" if bad and rng.random() < 0.05 else f"{rng.choice('abcdefgh')}{rng.choice(['ing', 'ed', 'tion'])}{rng.randrange(60)}") for _ in range(200))
    docs = spark.createDataFrame([(k, text(k % 5 == 0)) for k in range(400)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((got[k] >= 0.3) == (k % 5 == 0) for k in held)
    assert right / len(held) > 0.95 and 0 <= got[900] <= 1 and got[900] == got[901]
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.drop_toxic(docs, labels.limit(0)).count() == 402


def test_licenses_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    texts = [None, "", "MIT License mit license", "the GNU General  Public-License!", words(rng, 100) + "\nReleased under the MIT License. " + words(rng, 100), "Licensed under CC BY-NC 4.0.", "été " * 40 + "Licensed under the Apache License, Version 2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in docs.collect()])
    want = con.execute(licenses.SQL)
    names = [d[0] for d in want.description]
    want = Counter(want.fetchall())
    assert Counter(tuple(r[n] for n in names) for r in licenses.scan(docs).collect()) == want
    assert sum(r[names.index("n_base")] for r in want) >= 4
    assert licenses.scan(docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark, docs, empty):
    rng = random.Random(6)
    many = spark.createDataFrame([(k, words(rng, rng.randrange(400)), ["a", "b", "c", "d", None][k % 5]) for k in range(600)], "doc_id long, text string, source string")
    got = mixing.mix(many).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1:] = [r["target"], r["source_size"]]
    for taken, target, size in by.values():
        assert target <= 2 * size and abs(taken - target) <= max(300, 0.02 * target)
    total = sum(s for *_, s in by.values())
    assert sum(t for _, t, _ in by.values()) == pytest.approx(1.5 * total, rel=1e-9)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(many).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.where("text IS NULL").count() == 0
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_quality_measures(docs, labels, empty):
    text = b"a b c d e f g h i\na b c d e f g h i\n\n # $\nx"
    n, chars, symbols, dup, repeat = quality.base_measures(text)
    assert (n, chars, symbols, dup, repeat) == (21, 21, 2, 1, 18)
    assert quality.base_measures("été ça".encode())[:2] == (2, 5) and quality.base_measures(b"") == (0, 0, 0, 0, 0)
    got = quality.rate(docs, labels)
    assert got.count() == docs.count() and got.where("n_words < 20 AND kept").count() == 0
    assert quality.rate(empty, labels).count() == 0 and quality.rate(docs, labels.limit(0)).count() == docs.count()


def luhn_ok(digits):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_round_trip(spark, empty):
    texts = [None, "", "no findings", "card 4111 1111 1111 1111, again 4111111111111111. ip 10.2.33.255 and 300.1.1.1", "on 2024-02-29 and 2024-02-31; +1 (017) 555-7713 or 219-09-9999", "éa.b@mail.example.com token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\"", "7536784127813050 4845168114407329"]
    docs = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, n_found long")
    out = pii.without_pii(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[2] == texts[2]
    a, b = got[3].split("card ")[1].split(", again ")
    assert a.replace(" ", "") == b[:16] and luhn_ok(b[:16]) and b[:16] != "4111111111111111" and a.count(" ") == 3
    assert "10.2.33.255" not in got[3] and "300.1.1.1" in got[3]
    assert "2024-02-29" not in got[4] and "2024-02-31" in got[4] and "555-7713" not in got[4] and "219-09-9999" not in got[4]
    assert "a.b@" not in got[5] and "9233a8ec" not in got[5] and len(got[6]) == len(texts[6]) and got[6] != texts[6]
    back = {r["doc_id"]: r["text"] for r in pii.restore(out.select("doc_id", "text")).collect()}
    assert all(back[k] == texts[k] for k in (0, 1, 2, 3, 4, 6))
    assert pii.replaced(empty.drop("n_found")).count() == 0


def test_all_dates_and_social_numbers_are_permuted(spark):
    there, back = pii.Cipher("k"), pii.Cipher("k", inverse=True)
    for made in (
        spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("t")),
        spark.range(0, 898 * 99 * 9999, 88_801).select(F.format_string("%03d-%02d-%04d", F.expr("id div 989901 + 1 + if(id div 989901 >= 665, 1, 0)"), F.expr("id div 9999 % 99 + 1"), F.expr("id % 9999 + 1")).alias("t")),
    ):
        got = made.withColumn("p", there.pseudonym(F.col("t"))).withColumn("b", back.pseudonym(F.col("p"))).withColumn("ok", pii.valid(F.col("t")) & pii.valid(F.col("p")))
        row = got.agg(F.count("*").alias("n"), F.count_distinct("p").alias("d"), F.count_if(F.col("b") == F.col("t")).alias("back"), F.count_if("ok").alias("ok"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
        assert row["n"] == row["d"] == row["back"] == row["ok"]
        assert row["n"] != 73049 or (row["lo"], row["hi"]) == ("1900-01-01", "2099-12-31")


def test_only_validated_numbers_are_replaced(spark):
    left = "order 1234567890123 4111 1111 1111 1112 000-12-3456 666-12-3456 900-12-3456 123-00-3456 256.1.1.1 2024-02-31 2023/02/29 31.04.2020"
    taken = "2024/02/29 and 29.02.2024 on 2024-02-29, +44 20 7946 0958, 4111-1111-1111-1111 and 378282246310005 next"
    docs = spark.createDataFrame([(1, left), (2, taken), (2, taken), (3, taken + " " + "word " * 60_000 + "4111111111111111")], "doc_id long, text string")
    got = pii.replaced(docs, key="other").orderBy("doc_id").collect()
    assert got[0]["text"] == left and got[0]["n_found"] == 0
    assert got[1] == got[2] and got[1]["n_found"] == 6
    day, dotted, iso = got[1]["text"].split(",")[0].replace(" and ", " ").replace(" on ", " ").split(" ")
    assert day.replace("/", "-") == iso == "-".join(reversed(dotted.split("."))) != "2024-02-29"
    assert got[3]["n_found"] == 7 and got[3]["text"].count("word ") == 60_000
    assert pii.replaced(docs, key="third").where("doc_id = 2").first()["text"] != got[1]["text"]
    back = pii.restore(pii.replaced(docs, key="other"), key="other").orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [left, taken, taken, docs.where("doc_id = 3").first()["text"]]


def test_language_fuses_evidence(spark, empty):
    en, fr = "the house and the garden with many things", "la maison et le jardin avec beaucoup de choses"
    docs = spark.createDataFrame([(k, (en if k % 2 else fr) * 3, "en" if k % 2 else "fr") for k in range(40)], "doc_id long, text string, lang string")
    page = lambda lang, text: f"<html lang='{lang}'><script>var x='the and with';</script><p>{text}</p></html>"
    pages = [(k, f"http://h{k % 2}.example.{'fr' if k % 2 else 'com'}/x", page("fr" if k % 2 else "en", fr if k % 2 else en)) for k in range(20)]
    pages += [(20, "http://h1.example.fr/y", page("fr", "")), (21, None, None), (22, "not a url", "")]
    got = {r["page_id"]: r for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == 23 and all(got[k]["lang"] == ("fr" if k % 2 else "en") for k in range(20))
    assert got[20]["lang"] == "fr" and got[21]["lang"] is not None
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert langid.identify(p, docs.limit(0)).count() == 23 and langid.identify(p.limit(0), docs).count() == 0


def test_language_takes_every_language(spark):
    """More languages than any fixed small number, each with words of its own, the last one the rarest."""
    rng = random.Random(9)
    words_of = {f"{a}{b}": [f"{a}{b}{rng.choice('aeiou')}{rng.choice('klmnr')}{b}{a}" for _ in range(30)] for a in "qwxyzjkv" for b in "bcdfghlmn"}
    text = lambda x: " ".join(rng.choices(words_of[x], k=40))
    names = list(words_of)
    docs = spark.createDataFrame([(k, text(x), x) for k, x in enumerate(names + names[:-5])], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(k, f"http://h{k}.example.com/", f"<p>{text(x)}</p>") for k, x in enumerate(names)], "page_id long, url string, html string")
    assert len(names) > 64
    assert {r["page_id"]: r["lang"] for r in langid.identify(pages, docs).collect()} == dict(enumerate(names))


def test_packing(docs, rows, empty):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[(i, k, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))] += 1
    got = packing.pack(packing.pieces(docs)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 2
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_plan_places_every_piece():
    rng = random.Random(8)
    for _ in range(30):
        h = {rng.randrange(1, 101): rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))}
        rows = packing.plan(h, 100)
        done, fill = Counter(), defaultdict(list)
        for length, lo, hi, first, each, at in rows:
            for r in range(lo, hi):
                done[length, r] += 1
                fill[first + (r - lo) // each].append((at + (r - lo) % each * length, length))
        assert done == Counter({(n, r): 1 for n, c in h.items() for r in range(c)})
        for own in fill.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 100 and sum(3 * n > 100 for _, n in own) <= 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, names = docs, docs.columns
    for name, stage in p.STAGES:
        after = stage(spark, before, SF)
        if name != "packing":
            assert after.columns == names
        if name == "pii":
            assert after.count() == before.count()
        before = after
    assert before.count() > 0
