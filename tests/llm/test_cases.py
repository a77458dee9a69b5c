"""Rows that operators must stand, and brute-force versions of what has no SQL."""

import math
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftworks.llm import common, langid, licenses, minhash, mixing, packing, pii, quality, suffix, topk, toxicity

SF = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def text(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def files(spark):
    path = common.shared_dir(spark).removeprefix("file:")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


# --- written steps ---------------------------------------------------------------------------------------------------------------


def test_temporary_files_go(spark):
    before = files(spark)
    with common.temporaries():
        a = common.staged(spark.range(5))
        with common.temporaries():
            b = common.staged(spark.range(7))
            c = common.staged(b.where("id > 3"), keep=True)
            assert len(files(spark) - before) == 3
        assert len(files(spark) - before) == 2 and c.count() == 3 and a.count() == 5
    assert files(spark) == before
    with pytest.raises(ZeroDivisionError), common.temporaries():
        common.staged(spark.range(1))
        1 / 0  # noqa: B018
    assert files(spark) == before


# --- suffixes --------------------------------------------------------------------------------------------------------------------


def covered(rows, n=50):
    tokens = [(i, (t or "").encode().lower().split()) for i, t in rows if i is not None]
    seen, cover = Counter(tuple(w[k : k + n]) for _, w in tokens for k in range(len(w) - n + 1)), defaultdict(set)
    for i, w in tokens:
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                cover[i] |= set(range(k, k + n))
    return cover


@pytest.mark.parametrize("vocabulary", [30, 3000])
def test_repeats_of_pasted_passages(spark, vocabulary):
    """Passages of all lengths from one source, so that the best partner is often not the neighbour in suffix order."""
    rng = random.Random(vocabulary)
    base, rows = text(rng, 300, vocabulary).split(), []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(250)
            w += base[at : at + rng.randrange(20, 110)] + [f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(4))]
        rows.append((i, " ".join(w)))
    rows += [(90, rows[0][1]), (90, rows[1][1]), (91, None), (92, "w1 " * 200), (93, ""), (None, rows[2][1])]
    rows = [r for r in rows if r[0] != 90] + [(94, rows[0][1]), (95, "A" + "b" * 40_000 + " " + rows[3][1])]
    got = defaultdict(set)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, span long, suffix string")
    for r in suffix.repeats(df).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert got == covered(rows)


def test_equal_halves_of_hashes_are_no_repeat(spark, monkeypatch):
    """Two words whose 64-bit hashes collide: contexts and windows agree in the first half only, and no step takes them for equal."""
    true = common.WordHash.digest
    hashes = common.WordHash()
    hashes.digest = lambda w: (true(b"one") & 0xFFFFFFFFFFFFFFFF) | (true(w) >> 64 << 64) if w == b"two" else true(w)
    monkeypatch.setattr(suffix, "HASHES", hashes)
    words = [f"w{k}" for k in range(60)]
    a, b = (suffix.anchors(" ".join([*words[:5], w, *words[5:]]).encode()) for w in ("one", "two"))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and (a[2][0] != b[2][0])
    rows = spark.createDataFrame([(1, 5, 6, 0, 0), (1, 5, 7, 1, 0)], "gram long, c1 long, c2 long, doc_id long, span long")
    assert {r["kind"] for r in suffix.neighbours(rows).collect()} == {0}
    windows = spark.createDataFrame([(1, 5, 0, 0, False), (1, 6, 1, 0, False), (2, 2, 4, 9, False), (2, 2, 5, 9, False)], "h1 long, h2 long, doc_id long, start long, sure boolean")
    assert {(r["doc_id"], r["start"]) for r in suffix.repeated(windows).collect()} == {(4, 9), (5, 9)}


# --- near-duplicates ---------------------------------------------------------------------------------------------------------------


def test_near_duplicates_of_rows_without_id(spark):
    rng = random.Random(4)
    a, b = text(rng, 100, 10**6), text(rng, 100, 10**6)
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    rows = [(None, a, "m"), (None, near(a), "n"), (None, b, "m"), (7, near(b), "m"), (7, near(b), "l"), (3, "", "x"), (3, "", "x"), (None, None, "x"), (9, text(rng, 9), "x"), (9, text(rng, 9), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, md5 string")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 10 and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["md5"]) for r in minhash.without_near_duplicates(docs).collect())
    want = [(0, min(a, near(a), key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest()), None), (0, "", "x"), (3, "", "x"), (7, near(b), "l"), *((9, t, "x") for i, t, _ in rows if i == 9)]
    assert [(i, t) for i, t, _ in kept] == sorted((i, t) for i, t, _ in want)
    assert next(m for i, _, m in kept if i == 7) == "l"


def test_recall_under_shared_boilerplate(spark):
    """Pairs just over the threshold among many pages that share their boilerplate, pairwise under it."""
    rng = random.Random(11)
    shared = text(rng, 60, 10**6)
    rows = []
    for k in range(150):
        own = text(rng, 150, 10**6).split()
        other = list(own)
        for at in rng.sample(range(5, 145, 12), 3):
            other[at] = f"y{rng.randrange(10**9)}"
        rows += [(2 * k, shared + " " + " ".join(own)), (2 * k + 1, shared + " " + " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(150))


# --- top-k -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("size", "ragged"), [(3, False), (300, True), (10**6, True), (10**9, False), (8 * 10**8, True)])
def test_topk_of_any_size_and_length(spark, size, ragged):
    rng = random.Random(size)
    data = [(rng.randrange(40), [rng.randrange(-size, size + 1) / 256 for _ in range(rng.choice([2, 4, 5]) if ragged else 5)], "x", 1) for _ in range(70)]
    df = topk.whole(spark.createDataFrame(data, "vec_id long, embedding array<double>, shard string, block int"))
    rows = [(i, [math.floor(256.0 * x) for x in v]) for i, v, *_ in data]
    want = defaultdict(list)
    for q, w in rows:
        if q % 7 == 0:
            want[q] += [(-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in rows if i != q]
    want = sorted((q, k + 1, i, -s) for q, own in want.items() for k, (s, i) in enumerate(sorted(own)[:5]))
    got = topk.search(df.withColumn("theta", F.lit(1)), df.where("vec_id % 7 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_threshold_rises_and_moves_the_essential_line():
    rng = np.random.default_rng(5)
    ids, vectors = np.arange(3 * topk.STRETCH), np.floor(256 * rng.normal(0, 0.2, (3 * topk.STRETCH, 32)))
    shard = topk.Shard(ids, vectors)
    for q in range(5):
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        for theta in (None, scores[order[-1]], scores[order[-1]] - 1000):
            top_ids, top = shard.best(q, vectors[q], theta, 5)
            assert top_ids.tolist() == order and top.tolist() == scores[order].tolist()
        assert not len(shard.best(q, vectors[q], scores[order[0]] + 1, 5)[0])


# --- toxicity --------------------------------------------------------------------------------------------------------------------------


def test_toxicity_of_awkward_rows(spark):
    rng = random.Random(2)
    words = lambda bad, n=80: " ".join("dreadful" if bad and rng.random() < 0.08 else f"{rng.choice('abcdefgh')}{rng.choice(['ing', 'ed', 'tion'])}{rng.randrange(60)}" for _ in range(n))
    train = [(k, words(k % 4 == 0)) for k in range(300)]
    extra = [(500, words(True, 40_000)), (501, words(False, 40_000)), (502, "x" * 100_000), (None, words(True)), (503, train[0][1]), (503, train[0][1])]
    docs = spark.createDataFrame([(i, t, 1.0, "s") for i, t in train + extra], "doc_id long, text string, score double, _toxic_score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 7) for k in range(300)] + [(0, 1, 7), (None, 1, 7), (1, None, 7)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 306 and got[500] >= 0.3 > got[501] and got[502] < 0.3
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 503)}) == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.3 and i is not None}
    again = toxicity.train(docs.repartition(3), labels)
    assert again == model


# --- licenses --------------------------------------------------------------------------------------------------------------------------


def test_whole_license_texts(spark):
    rng = random.Random(5)
    rows = []
    for label, t in licenses.TEMPLATES:
        w = t.split()
        for _ in range(len(w) // 40):
            w[rng.randrange(len(w))] = "zzz"
        rows.append((len(rows), " ".join([text(rng, rng.randrange(200)), *w, text(rng, 50)]), label, 1))
    rows.append((len(rows), " ".join(w for w in text(rng, 70_000).split()) + " " + licenses.TEMPLATES[0][1], "mit", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score int")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert all(label in found[i]["labels"].split(",") for i, _, label, _ in rows if rows[i][1].count("zzz") <= 0.1 * len(set(licenses.TEMPLATES[min(i, len(rows) - 2)][1].split())) or i == len(rows) - 1)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r[:2]) for r in rows[:-1]])
    want = con.execute(licenses.SQL)
    names = [d[0] for d in want.description]
    assert sorted(want.fetchall()) == sorted(tuple(r[n] for n in names) for i, r in found.items() if i < len(rows) - 1)


# --- mixing ----------------------------------------------------------------------------------------------------------------------------


def test_mix_carries_columns_of_any_name(spark):
    names = ["size", "_taken", "_copy", "_tie", "tie", "taken", "copy", "d", "key", "at"]
    rng = random.Random(3)
    rows = [(k % 20, text(rng, 30) if k % 7 else None, ["a", "b", None][k % 3], k, *([k % 20] * len(names))) for k in range(40)]
    rows += [rows[1], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[n] == r["doc_id"] for n in names) and r["n_chars"] == len(r["text"])
        assert any(x[0] == r["doc_id"] and (x[1] or "").startswith(r["text"]) for x in rows)
    words = sum(len(r["text"].split()) for r in out.collect())
    assert words == mixing.mix(docs).agg(F.sum("taken")).first()[0]


# --- quality -------------------------------------------------------------------------------------------------------------------------


def test_quality_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, (text(rng, 60, 40) if k % 3 else text(rng, 60)) + ("\n" + text(rng, 5, 9)) * (k % 4), "c", 1) for k in range(120)]
    rows += [(200, None, "c", 1), (201, "", "c", 1), (202, "été # été\nété # été\n\n", "c", 1), (203, text(rng, 30_000), "c", 1), (5, rows[5][1], "c", 1), (None, rows[5][1], "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, _y int")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 120, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    folds = {r[0]: r[1] for r in docs.select("text", quality.fold(common.utf8())).collect()}
    llr = {}
    raw, trusted = Counter(), defaultdict(Counter)
    grams = lambda t: quality.buckets((t or "").encode().split()) if (t or "").split() else []
    good = {k for k in range(0, 120, 2) if k % 3}
    for i, t, *_ in rows:
        raw.update(g := list(grams(t)))
        if i in good:
            trusted[folds[t]].update(g)
    for f in range(quality.FOLDS):
        own = Counter()
        for other, c in trusted.items():
            if other != f:
                own.update(c)
        strength, total, every = quality.SMOOTH * sum(own.values()) + 1, sum(own.values()), sum(raw.values())
        p = lambda b: (raw[b] + 0.5) / (every + 0.5 * quality.BUCKETS)  # noqa: E731, B023
        llr[f] = {b: math.log((own[b] + strength * p(b)) / (total + strength)) - math.log(p(b)) for b in raw}
    got = quality.rate(docs, labels).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w, lines, g = t.split(), [x for x in t.split("\n")], grams(t)
        dup = sum(1 for k, x in enumerate(lines) if x.split() and x in lines[:k])
        eight = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeat = {k + j for k in range(len(w) - 7) if eight[tuple(w[k : k + 8])] > 1 for j in range(8)}
        score = sum(llr[folds[t or None if t else (None if i == 200 else "")]][b] for b in g) / len(g) if len(g) else 0.0
        failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat), round(score, 6), failed)] += 1
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((*(r[n] for n in names), round(r["score"], 6), r["base_failed"]) for r in got) == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(r["kept"] and r["base_failed"] for r in got)
    least = min((math.floor(r["score"] / quality.STEP) for r in got if r["kept"]), default=0)
    assert all(r["kept"] == (not r["base_failed"] and math.floor(r["score"] / quality.STEP) >= least) for r in got) and any(kept.values())


def test_threshold_of_counts():
    at = np.arange(5.0)
    assert quality.threshold(np.zeros(5), np.ones(5), at) == -np.inf
    assert quality.threshold(np.array([0, 0, 1, 50, 50.0]), np.array([5, 5, 5, 0, 0.0]), at) == 3.0
    assert quality.threshold(np.array([0, 0, 5, 50, 50.0]), np.array([5, 5, 5, 0, 0.0]), at) == 2.0
    assert quality.threshold(np.array([1, 0, 1, 99, 99.0]), np.zeros(5), at) == 3.0


@there
def test_unseen_trusted_documents_are_kept_like_seen_ones(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    half = F.expr("crc32(cast(doc_id as string)) % 2 = 0")
    got = quality.rate(docs, labels.where(half)).where("NOT base_failed").join(labels.where("quality = 1"), "doc_id").groupBy(half.alias("seen")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    shares = {r["seen"]: r["kept"] for r in got}
    assert abs(shares[True] - shares[False]) <= 0.05 and min(shares.values()) > 0.9


# --- language --------------------------------------------------------------------------------------------------------------------------


def test_language_against_brute_force(spark):
    rng = random.Random(6)
    en, fr, de = "the house and garden with many things".split(), "la maison et le jardin avec des choses".split(), "das haus und der garten mit vielen dingen".split()
    say = lambda w, n: " ".join(rng.choices(w, k=n))
    docs = [(k, say(w, 40), x) for k in range(30) for w, x in ((en, "en"), (fr, "fr"), (de, "de"))] + [(900, None, "en"), (901, "x", None)]
    pages = []
    for k in range(60):
        w, x = [(en, "en"), (fr, "fr"), (de, "de")][k % 3]
        pages.append((k, f"http://u@h{k % 5}.example.{['com', 'fr', 'de'][k % 3]}:80/{k}" if k % 7 else None, f"<html lang={rng.choice([x, x, 'xx'])}><p>{say(w + en[:3], rng.randrange(9))}</p></html>" if k % 11 else None, "x"))
    pages += [pages[1], (500, "", "<p>" + say(de, 30_000) + "</p>", "x"), (None, "http://h1.example.com", "", "x")]
    langs = ["de", "en", "fr"]
    p, d = spark.createDataFrame(pages, "page_id long, url string, html string, lang string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.likelihoods(d, langs)
    n = np.full((3, langid.BUCKETS), 0.05)
    for _, t, x in docs:
        if x:
            np.add.at(n[langs.index(x)], langid.grams(t or ""), 1)
    assert np.allclose(model, np.log(n / n.sum(axis=1, keepdims=True)))
    rows = []
    for i, url, h, _ in pages:
        g = langid.grams(langid.visible(h or ""))
        s = model[:, g].sum(axis=1) * (min(langid.EVIDENCE, len(g)) / len(g) if len(g) else 1)
        t = np.exp(s - s.max())
        host = (url or "").split("//")[-1].split("@")[-1].split(":")[0].split("/")[0]
        said = (h or "").split("lang=")[1][:2] if "lang=" in (h or "") else ""
        rows.append([i, host, host.rsplit(".", 1)[-1], said if said in [*langs, ""] else "other", t / t.sum()])
    every = sum(r[4] for r in rows) + 1
    share = every / every.sum()
    sums = [defaultdict(lambda: np.zeros(3)) for _ in range(3)]
    for r in rows:
        for k in range(3):
            sums[k][r[1 + k]] = sums[k][r[1 + k]] + r[4]
    kinds = [*langs, "other"]
    says = np.array([sums[2][k] + langid.DECLARED_SMOOTH for k in kinds])
    says = dict(zip(kinds, says / says.sum(axis=0), strict=True)) | {"": np.ones(3)}
    want = Counter()
    for i, host, suffix_, said, t in rows:
        s = np.maximum(sums[1][suffix_] - t, 0) + langid.SMOOTH * share
        h = np.maximum(sums[0][host] - t, 0) + langid.SMOOTH * s / s.sum()
        q = t * says[said] * h / h.sum()
        want[(i, host, said, langs[int(np.argmax(q))], round(float(q.max() / q.sum()), 6))] += 1
    assert Counter((r["page_id"], r["host"], r["declared"], r["lang"], round(r["confidence"], 6)) for r in langid.identify(p, d).collect()) == want


# --- packing ---------------------------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    definition = open(packing.tokenizer_path()).read()
    tokenizer, encoder, rng = Tokenizer.from_str(definition), packing.Encoder.of(definition), random.Random(12)
    alphabet = [*"abcXYZİıßẞΣσςŞÉéǅﬁŉᾴ̇ͅ'.,-#$!0129 \n\t 　一", "é", "İ#", "'s", "'LL"]
    for _ in range(60_000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))
        ids = tokenizer.encode(s, add_special_tokens=False).ids
        assert encoder.encode(s) == struct.pack(f"<{len(ids)}I", *ids), repr(s)


def test_plans_stay_within_their_bound():
    rng = random.Random(1)
    for most in (3, 50, 10_000):
        h = {n: rng.randrange(1, most) for n in range(1, 2049)}
        assert len(packing.plan(h)) <= packing.PLAN_ROWS * 2048


# --- pipeline --------------------------------------------------------------------------------------------------------------------------

ROWS = [(1, None), (2, ""), (3, "  \n"), (4, "few words"), (4, "few words"), (5, "é " * 30), (None, "no id here at all, 4111111111111111"), (None, None)]
EXTRA = ["size", "_taken", "_copy", "_tie", "n_found", "_found", "_toxic_score", "key", "md5", "d", "taken"]


@there
@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "pii", "mixing", "packing"])
def test_stage_stands_awkward_rows(spark, name):
    import corpus_pipeline as p

    rng = random.Random(8)
    rows = [*ROWS, *((k, text(rng, 40), ) for k in range(10, 30)), (30, text(rng, 50_000))]
    docs = spark.createDataFrame([(i, t, "en", None if (i or 0) % 2 else "s", len(t or ""), *(["c"] * len(EXTRA))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))
    stage = dict(p.STAGES)[name]
    got, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == got.columns
    if name == "packing":
        assert got.groupBy("doc_id", "piece").count().where("count > 2").count() == 0 and got.where("piece = 0").count() == len(rows)
        return
    assert got.columns == docs.columns and got.where(" OR ".join(f"{c} <> 'c'" for c in EXTRA)).count() == 0
    out = Counter((r["doc_id"], r["text"]) for r in got.collect())
    if name == "pii":
        assert sum(out.values()) == len(rows) and sum(v for (i, t), v in out.items() if (i, t) in rows) == len(rows) - 1
    if name == "toxicity":
        assert set(out) <= set(rows)
    if name == "near_duplicates":
        assert set(out) == set(rows) and set(out.values()) == {1}
    if name == "mixing":
        assert all(t and t.split() for _, t in out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_pipeline_against_brute_force(spark):
    """Each stage's rows from those of the one before, by plain means."""
    import corpus_pipeline as p

    sf, before = "/root/testdata/sf0.001", files(spark)
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in p.STAGES:
        docs.append(stage(spark, docs[-1], sf).cache())
    raw, clean, single, masked, mixed, packed = docs
    model = toxicity.train(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    saved = model.distances()
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in raw.collect() if model.score(saved((r["text"] or "").encode())) < 0.3}
    sets = {}
    for r in clean.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in single.collect()} == {root(i) for i in sets}
    assert {r["doc_id"]: r["text"] for r in pii.restore(masked).collect() if "@" not in (r["text"] or "")}.items() >= {r["doc_id"]: r["text"] for r in single.collect() if not any(c in (r["text"] or "") for c in "@0123456789")}.items()
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [[r["doc_id"], r["text"], r["source"]] for r in masked.collect()])
    want = {i: taken for i, _, _, _, taken, _ in con.execute(mixing.SQL).fetchall() if taken}
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert got == want
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in mixed.collect():
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        want.update((r["doc_id"], k, zlib.crc32(struct.pack(f"<{len(ids[at : at + 2048])}I", *ids[at : at + 2048]))) for k, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect()) == want
    left = files(spark)
    whole = p.run(spark, sf)
    assert Counter(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == want
    assert len(files(spark) - left) == 1 and left >= before
