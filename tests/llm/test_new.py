"""Manifest, embeddings and spelling against brute force, and on rows they must stand."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from liftworks.llm import manifest, metric, spelling

SF = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, path string, grp string, row string, v string, m string"


def same_as_sql(spark, query, sql, tables, sf=SF):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = query(spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


# --- manifest --------------------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(level):
    """root, and each leaf's siblings in order, of a list of digests."""
    sibs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(level):
                sibs[k].append((i & 1, level[i ^ 1]))
            else:
                sibs[k].append((0, ""))
        at = [i // 2 for i in at]
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], sibs


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        i, n = r[0], r[3]
        bad = n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        groups[r[2]].append((i is None, i or 0, h(*map(part, r)), h(*map(part, (*r[:3], bad, r[4])))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for k, g in enumerate(order):
        for (none, i, leaf, bad), sibs in zip(sorted(groups[g]), trees[g][1], strict=True):
            way = [*sibs, *above[k]]
            for left, s in way:
                bad = h(s, bad) if left else h(bad, s)
            out.append((None if none else i, leaf, trees[g][0], root, h(*(s for _, s in way)), bad, bad == root))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_against_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(i, rng.choice([None, "s", "é:-"]), lang, rng.choice([None, i, 7]), rng.choice([None, "", "x" * i, "ü 1:"])) for i, lang in enumerate(["en"] * 37 + ["fr"] + ["de"] * 16 + [None] * 5 + [""] * 2 + ["é"] * 3 + ["z"])]
    rows += [(None, None, None, None, None), (None, "s", "en", 1, "x"), (3, "s", "en", 1, "again"), (3, "s", "en", 1, "again"), (3, "s", "en", 1, "again"), (99, None, "long", 9, "y" * 200_000)]
    docs = spark.createDataFrame([(i, t, lang, s, n, 1, "p", "g", "r", "v", "m") for i, s, lang, n, t in rows], SCHEMA)
    got = manifest.verified(manifest.manifest(docs)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(map(tuple, got.collect())) == by_hand(rows)


def test_manifest_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest.verified(manifest.manifest(empty)).count() == 0
    one = manifest.verified(manifest.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))).first()
    assert one["leaf"] == one["subroot"] == one["root"] == h("1:1", "1:s", "2:en", "1:1", "1:a") and one["proof_sha256"] == h() and one["verified"]


@there
def test_manifest_against_sql(spark):
    same_as_sql(spark, manifest.op12_manifest, manifest.SQL, ["documents"])


# --- embeddings ------------------------------------------------------------------------------------------------------------------


def near_by_hand(rows, cosine):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector)."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / max(np.linalg.norm(v), 1e-300) if g else None for (_, v), g in zip(rows, good, strict=True)]
    up, n = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine - 1e-12:
                n[a], n[b], up[root(a)] = n[a] + 1, n[b] + 1, root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    return Counter((i, n[k], least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def clustered(rng, n, width):
    """Random vectors, tight groups, chains just in range, and copies."""
    centres, out = rng.normal(size=(6, width)), []
    for _ in range(n):
        kind = rng.integers(4)
        if kind == 0 or not out:
            v = rng.normal(size=width)
        elif kind == 1:
            v = centres[rng.integers(6)] + 0.1 * rng.normal(size=width)
        elif kind == 2:
            step = rng.normal(size=width)
            v = out[rng.integers(len(out))] / 1.0 + step * (0.45 * np.linalg.norm(out[-1]) / np.linalg.norm(step))
        else:
            v = out[rng.integers(len(out))]
        out.append(v)
    return out


@pytest.mark.parametrize(("width", "cosine", "block", "cells"), [(3, 0.9, 60, 16), (8, 0.9, 200, 40), (64, 0.9, 1 << 20, 16), (4, 0.5, 100, 8), (6, 0.999, 90, 5)])
def test_links_against_all_pairs(spark, monkeypatch, width, cosine, block, cells):
    monkeypatch.setattr(metric, "BLOCK", block)
    monkeypatch.setattr(metric, "LEAST_CELLS", cells)
    rng = np.random.default_rng(width)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(clustered(rng, 400, width))]
    rows += [(1000, None), (1001, []), (1002, [0.0] * width), (1003, [float("nan")] * width), (1004, [None] * width), (1005, [float("inf")] * width), (1006, [1.0] * (width + 1)), (1007, [2.0] * (width + 1)), (5, rows[9][1]), (None, rows[9][1]), (None, [-1e-200] * (width + 2))]
    docs = spark.createDataFrame([(i, v, 1, 2, "k") for i, v in rows], "vec_id long, embedding array<double>, node long, cell int, k1 string")
    got = metric.near_duplicates(docs, cosine)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == near_by_hand(rows, cosine)


def test_one_tight_group_is_counted_not_compared(spark, monkeypatch):
    rng, seen = np.random.default_rng(2), []
    centre = rng.normal(size=16)
    rows = [(k, [float(x) for x in (centre + 0.02 * rng.normal(size=16) if k % 3 else rng.normal(size=16))]) for k in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes = metric.distinct(frame).withColumn("node", metric.F.col("vec_id"))
    units = metric.matrix(nodes.select("v").toArrow().column("v"))
    cells = metric.Cells(metric.chosen(units, 16, 0.9), 0.9)
    home, core, seen = cells.homes(units)
    tight = np.abs(units @ (centre / np.linalg.norm(centre))) > 0.97
    assert core[tight].mean() > 0.99  # the group stands in cores
    visitors = Counter(int(c) for s in seen for c in s)
    crowd = Counter((2 * home + core).tolist()).most_common(1)[0][0]
    assert crowd % 2 == 1 and visitors[crowd] < 20  # whose work is its size times its few visitors
    assert Counter(map(tuple, metric.near_duplicates(frame).collect())) == near_by_hand(rows, 0.9)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError, match="cosine"):
        metric.near_duplicates(empty, 0.0)


@there
def test_links_against_sql(spark):
    same_as_sql(spark, metric.op11_embeddings, metric.SQL, ["embeddings"])


# --- spelling --------------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants_by_hand(rows):
    count = Counter()
    for i, text in rows:
        run, low = "", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                k = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run[: k % len(run)] + run[k % len(run) + 1 :] if k % 97 == 0 else run
                count[word] += len(word) >= 5
            run = ""
    words = {w: n for w, n in count.items() if n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        x = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = x if x is not None and words[x] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def spelt(rng, letters, n):
    """Words, their misspellings and anagrams, in texts of all kinds."""
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 10))) for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        if rng.random() < 0.1:
            rng.shuffle(w)
        out.append("".join(w))
    return out


@pytest.mark.parametrize(("letters", "crowd"), [("abé", 256), ("abcdefghijklmnopqrstuvwxyzß", 256), ("abc", 2), ("aeiourstln", 0)])
def test_variants_against_all_pairs(spark, monkeypatch, letters, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rng = random.Random(letters)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in spelt(rng, letters, 120))) for i in range(40)]
    rows += [(None, "aaaaa bbbbb aaaab"), (None, None), (7, ""), (8, "x" * 50_000 + " aaaaa,aaaab;aaaac÷×"), (rows[0][0], rows[0][1]), (9, "ÀÉÎÕÜ àéîõü 12abcde34abcde5abcde_abcde")]
    docs = spark.createDataFrame([(i, t, "w", 1, "s") for i, t in rows], "doc_id long, text string, word string, n int, sig string")
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == variants_by_hand(rows)


def test_ways_to_the_root_are_followed(spark):
    texts = " ".join(w for k, w in enumerate(["aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb", "bbbbbbb", "bbbbbbbb"]) for _ in range(3 << k))
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(4, texts)], "doc_id long, text string")).collect()}
    assert {tuple(r) for r in got.values()} == set(variants_by_hand([(4, texts)])) and got["aaaaab"]["root"] == "bbbbbbbb"


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "four 12345 a b")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


@there
def test_variants_against_sql(spark):
    same_as_sql(spark, spelling.op13_spelling, spelling.SQL, ["documents"])
