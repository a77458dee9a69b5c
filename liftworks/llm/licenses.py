"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

A template's blocks are all stretches of `block(template)` words that begin at one of its tokens (any other block holds no more of it
than the one that begins at its first token). A template matches a block that contains at least CONTAINMENT of its distinct tokens.
Tokens are ordered by document frequency over the whole corpus, rarest first: a matching block must hold one of a template's first
|T| - need + 1 tokens (prefix filter), so only blocks around places of these are looked at (positional filter), and only in texts that
hold at least `need` template tokens (length filter); what passes is counted exactly.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftworks.llm.common import small_batches, table, utf8
from liftworks.llm.license_texts import NOTICES, TEXTS

CONTAINMENT = 0.9
#: Base phrases and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = TEXTS + NOTICES
_WORDS = bytes(c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def need(size: int, containment: float = CONTAINMENT) -> int:
    """Tokens of a template of that size that a block must hold."""
    return next(n for n in range(size + 1) if n >= containment * size - 1e-9)


def block(words: int) -> int:
    """Words of a template's blocks, by the template's own: room for a quarter more and a few between."""
    return words + words // 4 + 8


class Index:
    """Templates under a global token order, and the tokens of their prefixes. Its size depends on the templates alone."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], containment: float = CONTAINMENT):
        vocabulary = {w for _, t in templates for w in words_of(t.encode())}
        self.order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.prefix = [], {}
        for label, t in templates:
            words = words_of(t.encode())
            tokens = sorted({self.order[w] for w in words})
            least = need(len(tokens), containment)
            for x in tokens[: len(tokens) - least + 1]:
                self.prefix.setdefault(x, []).append(len(self.templates))
            self.templates.append((label, frozenset(tokens), frozenset(tokens[: len(tokens) - least + 1]), least, block(len(words))))
        self.rare = frozenset(w for w, i in self.order.items() if i in self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(block start, template, containment) of every block and template that meet the threshold."""
        if self.rare.isdisjoint(words):
            return []
        here = [(i, self.order[w]) for i, w in enumerate(words) if w in self.order]
        present = {x for _, x in here}
        found = []
        for k in sorted({k for x in present for k in self.prefix.get(x, ())}):  # prefix filter
            _, tokens, prefix, least, span = self.templates[k]
            if len(present & tokens) < least:  # length filter
                continue
            own = [(i, x) for i, x in here if x in tokens]
            inside: Counter = Counter()
            end, rare = 0, -1  # of the block that begins at a place: its end among the places, its next place of a prefix token
            for at, (i, x) in enumerate(own):
                while end < len(own) and own[end][0] < i + span:
                    inside[own[end][1]] += 1
                    end += 1
                while rare < at or (rare < len(own) and own[rare][1] not in prefix):
                    rare = max(rare + 1, at)
                    if rare >= len(own):
                        break
                if rare < end and len(inside) >= least:  # positional filter, then the exact count
                    found.append((i, k, len(inside) / len(tokens)))
                inside[x] -= 1
                if not inside[x]:
                    del inside[x]
        return found


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every base phrase."""
    text = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in PHRASES.items():
        p = b" " + phrase.encode() + b" "
        at = text.find(p)
        while at >= 0:
            found.append((text.count(b" ", 0, at), label))
            at = text.find(p, at + 1)
    return sorted(found)


def frequencies(documents: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Document frequency of each template token over the whole corpus; at most the templates' tokens reach the driver."""
    small_batches(documents.sparkSession)
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                n.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    rows = documents.select(utf8()).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {r["w"].encode(): r["n"] for r in rows}


def scan(documents: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: base phrases, labels of phrases and templates, starts of matching blocks, best containment.

    Null and empty texts have no words, no labels and score 0; very long texts are scanned whole; repeated rows are scanned each; other
    columns play no part; an empty table gives no rows."""
    index = Index(templates, frequencies(documents, templates))

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                base = places(words)
                hits = index.matches(words)
                own = {label for _, label in base}
                out.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {index.templates[k][0] for _, k, _ in hits})), max((c for *_, c in hits), default=0.0), len({s for s, *_ in hits})))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).mapInArrow(run, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    words = [(label, [w.decode() for w in words_of(t.encode())]) for label, t in TEMPLATES]
    literal = lambda t: "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(t)) + "]"
    templates = ", ".join(f"('{label}', {literal(t)}, {need(len(set(t)))}, {block(len(t))})" for label, t in words)
    phrase = " OR ".join("(" + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES)
    label = "CASE " + " ".join("WHEN " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + f" THEN '{name}'" for p, name in PHRASES.items()) + " END"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT r, i, {label} AS label FROM (SELECT r, w, unnest(range(len(w))) AS i FROM t) WHERE {phrase}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
templates(label, tokens, least, span) AS (VALUES {templates}),
likely AS (SELECT r, w, label, tokens, least, span FROM t JOIN templates ON len(list_intersect(w, tokens)) >= least),
blocks AS (SELECT r, i AS s, label, len(tokens) AS n, least, len(list_intersect(list_slice(w, i + 1, i + span), tokens)) AS held FROM (SELECT *, unnest(range(len(w))) AS i FROM likely) WHERE list_contains(tokens, w[i + 1])),
hits AS (SELECT r, s, label, held / n::DOUBLE AS c FROM blocks WHERE held >= least),
found AS (SELECT r, max(c) AS score, count(DISTINCT s) AS n_blocks FROM hits GROUP BY r),
both_labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION ALL SELECT r, label FROM places) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM t LEFT JOIN base USING (r) LEFT JOIN found USING (r) LEFT JOIN both_labels USING (r)"""


SQL = _sql()
