"""Small documents with every odd case, and plain-Python counterparts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
PROSE = ("the quick brown fox jumps over the lazy dog and runs into the deep forest where an old owl "
         "watches from a tall tree while the wind blows softly across the quiet river near the mill")
ODD_TEXTS = [
    None, "", " \t\n ", "one", "one two three", "a b c d e", LONG, PROSE, PROSE, PROSE + " again",
    PROSE.upper(), "\n\n".join([PROSE] * 3), "ß é 你好 🙂 　 x", "x" * 20_000, "1 " * 3_000,
    "mail me.at+home@mail.example.com or call +1 (555) 010-2030, 4111 1111 1111 1111 at 10.0.0.255",
]


def documents(spark: SparkSession, texts: list[str | None] | None = None) -> DataFrame:
    texts = ODD_TEXTS if texts is None else texts
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t or ""))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_documents(spark: SparkSession) -> DataFrame:
    """All odd texts, a repeated row, a NULL id, and columns named like inner ones."""
    docs = documents(spark)
    more = spark.createDataFrame([(7, PROSE, "en", "s1", 1), (None, PROSE, None, None, None)], SCHEMA)
    both = docs.union(more)
    for name in ("features", "label", "prediction", "component", "node", "ids", "copy", "mix_copy", "words",
                 "vector", "first", "pii_spans", "n", "bucket", "place", "score", "row", "key", "mix_source",
                 "mix_levels", "mix_copies", "mix_place", "jaccard_dropped", "passage_doc_id", "repeat_doc_id", "a.b"):
        both = both.selectExpr("*", f"'{name}' AS `{name}`")
    return both


def empty_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None, k: int = 5) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def similar(a: frozenset, b: frozenset) -> bool:
    shared = len(a & b)
    return shared > 0 and 100 * shared >= 80 * (len(a) + len(b) - shared)


def components(sets: dict) -> dict:
    """Smallest key reachable by similar sets, by comparing all sets that share an element."""
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders: dict = {}
    for key in sorted(sets):
        met = {other for s in sets[key] for other in holders.get(s, ())}
        for s in sets[key]:
            holders.setdefault(s, []).append(key)
        for other in met:
            if similar(sets[key], sets[other]):
                a, b = root(key), root(other)
                parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in sets}
