"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows: words, and stems with several endings in one
text, that are far likelier in toxic texts by a likelihood-ratio test. Two thirds of those
rows fit the trees, the rest calibrates their margins. Features are densities of lexicon
words and stems, plain and obfuscated, second-person words near them, capitals, punctuation
and obfuscation rates. Neither labels nor language, source or id enter a score.

Bounds: at most ``SAMPLE_ROWS`` labelled rows, those of the smallest hashed ids, train the
model, and at most ``LEXICON_TERMS`` terms are learned. Scoring covers every whole text.

Defined results: NULL, empty and blank texts have all features 0 and get the score of such
a text. Several labels of one id count as toxic if one of them is. Repeated rows each get
the same score. Without labels of both classes the score is the lexicon's verdict alone
(1 with a hit, else 0). An id that is NULL is not held out. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlens.llm.names import column, columns
from ledgerlens.session import materialize

SAMPLE_ROWS = 20_000
LEXICON_TERMS = 500
MIN_LOG_ODDS = 2.5
# Likelihood-ratio statistic of a term; 24 has a chance below one in a million.
MIN_EVIDENCE = 24.0
STEM_CHARS = (4, 5, 6, 7)
STEM_ENDINGS = 2
HELD_OUT_FOLDS = 5
PARTS = 3
TREES = 20
DEPTH = 3
SEED = 17

# A start lexicon, used beside the learned terms.
SEED_TERMS = (
    "idiot stupid moron scum trash loser pathetic worthless disgusting clown "
    "dumb fool imbecile garbage filth vermin"
).split()
# Second-person words of the corpus languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "ihr euch usted ustedes vosotros ti tuyo".split()
)
# Signs that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
                            "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_kinds", "stem_density", "stem_hits", "stem_kinds", "hidden_density", "hidden_hits",
    "second_person_density", "second_person_near", "capital_ratio", "shouted_ratio",
    "exclamation_rate", "question_rate", "punctuation_rate", "obfuscation_rate", "log_words",
)

WORD = re.compile(r"[^\W_]+")
# Letters broken by digits or signs, without a space: sc*m, l0ser, i.d.i.o.t
BROKEN = re.compile(r"[^\W\d_]+(?:[0-9@$!|€*._+-]+[^\W\d_]+)+")
NON_LETTER = re.compile(r"[^a-z]")
CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
NEAR = 3


def fold(id_col: str, folds: int = HELD_OUT_FOLDS) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def stems_of(words: set[str]) -> Iterator[str]:
    """Beginnings that several longer words of a text share, with a dash behind."""
    for size in STEM_CHARS:
        heads = Counter(w[:size] for w in words if len(w) > size)
        yield from (f"{h}-" for h, n in heads.items() if n >= STEM_ENDINGS)


class Lexicon:
    """Terms ready for look-up: words, and stems (with a dash behind)."""

    def __init__(self, terms: list[str]):
        self.words = frozenset(t for t in terms if not t.endswith("-"))
        self.stems = tuple(sorted(t[:-1] for t in terms if t.endswith("-")))
        self.heads = frozenset(s[:STEM_CHARS[0]] for s in self.stems)
        self.starred: dict[tuple[int, str], set[str]] = {}
        for term in self.words:
            self.starred.setdefault((len(term), term[0]), set()).add(term)

    def stemmed(self, words: list[str]) -> list[str]:
        size, heads = STEM_CHARS[0], self.heads
        near = [w for w in words if w[:size] in heads] if heads else []
        return [w for w in near if w.startswith(self.stems)]

    def hides(self, word: str) -> bool:
        """Whether a broken word spells a term once signs are read as letters or left out."""
        spelled = word.translate(LOOKALIKES)
        if NON_LETTER.sub("", spelled) in self.words or NON_LETTER.sub("", word) in self.words:
            return True
        return "*" in word and any(
            all(w == t or w == "*" for w, t in zip(spelled, term))
            for term in self.starred.get((len(word), word[0]), ()))


def features_of(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    found = lexicon.words.intersection(words)
    hits = near = 0
    if found:
        places = [i for i, w in enumerate(words) if w in found]
        hits = len(places)
        near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR):i + NEAR + 1]) for i in places)
    stemmed = lexicon.stemmed(words)
    broken = BROKEN.findall(low)
    hidden = sum(map(lexicon.hides, broken))
    second = sum(map(SECOND_PERSON.__contains__, words))
    capitals = len(CAPITAL.findall(text))
    shouted = len(SHOUTED.findall(text)) if capitals > 1 else 0
    exclaimed, asked = text.count("!"), text.count("?")
    signs = exclaimed + asked + sum(map(text.count, ".,;:*#$%&"))
    return [
        hits / n, float(hits), float(len(found)), len(stemmed) / n, float(len(stemmed)),
        float(len(set(stemmed))), hidden / n, float(hidden), second / n, float(near),
        capitals / len(text), shouted / n, exclaimed / n, asked / n, signs / n, len(broken) / n,
        float(np.log1p(n)),
    ]


def text_features(docs: DataFrame, terms: list[str], id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``features`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            rows = [features_of(t.as_py(), lexicon) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.select(column(id_col), column(text_col)).mapInArrow(run, schema)


def training_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` ids that may be learned from, with label and part (0, 1 or 2)."""
    known = labels.where("toxic is not null and doc_id is not null").where(fold("doc_id") != 0)
    once = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    hashed = once.withColumn("place", F.xxhash64("doc_id"))
    return hashed.orderBy("place", "doc_id").limit(rows).select(
        "doc_id", "label", F.pmod("place", F.lit(PARTS)).alias("part"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = set(WORD.findall((text.as_py() or "").lower()))
            found = [*words, *stems_of(words)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(found), pa.float64()), pa.array(found, pa.string())],
                ["label", "term"])


def learned_terms(texts: DataFrame, terms: int = LEXICON_TERMS) -> list[str]:
    """Words and stems of ``text`` that speak for a toxic ``label``, the clearest first."""
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)
    if not toxic or not clean:
        return []
    counts = texts.select("label", "text").mapInArrow(_terms, "label double, term string").groupBy("term").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    bad, good, n = F.col("bad"), F.col("good"), F.col("bad") + F.col("good")
    share = toxic / (toxic + clean)
    odds = F.log((bad + 0.5) / (toxic - bad + 0.5)) - F.log((good + 0.5) / (clean - good + 0.5))
    evidence = 2 * (bad * F.log(bad / (n * share)) + F.when(good > 0, good * F.log(
        good / (n * (1 - share)))).otherwise(0.0))
    best = counts.where("bad > 0").withColumns({"odds": odds, "evidence": evidence}).where(
        (F.col("odds") >= MIN_LOG_ODDS) & (F.col("evidence") >= MIN_EVIDENCE)
    ).orderBy(F.desc("evidence"), "term").limit(terms)
    return [r["term"] for r in best.select("term").collect()]


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; the models are None where labels allow none."""

    terms: list[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, features: DataFrame) -> DataFrame:
        """``doc_id`` and ``score`` of rows with ``features``."""
        if self.trees is None or self.calibration is None:
            hit = F.lit(False)
            for name in ("lexicon_hits", "stem_hits", "hidden_hits"):
                hit = hit | (F.col("features")[FEATURES.index(name)] > 0)
            return features.select("doc_id", hit.cast("double").alias("score"))
        calibrated = self.calibration.transform(_margins(self.trees, features))
        inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
        return calibrated.select("doc_id", inside.alias("score"))


def _margins(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    vectors = rows.withColumn("vector", array_to_vector("features"))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    return trees.transform(vectors).select(*rows.columns, margin)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
                 id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    chosen = materialize(training_labels(labels, rows).coalesce(1), "labels")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # At most ``rows`` ids, so the broadcast is bounded by the parameter.
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id"), "sample")
    terms = list(dict.fromkeys([*learned_terms(sample), *SEED_TERMS]))
    found = text_features(sample, terms).join(F.broadcast(chosen), "doc_id")
    ready = materialize(found.coalesce(4), "training")
    classes = ready.groupBy("part").agg(F.countDistinct("label").alias("n")).where("n > 1")
    if classes.count() < PARTS:
        return ToxicityModel(terms, None, None)
    vectors = ready.withColumn("vector", array_to_vector("features"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label",
                          maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=10,
                          seed=SEED, cacheNodeIds=False).fit(vectors.where("part < 2").drop("part"))
    margins = _margins(trees, ready.where("part = 2"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(
        margins.select("margin", "label"))
    return ToxicityModel(terms, trees, calibration)


def clean_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged.

    Whole rows go along with their features, so nothing is joined and NULL ids are judged too.
    """
    model = fit_toxicity(docs, labels, rows, id_col, text_col)
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns(docs.columns))])
    packed = docs.select(row.alias("doc_id"), column(text_col).alias("text"))
    scored = model.score(text_features(packed, model.terms))
    return scored.where("score < 0.5").select(
        *[F.col(f"doc_id.c{i}").alias(name) for i, name in enumerate(docs.columns)])


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    model = fit_toxicity(docs, labels, rows, id_col, text_col)
    scored = model.score(text_features(docs, model.terms, id_col, text_col))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
