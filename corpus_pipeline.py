"""From raw documents to token ids: the training-data pipeline, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import jaccard, mixing, pieces, pii, toxicity
from ledgerlens.llm.names import columns
from ledgerlens.llm.shipping import ship_code
from ledgerlens.session import arrow_batches, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Whole texts go to Python so many rows at once; results do not depend on it.
BATCH_ROWS = 1_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    ship_code(spark)
    with arrow_batches(spark, BATCH_ROWS):
        clean = toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        # Written here, as the size of a batch is that of the session when the rows are made.
        return materialize(clean, "clean")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts: the one of the smallest id."""
    ship_code(spark)
    return jaccard.one_of_each_group(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind; ``n_chars`` follows."""
    ship_code(spark)
    with arrow_batches(spark, BATCH_ROWS):
        found = pii.find_pii(docs).withColumns(
            {"text": F.col("pii_redacted"), "n_chars": F.length("pii_redacted").cast("long")})
        return materialize(found.select(*columns(docs.columns)), "redacted")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    return mixing.mix_sources(docs).select(*columns(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    ship_code(spark)
    with arrow_batches(spark, BATCH_ROWS):
        return materialize(pieces.encode_documents(docs), "encoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix),
    ("sentencepiece", encode),
]

# The stages that write their rows themselves.
WRITTEN = ("toxicity", "pii", "sentencepiece")

# Trained models decide in several stages, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over a written table of its predecessor's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name not in WRITTEN:
            docs = materialize(docs, name)
    return docs
