"""The named queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm import (
    chat, jaccard, langid, merkle, mixing, neighbours, passages, periodic, pieces, pii, quality, sharding, substring,
    toxicity,
)
from ledgerlens.llm.shipping import ship_code

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents"))


def op3_pii_skip_chain(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(_table(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.col("pii_counts")[i].alias(f"n_{kind}") for i, kind in enumerate(pii.BASE_KINDS)]
    spans = F.filter(F.split("pii_spans", ","), lambda span: span != "")
    secrets = F.size(F.filter(spans, lambda span: span.startswith("secret:")))
    added = F.size(spans) - F.aggregate("pii_counts", F.lit(0).cast("long"), lambda n, count: n + count)
    return found.select("doc_id", *counts, F.sha2("pii_base", 256).alias("base_sha256"),
                        F.col("pii_spans").alias("spans"), secrets.cast("long").alias("n_secret"),
                        added.cast("long").alias("n_added"))


def op4_toxicity_trees(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_preference_turns(spark: SparkSession, folder: str) -> DataFrame:
    return chat.continued_pairs(_table(spark, folder, "conversations"))


def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Equal and similar lines, and equal passages wherever lines begin and end."""
    docs = _table(spark, folder, "documents")
    lines = substring.repeated_paragraphs(docs).withColumn("kind", F.lit("paragraph"))
    return lines.unionByName(
        passages.repeated_passages(docs).withColumn("kind", F.lit("passage")), allowMissingColumns=True)


def op6_repeated_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return substring.repeated_paragraphs(_table(spark, folder, "documents"))


def op7_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify_languages(_table(spark, folder, "documents"))


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, folder, "documents"))


def op9_hash_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, folder, "documents"))


def _id_hash() -> Column:
    """Unsigned CRC-32 of the decimal id; 1, which changes nothing, for NULL."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, and the roots that it gives after every second document has lost its line breaks."""
    docs = _table(spark, folder, "documents")
    tampered = F.when(_id_hash() % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = merkle.leaf_of([tampered if field == "text" else F.col(field) for field in merkle.FIELDS])
    manifest = merkle.merkle_manifest(docs, carried={"changed": changed})
    folded = merkle.folded_root(F.col("changed"), F.col("proof"))
    return manifest.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and place of every document, planned from keys and sizes alone."""
    sized = _table(spark, folder, "documents").select(
        "doc_id", sharding.text_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = sharding.shard_by_bytes(sized, order=("doc_id", "text_crc32"), size=F.col("size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``: the words of every tenth document repeat a piece of it from some word on."""
    g = F.floor(_id_hash() / 10)
    words = F.when(_id_hash() % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", words.alias("words"), g.alias("g")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    left = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    piece = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(piece, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    changed = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), tail)
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of all documents, some of which are given a repeated tail."""
    found = periodic.periodic_runs(repeated_tails(_table(spark, folder, "documents")))
    best = periodic.strongest_run(F.col("runs"))
    lines = F.transform("runs", lambda run: F.concat(
        F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_pii_skip_chain": op3_pii_skip_chain,
    "op4_toxicity_trees": op4_toxicity_trees,
    "op5_preference_turns": op5_preference_turns,
    "op6_repeated_passages": op6_repeated_passages,
    "op6_repeated_paragraphs": op6_repeated_paragraphs,
    "op7_language_profiles": op7_language_profiles,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_hash_prefix_forest": op9_hash_prefix_forest,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_shards": op12_byte_shards,
    "op13_periodic_runs": op13_periodic_runs,
}
