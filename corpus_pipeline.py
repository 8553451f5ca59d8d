"""A pipeline over documents: language, lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor wrote them, and decides about all of
them. All but the last return the columns of `documents`; what a stage changes is the rows, and in line
de-duplication the text (and n_chars with it). Null ids, null or empty texts, repeated rows, empty tables
and further columns of any name pass through as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspark.llm import common, decontam, langid, lines, minhash, packing


def _payload(docs: DataFrame) -> F.Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language: texts that are null or without letters go."""
    training = ~langid.held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull()
    samples = langid.sample_texts(docs, training)
    rows = docs.select(_payload(docs).alias("payload"), F.col("text"))
    return langid.identify(rows, samples).where(F.col("lang_pred") != langid.UNKNOWN).select("payload.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document that has nothing left goes."""
    rows = common.packed(docs, doc_id="doc_id", payload=_payload(docs.drop("text")), text="text")
    stripped = lines.decide(rows.drop("payload")).select("row", "n_removed", F.col("text").alias("new_text"))
    joined = rows.select("row", "payload").join(stripped, "row")
    kept = joined.where((F.col("n_removed") == 0) | F.col("new_text").rlike(r"\S"))
    columns = [F.col("new_text").alias("text") if c == "text" else F.col(f"payload.`{c}`").alias(c) for c in docs.columns]
    out = kept.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    rows = common.numbered(docs, doc_id="doc_id", text="text", payload=_payload(docs.drop("text")))
    kept = minhash.decide(rows.select("row", "doc_id", "text")).where("kept").select("row")
    columns = [F.col("text") if c == "text" else F.col(f"payload.`{c}`").alias(c) for c in docs.columns]
    return rows.join(kept, "row", "left_semi").select(*columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a passage of the benchmark."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in a sequence: doc_id, piece, n_tokens, bin, at."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None  # SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs
