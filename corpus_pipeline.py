"""From documents to packed sequences: five stages, each over all that the one before has kept.

A stage takes (spark, docs, sf_dir), where docs has the columns of `documents`; all but the last return these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import linededup, minhash, mixing, packing, toxicity
from lodestone.llm.common import discard, stored

#: No SQL: the stages fit models, sort suffixes and walk links. tests/llm holds each against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more. Null or empty texts stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines, and documents that nothing is left of. n_chars follows the text;
    documents that lose no line stay as they are."""
    out = linededup.line_dedup(docs)
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"[\s]+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by five-word shingles and a similarity of 0.8, one row stays, that of the smallest
    doc_id. Rows that repeat a doc_id with another text are documents of their own; of those with the same text, one stays."""
    return minhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by the weights of domains, languages and sources; a document taken for more than one
    epoch comes more than once."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`. Each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if hasattr(before, "stored_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
