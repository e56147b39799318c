"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir), docs having the columns of ``documents``,
and all but the last return these columns. ``run`` writes each stage's result as
Parquet to the shared folder and reads it again for the next one, so a lost
executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery.llm import bpe, decontam, minhash, rules, substring
from refinery.llm.store import saved

#: Documents less likely than this to be good are rejected.
LEAST_QUALITY = 0.5

#: Model fitting, signatures and byte-pair merges have no SQL form; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below LEAST_QUALITY go."""
    labels = _table(spark, sf_dir, "labels").where(rules.remainder(4) != 2) \
        .select("doc_id", F.col("quality").alias("label"))
    return rules.without_poor(docs, labels, threshold=LEAST_QUALITY).select(*_columns(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return minhash.deduplicate(docs, shingle=5, num=4, den=5).select(*_columns(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word sequences that occur earlier go; documents that lose all go."""
    return substring.strip_repeats(docs).select(*_columns(docs))


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(*_columns(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit numbers) of every document and the
    text they decode to."""
    return bpe.encoded(docs, *bpe.tokenizer(spark)).select(
        "doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontam_stage),
    ("byte_bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
