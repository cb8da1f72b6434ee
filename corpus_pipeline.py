"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import common, decontam, langid, neardup, packing, secrets


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those without a letter go.  Profiles are learned from docs."""
    common.small_batches(spark)
    profiles = langid.learn(docs, "true")
    clashing = [c for c in docs.columns if c in ("lang_pred", "score")]
    own = dict(zip(clashing, common.unused([*docs.columns, "lang_pred", "score"], *clashing)))
    found = langid.identify(docs.withColumnsRenamed(own), profiles, keep_text=True).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, judged by id and text: the smallest id's."""
    common.small_batches(spark)
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is without a copy, edited or not, of a benchmark item."""
    common.small_batches(spark)
    found = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    doc_id, version, version_of = common.unused(docs.columns, "gone", "version", "version_of")
    gone = common.materialize(found.select(F.col("doc_id").alias(doc_id), F.col("version").alias(version)).distinct(), "gone")
    keyed = docs.withColumn(version_of, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.col(version_of) == F.col(version))
    return keyed.join(common.narrow(gone), same, "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their text replaced by a mark; n_chars is the new length."""
    common.small_batches(spark)
    clean = secrets.redact(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    common.small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Tokenisation is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
