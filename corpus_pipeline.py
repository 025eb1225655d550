"""A training-corpus pipeline: quality, toxicity, near-dedup, personal data, packing. Each stage's rows are written and reread.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. The classifiers
learn from the labels table joined with the stage's own documents. Packing returns one row per piece.

Defined cases: null and empty texts are documents like others: both classifiers score them, equal ones (null as empty) are
near copies of each other, masking leaves them, and packing gives their end id. Very long texts are read whole. Repeated
rows are scored alike and become one in near-dedup; ties there go to the row that the table holds first. An empty table
gives no rows at any stage; labels that don't hold both kinds let a classifier keep every document. Extra columns pass
through to near-dedup and masking, whatever their names; packing leaves doc_id alone of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import near_dups, packing, pii, quality, toxicity
from riskweave.llm.base import drop_stored, stored, table, unused


def same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose combined chance of being good is a half or more."""
    model, out = quality.fit(docs, table(spark, sf_dir, "labels")), unused(docs, "quality_score")
    return same_columns(quality.score(docs, model, out).where(F.col(out) >= 0.5), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is under a half."""
    model, out = toxicity.fit(docs, table(spark, sf_dir, "labels")), unused(docs, "toxicity_score")
    return same_columns(toxicity.score(docs, model, out).where(F.col(out) < 0.5), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dups.keep_one(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the name of its kind in place of each piece of personal data; n_chars follows the text."""
    out = unused(docs, "pii_spans")
    masked = pii.find_pii(docs, mask=True, out=out)
    length = F.when(F.size(out) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return same_columns(masked.withColumn("n_chars", length), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pieces_of(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal),
    ("packing", pack),
]

#: Learned classifiers, signatures and tokenisers are beyond SQL; tests/llm derives the rows of run() without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)
