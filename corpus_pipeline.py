"""From raw documents to packed sequences: STAGES are applied in order, each to what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents,
whatever they are. ``run`` writes each stage's result as Parquet under the folder that
spark.checkpoint.dir names and reads it again, so a lost executor costs a stage's tasks at most.

Defined cases: extra columns pass through; n_chars, where it is there, follows the text; rows with a null doc_id pass
all filters that judge a text alone; of near copies the smallest doc_id stays, a null one only where all are null; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dischargelab.llm import langid, line_dedup, packing, pii, simhash
from dischargelab.session import ensure_checkpoint_dir

MASKED = ("email", "ip", "card", "phone", "account")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those in which no language stands out."""
    return langid.keep_identified(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of all documents but one."""
    return _sized(line_dedup.replace_texts(docs))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return _sized(pii.mask_pii(docs, kinds=MASKED))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts token streams into pieces and lays them out in sequences."""
    return packing.pack_documents(docs, str(public_tokenizers.path(packing.MODEL)))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
# Forward-backward and the tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
