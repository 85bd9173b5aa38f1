"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. All but the
last return the columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm._runtime import stage
from pagequarry.llm.langid import UNDETERMINED, fit_on_documents, predict
from pagequarry.llm.line_dedup import dedup_lines
from pagequarry.llm.packing import pack
from pagequarry.llm.pii import redact
from pagequarry.llm.simhash_dedup import keep_representatives

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in one of the learned languages; those without a letter or text go."""
    found = predict(docs.select(*COLUMNS), fit_on_documents(docs))
    return found.filter(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated lines; a document of which no letter or digit is left goes."""
    left = dedup_lines(docs.select(*COLUMNS), whole=True)
    return _recounted(left.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group of near copies by five-word shingles."""
    return keep_representatives(docs.select(*COLUMNS), shingle=5)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return _recounted(redact(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    import public_tokenizers

    return pack(docs, path or public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: SQL cannot express the learned and hashed stages; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
