"""From raw documents to token ids, stage by stage.

Each stage takes the documents that the one before kept, written and reread, and
returns the columns of documents, the last one with the token ids added:

1. quality rules: documents that fail, or go with their host, are dropped;
2. MinHash near-dedup (five words, similarity 0.8): the document with the
   smallest id of each group stays;
3. benchmark decontamination: documents with a benchmark passage are dropped;
4. secret scans: secrets are replaced in the text, and n_chars follows;
5. SentencePiece: ``ids`` and ``n_tokens`` of each document.

The benchmark table is read beside the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, near_dedup, quality_rules, secret_scan, sentence_pieces
from corpusmill.llm.common import table
from corpusmill.session import work_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs, length="n_chars")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = sentence_pieces.encoded(docs, MODEL)
    return found.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("token ids", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared
    folder and reread by the next."""
    docs, folder = table(spark, sf_dir, "documents"), work_folder(spark)
    for number, (_, stage) in enumerate(STAGES, 1):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs


#: Near-duplicate components and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None
