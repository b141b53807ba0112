"""From raw documents to encoded training rows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last keeps the columns of `documents`, in order.
Stages are written as Parquet between each other, in the shared folder that spark.checkpoint.dir names.

Decisions belong to rows and not to ids: ids that are null or repeat are rows like others in every stage. Extra columns are kept by all stages
but the last, whatever their names. An empty table goes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, jaccard, mixing, quality, secrets
from tideline.llm._common import checkpoint_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier accepts: score >= 0.7.

    Null and empty texts are scored by their (zero) statistics like any text; long texts are scored whole; equal texts, and so repeated rows, share
    one decision. Without labels of both classes all rows stay if the constant score accepts, else none.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of smallest id (a row without an id only if no row of the group has one).

    Rows that tie, by repeating an id and its text, are a group too, and one of them stays. Null and empty texts, and texts without a word, are
    groups of one row and all stay. Long texts are compared whole.
    """
    return jaccard.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with live secrets in their texts replaced by a mark. Null and empty texts stay as they are; repeated rows change alike; long texts are scanned whole."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 2 times. Rows without a word have no size and aren't taken; of rows that repeat or tie, any number may be taken."""
    return mixing.repeat(docs)


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text, of every row. A null text counts as empty: no ids, and a round trip to the empty text."""
    docs = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    encoder = bpe.Encoder(spark, docs, bpe.default_vocabulary())
    both = bpe.decode(bpe.encode(docs, encoder), encoder)
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encode_decode),
]

#: The stages aren't expressible in SQL; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
