"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``, and only these: further columns, also such as are named like
those that an operator makes, are left behind by the first stage. No documents give no rows, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlake.llm import exact, jaccard, mixing, pieces, quality
from orderlake.llm.common import table
from orderlake.sources.paths import fresh

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go. A null or empty text has no words and is rejected; a very long one is judged
    whole; repeated rows are judged alike, each on its own, also with a null doc_id; nulls elsewhere don't matter."""
    return quality.reject(docs.select(*COLUMNS))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays. Null and empty texts are equal; repeated rows of one doc_id and text stay or
    go together; rows without doc_id, which can't be told apart, stay."""
    return exact.drop(docs.select(*COLUMNS))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links on five-word shingles at 0.8 connect, the smallest doc_id stays. A text without words is linked
    with none; one of fewer than five words with those of the same words; a very long one by all its shingles; rows of one
    doc_id are one document, and rows without doc_id stay."""
    return jaccard.drop(docs.select(*COLUMNS))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson count of their source's mean rate: equal rows with equal doc_id have equal counts, and a
    null source is a source of its own. Rows are dealt by a hash of doc_id and copy."""
    return mixing.mix(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy: doc_id, n_tokens, ids_sha256, decoded_sha256, n_corrected. A null text counts as empty and has the
    begin and end ids alone."""
    return pieces.digests(docs, pieces.model_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can't express the encoding; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := fresh(spark, "stage"))
            docs = spark.read.parquet(path)
    return docs
