"""A training-corpus pipeline over ``documents``: language ID, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads again
as the next stage's input. All stages but the last return the columns of ``documents``.

Defined results in every stage: an empty table gives an empty one; texts are taken whole, however long; rows with null ids are judged by
their texts like any others, but only ``language`` removes a row for its null text. Extra columns stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import bpe, decontam, langid, secrets, simhash
from vexel.llm.common import read, write_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; ``lang`` stays as it is.

    Null texts and texts without a letter are rejected. The model learns from rows with a language and an id; without any, all rows go.
    Equal texts share one verdict, so repeated rows stay or go together.
    """
    return langid.keep_known(docs, langid.train(docs, where=langid.learnable("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are 0.8 similar or more, the one with the least doc_id stays.

    Ties of doc_id go to the lesser text hash; of rows that repeat id and text one stays. Blank texts and null ids stay.
    """
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with up to 5 % of edits, go. Null texts and an empty benchmark remove nothing; repeated rows go together."""
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text and ``n_chars`` is renewed. All rows stay; null texts stay null."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256): the encoded corpus, a row for each row. A null text has no tokens."""
    return bpe.encode(docs, extra=("lang", "source")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("hide_secrets", hide_secrets),
    ("tokenize", tokenize),
]

#: SQL has no counterpart of nearest centroids, SimHash and BPE: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
