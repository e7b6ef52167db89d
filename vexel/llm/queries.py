"""The registered queries of this subpackage: thin digests over the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, embeddings, langid, pii, secrets, simhash, substrings, token_counts, urls
from .common import read, shared_dir, write_table


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, where=langid.learnable("doc_id"))
    held_out = F.coalesce(~langid.learnable("doc_id"), F.lit(False)).alias("held_out")
    out = langid.predict(docs, model, extra=(held_out,))
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: one row for each document and benchmark item in it."""
    out = decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(read(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]
    return out.select(
        F.col("id").alias("doc_id"),
        *(F.size(pii.only(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(pii.span_text(pii.only(F.col("spans"), *base)), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_string("%.1f", s.getField("score"))), ",").alias("scores"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: word counts and byte counts come in, toxic documents go, documents of low quality
    are recounted by words that hold a letter or digit; the last batch arrives twice."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    text = F.col("text")
    counts = docs.select("doc_id", "source", "lang", token_counts.word_count(text).alias("words"), token_counts.byte_count(text).alias("bytes"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*")), F.lit(0)).cast("long").alias("real"))
    counts = write_table(counts, "token-counts")
    marked = counts.join(marks, "doc_id")
    roll = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    ops = token_counts.operations
    roll.commit(1, ops(counts, "insert", "words-1", F.col("words")))
    roll.commit(2, ops(counts, "insert", "bytes-1", F.col("bytes")))
    gone = marked.where("toxic = 1")
    roll.commit(3, ops(gone, "delete", "words-1", F.lit(0)).unionAll(ops(gone, "delete", "bytes-1", F.lit(0))))
    last = ops(marked.where("quality = 0"), "revise", "words-1", F.col("real"))
    roll.commit(4, last)
    roll.commit(4, last)
    return roll.totals()


OP8_SQL = r"""
WITH m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words, coalesce(strlen(text), 0) AS bytes,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*')), 0) AS real
  FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, source DESC NULLS LAST, lang DESC NULLS LAST) = 1),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bytes DESC, source DESC NULLS LAST, lang DESC NULLS LAST) = 1),
r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY real DESC, source DESC NULLS LAST, lang DESC NULLS LAST) = 1),
c AS (
  SELECT CASE WHEN m.quality = 0 THEN coalesce(r.source, w.source) ELSE w.source END AS source, CASE WHEN m.quality = 0 THEN coalesce(r.lang, w.lang) ELSE w.lang END AS lang,
         'words-1' AS tokenizer, CASE WHEN m.quality = 0 THEN r.real ELSE w.words END AS n
  FROM w JOIN r USING (doc_id) LEFT JOIN m USING (doc_id) WHERE coalesce(m.toxic, 0) <> 1
  UNION ALL
  SELECT b.source, b.lang, 'bytes-1', b.bytes FROM b LEFT JOIN m USING (doc_id) WHERE coalesce(m.toxic, 0) <> 1)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_langid": op1_langid,
        "op2_decontam": op2_decontam,
        "op3_substrings": op3_substrings,
        "op4_pii": op4_pii,
        "op5_bpe": op5_bpe,
        "op6_embeddings": op6_embeddings,
        "op7_urls": op7_urls,
        "op8_token_counts": op8_token_counts,
        "op9_simhash": op9_simhash,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_urls": urls.SQL, "op8_token_counts": OP8_SQL}
