"""Frames and SQL text shared by the registered queries.

Vectors are ``embeddings``, queries the rows whose vec_id is divisible by 20, metadata comes from ``documents`` and ``labels`` by id, and
the mutation log from all ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ivf

DIM, K, SEED, M, TOP = 64, 16, 52, 2, 10
#: The query set: every row whose id is divisible by 20.
IS_QUERY = "id % 20 = 0"
#: Cells are drawn from the first 500 vectors, which every scale has.
ANCHORS = ivf.anchor_ids(500, K, SEED)
SIGNS = V.signs(DIM, SEED)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles("embedding").alias("v"), "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(IS_QUERY).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.cells(vectors(spark, sf_dir), ANCHORS)


def assigned(spark: SparkSession, sf_dir: str, m: int = M) -> DataFrame:
    return ivf.assign(vectors(spark, sf_dir), cells(spark, sf_dir), m)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, lang, source, n_chars, quality, toxic, meta, nums): canonical metadata of each vector."""
    v = vectors(spark, sf_dir)
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    m = v.join(d, "id", "left").join(lab, "id", "left")
    strings = {"lang": F.array("lang"), "source": F.array("source"), "rank": F.array(F.col("n_chars").cast("string")), "both": F.array("lang", "source"), "toxic": F.array(F.when(F.col("toxic") == 1, "true").otherwise("false"))}
    has = {"lang": "lang", "source": "lang", "rank": "n_chars", "both": "lang", "toxic": "toxic"}
    entries = [F.struct(F.lit(k).alias("key"), F.when(F.col(has[k]).isNotNull(), x).alias("value")) for k, x in strings.items()]
    meta = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.getField("value").isNotNull()))
    nums = F.map_from_entries(F.filter(F.array(F.struct(F.lit("rank").alias("key"), F.when(F.col("n_chars").isNotNull(), F.array(F.col("n_chars").cast("long"))).alias("value"))), lambda e: e.getField("value").isNotNull()))
    return m.withColumns({"meta": meta, "nums": nums})


def log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(log, base): the mutation log that all events make over N vectors, of which four fifths exist before it. One error in 64 deletes,
    the others update; users are the tokens of inserts."""
    n = vectors(spark, sf_dir).count()
    op = F.create_map(*(F.lit(x) for p in (("signup", "insert"), ("purchase", "update"), ("view", "set_metadata"), ("click", "add_metadata"), ("error", "update")) for x in p))
    op = F.when((F.col("event_type") == "error") & (F.col("event_id") % 64 == 0), "delete").otherwise(op[F.col("event_type")])
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), ((F.col("event_id") * 7) % n).alias("id"), (F.col("event_id") % n).alias("vsrc"), F.concat(F.lit("k"), (F.col("event_id") % 6).cast("string")).alias("tag"), F.col("user_id").cast("string").alias("token"), (F.col("event_id") % 2).cast("string").alias("digest"))
    base = vectors(spark, sf_dir).where(F.col("id") < n * 4 // 5).select("id", F.col("id").alias("vsrc"))
    return rows, base


# ---- SQL ----

VEC = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
UNIT = "SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vec"
QRY = f"SELECT id AS qid, v AS q FROM unit WHERE {IS_QUERY}"
#: unit vectors and queries
BASE = f"vec AS ({VEC}), unit AS MATERIALIZED ({UNIT}), qry AS MATERIALIZED ({QRY})"
I8 = "list_transform({v}, lambda x: CAST(round_even(x * (127.0::DOUBLE / ({top} + 1e-9::DOUBLE)), 0) AS INTEGER))"
TOPABS = "list_max(list_transform({v}, lambda y: abs(y)))"


def i8(v: str, top: str | None = None) -> str:
    return I8.format(v=v, top=top or TOPABS.format(v=v))


#: cells(cell, v, q8, top)
CELLS = (
    "anchors(cell, id) AS (VALUES " + ", ".join(f"({i}, {a})" for i, a in enumerate(ANCHORS)) + "), "
    "atop AS MATERIALIZED (SELECT max(" + TOPABS.format(v="v") + ") AS top FROM anchors JOIN unit USING (id)), "
    "cells AS MATERIALIZED (SELECT CAST(cell AS INTEGER) AS cell, v, " + i8("v", "top") + " AS q8, top FROM anchors JOIN unit USING (id), atop)"
)
#: ranked(id, slot, cell, s, d2) of all cells
ASSIGN = (
    "v8 AS MATERIALIZED (SELECT id, v, " + i8("v") + " AS v8, 127.0::DOUBLE / (" + TOPABS.format(v="v") + " + 1e-9::DOUBLE) AS vq FROM unit), "
    "allpairs AS MATERIALIZED (SELECT id, cell, CAST(list_dot_product(CAST(v8 AS DOUBLE[]), CAST(q8 AS DOUBLE[])) AS BIGINT) AS s, vq, 127.0::DOUBLE / (top + 1e-9::DOUBLE) AS aq FROM v8, cells), "
    "ranked AS MATERIALIZED (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, cell) - 1 AS INTEGER) AS slot, cell, s, 2.0 - 2.0 * s / (vq * aq) AS d2 FROM allpairs), "
    f"assigned AS MATERIALIZED (SELECT * FROM ranked WHERE slot < {M})"
)
#: routed(qid, rank, cell, s) of all cells
ROUTE = (
    "routed AS MATERIALIZED (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, cell) AS INTEGER) AS rank, cell, s FROM "
    "(SELECT id AS qid, cell, s FROM ranked WHERE " + IS_QUERY + "))"
)
INDEX = f"{BASE}, {CELLS}, {ASSIGN}, {ROUTE}"
SG = "[" + ", ".join(f"{s}.0::DOUBLE" for s in SIGNS) + "]"


def rotated_sql(v: str) -> str:
    signed = f"list_transform(range({DIM}), lambda i: {v}[i + 1] * {SG}[i + 1])"
    return f"list_transform(range({DIM}), lambda i: list_sum(list_transform(range({DIM}), lambda j: CASE WHEN bit_count(i & j) % 2 = 0 THEN sv[j + 1] ELSE -sv[j + 1] END)) / sqrt({DIM}::DOUBLE))", signed


_rot, _signed = rotated_sql("v")
#: rot(id, r) of all vectors
ROT = f"signed AS MATERIALIZED (SELECT id, {_signed} AS sv FROM unit), rot AS MATERIALIZED (SELECT id, {_rot} AS r FROM signed)"
META = (
    "meta AS MATERIALIZED (SELECT u.id, u.v, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM unit u "
    "LEFT JOIN documents d ON d.doc_id = u.id LEFT JOIN labels l ON l.doc_id = u.id)"
)


def topk_sql(source: str, where: str = "true", k: int = TOP, ctes: str = "") -> str:
    return (
        f"WITH {BASE}{', ' + ctes if ctes else ''} SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM ("
        f"SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, x.id, list_dot_product(q, x.v) AS score FROM qry, {source} x WHERE {where})) WHERE rank <= {k}"
    )


#: log(seq, op, id, vsrc, tag, token, digest), base_n and the fold
LOG = """
n AS (SELECT count(*) AS n FROM embeddings),
log AS MATERIALIZED (SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'view' THEN 'set_metadata' WHEN event_type = 'click' THEN 'add_metadata' WHEN event_type = 'error' AND event_id % 64 = 0 THEN 'delete' ELSE 'update' END AS op,
  (event_id * 7) % n AS id, event_id % n AS vsrc, 'k' || (event_id % 6) AS tag, CAST(user_id AS VARCHAR) AS token, CAST(event_id % 2 AS VARCHAR) AS digest FROM events, n),
bn AS (SELECT n * 4 // 5 AS base_n FROM n),
ins0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY token ORDER BY seq) AS k, first(digest) OVER (PARTITION BY token ORDER BY seq) AS d0 FROM log WHERE op = 'insert'),
ins AS MATERIALIZED (SELECT seq, base_n + row_number() OVER (ORDER BY seq) - 1 AS id, vsrc, tag, token FROM ins0, bn WHERE k = 1),
born AS MATERIALIZED (SELECT vec_id AS id, -1 AS seq, vec_id AS vsrc, CAST(NULL AS VARCHAR) AS tag FROM embeddings, bn WHERE vec_id < base_n UNION ALL SELECT id, seq, vsrc, tag FROM ins),
known AS MATERIALIZED (SELECT l.*, coalesce(b.seq < l.seq, false) AS ex FROM log l LEFT JOIN born b ON b.id = l.id WHERE l.op <> 'insert'),
deleted AS MATERIALIZED (SELECT id, min(seq) AS ds FROM known WHERE op = 'delete' AND ex GROUP BY id),
st AS MATERIALIZED (SELECT k.*, ex AND (op = 'delete' OR ds IS NULL OR k.seq < ds) AS ok FROM known k LEFT JOIN deleted d ON d.id = k.id),
changes AS MATERIALIZED (SELECT seq, 'born' AS op, id, vsrc, tag FROM born UNION ALL SELECT seq, op, id, vsrc, tag FROM st WHERE ok),
cur AS MATERIALIZED (SELECT id, arg_max(vsrc, seq) AS vsrc FROM changes WHERE op IN ('born', 'update') GROUP BY id),
rs AS (SELECT id, max(seq) AS r FROM changes WHERE op IN ('born', 'update', 'set_metadata') GROUP BY id),
tags AS MATERIALIZED (SELECT DISTINCT c.id, c.tag FROM changes c JOIN rs USING (id) WHERE op <> 'delete' AND c.tag IS NOT NULL AND c.seq >= r)
"""
