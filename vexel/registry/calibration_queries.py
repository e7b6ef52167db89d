"""Registered queries on calibration statistics and the streaming fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import live
from ..plans import calibrate as C
from ..streaming import ingest
from . import index_queries as I
from . import workload as W


def calib_latency_summary(spark, d):
    s = C.latency_summary(W.read(spark, d, "orders"), "o_totalprice")
    return s.select(*(F.round(c, 4).alias(c) for c in ("mean", "p50", "p95")))


def calib_bernstein_bound(spark, d):
    e = W.read(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 10.0).alias("x"))
    return C.bernstein(e, "x", 0.05, ["l_returnflag"]).select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))


def calib_grid_choice(spark, d):
    """The library's choice over a grid: the configuration of least cost (its probes stand for its seconds) whose mean recall over the
    even queries reaches 0.85, validated once on the odd ones."""
    per = I.recalls(spark, d).withColumn("part", F.when((F.col("qid") / 20).cast("long") % 2 == 0, "train").otherwise("validation"))
    kept = {(r.part, r.nprobe): r.r for r in per.groupBy("part", "nprobe").agg(F.collect_list("recall").alias("r")).collect()}  # parts x steps lists
    measure = lambda part, nprobe, rerank: C.Measurement(nprobe, rerank, kept[part, nprobe], float(nprobe))
    p = C.calibrate(measure, [(n, 400) for n in I.STEPS], 0.85, "registry")
    found = {m["partition"]: m["recall"] for m in p.measurements if p.configuration and m["nprobe"] == p.configuration["nprobe"]}
    rows = [(p.configuration["nprobe"], round(found["train"], 6), round(found["validation"], 6), p.status)] if p.configuration else []
    return spark.createDataFrame(rows, "nprobe int, train double, validation double, status string")


def stream_fold_equals_batch(spark, d):
    """The log arrives through a file stream, is committed batch by batch and folded: the same state as the batch fold."""
    log, base = W.log(spark, d)
    landed = ingest.replay(spark, log)
    s = live.fold(landed, base)
    return s.vectors.join(s.deleted.select("id", F.lit(True).alias("gone")), "id", "left").select("id", "vsrc", F.coalesce("gone", F.lit(False)).alias("deleted"))


QUERIES = {
    "calib_latency_summary": (calib_latency_summary, "SELECT round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders"),
    "calib_bernstein_bound": (
        calib_bernstein_bound,
        "SELECT l_returnflag, n, round(mean, 6) AS mean, round(greatest(0.0, mean - sqrt(2 * var * ln(40.0::DOUBLE) / n) - 7 * ln(40.0::DOUBLE) / (3 * (n - 1))), 6) AS bound FROM "
        "(SELECT l_returnflag, count(*) AS n, avg(l_discount * 10.0::DOUBLE) AS mean, var_samp(l_discount * 10.0::DOUBLE) AS var FROM lineitem GROUP BY 1)",
    ),
    "calib_grid_choice": (
        calib_grid_choice,
        f"WITH {W.INDEX}, {I._TRUTH}, h AS (SELECT qid, a.id, min(r.rank) AS rank FROM routed r JOIN assigned a USING (cell) GROUP BY ALL), "
        "p AS (SELECT nprobe, (t.qid // 20) % 2 AS odd, avg(CASE WHEN h.rank <= nprobe THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM truth t LEFT JOIN h ON h.qid = t.qid AND h.id = t.id, (VALUES (1), (2), (4), (8), (16)) n(nprobe) GROUP BY ALL) "
        "SELECT CAST(a.nprobe AS INTEGER) AS nprobe, round(a.r, 6) AS train, round(b.r, 6) AS validation, CASE WHEN b.r >= 0.85 THEN 'validated' ELSE 'quality_not_validated' END AS status FROM p a JOIN p b USING (nprobe) WHERE a.odd = 0 AND b.odd = 1 AND a.r >= 0.85 ORDER BY 1 LIMIT 1",
    ),
    "stream_fold_equals_batch": (stream_fold_equals_batch, f"WITH {W.LOG} SELECT c.id, vsrc, d.id IS NOT NULL AS deleted FROM cur c LEFT JOIN deleted d USING (id)"),
}
