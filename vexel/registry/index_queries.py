"""Registered queries on the cell-partitioned index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import vectors as V
from ..operators import ivf, split, topk
from ..plans.collection import SearchParams
from ..plans.store import settle
from . import workload as W

ENTRY_BYTES = 72


def _scored(df):
    return df.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def ivf_assign_top2(spark, d):
    return W.assigned(spark, d).select("id", "slot", "cell", F.round("d2", 6).alias("d2"))


def ivf_assign_spill(spark, d):
    return ivf.spill(W.assigned(spark, d, 3), 0.05).select("id", "slot", "cell")


def _old_cells(spark, d):
    return ivf.cells(W.vectors(spark, d), W.ANCHORS[:8])


def ivf_assign_hierarchical(spark, d):
    new, old = W.cells(spark, d), _old_cells(spark, d)
    near = ivf.neighbours(old, new, 6)
    return ivf.assign_through(W.vectors(spark, d), old, near, new, W.M).select("id", "slot", "cell", F.round("d2", 6).alias("d2"))


def ivf_cell_histogram(spark, d):
    return ivf.histogram(W.assigned(spark, d), W.K, ENTRY_BYTES)


def ivf_route_topn(spark, d):
    return ivf.route(W.queries(spark, d), W.cells(spark, d), 6).select("qid", "rank", "cell", F.col("s").cast("long").alias("s"))


def ivf_adaptive_probes(spark, d):
    return ivf.adaptive_probes(ivf.route(W.queries(spark, d), W.cells(spark, d), W.K), 2, 0.8, W.K)


def ivf_byte_budget(spark, d):
    sizes = ivf.histogram(W.assigned(spark, d), W.K, ENTRY_BYTES).select("cell", (F.col("n") * ENTRY_BYTES).alias("bytes"))
    return ivf.byte_budget(ivf.route(W.queries(spark, d), W.cells(spark, d), 8), sizes, 30_000)


def _search(nprobe, where=None):
    def run(spark, d):
        entries = W.assigned(spark, d)
        if where is not None:
            entries = entries.join(W.metadata(spark, d).select("id", "meta", "nums"), "id")
        return _scored(ivf.search(W.queries(spark, d), W.vectors(spark, d), entries, W.cells(spark, d), nprobe, W.TOP, where() if where else None))

    return run


def ivf_entries_counters(spark, d):
    return ivf.entry_counters(ivf.route(W.queries(spark, d), W.cells(spark, d), 4), W.assigned(spark, d))


STEPS = (1, 2, 4, 8, 16)


def recalls(spark, d):
    """(nprobe, qid, recall) of each step; a search's scores in cells are exact, so a neighbour is found once its cell is probed."""
    truth = settle(topk.exact_top_k(W.vectors(spark, d), W.queries(spark, d), W.TOP).select("qid", "id"), "truth")
    hit = settle(ivf.first_rank(truth, ivf.route(W.queries(spark, d), W.cells(spark, d), W.K), W.assigned(spark, d)), "hits")
    parts = [ivf.recall(hit.where(F.col("rank") <= n), truth, W.TOP).withColumn("nprobe", F.lit(n)) for n in STEPS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ivf_recall_by_nprobe(spark, d):
    return recalls(spark, d).groupBy("nprobe").agg(F.round(F.avg("recall"), 6).alias("recall"))


def ivf_diagnose_losses(spark, d):
    """Losses by routing (4 cells) and by a candidate cap of 20 entries ranked by exact score."""
    truth = topk.exact_top_k(W.vectors(spark, d), W.queries(spark, d), W.TOP)
    probes = ivf.route(W.queries(spark, d), W.cells(spark, d), 4)
    entries = W.assigned(spark, d).select("id", "cell").join(W.vectors(spark, d).select("id", "v"), "id")
    kept = topk.rank(topk.scan_cells(probes, entries, W.queries(spark, d), 20, distinct=False, digits=9), 20, digits=9)
    return ivf.losses(truth, probes, W.assigned(spark, d), kept)


def index_fingerprint(spark, d):
    """SHA-256 over the canonical rows of the (bounded) cell table."""
    rows = W.cells(spark, d).select("cell", F.concat_ws(",", F.transform("q8", lambda x: x.cast("string"))).alias("t"))
    text = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "t"))), lambda x: F.concat(x.getField("cell").cast("string"), F.lit(":"), x.getField("t"))), ";").alias("t"))
    return text.select(F.sha2("t", 256).alias("fingerprint"))


def default_parameters(spark, d):
    """Default budgets and capacities by dimension, as the library gives them for an index of 100 cells."""
    rows = [(n, V.padded_dim(n), SearchParams.default(V.padded_dim(n), 100, False).nprobe, split.default_capacity(n)) for n in range(1, V.MAX_DIM + 1)]
    return spark.createDataFrame(rows, "dim int, padded int, nprobe int, capacity int")


def ivf_set_dedup(spark, d):
    """Distinct ids of multi-assigned entries, and how often each occurs."""
    w = Window.partitionBy("id")
    return W.assigned(spark, d).withColumn("times", F.count(F.lit(1)).over(w)).select("id", "times").distinct()


_P = "probed AS MATERIALIZED (SELECT qid, rank, cell FROM routed WHERE rank <= {n})"


def _search_sql(n, where="true", meta=""):
    return (
        f"WITH {W.INDEX}{', ' + meta if meta else ''}, {_P.format(n=n)}, hit AS (SELECT DISTINCT qid, a.id FROM probed JOIN assigned a USING (cell) {'JOIN meta m ON m.id = a.id' if meta else ''} WHERE {where}), "
        "s AS (SELECT qid, h.id, list_dot_product(q, u.v) AS score FROM hit h JOIN qry USING (qid) JOIN unit u ON u.id = h.id) "
        f"SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {W.TOP}"
    )


_TRUTH = f"truth AS MATERIALIZED (SELECT qid, id FROM (SELECT qid, u.id, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(q, u.v) DESC, u.id) AS k FROM qry, unit u) WHERE k <= {W.TOP})"
_HIER = (
    "old8 AS MATERIALIZED (SELECT CAST(cell AS INTEGER) AS old, v FROM anchors JOIN unit USING (id) WHERE cell < 8), "
    "otop AS (SELECT max(" + W.TOPABS.format(v="v") + ") AS t FROM old8), oq AS MATERIALIZED (SELECT old, " + W.i8("v", "t") + " AS q8 FROM old8, otop), "
    "near AS MATERIALIZED (SELECT old, cell FROM (SELECT old, cell, row_number() OVER (PARTITION BY old ORDER BY list_dot_product(CAST(oq.q8 AS DOUBLE[]), CAST(cells.q8 AS DOUBLE[])) DESC, cell) AS k FROM oq, cells) WHERE k <= 6), "
    "oa AS MATERIALIZED (SELECT id, old FROM (SELECT id, old, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(CAST(v8 AS DOUBLE[]), CAST(oq.q8 AS DOUBLE[])) DESC, old) AS k FROM v8, oq) WHERE k <= 2), "
    "cand AS (SELECT DISTINCT id, cell FROM oa JOIN near USING (old))"
)
_SIZES = f"sizes AS (SELECT cell, count(*) AS n, count(*) * {ENTRY_BYTES} AS bytes FROM assigned GROUP BY cell)"
QUERIES = {
    "ivf_assign_top2": (ivf_assign_top2, f"WITH {W.INDEX} SELECT id, slot, cell, round(d2, 6) AS d2 FROM assigned"),
    "ivf_assign_spill": (ivf_assign_spill, f"WITH {W.INDEX} SELECT id, slot, cell FROM (SELECT *, first(d2) OVER (PARTITION BY id ORDER BY slot) AS f FROM ranked WHERE slot < 3) WHERE slot = 0 OR d2 <= pow(1.05::DOUBLE, 2.0::DOUBLE) * f"),
    "ivf_assign_hierarchical": (ivf_assign_hierarchical, f"WITH {W.INDEX}, {_HIER} SELECT id, CAST(k - 1 AS INTEGER) AS slot, cell, round(d2, 6) AS d2 FROM (SELECT r.id, r.cell, r.d2, row_number() OVER (PARTITION BY r.id ORDER BY s DESC, r.cell) AS k FROM cand c JOIN ranked r ON r.id = c.id AND r.cell = c.cell) WHERE k <= 2"),
    "ivf_cell_histogram": (ivf_cell_histogram, f"WITH {W.INDEX}, {_SIZES} SELECT c.cell, coalesce(n, 0) AS n, CAST(coalesce(sum(coalesce(bytes, 0)) OVER (ORDER BY c.cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM cells c LEFT JOIN sizes USING (cell)"),
    "ivf_route_topn": (ivf_route_topn, f"WITH {W.INDEX} SELECT qid, rank, cell, s FROM routed WHERE rank <= 6"),
    "ivf_adaptive_probes": (
        ivf_adaptive_probes,
        f"WITH {W.INDEX}, g AS (SELECT a.qid, b.rank, (a.s - b.s) / greatest(abs(a.s), 1e-9) AS gap FROM routed a JOIN routed b USING (qid) WHERE a.rank = 1) "
        "SELECT qid, CAST(coalesce(min(rank) FILTER (gap >= 0.8 AND rank IN (2, 4, 8)), 16) AS INTEGER) AS probes FROM g GROUP BY qid",
    ),
    "ivf_byte_budget": (ivf_byte_budget, f"WITH {W.INDEX}, {_SIZES}, c AS (SELECT qid, rank, cell, sum(bytes) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM routed JOIN sizes USING (cell) WHERE rank <= 8), m AS (SELECT *, bool_or(rank > 1 AND cum > 30000) OVER (PARTITION BY qid) AS budget_limited FROM c) SELECT qid, rank, cell, budget_limited FROM m WHERE rank = 1 OR cum <= 30000"),
    "ivf_search_exact_cells": (_search(4), _search_sql(4)),
    "ivf_search_exhaustive": (_search(W.K), W.topk_sql("unit")),
    "ivf_search_filtered": (_search(6, lambda: M.where({"lang": ["en", "fr"]})), _search_sql(6, "lang IN ('en', 'fr')", W.META)),
    "ivf_entries_counters": (ivf_entries_counters, f"WITH {W.INDEX} SELECT qid, count(*) AS entries, count(DISTINCT id) AS distinct_ids FROM routed JOIN assigned USING (cell) WHERE rank <= 4 GROUP BY qid"),
    "ivf_recall_by_nprobe": (ivf_recall_by_nprobe, f"WITH {W.INDEX}, {_TRUTH}, h AS (SELECT qid, a.id, min(r.rank) AS rank FROM routed r JOIN assigned a USING (cell) GROUP BY ALL), p AS (SELECT nprobe, t.qid, sum(CASE WHEN h.rank <= nprobe THEN 1 ELSE 0 END) / 10.0::DOUBLE AS r FROM truth t LEFT JOIN h ON h.qid = t.qid AND h.id = t.id, (VALUES (1), (2), (4), (8), (16)) n(nprobe) GROUP BY ALL) SELECT CAST(nprobe AS INTEGER) AS nprobe, round(avg(r), 6) AS recall FROM p GROUP BY nprobe"),
    "ivf_diagnose_losses": (
        ivf_diagnose_losses,
        f"WITH {W.INDEX}, {_TRUTH}, e AS (SELECT qid, a.id, a.cell, round(list_dot_product(q, u.v), 9) AS score FROM routed r JOIN assigned a USING (cell) JOIN qry USING (qid) JOIN unit u ON u.id = a.id WHERE r.rank <= 4), "
        "k AS (SELECT DISTINCT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS n FROM e) WHERE n <= 20), ro AS (SELECT DISTINCT qid, id FROM e) "
        "SELECT t.qid, count(*) AS watched, count(ro.id) AS routed, count(k.id) AS candidates FROM truth t LEFT JOIN ro ON ro.qid = t.qid AND ro.id = t.id LEFT JOIN k ON k.qid = t.qid AND k.id = t.id GROUP BY t.qid",
    ),
    "index_fingerprint": (index_fingerprint, f"WITH {W.BASE}, {W.CELLS} SELECT sha256(string_agg(cell || ':' || array_to_string(q8, ','), ';' ORDER BY cell)) AS fingerprint FROM cells"),
    "default_parameters": (default_parameters, "SELECT CAST(d AS INTEGER) AS dim, CAST(p AS INTEGER) AS padded, CAST(least(100, greatest(1, p // 2)) AS INTEGER) AS nprobe, CAST(greatest(64, 2 * d) AS INTEGER) AS capacity FROM (SELECT d, greatest(8, CAST(pow(2, ceil(log2(d))) AS BIGINT)) AS p FROM range(1, 1025) t(d))"),
    "ivf_set_dedup": (ivf_set_dedup, f"WITH {W.INDEX} SELECT id, count(*) AS times FROM assigned GROUP BY id"),
}
