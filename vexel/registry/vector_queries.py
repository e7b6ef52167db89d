"""Registered queries on vectors, rotation and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import vectors as V
from ..operators import ivf, residual, topk, transform
from . import workload as W


def _unit(spark: SparkSession, d: str) -> DataFrame:
    return W.vectors(spark, d).select("id", V.unit(F.col("v")).alias("v"))


def _rotated(spark: SparkSession, d: str) -> DataFrame:
    return V.with_rotated(_unit(spark, d), "v", "r", W.SEED)


def _scales(spark: SparkSession, d: str, bits: int) -> DataFrame:
    """One row: the scale of every dimension, in order."""
    s = C.tq_scale(_rotated(spark, d), bits)
    return s.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "scale"))), lambda x: x.getField("scale")).alias("scale"))


def vec_scan_profile(spark, d):
    v = W.vectors(spark, d).select("v", V.is_valid(F.col("v"), W.DIM).alias("ok"), V.norm(F.col("v")).alias("n"))
    return v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("valid"), F.min(F.size("v")).alias("dim"), F.round(F.max(F.abs(F.col("n") - 1)), 3).alias("off"))


def vec_normalize(spark, d):
    u = V.unit(F.transform("v", lambda x: x * 3.0))
    return W.vectors(spark, d).select("id", F.round(V.norm(u), 9).alias("norm"), F.round(u[0], 6).alias("x0"))


def vec_pad(spark, d):
    p = V.pad(F.slice("v", 1, 50), V.padded_dim(50))
    return W.vectors(spark, d).select("id", F.size(p).cast("long").alias("n"), F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), p[63].alias("last"))


def vec_dot_pairs(spark, d):
    """Each query against all vectors; the queries are a matrix in every task."""
    return topk.all_scores(W.vectors(spark, d), W.queries(spark, d)).select("qid", "id", F.round("score", 6).alias("s"))


def vec_quantize_i8(spark, d):
    return _unit(spark, d).select("id", F.posexplode(V.quantize_i8(F.col("v"))).alias("d", "q"))


def vec_dot_i8(spark, d):
    q = _unit(spark, d).select("id", V.quantize_i8(F.col("v")).alias("v"))
    return topk.all_scores(q, q.where(W.IS_QUERY).select(F.col("id").alias("qid"), F.col("v").alias("q"))).select("qid", "id", F.col("score").cast("long").alias("s"))


def vec_rotate_seeded(spark, d):
    return _rotated(spark, d).select("id", F.posexplode("r").alias("d", "x")).select("id", "d", F.round("x", 6).alias("x"))


def tq_scale(spark, d):
    return C.tq_scale(_rotated(spark, d), 4).select("d", F.round("scale", 6).alias("scale"))


def _tq_encode(bits: int):
    def run(spark, d):
        s = _rotated(spark, d).crossJoin(F.broadcast(_scales(spark, d, bits)))
        return s.select("id", F.posexplode(C.tq_encode(F.col("r"), F.col("scale"), bits)).alias("d", "code"))

    return run


def _tq_score(bits: int):
    def run(spark, d):
        v = W.vectors(spark, d)
        scale = transform.scales(v, bits, W.SEED, W.DIM)
        codes = transform.encode(v.select("id", F.lit(0).alias("cell")), v, scale, bits, W.SEED, W.DIM)
        best = transform.candidates(codes, W.queries(spark, d), scale, bits, W.SEED, W.DIM, 50)
        return topk.rank(best, 50).select("qid", "rank", "id", F.round("score", 6).alias("score"))

    return run


def tq_prefix_topk(spark, d):
    """The pass over a prefix of the dimensions, with small bounds: of each query the best entries by the first 32 of 64 dimensions, then
    the best of these by all."""
    v, keep = W.vectors(spark, d), 120
    scale = transform.scales(v, 4, W.SEED, W.DIM)
    codes = transform.encode(v.select("id", F.lit(0).alias("cell")), v, scale, 4, W.SEED, W.DIM)
    best = transform.candidates(codes, W.queries(spark, d), scale, 4, W.SEED, W.DIM, 20, keep=keep, prefix=32)
    return topk.rank(best, 20).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def _residual(spark, d) -> DataFrame:
    """(cell, id, e): residual codes of both assignments, each against its cell's unit int8 centre."""
    cells = V.with_rotated(W.cells(spark, d).select("cell", V.unit(V.doubles("q8")).alias("a")), "a", "ar", W.SEED)
    rows = W.assigned(spark, d).join(_rotated(spark, d), "id").join(cells, "cell")
    return rows.select("cell", "id", "a", "ar", C.residual_encode(F.col("v"), F.col("r"), F.col("a"), F.col("ar"), W.DIM).alias("e"))


def residual_encode(spark, d):
    return _residual(spark, d).select("cell", "id", F.round("e.beta", 6).alias("beta"), F.round("e.gain", 6).alias("gain"), F.aggregate("e.code", F.lit(0), lambda s, x: s + x).cast("long").alias("total"))


def residual_score_topk(spark, d):
    """Routing to 8 cells, residual scores, 2 x 50 entries, then 50 distinct ids: the kernels that collections use."""
    cells, v, q = W.cells(spark, d), W.vectors(spark, d), W.queries(spark, d)
    codes = residual.encode(W.assigned(spark, d), v, cells, W.SEED, W.DIM)
    return residual.candidates(ivf.route(q, cells, 8), codes, q, cells, W.SEED, W.DIM, 50, W.M).select("qid", "id", F.round("score", 6).alias("score"))


_TQ = {b: f"list_transform(range({W.DIM}), lambda i: " + ("CASE WHEN r[i + 1] >= 0 THEN 1 ELSE 0 END" if b == 1 else f"greatest({-(1 << (b - 1))}, least({(1 << (b - 1)) - 1}, CAST(round_even(r[i + 1] * scale[i + 1], 0) AS INTEGER)))") + ")" for b in (1, 2, 4)}


def _scale_cte(bits: int) -> str:
    return (
        f"sc AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS d, {(1 << (bits - 1)) - 1 + 0.5}::DOUBLE / (3.0::DOUBLE * 1.2533::DOUBLE * avg(abs(r[i + 1])) + 1e-9::DOUBLE) AS scale FROM rot, range({W.DIM}) t(i) WHERE id % 64 = 0 GROUP BY i), "
        "scs AS MATERIALIZED (SELECT list(scale ORDER BY d) AS scale FROM sc)"
    )


def _tq_sql(bits: int) -> str:
    return f"WITH {W.BASE}, {W.ROT}, {_scale_cte(bits)}, c AS (SELECT id, {_TQ[bits]} AS code FROM rot, scs) SELECT id, CAST(i AS INTEGER) AS d, CAST(code[i + 1] AS INTEGER) AS code FROM c, range({W.DIM}) t(i)"


def _tq_score_sql(bits: int) -> str:
    if bits == 1:
        score = "CAST(list_dot_product(CAST(code AS DOUBLE[]), CAST(q8 AS DOUBLE[])) AS DOUBLE)"
    else:
        score = f"list_sum(list_transform(range({W.DIM}), lambda i: q[i + 1] * (code[i + 1] / scale[i + 1]) - 0.5::DOUBLE * (code[i + 1] / scale[i + 1]) * (code[i + 1] / scale[i + 1])))"
    return (
        f"WITH {W.BASE}, {W.ROT}, {_scale_cte(bits)}, c AS MATERIALIZED (SELECT id, scale, {_TQ[bits]} AS code FROM rot, scs), "
        f"rq AS MATERIALIZED (SELECT id AS qid, r AS q, {W.i8('r')} AS q8 FROM rot WHERE {W.IS_QUERY}), s AS (SELECT qid, id, round({score}, 9) AS score FROM c, rq) "
        "SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 50"
    )


def _part_score(n: int) -> str:
    return f"round(list_sum(list_transform(range({n}), lambda i: q[i + 1] * (code[i + 1] / scale[i + 1]) - 0.5::DOUBLE * (code[i + 1] / scale[i + 1]) * (code[i + 1] / scale[i + 1]))), 9)"


_PREFIX_SQL = (
    f"WITH {W.BASE}, {W.ROT}, {_scale_cte(4)}, c AS MATERIALIZED (SELECT id, scale, {_TQ[4]} AS code FROM rot, scs), rq AS MATERIALIZED (SELECT id AS qid, r AS q FROM rot WHERE {W.IS_QUERY}), "
    f"p AS MATERIALIZED (SELECT qid, id, {_part_score(32)} AS prefix, {_part_score(64)} AS score FROM c, rq), kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY prefix DESC, id) AS n FROM p) "
    "SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM kept WHERE n <= 120) WHERE rank <= 20"
)

_RESIDUAL_SQL = f"""
cu AS MATERIALIZED (SELECT cell, list_transform(CAST(q8 AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(q8 AS DOUBLE[]), CAST(q8 AS DOUBLE[])))) AS v FROM cells),
cs AS MATERIALIZED (SELECT cell, v AS a, {W._signed} AS sv FROM cu),
ca AS MATERIALIZED (SELECT cell, a, {W._rot} AS ar FROM cs),
b AS MATERIALIZED (SELECT s.cell, s.id, list_dot_product(u.v, ca.a) AS beta, r, ar FROM assigned s JOIN unit u USING (id) JOIN rot USING (id) JOIN ca USING (cell)),
w AS MATERIALIZED (SELECT cell, id, beta, list_transform(range({W.DIM}), lambda i: r[i + 1] - beta * ar[i + 1]) AS w FROM b),
wm AS MATERIALIZED (SELECT *, greatest({W.TOPABS.format(v='w')}, 1e-30::DOUBLE) AS mx FROM w),
u4 AS MATERIALIZED (SELECT cell, id, beta, w, list_transform(w, lambda x: greatest(0, least(15, CAST(round_even((x / mx + 1) * 15.0::DOUBLE * 0.5::DOUBLE, 0) AS INTEGER)))) AS code FROM wm),
res AS MATERIALIZED (SELECT cell, id, beta, code, list_dot_product(w, w) / greatest(list_sum(list_transform(range({W.DIM}), lambda i: w[i + 1] * (code[i + 1] * 2 - 15))), 1e-20::DOUBLE) AS gain FROM u4)"""

_RESIDUAL_SCORE_SQL = f"""
rq AS MATERIALIZED (SELECT p.qid, p.cell, list_dot_product(q.q, ca.a) AS qa, rr.r, ca.ar FROM routed p JOIN qry q USING (qid) JOIN rot rr ON rr.id = p.qid JOIN ca USING (cell) WHERE p.rank <= 8),
rw AS MATERIALIZED (SELECT qid, cell, qa, list_transform(range({W.DIM}), lambda i: r[i + 1] - qa * ar[i + 1]) AS w FROM rq),
rm AS MATERIALIZED (SELECT *, {W.TOPABS.format(v='w')} AS mx FROM rw),
r8 AS MATERIALIZED (SELECT qid, cell, qa, mx / 127.0::DOUBLE AS qs, list_transform(w, lambda x: CAST(round_even(x / (mx + 1e-9::DOUBLE) * 127.0::DOUBLE, 0) AS INTEGER)) AS q8 FROM rm),
sc AS (SELECT qid, id, round(list_dot_product(list_transform(code, lambda u: (u * 2 - 15)::DOUBLE), CAST(q8 AS DOUBLE[])) * qs * gain + beta * qa, 9) AS score FROM r8 JOIN res USING (cell)),
capped AS (SELECT qid, id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM sc) WHERE k <= 100 GROUP BY qid, id)
SELECT qid, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS k FROM capped) WHERE k <= 50"""

_U = f"WITH {W.BASE} "
QUERIES = {
    "vec_scan_profile": (vec_scan_profile, f"WITH vec AS ({W.VEC}) SELECT count(*) AS n, CAST(sum(CASE WHEN len(v) = {W.DIM} AND list_bool_and(list_transform(v, lambda x: isfinite(x))) THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(min(len(v)) AS INTEGER) AS dim, round(max(abs(sqrt(list_dot_product(v, v)) - 1)), 3) AS off FROM vec"),
    "vec_normalize": (vec_normalize, f"WITH vec AS ({W.VEC}), t AS (SELECT id, list_transform(v, lambda x: x * 3.0::DOUBLE) AS v FROM vec), u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM t) SELECT id, round(sqrt(list_dot_product(v, v)), 9) AS norm, round(v[1], 6) AS x0 FROM u"),
    "vec_pad": (vec_pad, f"WITH vec AS ({W.VEC}), p AS (SELECT id, list_concat(v[1:50], list_transform(range(14), lambda i: 0.0::DOUBLE)) AS p FROM vec) SELECT id, len(p) AS n, round(list_sum(p), 6) AS total, p[64] AS last FROM p"),
    "vec_dot_pairs": (vec_dot_pairs, f"WITH vec AS ({W.VEC}) SELECT a.id AS qid, b.id, round(list_dot_product(a.v, b.v), 6) AS s FROM vec a, vec b WHERE a.{W.IS_QUERY}"),
    "vec_quantize_i8": (vec_quantize_i8, f"{_U}SELECT id, CAST(i AS INTEGER) AS d, q[i + 1] AS q FROM (SELECT id, {W.i8('v')} AS q FROM unit), range({W.DIM}) t(i)"),
    "vec_dot_i8": (vec_dot_i8, f"{_U}, q8 AS MATERIALIZED (SELECT id, CAST({W.i8('v')} AS DOUBLE[]) AS q FROM unit) SELECT a.id AS qid, b.id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS s FROM q8 a, q8 b WHERE a.{W.IS_QUERY}"),
    "vec_rotate_seeded": (vec_rotate_seeded, f"WITH {W.BASE}, {W.ROT} SELECT id, CAST(i AS INTEGER) AS d, round(r[i + 1], 6) AS x FROM rot, range({W.DIM}) t(i)"),
    "tq_scale": (tq_scale, f"WITH {W.BASE}, {W.ROT}, {_scale_cte(4)} SELECT d, round(scale, 6) AS scale FROM sc"),
    **{f"tq{b}_encode": (_tq_encode(b), _tq_sql(b)) for b in (1, 2, 4)},
    **{f"tq{b}_score_topk": (_tq_score(b), _tq_score_sql(b)) for b in (1, 2, 4)},
    "tq_prefix_topk": (tq_prefix_topk, _PREFIX_SQL),
    "residual_encode": (residual_encode, f"WITH {W.INDEX}, {W.ROT}, {_RESIDUAL_SQL} SELECT cell, id, round(beta, 6) AS beta, round(gain, 6) AS gain, CAST(list_sum(code) AS BIGINT) AS total FROM res"),
    "residual_score_topk": (residual_score_topk, f"WITH {W.INDEX}, {W.ROT}, {_RESIDUAL_SQL}, {_RESIDUAL_SCORE_SQL}"),
}
