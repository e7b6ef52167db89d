"""Registered queries on the mutation log and the live tier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import ivf, live, split, topk
from ..plans.store import settle
from . import workload as W


def _folded(spark, d):
    return live.fold(*W.log(spark, d))


def live_fold_state(spark, d):
    s = _folded(spark, d)
    return s.vectors.join(s.deleted.select("id", F.lit(True).alias("gone")), "id", "left").select("id", "vsrc", F.coalesce("gone", F.lit(False)).alias("deleted"))


def live_rejected_ops(spark, d):
    return _folded(spark, d).rejected


def live_idempotent_ids(spark, d):
    return _folded(spark, d).inserts.where("outcome <> 'conflict'").select("seq", "token", "outcome", "id")


def live_idempotency_conflicts(spark, d):
    return _folded(spark, d).inserts.where("outcome = 'conflict'").select("seq", "token", "digest")


def live_insert_ids(spark, d):
    return _folded(spark, d).born.where("seq >= 0").select("id", "seq")


def live_tags_after_fold(spark, d):
    return _folded(spark, d).tags


def live_stats(spark, d):
    return live.stats(_folded(spark, d))


def live_add_bulk(spark, d):
    """Bulk additions: each add row names three ids; one unknown or deleted id rejects the whole row."""
    log, base = W.log(spark, d)
    n = W.vectors(spark, d).count()
    s = live.fold(log, base)
    bulk = log.where("op = 'add_metadata'").withColumn("ids", F.array(F.col("id"), (F.col("id") + 1) % n, (F.col("id") + 2) % n))
    return live.add_all_or_nothing(bulk, s.born, s.deleted.select("id", "seq")).distinct()


def _tiers(spark, d):
    """(frozen, live): frozen vectors that are neither overridden nor deleted; live ones by their newest vector."""
    s, v = _folded(spark, d), W.vectors(spark, d)
    now = settle(live.visible(s), "visible")  # both tiers and all searches read the fold once
    base = v.where(F.col("id") < v.count() * 4 // 5).select("id")
    same = now.where("id = vsrc").join(base, "id", "left_semi")
    frozen = same.join(v.select("id", "v"), "id").select("id", "v")
    moved = now.join(same.select("id"), "id", "left_anti").join(v.select(F.col("id").alias("vsrc"), "v"), "vsrc").select("id", "v")
    return frozen, moved


def live_merge_topk(spark, d):
    frozen, moved = _tiers(spark, d)
    q = W.queries(spark, d)
    parts = [topk.exact_top_k(t, q, W.TOP) for t in (frozen, moved)]
    return topk.rank(live.merge(*parts), W.TOP, digits=topk.DIGITS).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def live_tail_search(spark, d):
    """A packed prefix of the live vectors is searched by cells (all of them), the tail exactly; the merge equals the exact result."""
    frozen, moved = _tiers(spark, d)
    q, packed, tail = W.queries(spark, d), moved.where("id % 2 = 0"), moved.where("id % 2 = 1")
    cells = W.cells(spark, d)
    by_cells = ivf.search(q, packed, ivf.assign(packed, cells, W.M), cells, W.K, W.TOP)
    out = live.merge(topk.exact_top_k(frozen, q, W.TOP), by_cells, topk.exact_top_k(tail, q, W.TOP))
    return topk.rank(out, W.TOP, digits=topk.DIGITS).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def live_compact_equivalence(spark, d):
    """The folded state, written as a new base and folded with an empty log, gives the same results."""
    now = live.visible(_folded(spark, d)).join(W.vectors(spark, d).select(F.col("id").alias("vsrc"), "v"), "vsrc").select("id", "v")
    base = settle(now, "base")
    again = live.visible(live.fold(W.log(spark, d)[0].limit(0), base.select("id", F.col("id").alias("vsrc"))))
    return topk.exact_top_k(again.join(base, "id").select("id", "v"), W.queries(spark, d), W.TOP).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def live_route_top2(spark, d):
    """Live routing: int8 product over the length of the centre, the best two cells; the kernel that collections use."""
    rows = ivf.cells(W.vectors(spark, d), W.ANCHORS).select("cell", V.quantize_i8(F.col("v")).alias("q8")).orderBy("cell").collect()  # 16 cells
    out = split.attach(W.vectors(spark, d), np.array([r.q8 for r in rows], np.int8), 2)
    return out.select("id", "slot", "cell", F.round("score", 6).alias("score"))


def live_split_once(spark, d):
    """One round that splits every cell of the first assignment: which half each entry goes to."""
    entries = W.assigned(spark, d, 1).select("id", "slot", "cell")
    done = split.split_round(entries, W.vectors(spark, d).select("id", V.unit(F.col("v")).alias("v")), list(range(W.K)), W.K, 0)
    return done.where("slot >= 0").select("id", (F.col("cell") % W.K).cast("int").alias("cell"), (F.col("cell") >= W.K).cast("int").alias("half"))


def live_split_to_capacity(spark, d):
    """Rounds of splits until no cell exceeds 128 entries: invariants of the outcome."""
    vec = W.vectors(spark, d).select("id", V.unit(F.col("v")).alias("v"))
    centres, entries, done = split.grow(vec, capacity=128)
    per = entries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("ids"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") <= 128).alias("within"), F.sum("n").alias("entries"))
    return sizes.crossJoin(per).select("within", "entries", "ids", "least", "most", F.lit(len(centres) == done["splits"] + 2).alias("numbered"))


_L = f"WITH {W.BASE}, {W.LOG}"
_MERGED = f"{_L}, now AS MATERIALIZED (SELECT c.id, u.v FROM cur c JOIN unit u ON u.id = c.vsrc WHERE c.id NOT IN (SELECT id FROM deleted)) SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT qid, n.id, list_dot_product(q, n.v) AS score, row_number() OVER (PARTITION BY qid ORDER BY list_dot_product(q, n.v) DESC, n.id) AS rank FROM qry, now n) WHERE rank <= {W.TOP}"
_C8 = W.i8("v")


def _draws() -> str:
    """(cell, k, x, y): the seeded draws of each cell's pairs."""
    rows = []
    for cell in range(W.K):
        state = split.SPLIT_SEED + (W.K + cell) * split.SPLIT_STEP + cell
        for k in range(split.PAIRS):
            state, x = V.splitmix64(state)
            state, y = V.splitmix64(state)
            rows.append(f"({cell}, {k}, {x}::UBIGINT, {y}::UBIGINT)")
    return ", ".join(rows)


_MINUS = "list_transform(range({d}), lambda i: {a}[i + 1] - {b}[i + 1])"
_SPLIT_SQL = (
    f"WITH {W.INDEX}, draws(cell, k, x, y) AS (VALUES {_draws()}), "
    "m AS MATERIALIZED (SELECT a.cell, a.id, u.v, row_number() OVER (PARTITION BY a.cell ORDER BY a.id) - 1 AS r, count(*) OVER (PARTITION BY a.cell) AS n FROM assigned a JOIN unit u USING (id) WHERE a.slot = 0), "
    "sz AS (SELECT cell, max(n) AS n FROM m GROUP BY cell), "
    f"pairs AS MATERIALIZED (SELECT d.cell, d.k, {_MINUS.format(d=W.DIM, a='a.v', b='b.v')} AS axis FROM draws d JOIN sz USING (cell) JOIN m a ON a.cell = d.cell AND a.r = d.x % sz.n::UBIGINT JOIN m b ON b.cell = d.cell AND b.r = d.y % sz.n::UBIGINT), "
    "best AS MATERIALIZED (SELECT cell, axis FROM pairs QUALIFY row_number() OVER (PARTITION BY cell ORDER BY list_dot_product(axis, axis) DESC, k) = 1), "
    "p AS (SELECT m.id, m.cell, m.n, row_number() OVER (PARTITION BY m.cell ORDER BY list_dot_product(m.v, best.axis) DESC, m.id) AS o FROM m JOIN best USING (cell)) "
    "SELECT id, cell, CASE WHEN o > n // 2 THEN 1 ELSE 0 END AS half FROM p"
)
QUERIES = {
    "live_fold_state": (live_fold_state, f"{_L} SELECT c.id, vsrc, d.id IS NOT NULL AS deleted FROM cur c LEFT JOIN deleted d USING (id)"),
    "live_rejected_ops": (live_rejected_ops, f"{_L} SELECT seq, op, id FROM st WHERE NOT ok"),
    "live_idempotent_ids": (live_idempotent_ids, f"{_L} SELECT i.seq, i.token, CASE WHEN k = 1 THEN 'insert' ELSE 'replay' END AS outcome, n.id FROM ins0 i JOIN ins n USING (token) WHERE k = 1 OR digest = d0"),
    "live_idempotency_conflicts": (live_idempotency_conflicts, f"{_L} SELECT seq, token, digest FROM ins0 WHERE k > 1 AND digest <> d0"),
    "live_insert_ids": (live_insert_ids, f"{_L} SELECT id, seq FROM ins"),
    "live_tags_after_fold": (live_tags_after_fold, f"{_L} SELECT id, tag FROM tags"),
    "live_stats": (live_stats, f"{_L} SELECT (SELECT count(*) FROM born) AS allocated, (SELECT count(*) FROM deleted) AS deleted, (SELECT count(*) FROM born) - (SELECT count(*) FROM deleted) AS active, (SELECT count(DISTINCT token) FROM ins0) AS idempotency_records"),
    "live_add_bulk": (live_add_bulk, f"{_L}, e AS (SELECT seq, tag, unnest([id, (id + 1) % n, (id + 2) % n]) AS id FROM log, n WHERE op = 'add_metadata'), k AS (SELECT e.*, coalesce(b.seq < e.seq, false) AND (ds IS NULL OR e.seq < ds) AS ok FROM e LEFT JOIN born b ON b.id = e.id LEFT JOIN deleted d ON d.id = e.id) SELECT DISTINCT seq, id, tag FROM k WHERE seq IN (SELECT seq FROM k GROUP BY seq HAVING bool_and(ok))"),
    "live_merge_topk": (live_merge_topk, _MERGED),
    "live_tail_search": (live_tail_search, _MERGED),
    "live_compact_equivalence": (live_compact_equivalence, _MERGED),
    "live_route_top2": (live_route_top2, f"WITH {W.INDEX}, c8 AS MATERIALIZED (SELECT cell, CAST({_C8} AS DOUBLE[]) AS c FROM cells), s AS (SELECT id, cell, round(list_dot_product(CAST(v8 AS DOUBLE[]), c) * (1.0::DOUBLE / sqrt(list_dot_product(c, c))), 9) AS s FROM v8, c8) SELECT id, CAST(k - 1 AS INTEGER) AS slot, cell, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cell) AS k FROM s) WHERE k <= 2"),
    "live_split_once": (live_split_once, _SPLIT_SQL),
    "live_split_to_capacity": (live_split_to_capacity, "SELECT true AS within, 2 * count(*) AS entries, count(DISTINCT vec_id) AS ids, CAST(2 AS BIGINT) AS least, CAST(2 AS BIGINT) AS most, true AS numbered FROM embeddings"),
}
