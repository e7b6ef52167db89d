"""The cell-partitioned index: anchors, multi-assignment with spill, routing, probing, rerank and their counters.

Cells (anchor, centre) go to the tasks as int8 matrices of at most ``CELL_BYTES``. A larger cell table is dealt into blocks: each
block keeps the best cells of a row in a narrow pass, and the blocks' best are merged. Assignments and codes are long tables laid
out by cell, so that a probe join prunes on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.store import settle
from .topk import DIGITS, RESULT, query_blocks, rank, scan_cells

CELL_BYTES = 64 << 20
#: Cells scored at once by a task.
STRIP = 4096


def anchor_ids(n: int, k: int, seed: int) -> list[int]:
    """``k`` distinct row numbers of ``n``: a seeded draw without replacement."""
    taken: dict[int, None] = {}
    state = seed
    while len(taken) < min(k, n):
        state, z = V.splitmix64(state)
        taken.setdefault(z % n)
    return list(taken)


def cells(vectors: DataFrame, ids: list[int], id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """(cell, v, q8, top): anchors in the order of ``ids``; all share one quantisation scale."""
    anchors = vectors.sparkSession.createDataFrame(list(enumerate(ids)), f"cell int, `{id_col}` long")
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col).join(anchors, id_col).select("cell", V.unit(V.doubles(vec_col)).alias("v"))
    top = rows.agg(F.max(V.largest(F.col("v"))).alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("cell", "v", V.quantize_i8(F.col("v"), F.col("top")).alias("q8"), "top")


def cell_blocks(cells_df: DataFrame, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(cell numbers, int8 rows, shared scale) in the order of cells, streamed in blocks of at most ``limit`` bytes."""
    numbers, rows, size, scale = [], [], 0, 127.0
    for r in cells_df.select("cell", "q8", "top").orderBy("cell").toLocalIterator():
        numbers.append(r.cell)
        rows.append(np.asarray(r.q8, np.int8))
        size, scale = size + len(r.q8), 127.0 / (r.top + 1e-9)
        if size + len(r.q8) > (limit or CELL_BYTES):
            yield np.array(numbers, np.int32), np.array(rows), scale
            numbers, rows, size = [], [], 0
    if numbers:
        yield np.array(numbers, np.int32), np.array(rows), scale


def _top(s: np.ndarray, m: int) -> np.ndarray:
    """Positions of the ``m`` best of each row, the first of equals first."""
    if s.shape[1] <= max(64, 2 * m):
        return np.argsort(-s, axis=1, kind="stable")[:, :m]
    cut = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
    out = np.empty((len(s), m), np.int64)
    for i, row in enumerate(s):
        some = np.flatnonzero(row >= cut[i])
        out[i] = some[np.argsort(-row[some], kind="stable")[:m]]
    return out


def best_of(v8: np.ndarray, numbers: np.ndarray, a8: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(products, cell numbers) of the ``m`` best cells of each row of quantised vectors, strip by strip."""
    held_s, held_c = np.zeros((len(v8), 0)), np.zeros((len(v8), 0), np.int32)
    for at in range(0, len(a8), STRIP):
        s = np.hstack((held_s, v8 @ a8[at : at + STRIP].astype(np.float64).T))  # exact: products of small integers
        c = np.hstack((held_c, np.broadcast_to(numbers[at : at + STRIP], (len(v8), len(numbers[at : at + STRIP])))))
        top = _top(s, min(m, s.shape[1]))
        held_s, held_c = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
    return held_s, held_c


def best_cells(rows: DataFrame, cells_df: DataFrame, m: int, quantised: bool = False, limit: int | None = None) -> DataFrame:
    """(id, slot, cell, s, d2) of rows (id, v): the ``m`` best cells by int8 product, the first of equals first; d2 = 2 - 2 cos of the
    quantised pair. ``quantised``: v holds int8 values already. One narrow pass a block of cells; only several blocks are shuffled."""
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), V.doubles("v").alias("v"))
    parts = []
    for block in cell_blocks(cells_df, limit):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            numbers, a8, aq = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    t = b.slice(at, 1024)
                    v = V.matrix(t.column(1))
                    if quantised:
                        vq, v8 = np.ones(len(v)), v
                    else:
                        v = V.unit_rows(v)
                        vq = 127.0 / (np.abs(v).max(1) + 1e-9)
                        v8 = np.rint(v * vq[:, None])
                    s, c = best_of(v8, numbers, a8, m)
                    n = s.shape[1]
                    d2 = 2.0 - 2.0 * s / (vq[:, None] * aq)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(v))), pa.array(c.ravel().astype(np.int32)), pa.array(s.ravel().astype(np.int64)), pa.array(d2.ravel())], ["id", "slot", "cell", "s", "d2"])

        parts.append(rows.mapInArrow(run, "id long, slot int, cell int, s long, d2 double"))
    if not parts:
        return spark.createDataFrame([], "id long, slot int, cell int, s long, d2 double")
    if len(parts) == 1:
        return parts[0]
    merged = rank(reduce(DataFrame.unionAll, parts), m, "s", "id", "cell")
    return merged.select("id", (F.col("rank") - 1).cast("int").alias("slot"), "cell", "s", "d2")


def assign(vectors: DataFrame, cells_df: DataFrame, m: int, id_col: str = "id", vec_col: str = "v", limit: int | None = None) -> DataFrame:
    """(id, slot, cell, d2): the ``m`` best cells of each vector."""
    if not 1 <= m <= 4:
        raise ValueError("m lies in 1..4")
    return best_cells(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), cells_df, m, limit=limit).select("id", "slot", "cell", "d2")


def neighbours(old: DataFrame, new: DataFrame, n: int, limit: int | None = None) -> DataFrame:
    """(old, cell): of each old cell the ``n`` nearest new ones (both tables are cells)."""
    return best_cells(old.select(F.col("cell").alias("id"), F.col("q8").alias("v")), new, n, True, limit).select(F.col("id").cast("int").alias("old"), "cell")


def assign_through(vectors: DataFrame, old: DataFrame, near: DataFrame, new: DataFrame, m: int, limit: int | None = None) -> DataFrame:
    """(id, slot, cell, d2): hierarchical assignment. A vector goes to its ``m`` best old cells, and only the new cells near these are
    scored. The old cells are the small level: they and the lists of near ones go to every task, the new ones block by block."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), V.doubles("v").alias("v"))
    roots = list(cell_blocks(old, limit))
    if not roots:
        return spark.createDataFrame([], "id long, slot int, cell int, d2 double")
    if len(roots) > 1:
        raise ValueError("the coarse level fits in one block: take fewer coarse cells")
    lists: dict[int, list[int]] = {}
    for r in near.orderBy("old", "cell").toLocalIterator():  # coarse cells x neighbours
        lists.setdefault(r.old, []).append(r.cell)
    parts = []
    for block in cell_blocks(new, limit):
        mine = {o: np.flatnonzero(np.isin(block[0], c)) for o, c in lists.items()}
        shared = spark.sparkContext.broadcast((roots[0], block, mine))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (roots8, r8, _), (numbers, a8, aq), mine = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    t = b.slice(at, 1024)
                    v = V.unit_rows(V.matrix(t.column(1)))
                    vq = 127.0 / (np.abs(v).max(1) + 1e-9)
                    v8 = np.rint(v * vq[:, None])
                    _, up = best_of(v8, roots8, r8, m)
                    held: list[list[tuple[float, int]]] = [[] for _ in v]
                    for o in np.unique(up):
                        to, who = mine.get(int(o), np.zeros(0, np.int64)), np.flatnonzero((up == o).any(1))
                        if len(to):
                            s = v8[who] @ a8[to].astype(np.float64).T
                            top = _top(s, min(m, len(to)))
                            for i, w in enumerate(who.tolist()):
                                held[w] += zip((-s[i, top[i]]).tolist(), numbers[to[top[i]]].tolist())
                    found = [sorted(set(h))[:m] for h in held]
                    n = [len(f) for f in found]
                    s = np.array([-x for f in found for x, _ in f], np.float64)
                    who = np.repeat(np.arange(len(v)), n)
                    d2 = 2.0 - 2.0 * s / (vq[who] * aq)
                    yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(who)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in n] or [np.zeros(0, np.int32)])), pa.array(np.array([c for f in found for _, c in f], np.int32)), pa.array(s.astype(np.int64)), pa.array(d2)], ["id", "slot", "cell", "s", "d2"])

        parts.append(rows.mapInArrow(run, "id long, slot int, cell int, s long, d2 double"))
    if len(parts) > 1:
        merged = rank(reduce(DataFrame.unionAll, parts), m, "s", "id", "cell")
        return merged.select("id", (F.col("rank") - 1).cast("int").alias("slot"), "cell", "d2")
    return parts[0].select("id", "slot", "cell", "d2") if parts else spark.createDataFrame([], "id long, slot int, cell int, d2 double")


def spill(assigned: DataFrame, eps: float) -> DataFrame:
    """Keep slot 0, and slot j while d2 <= (1 + eps)^2 of slot 0's; slots ascend, so the first failure ends it."""
    w = Window.partitionBy("id").orderBy("slot")
    first = F.first("d2").over(w)
    return assigned.withColumn("first", first).where((F.col("slot") == 0) | (F.col("d2") <= F.pow(F.lit(1 + eps), F.lit(2.0)) * F.col("first"))).drop("first")


def histogram(assigned: DataFrame, k: int, entry_bytes: int) -> DataFrame:
    """(cell, n, offset) of all ``k`` cells: entries and the exclusive running sum in bytes. ``k`` rows pass one window."""
    counts = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    all_cells = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return all_cells.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)) * entry_bytes)


def route(queries: DataFrame, cells_df: DataFrame, nprobe: int, limit: int | None = None) -> DataFrame:
    """(qid, rank, cell, s): the ``nprobe`` best cells of each query by int8 product."""
    found = best_cells(queries.select(F.col("qid").alias("id"), F.col("q").alias("v")), cells_df, nprobe, limit=limit)
    return found.select(F.col("id").alias("qid"), (F.col("slot") + 1).cast("int").alias("rank"), "cell", "s")


def adaptive_probes(routed: DataFrame, minimum: int, gap: float, maximum: int) -> DataFrame:
    """(qid, probes): start at ``minimum`` and double while the relative gap of the last probed score to the first is under ``gap``."""
    steps, n = [], min(minimum, maximum)
    while True:
        steps.append(n)
        if n >= maximum:
            break
        n = maximum if n > maximum // 2 else 2 * n
    scores = routed.where(F.col("rank") <= maximum).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("s").cast("double")))).alias("m"))
    first = F.col("m")[1]
    out = F.lit(steps[-1])
    for n in reversed(steps[:-1]):
        far = (first - F.col("m")[n]) / F.greatest(F.abs(first), F.lit(1e-9))
        out = F.when(F.col("m")[n].isNull() | (far >= gap) if gap > 0 else F.lit(True), F.lit(n)).otherwise(out)
    return scores.select("qid", out.cast("int").alias("probes"))


def byte_budget(routed: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """(qid, rank, cell, budget_limited): probes by rank while their bytes fit; the first is always read."""
    w = Window.partitionBy("qid").orderBy("rank")
    cum = routed.join(sizes.select("cell", "bytes"), "cell").withColumn("cum", F.sum("bytes").over(w))
    ok = (F.col("rank") == 1) | (F.col("cum") <= budget)
    every = Window.partitionBy("qid")
    return cum.withColumn("budget_limited", F.max((~ok).cast("int")).over(every) == 1).where(ok).select("qid", "rank", "cell", "budget_limited")


def probe(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of the probed cells: an equi-join on cell; probes (queries x nprobe rows) are the side AQE may broadcast."""
    return probes.select("qid", "cell").join(entries, "cell")


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score): distinct candidates, bounded by a cap, scored by exact cosine; the queries are a matrix in every task."""
    spark, parts, pairs = candidates.sparkSession, [], candidates.select("qid", "id").distinct()
    for qids, q in query_blocks(queries.orderBy("qid")):
        if len(parts) == 1:  # a second block
            pairs = settle(pairs, "candidates")
        shared = spark.sparkContext.broadcast((qids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            for b in batches:
                if b.num_rows:
                    qid = b.column(0).to_numpy()
                    at = np.minimum(np.searchsorted(qids, qid), len(qids) - 1)
                    known = qids[at] == qid
                    score = np.einsum("ij,ij->i", q[at], V.unit_rows(V.matrix(b.column(2))))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[known]), pa.array(b.column(1).to_numpy()[known]), pa.array(score[known])], ["qid", "id", "score"])

        mine = pairs.where(F.col("qid").between(int(qids[0]), int(qids[-1])))
        parts.append(mine.join(vectors.select("id", V.doubles("v").alias("v")), "id").select("qid", "id", "v").mapInArrow(run, RESULT))
    scored = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], RESULT)
    return rank(scored, k, digits=DIGITS).select("qid", "rank", "id", "score")


def candidates_by_code(scored: DataFrame, rerank_n: int, m: int = 1, dedup_first: bool = False) -> DataFrame:
    """Cap entries, then distinct ids: ``m * rerank`` entries and ``rerank`` distinct ids (residual codes), or ``rerank`` entries
    and what distinct ids they hold (transform codes, ``m`` = 1)."""
    capped = rank(scored, m * rerank_n).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return rank(capped, rerank_n).select("qid", "id", "score")


def search(queries: DataFrame, vectors: DataFrame, entries: DataFrame, cells_df: DataFrame, nprobe: int, k: int, where: Column | None = None) -> DataFrame:
    """Route, filter, score what the probed cells hold. ``where`` (over the entries' columns) comes before any cap."""
    held = (entries if where is None else entries.where(where)).select("id", "cell").join(vectors.select("id", "v"), "id")
    return rank(scan_cells(route(queries, cells_df, nprobe), held, queries, k), k, digits=DIGITS).select("qid", "rank", "id", "score")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): share of the k true neighbours found."""
    hit = truth.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def first_rank(truth: DataFrame, probes: DataFrame, assigned: DataFrame) -> DataFrame:
    """(qid, id, rank): of the pairs in ``truth`` those whose id lies in a probed cell (qid, rank, cell), with the best rank of such a cell.
    The few true pairs find their cells, so no row is made for another entry."""
    cells = truth.select("qid", "id").distinct().join(assigned.select("id", "cell").distinct(), "id")
    return cells.join(probes.select("qid", "rank", "cell"), ["qid", "cell"]).groupBy("qid", "id").agg(F.min("rank").alias("rank"))


def losses(truth: DataFrame, probes: DataFrame, assigned: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(qid, watched, routed, candidates): how many true neighbours lie in a probed cell, and how many survive the candidate cap; without
    ``kept`` there is no cap, and what is routed is a candidate."""
    t = truth.select("qid", "id")
    r = first_rank(t, probes.select("qid", "cell", F.lit(1).alias("rank")), assigned).select("qid", "id", F.lit(1).alias("routed"))
    c = kept.select("qid", "id", F.lit(1).alias("kept")).distinct() if kept is not None else r.withColumnRenamed("routed", "kept")
    return t.join(r, ["qid", "id"], "left").join(c, ["qid", "id"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("watched"), F.count("routed").alias("routed"), F.count("kept").alias("candidates"))


def entry_counters(probes: DataFrame, assigned: DataFrame) -> DataFrame:
    """(qid, entries, distinct_ids): all records of the probed cells, before any filter.

    Ids with the same cells are counted together: a query counts a set of cells once if it probes one of them. The sets are few where
    cells are, and a query never meets more of them than entries.
    """
    sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    entries = probes.select("qid", "cell").join(sizes, "cell").groupBy("qid").agg(F.sum("n").alias("entries"))
    sets = assigned.groupBy("id").agg(F.array_sort(F.collect_set("cell")).alias("cells")).groupBy("cells").agg(F.count(F.lit(1)).alias("n"))
    met = probes.select("qid", "cell").join(sets.select("cells", "n", F.explode("cells").alias("cell")), "cell").select("qid", "cells", "n").distinct()
    return entries.join(met.groupBy("qid").agg(F.sum("n").alias("distinct_ids")), "qid")
