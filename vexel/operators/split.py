"""Cells that split themselves: routing of live vectors, halving of overflowing cells in rounds, the capacity policy.

A round splits every overflowing cell at once, in ascending cell order, and gives the new halves the next numbers. Topology depends
on the order of splits; what a search with exhaustive budgets returns does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.store import settle
from .topk import TILE, rank

#: Fixed values of the policy: least capacity, and the seed of the pairs tried.
MIN_CAPACITY, MAX_CAPACITY, SPLIT_SEED, SPLIT_STEP, PAIRS, SKETCH = 64, 65_536, 781_923, 31_337, 16, 64


def default_capacity(dim: int) -> int:
    return max(MIN_CAPACITY, 2 * dim)


def split_cell(ids: np.ndarray, v: np.ndarray, cell: int, splits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(second-half mask, centre of the first half, of the second): of some seeded pairs the farthest one gives the axis."""
    order = np.argsort(ids, kind="stable")
    sketch = v[:, : min(SKETCH, v.shape[1])]
    state = SPLIT_SEED + splits * SPLIT_STEP + cell
    best, pair = -1.0, (0, len(ids) - 1)
    for _ in range(PAIRS):
        state, x = V.splitmix64(state)
        state, y = V.splitmix64(state)
        i, j = order[x % len(ids)], order[y % len(ids)]
        d = float(((sketch[i] - sketch[j]) ** 2).sum())
        if d > best:
            best, pair = d, (i, j)
    p = sketch @ (sketch[pair[0]] - sketch[pair[1]])
    ranked = np.lexsort((ids, -p))
    second = np.zeros(len(ids), bool)
    second[ranked[len(ids) // 2 :]] = True
    return second, v[~second].sum(0), v[second].sum(0)


def _centre(x: np.ndarray) -> list[int]:
    """The centre as it is kept: int8 values; scores take them over their length."""
    return np.rint(x * (127.0 / (np.abs(x).max() + 1e-30))).astype(int).tolist()


def first_best(s: np.ndarray, m: int) -> np.ndarray:
    """Positions of the ``m`` best of each row, the first of equals first."""
    if m > 4 or s.shape[1] <= m:
        return np.argsort(-s, axis=1, kind="stable")[:, :m]
    s, out, rows = s.copy(), np.empty((len(s), m), np.int64), np.arange(len(s))
    for n in range(m):
        out[:, n] = s.argmax(1)
        s[rows, out[:, n]] = -np.inf
    return out


def attach(vectors: DataFrame, centres: np.ndarray, m: int = 2, numbers: np.ndarray | None = None, limit: int = 64 << 20) -> DataFrame:
    """(id, slot, cell): the best ``m`` cells of each vector by int8 product over the centre's length, first cell on ties.

    ``centres`` holds int8 rows, of cells 0, 1, ... or of ``numbers`` (ascending). They go out in blocks of at most ``limit`` bytes.
    """
    spark, parts = vectors.sparkSession, []
    rows = vectors.select(F.col("id").cast("long").alias("id"), V.doubles("v").alias("v"))
    numbers = np.arange(len(centres), dtype=np.int32) if numbers is None else np.asarray(numbers, np.int32)
    step = max(1, limit // max(1, centres.shape[1] if centres.ndim == 2 else 1))
    for at in range(0, len(centres), step):
        shared = spark.sparkContext.broadcast((numbers[at : at + step], np.asarray(centres[at : at + step], np.int8)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            numbers, c8 = shared.value
            c = c8.astype(np.float64)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
            rows_at_once = max(1, TILE // len(c))
            for b in batches:
                for at in range(0, b.num_rows, rows_at_once):
                    t = b.slice(at, rows_at_once)
                    s = np.round(V.quantize_rows(V.unit_rows(V.matrix(t.column(1)))).astype(np.float64) @ c.T, 9)
                    top = first_best(s, m)
                    n = top.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), t.num_rows)), pa.array(numbers[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], ["id", "slot", "cell", "score"])

        parts.append(rows.mapInArrow(run, "id long, slot int, cell int, score double"))
    if not parts:
        return spark.createDataFrame([], "id long, slot int, cell int, score double")
    if len(parts) == 1:
        return parts[0]
    return rank(reduce(DataFrame.unionAll, parts), m, "score", "id", "cell").select("id", (F.col("rank") - 1).cast("int").alias("slot"), "cell", "score")


def _in_cells(entries: DataFrame, cells: list[int], inside: bool = True) -> DataFrame:
    """The entries of some cells, or the others: a literal list while it is short, else a join."""
    if len(cells) <= 1024:
        hit = F.col("cell").isin(cells)
        return entries.where(hit if inside else ~hit)
    return entries.join(entries.sparkSession.createDataFrame([(c,) for c in cells], "cell int"), "cell", "left_semi" if inside else "left_anti")


def split_round(entries: DataFrame, vectors: DataFrame, over: list[int], first: int, splits: int) -> DataFrame:
    """(id, slot, cell, centre): one split of each cell in ``over``; the new halves get the numbers from ``first`` on. Rows with slot -1
    carry the new centres. A cell is grouped in one task: a capacity of at most 65536 and bounded appends keep it small."""
    number = {c: first + i for i, c in enumerate(over)}

    def halve(pdf):
        import pandas as pd

        cell = int(pdf["cell"].iloc[0])
        ids, v = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(np.float64)
        second, a, b = split_cell(ids, v, cell, splits + number[cell])
        rows = list(zip(ids.tolist(), pdf["slot"].tolist(), np.where(second, number[cell], cell).tolist(), [None] * len(ids)))
        rows += [(-1, -1, cell, _centre(a)), (-1, -1, number[cell], _centre(b))]
        return pd.DataFrame(rows, columns=["id", "slot", "cell", "centre"])

    some = _in_cells(entries, over).join(vectors.select("id", V.doubles("v").alias("v")), "id")
    return some.groupBy("cell").applyInPandas(halve, "id long, slot int, cell int, centre array<int>")


def grow(vectors: DataFrame, capacity: int, max_cells: int = 300_000, centres: np.ndarray | None = None, entries: DataFrame | None = None) -> tuple[np.ndarray, DataFrame, dict[str, int]]:
    """(int8 centres, entries(id, slot, cell), counters): split in rounds until no cell exceeds ``capacity`` or ``max_cells`` is reached.

    Without centres the collection starts as two cells, both at the first vector, and each vector is in both. Only
    overflowing cells are grouped. The counters are those of this call: splits, rounds and entries rewritten.
    """
    if not MIN_CAPACITY <= capacity <= MAX_CAPACITY or not 2 <= max_cells:
        raise ValueError("capacity lies in 64..65536, max_cells is at least 2")
    done = {"splits": 0, "rounds": 0, "rewritten": 0}
    if centres is None:
        first = vectors.orderBy("id").select("v").first()
        if first is None:
            return np.zeros((0, 0), np.int8), vectors.sparkSession.createDataFrame([], "id long, slot int, cell int"), done
        centres = np.array([_centre(np.array(first.v))] * 2, np.int8)
    if entries is None:
        entries = settle(attach(vectors, centres).select("id", "slot", "cell"), "entries")
    while len(centres) < max_cells:
        full = {r.cell: r["count"] for r in entries.groupBy("cell").count().where(F.col("count") > capacity).collect()}
        over = sorted(full)[: max_cells - len(centres)]
        if not over:
            break
        halves = settle(split_round(entries, vectors, over, len(centres), done["splits"]), "halves")
        grown = np.vstack((centres, np.zeros((len(over), centres.shape[1]), np.int8)))
        for r in halves.where("slot = -1").collect():
            grown[r.cell] = r.centre
        centres = grown
        entries = settle(_in_cells(entries, over, False).unionByName(halves.where("slot >= 0").select("id", "slot", "cell")), "entries")
        done = {"splits": done["splits"] + len(over), "rounds": done["rounds"] + 1, "rewritten": done["rewritten"] + sum(full[c] for c in over)}
    return centres, entries, done


def cell_stats(entries: DataFrame, capacity: int) -> dict[str, int]:
    """Counts over the cells that hold entries, and how many of them wait for a split."""
    n = entries.groupBy("cell").count()
    r = n.agg(F.count(F.lit(1)).alias("cells"), F.max("count").alias("largest"), F.min("count").alias("least"), F.sum("count").alias("n"), F.sum((F.col("count") > capacity).cast("int")).alias("pending")).first()
    return {"filled_cells": r.cells, "largest_cell": r.largest or 0, "smallest_cell": r.least or 0, "entries": r.n or 0, "pending": r.pending or 0}
