"""Residual codes at scale: kernels over Arrow batches for what ``functions.codes`` defines as Column expressions.

Codes (cell, id, beta, gain, code) are a long table laid out by cell. Scoring a batch of queries reads only probed cells (a pushed-down IN
list while it is short, else a semi-join), and a task keeps the best entries of each query, scored in tiles, as in exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import vectors as V
from ..plans.store import settle
from . import ivf
from .topk import RESULT, Held, groups, in_cells, probed_blocks, queries_of, rank, tiles

CODES = "cell int, id long, beta double, gain double, code binary"
#: Decimals of a score before entries are ranked.
DIGITS = 9


def centres(a8: np.ndarray, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows of int8 centres, their rotations), padded to ``dim``."""
    a = np.zeros((len(a8), dim))
    if len(a8):
        a[:, : a8.shape[1]] = V.unit_rows(a8.astype(np.float64))
    return a, V.rotate_rows(a, seed) if len(a) else a


def encode_rows(v: np.ndarray, r: np.ndarray, a: np.ndarray, ar: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beta, gain, codes) of rows against the centres beside them."""
    levels, cd = (1 << bits) - 1, C.residual_dims(v.shape[1])
    beta = (v * a).sum(1)
    w = r - beta[:, None] * ar
    top = np.maximum(np.abs(w[:, :cd]).max(1, keepdims=True), 1e-30)
    u = (w[:, :cd] >= 0).astype(np.int64) if bits == 1 else np.clip(np.rint((w[:, :cd] / top + 1) * levels * 0.5), 0, levels).astype(np.int64)
    gain = (w * w).sum(1) / np.maximum((w[:, :cd] * (2 * u - levels)).sum(1), 1e-20)
    return beta, gain, u.astype(np.uint8)


def _padded(v: np.ndarray, dim: int) -> np.ndarray:
    return np.hstack((v, np.zeros((len(v), dim - v.shape[1]))))


def encode(assigned: DataFrame, vectors: DataFrame, cells_df: DataFrame, seed: int, dim: int, bits: int | None = None) -> DataFrame:
    """(cell, id, beta, gain, code) of every assignment; ``dim`` is the padded dimension. Centres reach their rows by a join on cell."""
    bits = bits or C.residual_bits(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, first, of = np.unique(b.column(0).to_numpy(), return_index=True, return_inverse=True)
            a, ar = centres(V.matrix(b.column(3).take(pa.array(first))), dim, seed)
            v = _padded(V.unit_rows(V.matrix(b.column(2))), dim)
            beta, gain, u = encode_rows(v, V.rotate_rows(v, seed), a[of], ar[of], bits)
            if not np.isfinite(gain).all() or (gain > C.GAIN_MAX).any():
                raise ValueError("a gain is out of range")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(beta), pa.array(gain), pa.array([x.tobytes() for x in u], pa.binary())], ["cell", "id", "beta", "gain", "code"])

    rows = assigned.select("cell", "id").join(vectors.select("id", V.doubles("v").alias("v")), "id")
    return rows.join(cells_df.select("cell", "q8"), "cell").select("cell", "id", "v", "q8").mapInArrow(run, CODES)


def score(probes: DataFrame, codes: DataFrame, queries: DataFrame, cells_df: DataFrame, seed: int, dim: int, keep: int, bits: int | None = None, limit: int | None = None) -> DataFrame:
    """(qid, id, score): the ``keep`` best entries of each query and task among the cells it probes; rounded before ranking.

    Probes are laid out by query once. A pass takes a block of queries and a block of cells, each of bounded bytes, and reads the
    codes of those cells alone; ``keep`` bounds what a task holds for a query.
    """
    bits, cd, spark = bits or C.residual_bits(dim), C.residual_dims(dim), codes.sparkSession
    levels = (1 << bits) - 1
    parts = []
    for qids, q, lists in probed_blocks(probes, queries, 16 * keep):
        wanted = cells_df.join(spark.createDataFrame([(c,) for c in lists[0].tolist()], "cell int"), "cell", "left_semi")
        qp = _padded(q, dim)
        for numbers, a8, _ in ivf.cell_blocks(wanted, limit):
            shared = spark.sparkContext.broadcast((qids, qp, V.rotate_rows(qp, seed), lists, numbers, a8))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                qids, qp, rq, lists, numbers, a8 = shared.value
                held = Held(len(qids), keep, DIGITS)
                for b in batches:
                    ids, beta, gain = (b.column(n).to_numpy() for n in (1, 2, 3))
                    for c, at in groups(b.column(0).to_numpy()):
                        which = queries_of(lists, c)
                        a, ar = centres(a8[np.searchsorted(numbers, c)][None], dim, seed)
                        u = 2 * np.frombuffer(b"".join(b.column(4).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1).astype(np.float64) - levels
                        for x, y in tiles(len(which), len(at)):
                            mine = which[x]
                            qa = qp[mine] @ a[0]
                            w = (rq[mine] - qa[:, None] * ar)[:, :cd]
                            top = np.abs(w).max(1, keepdims=True)
                            q8 = np.rint(w / (top + 1e-9) * 127.0)
                            s = q8 @ u[y].T
                            s *= top / 127.0
                            s *= gain[at[y]]
                            s += qa[:, None] * beta[at[y]]
                            held.add(mine, s, ids[at[y]])
                for out in held.batches(qids, ["qid", "id", "score"]):
                    yield pa.RecordBatch.from_arrays([*out.columns[:2], pa.array(np.round(out.column(2).to_numpy(), DIGITS))], out.schema.names)

            parts.append(in_cells(codes, numbers).select("cell", "id", "beta", "gain", "code").mapInArrow(run, RESULT))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], RESULT)


def candidates(probes: DataFrame, codes: DataFrame, queries: DataFrame, cells_df: DataFrame, seed: int, dim: int, rerank: int, m: int, bits: int | None = None) -> DataFrame:
    """(qid, id, score): ``m * rerank`` entries, then ``rerank`` distinct ids of each query."""
    scored = score(probes, codes, queries, cells_df, seed, dim, m * rerank, bits)
    capped = rank(scored, m * rerank).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return rank(capped, rerank).select("qid", "id", "score")
