"""Transform codes at scale: kernels over Arrow batches for what ``functions.codes`` defines as Column expressions.

Codes (cell, id, code) of 1, 2 or 4 bits a dimension are kept one byte a dimension and laid out by cell. A search with many
dimensions scores a prefix first: of each query the best ``max(PREFIX_KEEP, 4 * rerank)`` entries by their first ``PREFIX`` dimensions
are scored in full, ``rerank`` of them stay, and then each id counts once.
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
from .topk import OUT_ROWS, RESULT, Held, groups, in_cells, probed_blocks, queries_of, query_blocks, rank, tiles

CODES = "cell int, id long, code binary"
#: Fixed values of the prefix pass: its dimensions, from how many on it is made, and the entries that it keeps at least.
PREFIX, PREFIX_FROM, PREFIX_KEEP = 256, 512, 16_384
#: Decimals of a score before entries are ranked.
DIGITS = 9


def padded(v: np.ndarray, dim: int) -> np.ndarray:
    return np.hstack((v, np.zeros((len(v), dim - v.shape[1])))) if v.shape[1] < dim else v


def scales(vectors: DataFrame, bits: int, seed: int, dim: int, every: int = 64) -> np.ndarray:
    """The scale of every rotated dimension, from the rows whose id is a multiple of ``every``: sums of a task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim)
        for b in batches:
            if b.num_rows:
                total += np.abs(V.rotate_rows(padded(V.unit_rows(V.matrix(b.column(0))), dim), seed)).sum(0)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])

    parts = vectors.where(F.col("id") % every == 0).select(V.doubles("v").alias("v")).mapInArrow(run, "n long, total array<double>").collect()
    n = sum(r.n for r in parts)
    mean = sum((np.array(r.total) for r in parts), np.zeros(dim)) / max(n, 1)
    return C.tq_levels(bits) / (3.0 * C.SIGMA * mean + 1e-9)


def encode_rows(r: np.ndarray, scale: np.ndarray, bits: int) -> np.ndarray:
    if bits == 1:
        return (r >= 0).astype(np.int8)
    return np.clip(np.rint(r * scale), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int8)


def encode(assigned: DataFrame, vectors: DataFrame, scale: np.ndarray, bits: int, seed: int, dim: int, cdim: int | None = None) -> DataFrame:
    """(cell, id, code) of every assignment: the first ``cdim`` of ``dim`` rotated dimensions."""
    if bits not in (1, 2, 4):
        raise ValueError("codes have 1, 2 or 4 bits")
    shared = vectors.sparkSession.sparkContext.broadcast(scale[: cdim or dim])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = shared.value
        for b in batches:
            if b.num_rows:
                r = V.rotate_rows(padded(V.unit_rows(V.matrix(b.column(2))), dim), seed)[:, : len(scale)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in encode_rows(r, scale, bits)], pa.binary())], ["cell", "id", "code"])

    rows = assigned.select("cell", "id").join(vectors.select("id", V.doubles("v").alias("v")), "id").select("cell", "id", "v")
    return rows.mapInArrow(run, CODES)


def score_rows(u: np.ndarray, r: np.ndarray, scale: np.ndarray, bits: int) -> np.ndarray:
    """(queries, entries): int8 products where the bit is set, or q . c - |c|^2 / 2 of the decoded codes; rounded."""
    if bits == 1:
        return V.quantize_rows(r).astype(np.float64) @ u.astype(np.float64).T
    c = u / scale
    return np.round(r @ c.T - 0.5 * (c * c).sum(1), DIGITS)


def score_pairs(u: np.ndarray, r: np.ndarray, scale: np.ndarray, bits: int) -> np.ndarray:
    """The same for the pairs (entry, query) of equal positions."""
    out, step = np.empty(len(u)), max(1, OUT_ROWS // 4)
    for at in range(0, len(u), step):
        x, y = u[at : at + step], r[at : at + step]
        if bits == 1:
            out[at : at + step] = np.einsum("ij,ij->i", V.quantize_rows(y).astype(np.float64), x.astype(np.float64))
        else:
            c = x / scale
            out[at : at + step] = np.round(np.einsum("ij,ij->i", y, c) - 0.5 * (c * c).sum(1), DIGITS)
    return out


def candidates(codes: DataFrame, queries: DataFrame, scale: np.ndarray, bits: int, seed: int, dim: int, rerank: int, probes: DataFrame | None = None, keep: int = PREFIX_KEEP, prefix: int | None = None) -> DataFrame:
    """(qid, id, score): of each query the ``rerank`` best entries, then distinct ids (so there may be fewer). With ``probes`` (qid, cell)
    only entries of probed cells count. One pass over the codes for each block of queries."""
    spark, cdim, parts = codes.sparkSession, len(scale), []
    first = prefix or (PREFIX if cdim >= PREFIX_FROM else cdim)
    most = max(keep, 4 * rerank) if first < cdim else rerank
    blocks = probed_blocks(probes, queries, 24 * most) if probes is not None else ((qids, q, None) for qids, q in query_blocks(queries.orderBy("qid"), extra=24 * most))
    for qids, q, lists in blocks:
        rows = in_cells(codes, lists[0]) if lists is not None else codes
        shared = spark.sparkContext.broadcast((qids, V.rotate_rows(padded(q, dim), seed)[:, :cdim], scale, lists))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, r, scale, lists = shared.value
            width, every = len(scale), np.arange(len(qids))
            held = Held(len(qids), most, DIGITS, more=first < width)
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(1).to_numpy()
                u = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(b.num_rows, -1)
                for c, at in groups(b.column(0).to_numpy()) if lists is not None else [(None, np.arange(len(ids)))]:
                    which = every if lists is None else queries_of(lists, c)
                    for x, y in tiles(len(which), len(at)):
                        q_at, u_at = which[x], at[y]
                        s = score_rows(u[u_at][:, :first], r[q_at][:, :first], scale[:first], bits)
                        full = lambda i, j: score_pairs(u[u_at[j]], r[q_at[i]], scale, bits)  # noqa: B023, E731
                        held.add(q_at, s, ids[u_at], full if first < width else None)
            for out in held.batches(qids, ["qid", "id", "prefix"] + ["score"] * (first < width)):
                yield out if first < width else pa.RecordBatch.from_arrays([*out.columns, out.column(2)], ["qid", "id", "prefix", "score"])

        parts.append(rows.select("cell", "id", "code").mapInArrow(run, "qid long, id long, prefix double, score double"))
    if not parts:
        return spark.createDataFrame([], RESULT)
    entries = reduce(DataFrame.unionAll, parts)
    if first < cdim:
        entries = rank(entries, most, "prefix")
    capped = rank(entries.select("qid", "id", "score"), rerank)
    return capped.groupBy("qid", "id").agg(F.max("score").alias("score"))
