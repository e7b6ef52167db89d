"""Embedding near-duplicates: product quantisation.

Unit vectors are dealt into inverted lists by the nearest of the coarse centroids; each keeps the codes of its residual in
``subspaces`` subspaces and the length of what the codes miss. A query scores a list by summing table look-ups (asymmetric:
the query is not quantised), and what may still reach the threshold is reranked by the exact cosine in double precision.

There are as many lists as the largest label needs for about ``LIST_ROWS`` rows each: one level of centroids, or above ``LEVEL``
lists two, the second one dividing the residuals of each first one. Centroids are fitted on at most ``SAMPLE`` vectors.

With radius r = sqrt(2 - 2 * threshold) a partner of u lies within r of u, so its list can be probed only if the bisector between
u's cell and that one lies within r of u. Differences of near copies point in all directions, so towards one bisector they
reach about r / sqrt(d) in d effective dimensions (of the sample's covariance): lists whose bisector lies within ``SPREAD`` times
that are probed, all within r if ``spread`` is infinite. In a probed list nothing is lost: a partner's approximate distance is
at most r plus its own coding error. Tests measure the recall against brute force.

Equal vectors (same label) are one class with a multiplicity before any search. A list of more rows than fill ``BLOCK_BYTES`` is
dealt into pairs of blocks. A task counts partners and returns counts and a spanning forest, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or
id, link with nothing; vectors of different lengths are not compared. Rows that repeat an id keep their rows, each with the
links of its own vector. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, blocked, components, drop_table, sorted_groups, write_table

SAMPLE = 16384
LIST_ROWS = 4096
LEVEL = 1024
SUBSPACES = 8
CODES = 64
SPREAD = 4.0
BLOCK_BYTES = 8 << 20


@dataclass
class Codebook:
    coarse: np.ndarray  # (lists of the first level, dim)
    fine: np.ndarray  # (lists that each of these is divided into, dim): offsets; one row of zeros for a single level
    parts: list[np.ndarray]  # of each subspace: (codes, width)
    cuts: list[int]
    reach: float  # share of the radius within which bisectors are probed

    def centre(self, cell: np.ndarray | int) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]


def kmeans(v: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = v[r.choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(v, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, v)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((v * v).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * v @ c.T, 0)


def nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return squares(v, c).argmin(1)


def fit(v: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, spread: float = SPREAD) -> Codebook:
    """Centroids and codes from sample rows ``v`` for about ``lists`` lists."""
    first = min(lists, LEVEL)
    coarse = kmeans(v, first)
    rest = v - coarse[nearest(v, coarse)]
    second = min(LEVEL, -(-lists // first))
    fine = kmeans(rest, second, seed=2) if second > 1 else np.zeros((1, v.shape[1]))
    rest = rest - fine[nearest(rest, fine)]
    n = min(subspaces, v.shape[1])
    cuts = [i * v.shape[1] // n for i in range(n + 1)]
    cov = np.atleast_2d(np.cov(v.T)) if len(v) > 1 else np.zeros((1, 1))
    effective = np.trace(cov) ** 2 / max(float((cov * cov).sum()), 1e-300)
    return Codebook(coarse, fine, [kmeans(rest[:, a:b], codes) for a, b in zip(cuts, cuts[1:])], cuts, min(1.0, spread / math.sqrt(max(effective, 1.0))))


def encode(book: Codebook, v: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, length of what the codes miss) of unit vectors in their cells."""
    rest = v - book.centre(cell)
    code = np.stack([nearest(rest[:, a:b], p) for a, b, p in zip(book.cuts, book.cuts[1:], book.parts)], 1).astype(np.uint8)
    back = np.hstack([p[code[:, i]] for i, p in enumerate(book.parts)])
    return code, np.linalg.norm(rest - back, axis=1)


def probes(book: Codebook, v: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each vector, rows, cells): visits go to cells after the own one whose bisectors come within reach; so pairs meet once."""
    reach = radius * book.reach + 1e-6
    at = np.arange(len(v))
    d = squares(v, book.coarse)
    first = d.argmin(1)
    gap = np.sqrt(squares(book.coarse, book.coarse))
    row, to = np.nonzero(d - d[at, first][:, None] <= 2 * gap[first] * reach)
    if len(book.fine) == 1:
        visit = to > first[row]
        return first, row[visit], to[visit]
    k = len(book.fine)
    gap = np.sqrt(squares(book.fine, book.fine))
    home, rows, cells = np.zeros(len(v), np.int64), [], []
    for s in range(0, len(row), 1024):
        r, t = row[s : s + 1024], to[s : s + 1024]
        e = squares(v[r] - book.coarse[t], book.fine)
        second = e.argmin(1)
        own = t == first[r]
        home[r[own]] = t[own] * k + second[own]
        x, y = np.nonzero(e - e[np.arange(len(r)), second][:, None] <= 2 * gap[second] * reach)
        rows.append(r[x])
        cells.append(t[x] * k + y)
    rows, cells = np.concatenate(rows), np.concatenate(cells)
    visit = cells > home[rows]
    return home, rows[visit], cells[visit]


def table_distances(book: Codebook, cell: int, q: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(queries, members): asymmetric distances by table look-up."""
    rest = (q - book.centre(cell)).astype(np.float64)
    out = np.zeros((len(q), len(code)))
    for i, (a, b, p) in enumerate(zip(book.cuts, book.cuts[1:], book.parts)):
        out += squares(rest[:, a:b], p)[:, code[:, i]]
    return np.sqrt(out)


def _vectors(rows: DataFrame, kind: str) -> DataFrame:
    """(id, label, digest, dim, vec) of all rows; digest is null for what cannot link, vec the components as ``kind`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, label, v in zip(*(c.to_pylist() for c in b.columns)):
                out.append((i, None, None, None, None))
                if i is not None and label is not None and v and not any(x is None for x in v):
                    a = np.array(v, kind) + np.array(0, kind)  # no negative zero
                    if np.isfinite(a).all() and a.any():
                        raw = a.tobytes()
                        out[-1] = (i, label, hashlib.blake2b(raw + label.encode(), digest_size=16).digest(), len(a), raw)
            if out:
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "label", "digest", "dim", "vec"])

    return rows.mapInArrow(run, "id long, label string, digest binary, dim int, vec binary")


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    """Unit rows in doubles, padded with zeros to ``dim``."""
    out = np.zeros((len(col), dim))
    for i, x in enumerate(col.to_pylist()):
        v = np.frombuffer(x, kind).astype(np.float64)
        scale = np.abs(v).max()
        v = v / scale  # keeps the norm finite
        out[i, : len(v)] = v / math.sqrt(float(v @ v))
    return out


class _Groups:
    """Components of the rows of one unit; gives back the links that merged two of them."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.of, self.forest, self.links = ids, np.arange(len(ids)), Forest(), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.of[a], self.of[b]
        apart = x != y
        if apart.any():
            pairs = np.unique(np.stack((x[apart], y[apart]), 1), axis=0)
            self.links += [(int(self.ids[i]), int(self.ids[j])) for i, j in pairs.tolist() if self.forest.join(i, j)]
            seen = np.unique(self.of)
            roots = np.array([self.forest.root(i) for i in seen.tolist()])
            self.of = roots[np.searchsorted(seen, self.of)]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, list_rows: int = LIST_ROWS, block: int | None = None, spread: float = SPREAD) -> DataFrame:
    """(id, n_links, component_id): one row for each row of ``df``."""
    spark = df.sparkSession
    radius = math.sqrt(2 - 2 * threshold)
    kind = "<f4" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    vectors = write_table(_vectors(rows, kind), "pq-vectors")
    classes = vectors.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = write_table(classes.withColumn("rep", F.monotonically_increasing_id()), "pq-classes")  # numbers hold once written
    size = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("dim").alias("dim")).first()
    dim = size.dim or 1
    share = min(1.0, 1.5 * SAMPLE / max(size.n or 0, 1))
    sample = classes.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).orderBy(F.xxhash64("digest")).select("vec").limit(SAMPLE)
    vecs = [r.vec for r in sample.collect()]
    book = fit(_matrix(pa.array(vecs, pa.binary()), dim, kind), max(1, -(-(size.most or 0) // list_rows)), spread=spread) if vecs else None
    shared = spark.sparkContext.broadcast(book)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                t = b.slice(s, 1024)
                u = _matrix(t.column("vec"), dim, kind)
                cell, row, to = probes(m, u, radius)
                code, miss = encode(m, u, cell)
                at = np.concatenate((np.arange(len(u)), row))
                home = np.arange(len(at)) < len(u)
                where = np.concatenate((cell, to))
                codes = [x.tobytes() for x in code]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [t.column("label").take(take), t.column("dim").take(take), pa.array(where, pa.int32()), pa.array(home), t.column("rep").take(take), t.column("mult").take(take), t.column("vec").take(take), pa.array([codes[i] if h else None for i, h in zip(at, home)], pa.binary()), pa.array(miss[at].astype(np.float32) + np.float32(1e-6))],
                    ["label", "dim", "cell", "home", "rep", "mult", "vec", "code", "miss"],
                )

    placed = classes.select("label", "dim", "rep", "mult", "vec").mapInArrow(place, "label string, dim int, cell int, home boolean, rep long, mult long, vec binary, code binary, miss float")
    placed = placed.withColumn("key", F.xxhash64("label", "dim", "cell"))
    units = blocked(placed, "key", "rep", block or max(256, BLOCK_BYTES // (8 * dim)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for t, bounds in sorted_groups(batches, ["key", "unit_i", "unit_j"]):
            edges: list[tuple[int, int]] = []
            ids, mult, mine = (t.column(c).to_numpy() for c in ("rep", "mult", "mine"))
            home, cells, miss = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "cell", "miss"))
            dims = t.column("dim").to_numpy()
            links = np.zeros(t.num_rows, np.int64)
            for lo, hi in zip(bounds, bounds[1:]):
                if hi - lo < 2 or not home[lo:hi].any():
                    continue
                unit = t.slice(lo, hi - lo)
                u = _matrix(unit.column("vec"), dim, kind)
                names = unit.column("label").to_pylist()
                h = np.flatnonzero(home[lo:hi])
                code = np.frombuffer(b"".join(unit.column("code").take(pa.array(h)).to_pylist()), np.uint8).reshape(len(h), -1)
                own = mine[lo:hi]
                split = unit.column("unit_i")[0].as_py() != unit.column("unit_j")[0].as_py()
                groups = _Groups(ids[lo:hi])
                same = len(set(names)) == 1 and len(set(dims[lo:hi].tolist())) == 1 and len(set(cells[lo:hi].tolist())) == 1
                for s in range(0, hi - lo, 256):
                    q = np.arange(s, min(s + 256, hi - lo))
                    if same:
                        near = table_distances(m, int(cells[lo]), u[q], code) <= radius + miss[lo + h][None] + 1e-6
                        i, j = np.nonzero(near)
                    else:  # two keys with one hash: compare all
                        i, j = np.nonzero(np.ones((len(q), len(h)), bool))
                    i, j = q[i], h[j]
                    keep = (~home[lo + i] | (j > i)) & (i != j)  # homes meet each other once, visitors meet homes
                    if split:
                        keep &= own[i] != own[j]
                    i, j = i[keep], j[keep]
                    if not same:
                        ok = np.array([names[a] == names[b] and dims[lo + a] == dims[lo + b] and cells[lo + a] == cells[lo + b] for a, b in zip(i, j)], bool)
                        i, j = i[ok], j[ok]
                    for c in range(0, len(i), 20_000):  # exact rerank
                        a, b = i[c : c + 20_000], j[c : c + 20_000]
                        ok = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
                        a, b = a[ok], b[ok]
                        np.add.at(links, a + lo, mult[b + lo])
                        np.add.at(links, b + lo, mult[a + lo])
                        groups.join(a, b)
                edges += groups.links
            some = np.flatnonzero(links)
            a = np.concatenate((ids[some], np.array([e[0] for e in edges], np.int64)))
            b = [None] * len(some) + [e[1] for e in edges]
            n = np.concatenate((links[some], np.zeros(len(edges), np.int64)))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    found = write_table(units.mapInArrow(search, "a long, b long, n long"), "pq-found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.where("b is not null").select("a", "b"))
    known = classes.select("digest", "rep", "least", "mult").join(counts, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    known = known.select("digest", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    named = known.groupBy("c").agg(F.min("least").alias("component_id"))
    known = write_table(known.join(named, "c").select("digest", "n_links", "component_id"), "pq-known")
    for done in (classes, found, comp):
        drop_table(done)
    by_row = vectors.where("digest is not null").select("id", "digest").join(known, "digest").select("id", "n_links", "component_id")
    lone = vectors.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return by_row.unionByName(lone)
