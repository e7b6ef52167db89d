"""Substring dedup: De Bruijn compaction.

Words are runs of anything but ASCII white space. Every window of ``K`` words of a document is an edge of a De Bruijn graph (its nodes
are the windows of K - 1 words). What repeats across documents is found and removed in five steps:

1. Documents are range-partitioned by id and laid into *packs* of about ``PACK_CHARS``: rows of compressed text. Packs
   are in id order and never part equal ids, so "occurs in a smaller document" is "in an earlier pack" or can be told inside one.
2. Each pack sends the sorted set of its edges' hashes, those of a task's packs in one blob for each hash bucket; a bucket finds for every edge the
   first pack that has it and answers each later pack with that source. An edge in any number of documents of a pack
   is sent once, so no edge is hot: it has at most one entry for each pack.
3. In each pack, consecutive repeated edges with one source pack compact into paths: one row with the path's words instead
   of a row for each edge.
4. Paths join their source pack. There, edges are looked up, a path is cut wherever its edges' source coordinates stop advancing
   together (a branching node), and each nonbranching piece is verified word for word at its source coordinates.
5. Verified spans join their own pack, and the words they cover go. Repeats inside a pack are compacted and verified the same way.

Work tables are in the shared folder. Packs move three times, compressed; the edges once, 6 to 8 bytes each.

Defined results: null and blank texts have no words; documents shorter than a window lose nothing; rows that repeat an id
count as one document (its own rows never make each other repeats); rows with a null id are neither searched nor sources.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, partitions_for, rows_as_bytes, text_batches, write_table

K = 13
PACK_CHARS = 3_000_000
#: Edges of a hash bucket, about; a bucket is grouped in one task.
BUCKET_EDGES = 500_000
#: Edges that a task gathers before it sends a blob to each bucket.
TASK_EDGES = 4_000_000
#: Bytes of paths that one copy of a source pack verifies, or as many as the pack has, if that is more.
UNIT_BYTES = 500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, _U)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


@dataclass
class Words:
    """The words of some texts: ``start``/``end`` byte offsets into ``body``, ``of`` the number of the text."""

    body: bytes
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @classmethod
    def cut(cls, texts: list[bytes]) -> Words:
        body = b"\n".join(texts)
        b = np.frombuffer(body, np.uint8)
        word = np.zeros(len(b) + 2, np.int8)
        word[1:-1] = ~_SPACE[b]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        return cls(body, start, end, np.searchsorted(np.cumsum(sizes), start, "right"))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions of windows that lie in one text, their 64-bit hashes)."""
        n = len(self.start)
        if n < K:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        with np.errstate(over="ignore"):
            b = np.frombuffer(self.body, np.uint8)
            sums = np.zeros(len(b) + 1, _U)
            np.cumsum((b.astype(_U) + _U(1)) * _powers(_BASE, len(b)), out=sums[1:])
            back = _powers(_BACK, len(b))
            w = _mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(_U))
            del sums
            h = np.zeros(n - K + 1, _U)
            for j in range(K):
                h = h * _U(_STEP) + w[j : n - K + 1 + j]
            h = _mix(h)
        at = np.flatnonzero(self.of[: n - K + 1] == self.of[K - 1 :])
        return at, h[at]

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by one space."""
        s, e, body = self.start, self.end, self.body
        return b" ".join([body[i:j] for i, j in zip(s[a:b].tolist(), e[a:b].tolist())])


@dataclass
class Pack:
    ids: np.ndarray
    known: np.ndarray  # False where the text is null
    words: Words

    def first_word(self) -> np.ndarray:
        """Of each text, the number of its first word; one more at the end."""
        return np.searchsorted(self.words.of, np.arange(len(self.ids) + 1))


def _close(ids: list[int], texts: list[bytes | None]) -> tuple[bytes, bytes, bytes]:
    sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
    return np.array(ids, np.int64).tobytes(), sizes.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(t or b"" for t in texts))


def _open(row: dict) -> Pack:
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(row["body"])
    ends = np.cumsum(np.maximum(sizes, 0))
    return Pack(ids, sizes >= 0, Words.cut([raw[e - max(n, 0) : e] for e, n in zip(ends.tolist(), sizes.tolist())]))


PACKS = "pack long, ids binary, sizes binary, body binary"


def pack(docs: DataFrame, chars: int = PACK_CHARS, total: int | None = None) -> DataFrame:
    """Step 1: (pack, ids, sizes, body) of (id, text), in id order."""
    n = partitions_for(total or 0, 8 * chars)
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, seq, part = [], [], 0, 0, None

        def out() -> pa.RecordBatch:
            row = [(part << 24) + seq, *_close(ids, texts)]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["pack", "ids", "sizes", "body"])

        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            for i, t in zip(b.column(0).to_pylist(), rows_as_bytes(b, "text")):
                if size >= chars and i != ids[-1]:
                    yield out()
                    ids, texts, size, seq = [], [], 0, seq + 1
                ids.append(i)
                texts.append(t)
                size += len(t or b"") + 16
        if ids:
            yield out()

    rows = docs.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id().cast("long"))
    return rows.mapInArrow(run, PACKS)


def _planes(h: np.ndarray) -> bytes:
    """Runs of sorted hashes as differences (modulo 2^64) in byte planes: the high planes are zeros, which the shuffle's compression removes."""
    d = np.diff(h, prepend=_U(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(_U).ravel(), dtype=_U)


def edge_blobs(packs: DataFrame, bits: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """Step 2, out: (bucket, packs, sizes, edges): the distinct edges of a task's packs, pack by pack, in one blob for each bucket."""

    def flush(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        bounds = np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(0, _U)
        cuts = [np.concatenate(([0], np.searchsorted(h, bounds), [len(h)])) for _, h in held]
        out = []
        for k in range(1 << bits):
            some = [(p, h[c[k] : c[k + 1]]) for (p, h), c in zip(held, cuts) if c[k] < c[k + 1]]
            if some:
                out.append((k, np.array([p for p, _ in some], np.int64).tobytes(), np.array([len(h) for _, h in some], np.int64).tobytes(), _planes(np.concatenate([h for _, h in some]))))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "packs", "sizes", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for row in b.to_pylist():
                h = np.unique(_open(row).words.edges()[1])
                if len(h):
                    held.append((row["pack"], h))
                    n += len(h)
                if n >= task_edges:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return packs.mapInArrow(run, "bucket int, packs binary, sizes binary, edges binary")


def edge_sources(blobs: DataFrame) -> DataFrame:
    """Step 2, back: (pack, bucket, seen, source): bits of the pack's edges (in order) that an earlier pack has, and the first such
    pack of each, compressed."""

    def run(t: pa.Table) -> pa.Table:
        got = []
        for p, n, e in zip(*(t.column(c).to_pylist() for c in ("packs", "sizes", "edges"))):
            got += zip(np.frombuffer(p, np.int64).tolist(), np.split(_unplanes(e), np.cumsum(np.frombuffer(n, np.int64))[:-1]))
        got.sort(key=lambda x: x[0])
        packs, parts = np.array([p for p, _ in got], np.int64), [h for _, h in got]
        sizes = [len(p) for p in parts]
        h, of = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        by = np.argsort(h, kind="stable")  # packs stay in order inside equal edges
        new = np.ones(len(h), bool)
        new[1:] = h[by][1:] != h[by][:-1]
        first = np.empty(len(h), np.int32)
        first[by] = of[by][np.flatnonzero(new)[np.cumsum(new) - 1]]
        seen = first != of
        out, z, at = [], zstandard.ZstdCompressor(level=1), 0
        for i, n in enumerate(sizes):
            s = seen[at : at + n]
            if s.any():
                src = packs[first[at : at + n][s]]
                out.append((int(packs[i]), np.packbits(s).tobytes(), z.compress(src.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())))
            at += n
        cols = list(zip(*out)) if out else [[], [], []]
        bucket = t.column("bucket")[0].as_py()
        return pa.table([pa.array(cols[0], pa.int64()), pa.array([bucket] * len(cols[0]), pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["pack", "bucket", "seen", "source"])

    return blobs.groupBy("bucket").applyInArrow(run, "pack long, bucket int, seen binary, source binary")


def _runs(same: np.ndarray, on: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [a, b) where ``on`` holds and ``same[i]`` says that i goes on from i - 1."""
    start = on & ~(np.concatenate(([False], on[:-1])) & same)
    stop = on & ~np.concatenate(((on[1:] & same[1:]), [False]))
    return list(zip(np.flatnonzero(start).tolist(), (np.flatnonzero(stop) + 1).tolist()))


def paths(packs: DataFrame, sources: DataFrame, bits: int) -> DataFrame:
    """Step 3: (source, pack, at, words): paths of repeated edges with one source pack; ``at`` is the first word's number in the pack."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            words = _open(left.to_pylist()[0]).words
            at, h = words.edges()
            uniq, back = np.unique(h, return_inverse=True)
            cuts = np.searchsorted(uniq, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)) if bits else np.zeros(0, np.int64)
            lo = np.concatenate(([0], cuts, [len(uniq)]))
            src, z = np.full(len(uniq), -1, np.int64), zstandard.ZstdDecompressor()
            for r in right.to_pylist():
                a, b = lo[r["bucket"]], lo[r["bucket"] + 1]
                seen = np.unpackbits(np.frombuffer(r["seen"], np.uint8), count=b - a).astype(bool)
                got = np.ascontiguousarray(np.frombuffer(z.decompress(r["source"]), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
                src[a:b][seen] = got
            s = src[back]
            same = np.concatenate(([False], (s[1:] == s[:-1]) & (at[1:] == at[:-1] + 1)))
            out = [(int(s[a]), int(at[a]), words.text(at[a], at[b - 1] + K)) for a, b in _runs(same, s >= 0)]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array([key[0].as_py()] * len(cols[0]), pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["source", "pack", "at", "words"])

    return packs.groupBy("pack").cogroup(sources.groupBy("pack")).applyInArrow(run, "source long, pack long, at long, words binary")


def _verified(words: Words, at: np.ndarray, index: tuple[np.ndarray, np.ndarray], path: Words, pos: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int]]:
    """Nonbranching pieces of ``path`` (its edges at ``pos`` with hashes ``h``) that stand word for word in ``words``:
    (first word in the path, number of edges, first word in the source)."""
    uniq, first = index
    i = np.minimum(np.searchsorted(uniq, h), max(len(uniq) - 1, 0))
    found = uniq[i] == h if len(uniq) else np.zeros(len(h), bool)
    src = np.where(found, at[first[i]] if len(uniq) else -1, -1)
    same = np.concatenate(([False], (src[1:] == src[:-1] + 1) & (pos[1:] == pos[:-1] + 1)))
    out = []
    for a, b in _runs(same, found):
        p, q, n = int(pos[a]), int(src[a]), b - a
        if path.text(p, p + n - 1 + K) == words.text(q, q + n - 1 + K):
            out.append((p, n, q))
    return out


def spans(packs: DataFrame, found: DataFrame) -> DataFrame:
    """Step 4: (pack, at, n, src_id, src_at): verified spans of n edges; ``src_at`` counts words in document ``src_id``."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            p = _open(left.to_pylist()[0])
            at, h = p.words.edges()
            index = np.unique(h, return_index=True)
            base = p.first_word()
            texts = right.column("words").to_pylist()
            asked = Words.cut(texts)
            pos, ah = asked.edges()
            begin = np.searchsorted(asked.of, np.arange(len(texts)))
            into, own = right.column("pack").to_numpy(), right.column("at").to_numpy()
            for a, n, q in _verified(p.words, at, index, asked, pos, ah):
                i, d = int(asked.of[a]), int(p.words.of[q])
                out.append((int(into[i]), int(own[i]) + a - int(begin[i]), n, int(p.ids[d]), q - int(base[d])))
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["pack", "at", "n", "src_id", "src_at"])

    # A source that many paths ask for (the first of a large group of copies) is copied for each unit of its paths.
    size = packs.select(F.col("pack").alias("source"), F.octet_length("body").alias("size"))
    asks = found.groupBy("source").agg(F.sum(F.octet_length("words")).alias("asked"))
    hot = asks.join(size, "source").select("source", F.ceil(F.col("asked") / F.greatest(F.col("size"), F.lit(UNIT_BYTES))).cast("int").alias("units")).where("units > 1")
    hot = write_table(hot, "hot-sources")  # its size is then known: a short table joins without a shuffle by source
    left = packs.join(hot.withColumnRenamed("source", "pack"), "pack", "left").withColumn("unit", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("units") - 1, F.lit(0))))).drop("units")
    right = found.join(hot, "source", "left").withColumn("unit", F.pmod(F.xxhash64("pack", "at"), F.coalesce("units", F.lit(1))).cast("int")).drop("units")
    return left.groupBy("pack", "unit").cogroup(right.groupBy("source", "unit")).applyInArrow(run, "pack long, at long, n long, src_id long, src_at long")


def own_spans(p: Pack) -> list[tuple[int, int, int]]:
    """Step 5, inside a pack: (first word, edges, first word in the source) of repeats of a smaller document of the same pack."""
    at, h = p.words.edges()
    if not len(h):
        return []
    uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
    src = at[first[back]]
    of = p.ids[p.words.of]
    on = of[src] < of[at]
    same = np.concatenate(([False], (src[1:] == src[:-1] + 1) & (at[1:] == at[:-1] + 1)))
    out = []
    for a, b in _runs(same, on):
        s, q, n = int(at[a]), int(src[a]), b - a
        if p.words.text(s, s + n - 1 + K) == p.words.text(q, q + n - 1 + K):
            out.append((s, n, q))
    return out


def removed(packs: DataFrame, verified: DataFrame, keep_text: bool = False) -> DataFrame:
    """Step 5: (id, n_words, n_removed, kept_sha256[, text]) of each document; a null text stays null."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            p = _open(left.to_pylist()[0])
            n = len(p.words.start)
            gone = np.zeros(n + 1, np.int64)
            for a, m in zip(right.column("at").to_pylist(), right.column("n").to_pylist()):
                gone[a] += 1
                gone[a + m - 1 + K] -= 1
            for a, m, _ in own_spans(p):
                gone[a] += 1
                gone[a + m - 1 + K] -= 1
            left_over = np.cumsum(gone)[:n] == 0
            base, w = p.first_word(), p.words
            for i, (ident, known) in enumerate(zip(p.ids.tolist(), p.known.tolist())):
                lo, hi = int(base[i]), int(base[i + 1])
                k = np.flatnonzero(left_over[lo:hi]) + lo
                text = b" ".join([w.body[a:b] for a, b in zip(w.start[k].tolist(), w.end[k].tolist())])
                out.append((ident, hi - lo, hi - lo - len(k), hashlib.sha256(text).hexdigest(), text if known else None))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        t = pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "n_words", "n_removed", "kept_sha256", "text"])
        return t.set_column(4, "text", t.column(4).cast(pa.string())) if keep_text else t.drop_columns(["text"])

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    return packs.groupBy("pack").cogroup(verified.groupBy("pack")).applyInArrow(run, schema)


def untouched(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """The same columns for rows that lose nothing."""
    text_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [None if t is None else t.split() for t in rows_as_bytes(b, "text")]
            text = [b"" if k is None else b" ".join(k) for k in kept]
            cols = [b.column(0), pa.array([len(k or ()) for k in kept], pa.int64()), pa.array([0] * len(kept), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array([None if k is None else t.decode() for k, t in zip(kept, text)], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text)


def _settle(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows; its shuffle files are then free to go, and the cleaner is told so."""
    out = write_table(df, name, compression="none")
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, pack_chars: int = PACK_CHARS, bucket_edges: int = BUCKET_EDGES) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, text]): every document without the words that windows of a smaller document cover."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(16)).alias("n")).first().n or 0
    bits = max(0, (partitions_for(total, 6 * bucket_edges) - 1).bit_length())
    packs = _settle(pack(rows.where("id is not null"), pack_chars, total), "packs")
    sources = _settle(edge_sources(edge_blobs(packs, bits)), "edge-sources")
    found = _settle(paths(packs, sources, bits), "paths")
    drop_table(sources)
    verified = _settle(spans(packs, found), "spans")
    drop_table(found)
    out = removed(packs, verified, keep_text)
    lone = rows.where("id is null")
    return out.unionByName(untouched(lone, keep_text)) if lone.limit(1).count() else out
