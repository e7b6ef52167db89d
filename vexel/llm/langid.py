"""Language identification: nearest centroid over TF-IDF n-gram vectors.

A text's characters are lower-cased, runs of non-letters become one gap, and its n-grams of one to three characters are hashed
into ``BUCKETS`` counts. Counts become 1 + ln(count), weighted by inverse document frequency and scaled to length one.
For each language several centroids come from spherical k-means over a bounded sample of labelled rows; the text
takes the language of the centroid with the greatest cosine.

Rejection is by distance, at comparable size: pieces of 4, 16, 64, ... letters of the sample's texts are scored against their
own language, and a text is rejected if its cosine is zero or lies under ``REJECT`` times what all but the worst hundredth of its
language's pieces reach that have as many different n-grams (interpolated by the logarithm of that number).

Defined results: texts that are null or have no letter are ``und`` with score 0 and rejected. Without any labelled row every
text is ``und``. Whole texts count, however long. Ties go to the language that comes first in the alphabet. Rows
with a null language or null id are never learned from. The sample, and with it the model, depends on the rows alone, not on
their order or partitions. Extra columns are ignored by ``predict`` and kept by ``keep_known``; repeated rows each keep theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, rows_as_bytes, text_batches, write_table

BUCKETS = 1 << 15
#: Labelled rows learned from, for each language at most; chosen by a hash of the id.
SAMPLE = 300
CENTROIDS = 4
#: Share of a language's own low cosines at a length under which a text is rejected.
REJECT = 0.5
_STEP = 1 << 20

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case letter as a number, 0 for what is no letter."""
    global _LETTERS
    if _LETTERS is None:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                out[c] = ord(low[0])
        _LETTERS = out
    return _LETTERS


_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


def ngram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of the n-grams of a whole text; None if it has no letter."""
    table, total, seen = letters(), np.zeros(BUCKETS, np.int64), False
    carry = np.zeros(1, np.uint32)  # the last symbols so far; a text begins and ends with a gap
    for at in range(0, len(text) + 1, _STEP):
        part = text[at : at + _STEP]
        a = table[np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)]
        if at + _STEP > len(text):
            a = np.append(a, np.uint32(0))
        a = a[(a != 0) | (np.concatenate((carry[-1:], a[:-1])) != 0)]
        seen = seen or bool(a.any())
        s = np.concatenate((carry, a))
        m = s[:-1] * np.uint32(0x85EBCA77) + s[1:] * np.uint32(0xC2B2AE3D)
        h1 = (a[a != 0] * np.uint32(0x9E3779B1)) >> _SHIFT
        h2 = (m[len(m) - len(a) :] ^ np.uint32(0x5BD1E995)) * np.uint32(0x27D4EB2F) >> _SHIFT
        h3 = (m[:-1] * np.uint32(0x165667B1) + s[2:] * np.uint32(0x9E3779B1)) * np.uint32(0x2C1B3C6D) >> _SHIFT
        total += np.bincount(np.concatenate((h1, h2, h3)), minlength=BUCKETS)
        carry = s[-2:]
    return total if seen else None


@dataclass
class Model:
    """Column i of ``centroids`` (unit columns) belongs to ``langs[i]``; ``least`` has for each language logarithms of numbers of
    different n-grams and the cosines under which texts with so many are rejected."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: dict[str, tuple[list[float], list[float]]]

    def score(self, text: str) -> tuple[str, float, bool]:
        counts = ngram_counts(text) if self.langs else None
        if counts is None:
            return "und", 0.0, True
        at = np.flatnonzero(counts)
        cos = cosines(at, counts[at], self.idf, self.centroids)
        best = int(cos.argmax())
        x = float(min(1.0, max(0.0, cos[best])))
        return self.langs[best], x, x <= 0 or x < np.interp(math.log(len(at)), *self.least[self.langs[best]])


def cosines(at: np.ndarray, n: np.ndarray, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of a text with ``n`` n-grams in buckets ``at`` to each column of ``centroids``."""
    w = (1 + np.log(n)) * idf[at]
    return w @ centroids[at] / np.linalg.norm(w)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(counts.shape, np.float32)
    np.log(counts, out=v, where=counts > 0, casting="unsafe")
    v = np.where(counts > 0, (1 + v) * idf, 0).astype(np.float32)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` unit centroids; starts from the means of ``k`` slices of the rows, so that a stray row founds no cluster."""
    k = min(k, len(v))
    c = np.array([v[i::k].sum(0) for i in range(k)])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        sums = np.array([v[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return c.astype(np.float32)


def pieces(text: str) -> list[tuple[int, str]]:
    """(k, piece) of 4 ** (k + 1) letters: k + 1 whole powers of four up to the text's letters, from places spread over it, and the text itself as -1."""
    out, k = [(-1, text)], 0
    at = np.flatnonzero(letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)])
    while (n := 4 ** (k + 1)) <= len(at):
        first = (len(at) - n) * (k + 1) // (k + 2)
        out.append((k, text[at[first] : at[first + n - 1] + 1]))
        k += 1
    return out


def learnable(id_col: str) -> Column:
    """Rows outside the held-out quarter."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", where: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` rows of each language among those that ``where`` keeps."""
    text_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (where if where is not None else F.lit(True)))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit("langid"), F.col(id_col)).alias("h"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model([], np.zeros((BUCKETS, 0), np.float32), np.ones(BUCKETS, np.float32), {})
    if not sizes:
        return none
    # A threshold on the hash keeps about twice the sample before the exact cut, so the ranking sees few rows of a language of any size.
    grid = 1 << 40
    keep = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(grid, int(grid * (2 * sample + 60) / n)))))
    near = rows.where(F.pmod("h", F.lit(grid)) < keep[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    near = near.withColumn("r", rank).where(F.col("r") <= sample).select("lang", "r", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), rows_as_bytes(b, "text")):
                for k, piece in pieces(t.decode()):
                    if (c := ngram_counts(piece)) is not None:
                        at = np.flatnonzero(c).astype(np.int32)
                        out.append((lang, r, k, at.tobytes(), c[at].astype(np.int32).tobytes()))
            if out:
                cols = list(zip(*out))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["lang", "r", "k", "at", "n"])

    counts = write_table(near.mapInArrow(count, "lang string, r int, k int, at binary, n binary"), "langid-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                df[np.frombuffer(x, np.int32)] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])

    parts = counts.where("k < 0").select("at").coalesce(8).mapInArrow(frequencies, "n long, df binary").collect()
    n, df = sum(r.n for r in parts), sum((np.frombuffer(r.df, np.int64) for r in parts), np.zeros(BUCKETS, np.int64))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["k", "r"], kind="stable")  # the order of the sample, whatever the shuffle brought
        rows = [(np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)) for at, n in zip(pdf["at"], pdf["n"])]
        k = pdf["k"].to_numpy()
        v = np.zeros((int((k < 0).sum()), BUCKETS), np.float32)
        for x, (at, n) in zip(v, rows):
            x[at] = n
        c = spherical_kmeans(weigh(v, idf), CENTROIDS)
        best = np.array([cosines(at, n, idf, c.T).max() for at, n in rows])
        size = np.log([len(at) for at, _ in rows])
        steps = [k == i for i in range(k.max() + 1)] or [k < 0]
        least = [[float(np.median(size[s])) for s in steps], [float(REJECT * np.quantile(best[s], 0.01)) for s in steps]]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "i": range(len(c)), "c": [x.tobytes() for x in c], "least": [least] * len(c)})

    found = sorted(counts.groupBy("lang").applyInPandas(cluster, "lang string, i int, c binary, least array<array<double>>").collect(), key=lambda r: (r.lang, r.i))
    drop_table(counts)
    if not found:
        return none
    return Model([r.lang for r in found], np.ascontiguousarray(np.array([np.frombuffer(r.c, np.float32) for r in found]).T), idf, {r.lang: (r.least[0], r.least[1]) for r in found})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """(id, extra..., lang_pred, score, rejected) from the text alone: a narrow pass with the model (centroids of each language: 128 KB
    each) broadcast."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *extra, F.col(text_col).cast("string").alias("text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score((t or b"").decode()) for t in rows_as_bytes(b, "text")]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns as they are."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score((t or b"").decode()) for t in rows_as_bytes(b, text_col)]
            yield b.filter(pa.array([not g[2] for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
