"""Near-duplicates: SimHash by pigeonhole blocks, alone (``near_duplicates``) or checked by the Jaccard similarity of shingle sets
(``wide_near_duplicates``).

A text is cut into words (runs of anything but ASCII white space, A-Z lower-cased), its word shingles are hashed with XXH64
(seed 42), and bit i of the fingerprint is set if it is set in over half of the hashes. Fingerprints within ``k`` bits must
agree on at least ``blocks - k`` of ``blocks`` blocks of bits, so joining on every choice of ``blocks - k`` blocks finds every
such pair; the Hamming distance is then verified.

Defined results: a null or blank text has fingerprint zero and links like any other; fewer words than a shingle give one
shingle of all words; equal fingerprints are collapsed before the join, so copies are never paired with each other.
Rows with a null id keep their row with a null component. Extra columns are ignored by the operators.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, blocked, components, drop_table, hamming_links, popcount, rows_as_bytes, sorted_groups, text_batches, write_table

_U = np.uint64


def _mix(h: np.ndarray, i: int) -> np.ndarray:
    """Another 64 hash bits from ``h``: the finaliser of splitmix64 over a stepped value."""
    with np.errstate(over="ignore"):
        z = h + _U(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    words = (text or b"").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return np.zeros(0, _U)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], _U)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    xx = xxhash.xxh64_intdigest
    return np.array([xx(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], _U)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of hashes, ``words`` 64-bit words: bits set in over half of them. The first word uses the values themselves."""
    out = np.zeros(words, _U)
    if len(h):
        for w in range(words):
            x = _mix(h, w) if w else h
            n = np.zeros(64, np.int64)
            for at in range(0, len(x), 255):  # counts of 255 rows fit in a byte
                n += np.add.reduce(np.unpackbits(x[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
            out[w] = np.packbits(2 * n > len(x), bitorder="little").view(_U)[0]
    return out


def fingerprint(text: bytes | None, shingle: int = 3, words: int = 1) -> np.ndarray:
    return majority(shingle_hashes(text, shingle), words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1) -> DataFrame:
    """(id, fp0, ...): one row for each row of ``docs``."""
    text_batches(docs.sparkSession)
    names = ["id", *(f"fp{i}" for i in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, words) for t in rows_as_bytes(b, "text")], _U).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(words))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def block_masks(bits: int, blocks: int, k: int) -> list[int]:
    """Masks of every choice of ``blocks - k`` of ``blocks`` near-equal runs of bits."""
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in itertools.combinations(runs, blocks - k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_keys(prints: DataFrame, masks: list[tuple[str, int]]) -> DataFrame:
    """``prints`` with a row and its ``key`` for each (column, mask)."""
    return prints.withColumn("key", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col(c).bitwiseAND(F.lit(_signed(m)))) for i, (c, m) in enumerate(masks)))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, k: int = 2, blocks: int = 5) -> DataFrame:
    """(id, fingerprint long, component_id): components of fingerprints at ``k`` or fewer differing bits, named by their least id."""
    prints = write_table(fingerprints(docs, id_col, text_col, shingle), "simhash")
    reps = prints.groupBy("fp0").agg(F.min("id").alias("least"))
    masks = [("fp0", m) for m in block_masks(64, blocks, k)]
    links = hamming_links(reps.select(F.col("fp0").alias("id"), "fp0"), lambda p: block_keys(p, masks), 1, k)
    comp = components(links)
    labelled = reps.join(comp, reps.fp0 == comp.node, "left").select("fp0", "least", F.coalesce("component", "fp0").alias("c"))
    named = labelled.groupBy("c").agg(F.min("least").alias("component_id"))
    by_print = write_table(labelled.join(named, "c").select("fp0", "component_id"), "simhash-components")
    drop_table(comp)
    return prints.join(by_print, "fp0").select("id", F.col("fp0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Words of a set's SimHash and blocks of bits of a word: sets that differ in fewer bits than there are blocks share one.
WORDS, BLOCKS = 8, 4
#: Differing bits up to which sets that share a block are compared: at Jaccard similarity 0.8 some 15 % of the bits differ, 77 of 512
#: with a deviation of 8, so 4 pairs in 10,000 have more.
REACH = 104
PRINTS = [f"fp{i}" for i in range(WORDS)]
#: Rows of a bucket above which all are linked to one, unfiltered: links are candidates only, so none is lost.
HOT_BUCKET = 2048
#: Bytes of hashes in a block when the pairs of a group of candidates are compared.
BLOCK_BYTES = 16 << 20
#: Sets of up to so many hashes have keys by parts, which find every pair; sets of over four fifths of it have keys by bands.
SMALL = 128
#: Bands, and hashes of a band.
BANDS, BAND = 35, 5


@functools.cache
def size_classes(most: int) -> np.ndarray:
    """Last sizes of classes that grow by a quarter: sets of Jaccard similarity 0.8 lie in one class or in two that follow each other."""
    ends = [0]
    while ends[-1] < most:
        ends.append((ends[-1] + 1) * 5 // 4)
    return np.array(ends)


def differing(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """The most elements in which sets of ``a`` and ``b`` elements differ at Jaccard similarity 0.8 or more."""
    return (a + b) // 9


def partition_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes, of which any two sets at Jaccard similarity 0.8 or more share one.

    The hashes are dealt into parts by value. Sets that differ in at most d elements agree on one of any d + 1 parts, so a set
    gives the first d + 1 parts that hold anything, or all parts if there are not as many. The number of parts goes with the size class
    of the smaller set: a set gives keys for its own class and for the one below.
    """
    n, out = len(h), []
    ends = size_classes(1 << (n + 1).bit_length())
    own = int(np.searchsorted(ends, n))
    for c, most in ((own, n * 5 // 4), (own - 1, int(ends[own - 1]))):
        if c < 1 or n > ends[c] * 5 // 4 or not (d := differing(n, most)):
            continue  # no partner, or an equal set only
        parts = int(differing(ends[c], ends[c] * 5 // 4)) * 11 // 10 + 3
        at = ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        with np.errstate(over="ignore"):
            starts = np.flatnonzero(np.diff(at, prepend=-1))  # h is sorted, so parts come in order
            sums = np.add.reduceat(_mix(h, c + 1), starts)
            keys = _mix(sums ^ _mix(at[starts].astype(_U), 3), c + 1)
            if len(keys) <= d:
                empty = np.setdiff1d(np.arange(parts), at)
                keys = np.concatenate((keys, _mix(_mix(empty.astype(_U), 5), c + 1)))
        out.append(keys[: d + 1] if len(starts) > d else keys)
    return np.concatenate(out) if out else np.zeros(0, _U)


def band_keys(h: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set, each of ``BAND`` elements: those that follow the band's point in as many orders of the hashes.

    An element that follows a point in the union of two sets lies in both with the probability of their Jaccard similarity, so at
    0.8 two sets share a given band with probability 0.8 ** 5 = 0.33, and none of the bands with about (1 - 0.33) ** 35 = 1e-6.
    """
    at = (np.arange(BANDS, dtype=np.uint64) * _U((1 << 64) // BANDS)).astype(_U)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BAND):
            x = np.sort(_mix(h, 101 + i))
            key = _mix(key ^ x[np.searchsorted(x, at) % len(x)], 7)
    return key


def set_keys(h: np.ndarray) -> np.ndarray:
    """Keys of which two sets at Jaccard similarity 0.8 or more share one: two small sets always, others but for about 1 pair in a million."""
    parts = partition_keys(h) if len(h) <= SMALL else h[:0]
    return np.concatenate((parts, band_keys(h))) if len(h) > SMALL * 4 // 5 else parts


def shingle_set(text: bytes | None, shingle: int) -> tuple[np.ndarray, int]:
    """The sorted distinct hashes of a text and a hash of them all."""
    h = np.unique(shingle_hashes(text, shingle))
    return h, xxhash.xxh64_intdigest(h.tobytes(), 42) - (1 << 63)


def parity(h: np.ndarray) -> int:
    """64 bits of which no more differ between two sets than elements do."""
    return int((np.bincount((h & _U(63)).astype(np.int64), minlength=64) % 2 << np.arange(64)).sum())


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, digest, fp, n, bits, keys, fp0, ...): set hash, size, parity bits, keys and SimHash of each row (id, digest, text)."""
    text_batches(rows.sparkSession)
    names = ["id", "digest", "fp", "n", "bits", "keys", *PRINTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in rows_as_bytes(b, "text")]
            keys = [set_keys(h).view(np.int64) for h, _ in sets]
            cols = [pa.array([f for _, f in sets], pa.int64()), pa.array([len(h) for h, _ in sets], pa.int32()), pa.array([parity(h) for h, _ in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            fp = np.array([majority(h, WORDS) for h, _ in sets], _U).reshape(-1, WORDS)
            cols += [pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)

    return rows.mapInArrow(run, "id long, digest long, fp long, n int, bits long, keys array<long>, " + ", ".join(f"{c} long" for c in PRINTS))


def simhash_links(sets: DataFrame) -> DataFrame:
    """Spanning links (a, b) between sets (fp, fp0, ...) whose SimHashes share a block and differ in ``REACH`` bits or fewer: all pairs
    within ``WORDS * BLOCKS - 1`` bits share a block."""
    masks = [(c, m) for c in PRINTS for m in block_masks(64, BLOCKS, BLOCKS - 1)]
    return hamming_links(sets.select(F.col("fp").alias("id"), *PRINTS), lambda p: block_keys(p, masks), WORDS, REACH)


def candidate_links(keyed: DataFrame) -> DataFrame:
    """Spanning links (a, b) between sets (key, fp, n, bits) that share a key and whose sizes and parity bits allow similarity 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in sorted_groups(batches, ["key"]):
            ids, size = t.column("fp").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            bits = t.column("bits").to_numpy().view(np.uint64)
            forest, out = Forest(), []
            for g in np.flatnonzero(np.diff(bounds) > 1):
                lo, hi = bounds[g], bounds[g + 1]
                if hi - lo > HOT_BUCKET:
                    pairs = [(ids[lo], x) for x in ids[lo + 1 : hi].tolist()]
                else:
                    pairs = []
                    for r in range(lo, hi, 128):
                        e = min(r + 128, hi)
                        x, y = size[r:e, None], size[None, r:hi]
                        ok = (popcount(bits[r:e, None] ^ bits[None, r:hi]) <= differing(x, y)) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y))
                        i, j = np.nonzero(np.triu(ok, 1))
                        pairs += zip(ids[i + r].tolist(), ids[j + r].tolist())
                out += [(int(x), y) for x, y in pairs if x != y and forest.join(int(x), y)]
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def similar_links(sets: DataFrame) -> DataFrame:
    """Spanning links (a, b) between the sets (component, fp, hashes) of a component at Jaccard similarity 0.8 or more, by exact
    comparison of all pairs that no earlier link joins and whose sizes allow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in sorted_groups(batches, ["component", "unit_i", "unit_j"], 256):
            ids, held = t.column("fp").to_numpy(), t.column("hashes")
            forest, out = Forest(), []
            for lo, hi in zip(bounds, bounds[1:]):
                if hi - lo < 2:
                    continue
                rows = [np.frombuffer(held[k].as_py(), _U) for k in range(lo, hi)]
                n = np.array([len(x) for x in rows])
                order = np.argsort(n, kind="stable")  # partners by size lie side by side
                n, names = n[order], ids[lo:hi][order].tolist()
                rows = [rows[i] for i in order.tolist()]
                bits = np.array([parity(x) for x in rows], np.int64).view(_U)
                starts = np.concatenate(([0], np.cumsum(n)))
                words, where = np.unique(np.concatenate(rows), return_inverse=True)
                mark, of = np.zeros(len(words), bool), np.arange(hi - lo)
                for i in range(hi - lo - 1):
                    end = int(np.searchsorted(n, n[i] * 5 // 4, "right"))
                    left = np.arange(i + 1, end)
                    left = left[(of[left] != of[i]) & (popcount(bits[left] ^ bits[i]) <= differing(n[left], n[i]))]
                    while len(left):  # a few at first: in a group of copies the first links join the rest
                        some, left = left[:8], left[8:]
                        mark[where[starts[i] : starts[i + 1]]] = True
                        both = np.array([np.count_nonzero(mark[where[starts[j] : starts[j + 1]]]) for j in some.tolist()])
                        mark[where[starts[i] : starts[i + 1]]] = False
                        for j in some[5 * both >= 4 * (n[i] + n[some] - both)].tolist():
                            of[of == of[j]] = of[i]
                            if forest.join(names[i], names[j]):
                                out.append((names[i], names[j]))
                        left = left[of[left] != of[i]]
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return blocked(sets, "component", "fp", BLOCK_BYTES, F.octet_length("hashes")).mapInArrow(run, "a long, b long")


def wide_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, digest, component_id, keeper): components of texts whose sets of ``shingle``-word shingles have Jaccard similarity 0.8 or
    more, for each row; ``digest`` is xxhash64 of the text, ``keeper`` the (id, digest) that stands for the component, its least.

    SimHash gives the candidates (``simhash_links``); pairs at 0.8 that its blocks may miss come by further keys (``candidate_links``).
    Linked sets form groups, inside which all pairs are compared exactly (up to collisions of 64-bit hashes).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), F.col(text_col).cast("string").alias("text"))
    prints = write_table(shingle_sets(rows, shingle), "shingle-sets")
    one = [F.min(c).alias(c) for c in PRINTS]  # equal in all rows of a set
    reps = write_table(prints.groupBy("fp").agg(F.min(F.struct("id", "digest")).alias("least"), *one), "shingle-reps")
    first = prints.join(reps.select("fp", "least.id", "least.digest"), ["fp", "id", "digest"], "left_semi")
    near = write_table(simhash_links(reps), "simhash-links")
    rest = candidate_links(first.select(F.explode("keys").alias("key"), "fp", "n", "bits"))
    comp = components(near.unionByName(rest))
    drop_table(near)
    need = reps.join(comp, reps.fp == comp.node).select("least.id", "least.digest", "fp", "component")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle)[0].tobytes() for t in rows_as_bytes(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], ["fp", "component", "hashes"])

    texts = rows.join(need.hint("merge"), ["id", "digest"]).select("fp", "component", "text")  # grows with the corpus: not for a broadcast
    sets = write_table(texts.mapInArrow(hashes, "fp long, component long, hashes binary"), "shingle-hashes")
    same = components(similar_links(sets))
    for done in (comp, sets):
        drop_table(done)
    labelled = reps.join(same, reps.fp == same.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = labelled.groupBy("c").agg(F.min("least").alias("keeper"))
    by_print = write_table(labelled.join(named, "c").select("fp", "keeper"), "shingle-keepers")
    drop_table(reps)
    drop_table(same)
    return prints.select("id", "digest", "fp").join(by_print, "fp").select("id", "digest", F.col("keeper.id").alias("component_id"), "keeper")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near-duplicates the row with the least id (among equal ids: the least text hash), all columns as they are.

    Blank and null texts are no copies of each other: they stay, as do rows with a null id, which no group can be named by. Rows
    that repeat an id are told apart by their texts; of rows that repeat both one stays.
    """
    digest = F.xxhash64(F.col(text_col).cast("string"))
    blank = F.coalesce(F.trim(F.regexp_replace(F.col(text_col), r"[\x09-\x0D]", " ")), F.lit("")) == ""
    judged = F.col(id_col).isNotNull() & ~blank
    out = wide_near_duplicates(docs.where(judged).select(id_col, text_col), id_col, text_col)
    told = out.groupBy("id", "digest").agg(F.first("keeper").alias("keeper"), F.count(F.lit(1)).alias("times"))
    mine = F.struct("id", "digest") == F.col("keeper")
    gone = write_table(told.where(~mine | (F.col("times") > 1)).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), mine.alias("_one")), "near-duplicates")
    same = (F.col(id_col).cast("long") == F.col("_id")) & (digest == F.col("_digest"))
    rows = docs.join(gone.hint("merge"), same & judged, "left_anti")
    if gone.where("_one").limit(1).count():  # whole rows that repeat
        rows = rows.unionByName(docs.where(judged).join(gone.where("_one"), same, "left_semi").dropDuplicates([id_col, text_col]))
    return rows
