"""Benchmark decontamination: pigeonhole edit matching.

Texts are normalised (lower case, every run of characters that are no letters or digits becomes one space). A test item of m
characters may appear with up to k = floor(``rate`` * m) edits; it is split into k + 1 pieces, at least one of which must then
appear unchanged. One automaton finds all exact piece hits in a pass over each whole text, and around a hit Myers' bit-parallel
algorithm gives the least edit distance between the whole item and any part of the window.

The items go to the executors in blocks of at most ``BLOCK_CHARS`` characters, a proven size bound for each broadcast; with more
items there are more blocks, each run against all rows.

Defined results: null or blank texts and items match nothing; items shorter than ``FUZZY`` normalised characters match without
edits and on word boundaries only (scripts written without spaces have none). A leak's distance is the least in the whole text;
``times`` counts maximal runs of places where the item can end within its budget, for short items its occurrences (which may
overlap). Repeated items and documents each give their own rows, also those with null ids. Extra columns are ignored by
``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_as_bytes, text_batches

RATE = 0.05
#: Least normalised characters of an item that may differ by edits.
FUZZY = 24
BLOCK_CHARS = 4_000_000

_GAPS = re.compile(r"[\W_]+")
#: Characters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


def budget(item: str, rate: float) -> int:
    return int(rate * len(item)) if len(item) >= FUZZY else 0


def on_boundaries(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] begins and ends where words do."""
    cuts = [(text[i - 1], text[i]) for i in (a, b) if 0 < i < len(text)]
    return all(" " in (x, y) or _UNSPACED.match(x) or _UNSPACED.match(y) for x, y in cuts)


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): error budget plus one near-equal pieces."""
    n = budget(item, rate) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def positions(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def scores(peq: dict[str, int], m: int, window: str) -> Iterator[int]:
    """For each end in ``window``, the least edit distance of the item to a part that ends there: Myers' bit vectors as integers of m bits."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in window:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        yield score


def runs(peq: dict[str, int], m: int, k: int, window: str) -> tuple[int, int]:
    """(least distance, number of separate occurrences: maximal runs of ends within ``k``) of an item in ``window``."""
    least, times, inside = m, 0, False
    for d in scores(peq, m, window):
        if d <= k:
            times += not inside
            least = min(least, d)
        inside = d <= k
    return least, times


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items = [(i, t, budget(t, rate), positions(t)) for i, t in items]
        self.auto = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, _, _) in enumerate(self.items):
            for off, p in pieces(t, rate):
                where.setdefault(p, []).append((n, off))
        for p, places in where.items():
            self.auto.add_word(p, (len(p), places))
        if where:
            self.auto.make_automaton()
        self.any = bool(where)

    def leaks(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item id, least distance, number of separate occurrences) of the items in a text.

        The windows around an item's piece hits are joined where they overlap, so each part of the text is verified once.
        """
        if not self.any:
            return []
        t, found = normalise(text), {}
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.auto.iter(t):
            for n, off in places:
                _, item, k, _ = self.items[n]
                at = end + 1 - size - off  # where the item would begin without edits
                if len(item) < FUZZY:
                    if on_boundaries(t, at, end + 1):
                        found[n] = (0, found.get(n, (0, 0))[1] + 1)
                    continue
                lo, hi = at - k, at + len(item) + k
                mine = windows.setdefault(n, [])
                if mine and lo <= mine[-1][1] and hi >= mine[-1][0]:
                    mine[-1][:] = min(lo, mine[-1][0]), max(hi, mine[-1][1])
                else:
                    mine.append([lo, hi])
        for n, mine in windows.items():
            _, item, k, peq = self.items[n]
            joined: list[list[int]] = []
            for lo, hi in sorted(mine):
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(hi, joined[-1][1])
                else:
                    joined.append([lo, hi])
            got = [runs(peq, len(item), k, t[max(0, lo) : max(0, hi)]) for lo, hi in joined]
            least, times = min(d for d, _ in got), sum(c for _, c in got)
            if times:
                found[n] = (least, times)
        return [(self.items[n][0], d, times) for n, (d, times) in sorted(found.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Blocks of normalised items, streamed to the driver one partition at a time."""
    block, n = [], 0
    for r in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        t = normalise(r[1])
        if t:
            block.append((r[0], t))
            n += len(t)
            if n >= chars:
                yield block
                block, n = [], 0
    if block:
        yield block


def _with_block(docs: DataFrame, block: list[tuple[int, str]], rate: float) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(shared.value, rate)
        for b in batches:
            out = [(d, *x) for d, t in zip(b.column(0).to_pylist(), rows_as_bytes(b, "text")) if t for x in m.leaks(t.decode())]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item_id", "distance", "times"])

    return docs.mapInArrow(run, "id long, item_id long, distance long, times long")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id, item_id, distance, times): one row for each document and item that it holds within the item's error budget."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = [_with_block(rows, b, rate) for b in item_blocks(items, item_col, item_text_col)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "id long, item_id long, distance long, times long")
    return reduce(DataFrame.unionAll, parts)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are; each block of items filters what the one before left."""
    text_batches(docs.sparkSession)
    schema = docs.schema
    for block in item_blocks(items, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not (t and m.leaks(t.decode())) for t in rows_as_bytes(b, text_col)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
