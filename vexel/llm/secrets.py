"""Secret scans: one deterministic automaton for all rules.

The rules' expressions are compiled together by subset construction, minimised and laid out as a transition array. Each text's bytes
pass through it once, and the accepting states met give the places where matches of each rule first end. From such a place
the rule's reversed automaton walks back over the match to its leftmost start, and the anchored one from there to its longest
end: bytes of matches only are read again. Matches that fail a rule's filter are dropped, without another try inside them.

Spans count code points, end exclusive. Defined results: null and empty texts have no spans; all bytes of a text of any
length are scanned; rows that repeat or have null ids keep their rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Dfa, compile_rules, earliest, parse, reverse
from .common import rows_as_bytes, text_batches


@dataclass(frozen=True)
class Rule:
    """``pattern`` proposes spans, ``keep`` drops those that fail. In a rule no match holds another that ends before it does."""

    kind: str
    pattern: str
    keep: Callable[[bytes], bool]
    ignore_case: bool = False


def _value_length(match: bytes) -> int:
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


#: The base kinds, in the order of their names in digests, then those this method adds. Minimum lengths of plain runs are
#: written into the expressions, which gives the same spans: a run's leftmost match takes the whole run.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: _value_length(m) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
    Rule("hex", r"[0-9a-f]{24,}", lambda m: True),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", lambda m: len(m) >= 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m) >= 15),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: len(m) >= 40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", lambda m: len(m) >= 39),
)
RULES = BASE + ADDED


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.pattern, r.ignore_case) for r in rules]
        self.all = compile_rules([earliest(t) for t in trees], True)
        self.one: list[tuple[Dfa, Dfa]] = [(compile_rules([reverse(t)], False), compile_rules([t], False)) for t in trees]

    def ends(self, data: bytes) -> dict[int, list[int]]:
        """Of each rule that matches, the places of the last bytes of its shortest matches: one pass over the bytes for all rules."""
        table, accepting = self.all.table, self.all.accepting
        s, met = 0, []
        for e, c in enumerate(data.translate(self.all.classes)):
            s = table[s + c]
            if s >= accepting:
                met.append((e, s))
        out: dict[int, list[int]] = {}
        for e, s in met:
            bits = self.all.rules[s // self.all.width]
            while bits:
                out.setdefault((bits & -bits).bit_length() - 1, []).append(e)
                bits &= bits - 1
        return out

    def rule_spans(self, data: bytes, i: int, ends: list[int]) -> Iterator[tuple[int, int]]:
        back, ahead = self.one[i]
        keep, at = self.rules[i].keep, 0
        for e in ends:
            if e < at:
                continue
            start, s, table, classes, accepting = None, 0, back.table, back.classes, back.accepting
            for x in range(e, at - 1, -1):
                s = table[s + classes[data[x]]]
                if s >= accepting:
                    start = x
                elif s == back.dead:
                    break
            if start is None:  # it would begin inside the match before
                continue
            end, s, table, classes, accepting = e + 1, 0, ahead.table, ahead.classes, ahead.accepting
            for x in range(start, len(data)):
                s = table[s + classes[data[x]]]
                if s >= accepting:
                    end = x + 1
                elif s == ahead.dead:
                    break
            if keep(data[start:end]):
                yield start, end
            at = end

    def spans(self, data: bytes) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points by start, then rule order."""
        out = [(a, b, i) for i, ends in self.ends(data).items() for a, b in self.rule_spans(data, i, ends)]
        if not out:
            return []
        cuts = sorted({x for a, b, _ in out for x in (a, b)})
        place, n, before = {}, 0, 0
        for c in cuts:
            n += len(data[before:c].decode("utf-8", "replace"))
            place[c], before = n, c
        return [(place[a], place[b], self.rules[i].kind) for a, b, i in sorted(out, key=lambda x: (x[0], x[2]))]


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner() -> Scanner:
    """The scanner of the default rules, compiled once a process."""
    if RULES not in _SCANNERS:
        _SCANNERS[RULES] = Scanner(RULES)
    return _SCANNERS[RULES]


def span_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans string, n_assign, n_access, n_hex, base_sha256). A narrow pass: no shuffle."""
    text_batches(docs.sparkSession)
    base = [r.kind for r in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for b in batches:
            found = [scan.spans(t or b"") for t in rows_as_bytes(b, "text")]
            own = [[s for s in f if s[2] in base] for f in found]
            cols = [pa.array(map(span_text, found), pa.string())]
            cols += [pa.array([sum(s[2] == k for s in f) for f in own], pa.int64()) for k in base]
            cols.append(pa.array([hashlib.sha256(span_text(f).encode()).hexdigest() for f in own], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "spans", *(f"n_{k}" for k in base), "base_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, spans string, n_assign long, n_access long, n_hex long, base_sha256 string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret (overlapping spans together) replaced by ``mark`` and ``length_col`` renewed where that was done.

    All rows stay, also those with null texts; the columns stay as they are.
    """
    text_batches(docs.sparkSession)
    at, names = docs.columns.index(text_col), docs.columns
    length_at = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for b in batches:
            texts = list(rows_as_bytes(b, text_col))
            lengths = b.column(length_at).to_pylist() if length_at is not None else [None] * len(texts)
            for i, t in enumerate(texts):
                spans = scan.spans(t) if t else []
                if spans:
                    s, out, end = t.decode(), [], 0
                    for a, z, _ in spans:
                        if a >= end:
                            out += [s[end:a], mark]
                        end = max(end, z)
                    texts[i] = "".join([*out, s[end:]]).encode()
                    lengths[i] = len(texts[i].decode())
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.binary()).cast(b.schema.field(at).type)
            if length_at is not None:
                cols[length_at] = pa.array(lengths, b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
