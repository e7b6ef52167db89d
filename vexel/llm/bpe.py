"""Byte-pair encoding and decoding by a prefix-sharing trie traversal.

Distinct words are put into a trie, in byte order and so depth first. Each node holds the last token of the encoding of its prefix and
the state of an automaton over the vocabulary, so a prefix is encoded once, from its parent's state, however many words share
it: also words of later batches, as the trie stays (up to ``TRIE_NODES`` nodes). Token ``t`` is the last one of prefix ``p`` exactly if
``t`` encodes to itself and the pair (last token of ``p`` without ``t``, ``t``) encodes to itself; the candidates, tokens that
end ``p``, are those of the automaton's state.

Defined results: null and empty texts have no tokens. Strings of added tokens become their ids, as the tokenizer file says.
Texts of any length are encoded whole; a word of any length costs time in proportion to it. Rows that repeat or have null ids keep
their rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_as_bytes, text_batches

#: Words whose encodings a worker keeps between batches.
KEPT_WORDS = 300_000
#: Nodes above which the trie starts anew.
TRIE_NODES = 400_000


def byte_chars() -> dict[str, int]:
    """The character that byte-level vocabularies print for each byte: itself if visible, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Endings:
    """An automaton whose states tell the words of a vocabulary that end there, the longest first."""

    def __init__(self, vocab: dict[bytes, int]):
        self.next: dict[int, int] = {}  # state * 256 + byte; what fails is added when it is met
        self.found: list[tuple[tuple[int, int], ...]] = [()]  # of each state: (word, its length)
        for word, ident in vocab.items():
            s = 0
            for c in word:
                t = self.next.get(s << 8 | c)
                if t is None:
                    t = self.next[s << 8 | c] = len(self.found)
                    self.found.append(())
                s = t
            self.found[s] = ((ident, len(word)),)
        children: dict[int, list[tuple[int, int]]] = {}
        for k, t in self.next.items():
            children.setdefault(k >> 8, []).append((k & 255, t))
        self.fail = [0] * len(self.found)
        level = [t for _, t in children.get(0, ())]
        while level:
            nxt = []
            for s in level:
                self.found[s] += self.found[self.fail[s]]
                for c, t in children.get(s, ()):
                    self.fail[t] = self.step(self.fail[s], c)
                    nxt.append(t)
            level = nxt

    def step(self, s: int, c: int) -> int:
        key = s << 8 | c
        t = self.next.get(key)
        if t is None:
            t = self.step(self.fail[s], c) if s else 0
            if len(self.next) < 4_000_000:
                self.next[key] = t
        return t


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((raw(a), raw(b)), i)
        self.id_of = vocab
        self.bytes_of = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.added.items()}
        self.code = {v: v.to_bytes(4, "little") for v in self.bytes_of}
        self.size = {v: len(k) for v, k in ((v, k) for k, v in vocab.items())}
        self.ends = Endings(vocab)
        self.reset()
        self.words = regex.compile(pattern)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.rank:
            self.parts.setdefault(a + b, (a, b))
        self.alone: dict[int, bool] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain merging by rank: the definition, used on single tokens and pairs only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            a, b = parts[best], parts[best + 1]
            if (a, b) not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _ok(self, prev: int, tok: int) -> bool:
        ok = self.alone.get(tok)
        if ok is None:
            t = self.bytes_of[tok]
            ok = self.alone[tok] = self.merge(t) == [t]
        ok = ok and (prev < 0 or self._apart(prev, tok))
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[prev, tok] = ok
        return ok

    def _edge(self, tok: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at one edge of a token while it is merged, oldest first, each with the rank of the merge that uses it up."""
        out = self.edges[side].get(tok)
        if out is None:
            t, used = self.bytes_of[tok], float("inf")
            out = [(t, used)]
            while len(t) > 1:
                used, t = self.rank[self.parts[t]], self.parts[t][side]
                out.append((t, used))
            out.reverse()
            self.edges[side][tok] = out
        return out

    def _apart(self, prev: int, tok: int) -> bool:
        """No merge crosses the boundary of the two tokens: at each moment the pair at the boundary, if it has a merge at all,
        ranks behind a merge that uses up one of its sides (on the left an equal rank goes first)."""
        left, right = self._edge(prev, 1), self._edge(tok, 0)
        i = j = 0
        while True:
            (a, used_a), (b, used_b) = left[i], right[j]
            m = self.rank.get((a, b))
            if m is not None and m < used_a and m <= used_b:
                return False
            if used_a == used_b == float("inf"):
                return True
            if used_a <= used_b:
                i += 1
            else:
                j += 1

    def reset(self) -> None:
        """An empty trie: children by node * 256 + byte; of each node the automaton's state and the last token of its prefix."""
        self.child: dict[int, int] = {}
        self.state, self.last = [0], [-1]
        self.path, self.before = [0], b""  # the nodes on the way to the last word

    def encode_sorted(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of each of the words, which are in byte order, as little-endian 32-bit integers."""
        size, pairs, ok_of, code, found, step = self.size, self.pairs, self._ok, self.code, self.ends.found, self.ends.step
        jump = self.ends.next.get
        for w in words:
            if len(self.last) > TRIE_NODES:
                self.reset()
            child, state, last, path, before = self.child, self.state, self.last, self.path, self.before
            n = min(len(w), len(before))
            if w[:n] != before[:n]:
                n = next(i for i in range(n) if w[i] != before[i])
            del path[n + 1 :]
            node = path[n]
            for at in range(n, len(w)):
                c = w[at]
                key = node << 8 | c
                to = child.get(key)
                if to is None:
                    s = jump(state[node] << 8 | c)
                    if s is None:
                        s = step(state[node], c)
                    for tok, length in found[s]:
                        prev = last[path[at + 1 - length]]  # the root's is -1
                        ok = pairs.get((prev, tok))
                        if ok is None:
                            ok = ok_of(prev, tok)
                        if ok:
                            break
                    else:
                        raise ValueError("a byte is no token")
                    to = child[key] = len(last)
                    state.append(s)
                    last.append(tok)
                path.append(to)
                node = to
            self.before = w
            out, i = [], len(w)
            while i:
                t = last[path[i]]
                out.append(code[t])
                i -= size[t]
            out.reverse()
            yield b"".join(out)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split, find = self.split, self.words.findall
        cut = [split.split(t) if split and any(a in t for a in self.added) else [t] for t in texts]
        pieces = [[find(p) if i % 2 == 0 else p for i, p in enumerate(c)] for c in cut]
        known = self.known
        new = {w for c in pieces for p in c[::2] for w in p if w not in known}
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = {w for c in pieces for p in c[::2] for w in p}
        pairs = sorted((w.encode(), w) for w in new)
        known.update(zip((w for _, w in pairs), self.encode_sorted([b for b, _ in pairs])))
        get = known.__getitem__
        return [b"".join(self.code[self.added[p]] if i % 2 else b"".join(map(get, p)) for i, p in enumerate(c)) for c in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def tokenizer(path: str | None = None) -> Bpe:
    """The tokenizer of a file (the public byte-level one by default), loaded once a process."""
    if (path or "") not in _LOADED:
        import public_tokenizers

        _LOADED[path or ""] = Bpe(path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return _LOADED[path or ""]


def _slices(texts: Iterator[bytes | None], chars: int = 2_000_000) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append((t or b"").decode())
        n += len(held[-1])
        if n >= chars:
            yield held
            held, n = [], 0
    yield held


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, extra..., n_tokens, ids, ids_sha256, decoded_sha256): ids as little-endian unsigned 32-bit integers, and digests of the ids
    and of their decoding. One narrow pass: no shuffle, a worker's memory is bounded by ``TEXT_ROWS`` texts and ``KEPT_WORDS`` words.
    """
    text_batches(docs.sparkSession)
    added = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            ids = [x for part in _slices(rows_as_bytes(b, "text")) for x in bpe.encode_batch(part)]
            cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(sha, ids), pa.string()), pa.array((sha(bpe.decode(x).encode()) for x in ids), pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], *added])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *extra, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the texts of encoded ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")
