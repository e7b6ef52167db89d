"""A collection: versions of Parquet tables behind one manifest, with search, mutations, splits, packing, compaction and backups.

Tables of a version: ``frozen`` (id, v) and its cells, assignments and codes if an index was built; ``log``, the mutations since the
last compaction; ``base``, what compaction folded (id, v, meta, nums, deleted); ``centres``, entries and codes of the live cells.
Every write makes new tables and publishes manifest N + 1; a second writer of N + 1 fails. Calls with Python lists are bounded, and
their forms with frames keep rows on the executors; what a call brings to the driver are cells, counters and a batch's ids.

A search leaves the base as it is: what the log touches is folded once a version into a small table, base rows are anti-joined with
its ids, cells are probed first, and vectors are read for candidates only.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import metadata as M
from ..functions import vectors as V
from ..operators import ivf, residual, split, topk, transform
from ..operators.live import allocate, merge
from .store import Manifests, settle

STATE = "id long, v array<double>, meta map<string,array<string>>, nums map<string,array<bigint>>, deleted boolean"
LOG = "seq long, op string, id long, v array<double>, meta map<string,array<string>>, nums map<string,array<bigint>>, token string, digest string"
ID_LIMIT = (1 << 32) - 1
MAX_BATCH, MAX_BULK, EXACT_LIMIT = 100_000, 8192, 4096
#: Entries above a new capacity that a cell may hold, and the seed of the live cells' codes.
SCRATCH, LIVE_SEED = 512, 42


class IdempotencyConflict(ValueError):
    """A key came back with another payload."""


class BatchError(ValueError):
    """A batch stopped; ``committed_ids`` were written before."""

    def __init__(self, message: str, committed_ids: list[int]):
        super().__init__(message)
        self.committed_ids = committed_ids


@dataclass(frozen=True)
class SearchParams:
    """Budgets of a search. ``minimum``/``gap`` adapt the probes of the frozen tier, ``code_bytes`` bounds what they read."""

    nprobe: int
    rerank: int = 400
    minimum: int | None = None
    filtered_minimum: int | None = None
    gap: float = 0.0
    code_bytes: int | None = None
    top_k: int | None = None  # the most results that a calibrated profile answers for
    max_bytes: int | None = None  # of the candidates of a batch
    exact_limit: int = EXACT_LIMIT  # eligible rows up to which a search scores them all

    def __post_init__(self):
        if not 1 <= self.nprobe <= 1_000_000 or not 1 <= self.rerank <= 1_000_000:
            raise ValueError("nprobe and rerank lie in 1..1000000")
        if (self.max_bytes is not None and self.max_bytes < 1) or (self.top_k is not None and self.top_k < 1):
            raise ValueError("bounds are positive")

    @classmethod
    def default(cls, padded: int, cells: int, live_only: bool) -> SearchParams:
        return cls(1536 if live_only else min(cells, max(1, padded // 2)))

    @classmethod
    def from_profile(cls, profile, fingerprint: str) -> SearchParams:
        if not profile.validated or profile.fingerprint != fingerprint:
            raise ValueError("the profile is not validated for this index")
        return cls(profile.configuration["nprobe"], profile.configuration["rerank"], top_k=profile.configuration.get("top_k"))


def payload_digest(v: Sequence[float], keys: Iterable[str]) -> str:
    h = hashlib.sha256(np.asarray(v, np.float32).tobytes())
    for k in sorted(keys):
        h.update(len(k.encode()).to_bytes(4, "little") + k.encode())
    return h.hexdigest()


class Collection:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None, float_specs: M.FloatSpecs | None = None):
        self.spark, self.specs = spark, dict(float_specs or {})
        self.manifests = Manifests(spark, path)
        self.m: dict[str, Any] = self.manifests.load(version)
        self._pinned = version is not None
        self._fold: tuple[int, DataFrame] | None = None

    # ---- making and opening ----

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, cell_capacity: int | None = None, max_cells: int = 300_000, float_specs: M.FloatSpecs | None = None) -> Collection:
        """An empty collection that grows by splitting."""
        capacity = cell_capacity or split.default_capacity(dim)
        if not 1 <= dim <= V.MAX_DIM or not split.MIN_CAPACITY <= capacity <= split.MAX_CAPACITY or not 2 <= max_cells <= 1_000_000:
            raise ValueError("dim 1..1024, capacity 64..65536, max_cells 2..1000000")
        man = Manifests(spark, path)
        if man.files.exists():
            raise FileExistsError(path)
        man.publish({"version": 1, "dim": dim, "capacity": capacity, "max_cells": max_cells, "base_n": 0, "frozen": None, "base": None, "logs": [], "entries": None, "centres": None, "live_codes": None, "splits": 0, "rewritten": 0, "packed_seq": 0, "seq": 0, "count": 0, "index": None})
        return cls(spark, path, float_specs=float_specs)

    @classmethod
    def build_index(cls, spark: SparkSession, path: str, vectors: DataFrame, k: int, eps: float = 0.2, m: int = 3, seed: int = 42, nmax: int = 0, coarse: int = 0, neighbours: int = 64, float_specs: M.FloatSpecs | None = None, anchors: Sequence[int] | None = None) -> Collection:
        """A frozen index of ``vectors`` (id dense from 0, v) with ``k`` cells and up to ``m`` spilled assignments. With ``coarse`` cells a
        vector is first assigned to these, and only the ``neighbours`` cells near its coarse ones are scored. ``anchors``: the ids of the
        cells' vectors, instead of a seeded draw."""
        rows = vectors.select(F.col("id").cast("long").alias("id"), V.doubles("v").alias("v"))
        if nmax:
            rows = rows.where(F.col("id") < nmax)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"), F.min("id").alias("low"), F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("least"), F.countDistinct("id").alias("ids")).first()
        if not size.n or size.low != 0 or size.top != size.n - 1 or size.ids != size.n or size.dim != size.least or not 1 <= k <= size.n:
            raise ValueError("ids must be dense from 0, vectors of one length, k at most their number")
        if rows.where(~V.is_valid(F.col("v"), size.dim, False)).limit(1).count():
            raise ValueError("vectors must be finite")
        self = cls.create(spark, path, size.dim, float_specs=float_specs)
        frozen = self._save(rows.select("id", V.unit(F.col("v")).alias("v")), "frozen", "id")
        vec = spark.read.parquet(frozen)
        cells = self._save(ivf.cells(vec, list(anchors) if anchors is not None else ivf.anchor_ids(size.n, k, seed)), "cells")
        new = spark.read.parquet(cells)
        if coarse:
            old = ivf.cells(vec, ivf.anchor_ids(size.n, coarse, seed))
            rough = ivf.assign_through(vec, old, ivf.neighbours(old, new, neighbours), new, m)
        else:
            rough = ivf.assign(vec, new, m)
        assigned = self._save(ivf.spill(rough, eps), "assigned", "cell")
        self._publish(frozen=frozen, base_n=size.n, count=size.n, index={"cells": cells, "assigned": assigned, "k": k, "m": m, "eps": eps, "seed": seed})
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, float_specs: M.FloatSpecs | None = None, validate: bool = False) -> Collection:
        self = cls(spark, path, version, float_specs)
        codes_for = (self.m["index"] or {}).get("codes_for")
        if codes_for is not None and codes_for != self._binding():
            raise OSError("the codes belong to another index")
        if validate:
            self.validate()
        return self

    def validate(self) -> None:
        """Read the tables of the frozen index and refuse what a search could not use."""
        index = self.m["index"]
        if not index:
            return
        cells, assigned = (self.spark.read.parquet(index[t]) for t in ("cells", "assigned"))
        c = cells.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell").alias("cells"), F.min("cell").alias("low"), F.max("cell").alias("high"), F.min(F.size("q8")).alias("least"), F.max(F.size("q8")).alias("most"), F.min("top").alias("top"), F.max("top").alias("high_top")).first()
        if (c.n, c.cells, c.low, c.high) != (index["k"], index["k"], 0, index["k"] - 1) or (c.least, c.most) != (self.m["dim"],) * 2 or not 0 < c.top <= c.high_top < math.inf:
            raise OSError("the cell table is damaged")
        a = assigned.agg(F.min("cell").alias("low"), F.max("cell").alias("high"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum((F.col("slot") == 0).cast("int")).alias("n")).first()
        if not (0 <= a.low <= a.high < index["k"] and a.first == 0 and a.last == self.m["base_n"] - 1 and a.n == self.m["base_n"]):
            raise OSError("the assignments are damaged")
        if index.get("codes"):
            codes = self.spark.read.schema(residual.CODES).parquet(*index["codes"])
            dim = C.residual_dims(V.padded_dim(self.m["dim"]))
            bad = ~(F.col("gain").between(0, C.GAIN_MAX) & (F.abs("beta") <= 1.000001) & (F.octet_length("code") == dim)) | F.col("gain").isNull() | F.col("beta").isNull() | F.isnan("gain") | F.isnan("beta")
            if codes.where(bad).limit(1).count() or codes.count() != assigned.count():
                raise OSError("the codes are damaged")

    def _binding(self) -> str:
        """What codes are bound to: the assignments and parameters of the index they were made for."""
        i = self.m["index"]
        return hashlib.sha256(json.dumps([i["assigned"].rsplit("/", 1)[-1], i["cells"].rsplit("/", 1)[-1], i["k"], i["seed"], self.m["dim"], self.m["base_n"]]).encode()).hexdigest()

    def _vectors_below(self, n: int) -> DataFrame:
        return self.state().where(F.col("id") < n).select("id", "v")

    def build_residual(self, ranges: int = 8) -> None:
        """Residual codes of the frozen assignments: searches then cap candidates by code before the exact rerank.

        Codes are written by ranges of cells to a folder named after what they are bound to; a build that broke goes on behind the
        ranges that are complete, and a changed index starts another folder."""
        index = self.m["index"]
        if not index:
            raise ValueError("there is no frozen index")
        cells, assigned = (self.spark.read.parquet(index[t]) for t in ("cells", "assigned"))
        folder = f"codes-{self._binding()[:32]}"
        step = -(-index["k"] // ranges)
        for low in range(0, index["k"], step):
            part = f"{folder}/cells-{low}"
            if not self.manifests.files.exists(f"{part}/_SUCCESS"):
                some = F.col("cell").between(low, low + step - 1)
                codes = residual.encode(assigned.where(some), self._vectors_below(self.m["base_n"]), cells.where(some), index["seed"], V.padded_dim(self.m["dim"]))
                codes.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{self.manifests.root}/{part}")
        paths = [f"{self.manifests.root}/{folder}/cells-{low}" for low in range(0, index["k"], step)]
        self._publish(index={**index, "codes": paths, "codes_for": self._binding()})

    def build_transform(self, bits: int, cdim: int | None = None) -> None:
        """Transform codes of 1, 2 or 4 bits over the first ``cdim`` rotated dimensions; searches use them where there are no residual codes."""
        index, dim = self.m["index"], V.padded_dim(self.m["dim"])
        if not index:
            raise ValueError("there is no frozen index")
        if cdim is not None and not 1 <= cdim <= dim:
            raise ValueError("cdim lies in 1..padded dimension")
        vec = self._vectors_below(self.m["base_n"])
        scale = transform.scales(vec, bits, index["seed"], dim)[: cdim or dim]
        codes = transform.encode(self.spark.read.parquet(index["assigned"]), vec, scale, bits, index["seed"], dim, cdim)
        self._publish(index={**index, "transform": {"codes": self._save(codes, "transform", "cell"), "bits": bits, "scale": scale.tolist()}})

    def _save(self, df: DataFrame, name: str, by: str | None = None) -> str:
        path = self.manifests.table(name)
        if by:  # row groups get narrow ranges of ``by``, which scans prune on
            df = df.repartitionByRange(by).sortWithinPartitions(by)
        df.write.parquet(path)
        return path

    def _publish(self, **changes: Any) -> None:
        if self._pinned:
            raise OSError("a pinned version is read-only")
        new = {**self.m, **changes, "version": self.m["version"] + 1}
        self.manifests.publish(new)
        self.m = new

    # ---- state ----

    def _logs(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*self.m["logs"]) if self.m["logs"] else self.spark.createDataFrame([], LOG)

    def _base(self) -> DataFrame:
        if self.m["base"]:
            return self.spark.read.schema(STATE).parquet(self.m["base"])
        if not self.m["frozen"]:
            return self.spark.createDataFrame([], STATE)
        none = [F.expr(f"cast(map() as {t})").alias(c) for c, t in (("meta", "map<string,array<string>>"), ("nums", "map<string,array<bigint>>"))]
        return self.spark.read.parquet(self.m["frozen"]).select("id", "v", *none, F.lit(False).alias("deleted"))

    def _touched(self) -> DataFrame:
        """(id, v, meta, nums, deleted, moved) of the ids in the log: base rows and log folded, settled once a version.

        Rows are checked before they enter the log, so the fold need not. Added values are pre-aggregated by (id, field, value).
        """
        if self._fold and self._fold[0] == self.m["version"]:
            return self._fold[1]
        log = self._logs()
        whole = F.col("op").isin("insert", "update", "set")
        by_id = log.groupBy("id").agg(
            F.max_by("v", F.when(F.col("v").isNotNull(), F.col("seq"))).alias("nv"),
            F.max(F.when(whole, F.col("seq"))).alias("reset"),
            F.max_by(F.struct("meta", "nums"), F.when(whole, F.col("seq"))).alias("nm"),
            F.max(F.col("op") == "delete").alias("gone"),
            F.max(F.col("v").isNotNull()).alias("moved"),
        )
        added = log.where("op = 'add'").select("id", "seq", F.explode("meta").alias("field", "values"), "nums").select("id", "seq", "field", F.get("values", F.lit(0)).alias("value"), F.expr("get(nums[field], 0)").alias("number"))
        added = added.groupBy("id", "field", "value").agg(F.max("seq").alias("last"), F.first("number").alias("number")).groupBy("id").agg(F.collect_list(F.struct("field", "value", "number", "last")).alias("adds"))
        old = self._base().join(by_id.select("id"), "id", "left_semi")
        both = by_id.join(old, "id", "left").join(added, "id", "left")
        none_meta, none_nums = F.expr("cast(map() as map<string,array<string>>)"), F.expr("cast(map() as map<string,array<bigint>>)")
        fresh = F.col("reset").isNotNull()
        both = both.withColumns({"sm": F.coalesce(F.when(fresh, F.col("nm.meta")).otherwise(F.col("meta")), none_meta), "sn": F.coalesce(F.when(fresh, F.col("nm.nums")).otherwise(F.col("nums")), none_nums)})
        later = F.filter(F.coalesce("adds", F.array()), lambda a: a.getField("last") > F.coalesce("reset", F.lit(-1)))

        def union(start, value, kind):
            """Of each field its values and those added, each once."""
            some = F.filter(later, lambda a: a.getField(value).isNotNull())
            fields = F.array_distinct(F.concat(F.map_keys(start), F.transform(some, lambda a: a.getField("field"))))
            mine = lambda f: F.transform(F.filter(some, lambda a: a.getField("field") == f), lambda a: a.getField(value))
            return F.map_from_arrays(fields, F.transform(fields, lambda f: F.array_distinct(F.concat(F.coalesce(start[f], F.array().cast(kind)), mine(f)))))

        out = both.select("id", F.coalesce("nv", "v").alias("v"), union(F.col("sm"), "value", "array<string>").alias("meta"), union(F.col("sn"), "number", "array<bigint>").alias("nums"), (F.coalesce("deleted", F.lit(False)) | F.col("gone")).alias("deleted"), "moved")
        self._fold = (self.m["version"], settle(out, "touched"))
        return self._fold[1]

    def _untouched(self) -> DataFrame:
        """Base rows that the log leaves alone: an anti-join with the short table of touched ids."""
        return self._base().join(self._touched().select("id"), "id", "left_anti") if self.m["logs"] else self._base()

    def state(self) -> DataFrame:
        """(id, v, meta, nums, deleted): base and log folded."""
        cols = ("id", "v", "meta", "nums", "deleted")
        return self._untouched().select(*cols).unionByName(self._touched().select(*cols)) if self.m["logs"] else self._base()

    @property
    def count(self) -> int:
        """Allocated ids, deleted ones included."""
        return self.m["count"]

    @property
    def deleted_count(self) -> int:
        return self.state().where("deleted").count()

    def stats(self) -> dict[str, int]:
        gone = self.deleted_count
        tokens = self._ledger().select("token").distinct().count()
        return {"allocated": self.count, "deleted": gone, "active": self.count - gone, "idempotency_records": tokens, "log_rows": self._logs().count(), "version": self.m["version"]}

    def keys_table(self) -> DataFrame:
        """(key): the distinct metadata keys of visible documents."""
        return self.state().where(~F.col("deleted")).select(F.explode(M.key_column(F.col("meta"), F.col("nums"))).alias("key")).distinct()

    def keys(self, most: int = 1_000_000) -> list[str]:
        """The same as a sorted list; refused above ``most``."""
        k = [r.key for r in self.keys_table().limit(most + 1).collect()]
        if len(k) > most:
            raise ValueError(f"more than {most} keys: take keys_table()")
        return sorted(k)

    def values(self, field: str, pattern: str) -> list[str]:
        """The values of a field that an expression matches, as many as a filter may have and one more."""
        return M.matching(self.state().where(~F.col("deleted")), field, pattern)

    def fingerprint(self) -> str:
        """SHA-256 over the cells, the parameters and the size of the frozen tier."""
        parts = [json.dumps({k: self.m[k] for k in ("dim", "base_n")}, sort_keys=True)]
        if self.m["index"]:
            parts.append(json.dumps({k: self.m["index"][k] for k in ("k", "m", "eps", "seed")}, sort_keys=True))
            parts += [f"{r.cell}:{','.join(map(str, r.q8))}" for r in self.spark.read.parquet(self.m["index"]["cells"]).orderBy("cell").toLocalIterator()]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()

    # ---- mutations ----

    def _check_vector(self, v: Sequence[float]) -> list[float]:
        a = np.asarray(v, np.float32)
        if a.shape != (self.m["dim"],) or not np.isfinite(a).all() or not a.any():
            raise ValueError(f"a vector has {self.m['dim']} finite components, not all zero")
        a = a.astype(np.float64)
        return (a / math.sqrt(float(a @ a))).tolist()

    def _ledger(self) -> DataFrame:
        old = self.spark.read.parquet(self.m["ledger"]) if self.m.get("ledger") else None
        new = self._logs().where("token is not null").select("token", "digest", "id")
        return new if old is None else old.unionByName(new)

    def insert(self, vector: Sequence[float], metadata: Mapping[str, Any] | None = None, key: str | None = None) -> int:
        return self.insert_batch([vector], [metadata or {}], [key])[0]

    def insert_batch(self, vectors: Sequence[Sequence[float]], metadata: Sequence[Mapping[str, Any]] | None = None, keys: Sequence[str | None] | None = None) -> list[int]:
        """Ids of a batch. Everything is validated before anything is written. A key seen before with the same payload gives its old
        id; with another payload the rows before it are committed and reported by ``BatchError``."""
        n = len(vectors)
        metadata, keys = metadata or [{}] * n, keys or [None] * n
        if not n <= MAX_BATCH or len(metadata) != n or len(keys) != n:
            raise ValueError(f"at most {MAX_BATCH} vectors with as many metadata and keys")
        rows = []
        for v, md, k in zip(vectors, metadata, keys):
            if k is not None and not (isinstance(k, str) and 0 < len(k.encode()) <= 256):
                raise ValueError("a key is a string of 1 to 256 bytes")
            unit, (meta, nums) = self._check_vector(v), M.encode(md, self.specs)
            rows.append((unit, meta, nums, hashlib.sha256(k.encode()).hexdigest() if k else None, payload_digest(v, M.keys(meta, nums)) if k else None))
        tokens = {t for *_, t, _ in rows if t}
        known = {r.token: (r.digest, r.id) for r in self._ledger().join(F.broadcast(self.spark.createDataFrame([(t,) for t in tokens], "token string")), "token").collect()} if tokens else {}
        ids, new, conflict, at, seq = [], [], None, self.m["count"], self.m["seq"]
        for unit, meta, nums, token, digest in rows:
            if token in known:
                if known[token][0] != digest:
                    conflict = "the key was used with another payload"
                    break
                ids.append(known[token][1])
                continue
            if at >= ID_LIMIT:
                raise ValueError("no ids left")
            if token:
                known[token] = (digest, at)
            new.append((seq + len(new) + 1, "insert", at, unit, meta, nums, token, digest))
            ids.append(at)
            at += 1
        if new:
            self._append(new, count=at)
        if conflict:
            if n == 1:
                raise IdempotencyConflict(conflict)
            raise BatchError(conflict, ids)
        return ids

    def _append(self, rows: list[tuple], **changes: Any) -> None:
        path = self._save(self.spark.createDataFrame(rows, LOG), "log")
        self._publish(logs=[*self.m["logs"], path], seq=rows[-1][0], **changes)

    def _need(self, ids: Sequence[int], allow_deleted: bool = False) -> None:
        for i in ids:
            if isinstance(i, bool) or not isinstance(i, (int, np.integer)) or not 0 <= i < ID_LIMIT:
                raise ValueError(f"not an id: {i!r}")
        if any(i >= self.count for i in ids):
            raise OSError("unknown id")
        if not allow_deleted and self.state().where(F.col("id").isin([int(i) for i in ids]) & F.col("deleted")).limit(1).count():
            raise OSError("the document is deleted")

    def update(self, doc_id: int, vector: Sequence[float], metadata: Mapping[str, Any] | None = None) -> None:
        """Replaces the vector and all metadata."""
        unit, (meta, nums) = self._check_vector(vector), M.encode(metadata, self.specs)
        self._need([doc_id])
        self._append([(self.m["seq"] + 1, "update", int(doc_id), unit, meta, nums, None, None)])

    def delete(self, *ids: int) -> None:
        """Idempotent; ids are never used again."""
        self._need(ids, allow_deleted=True)
        if ids:
            self._append([(self.m["seq"] + 1 + n, "delete", int(i), None, None, None, None, None) for n, i in enumerate(ids)])

    def set_metadata(self, doc_id: int, metadata: Mapping[str, Any]) -> None:
        meta, nums = M.encode(metadata, self.specs)
        self._need([doc_id])
        self._append([(self.m["seq"] + 1, "set", int(doc_id), None, meta, nums, None, None)])

    def add_metadata(self, ids: Sequence[int], metadata: Mapping[str, Any]) -> None:
        """Adds one value to up to 8192 documents; an unknown or deleted id rejects the whole call."""
        meta, nums = M.encode(metadata, self.specs)
        if not 1 <= len(ids) <= MAX_BULK or len(meta) != 1 or len(next(iter(meta.values()))) != 1:
            raise ValueError("one field with one value, 1 to 8192 ids")
        self._need(ids)
        self._append([(self.m["seq"] + 1 + n, "add", int(i), None, meta, nums, None, None) for n, i in enumerate(dict.fromkeys(map(int, ids)))])

    # ---- mutations by frames: the same rules, rows stay on the executors ----

    def insert_frame(self, rows: DataFrame, order: str = "seq") -> DataFrame:
        """Insert rows (order, v[, meta, nums][, key]) of any number and return (order, id).

        ``meta`` and ``nums`` are the maps of ``functions.metadata.encode``. Keys are idempotent as in ``insert_batch``: the first row of
        a key counts, rows that bring it again with the same payload get its id. With another payload, the rows before the
        first such one are committed, and a ``BatchError`` is raised.
        """
        null = {"meta": "map<string,array<string>>", "nums": "map<string,array<bigint>>", "key": "string"}
        cols = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in null.items()]
        rows = rows.select(F.col(order).cast("long").alias("ord"), V.doubles("v").alias("v"), *cols)
        wrong = ~V.is_valid(F.col("v"), self.m["dim"]) | F.col("ord").isNull() | (F.col("key").isNotNull() & ~F.octet_length("key").between(1, 256))
        if rows.where(wrong).limit(1).count():
            raise ValueError(f"vectors have {self.m['dim']} finite components, not all zero; keys 1 to 256 bytes")

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tokens, digests = [], []
                for v, meta, nums, key in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                    tokens.append(hashlib.sha256(key.encode()).hexdigest() if key is not None else None)
                    digests.append(payload_digest(v, M.keys(dict(meta or ()), dict(nums or ()))) if key is not None else None)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(tokens, pa.string()), pa.array(digests, pa.string())], ["ord", "v", "meta", "nums", "token", "digest"])

        ready = rows.mapInArrow(prepare, "ord long, v array<double>, meta map<string,array<string>>, nums map<string,array<bigint>>, token string, digest string")
        ready = settle(ready.withColumn("v", V.unit(F.col("v").cast("array<float>").cast("array<double>"))), "insert")
        first = ready.where("token is not null").groupBy("token").agg(F.min("ord").alias("o1"), F.min_by("digest", "ord").alias("d1"))
        old = self._ledger().join(first.select("token"), "token", "left_semi").select("token", F.col("digest").alias("d0"), F.col("id").alias("id0"))
        seen = ready.select("ord", "token", "digest").join(first, "token", "left").join(old, "token", "left")
        seen = settle(seen.select("ord", "token", "id0", (F.coalesce("d0", "d1") != F.col("digest")).alias("other"), (F.col("token").isNull() | (F.col("id0").isNull() & (F.col("ord") == F.col("o1")))).alias("new")), "seen")
        stop = seen.where("other").agg(F.min("ord")).first()[0]
        if stop is not None:
            seen = seen.where(F.col("ord") < stop)
        ids = settle(allocate(seen.where("new").select("ord", "token"), "ord", self.m["count"]), "ids")
        n = ids.count()
        if self.m["count"] + n > ID_LIMIT:
            raise ValueError("no ids left")
        if n:
            log = ready.drop("token").join(ids, "ord").select((F.col("new_id") - self.m["count"] + self.m["seq"] + 1).cast("long").alias("seq"), F.lit("insert").alias("op"), F.col("new_id").cast("long").alias("id"), "v", "meta", "nums", "token", "digest")
            self._publish(logs=[*self.m["logs"], self._save(log, "log")], seq=self.m["seq"] + n, count=self.m["count"] + n)
        mine = seen.join(ids.select("ord", "new_id"), "ord", "left").join(ids.where("token is not null").select("token", F.col("new_id").alias("first_id")), "token", "left")
        out = mine.select(F.col("ord").alias(order), F.coalesce("id0", "new_id", "first_id").cast("long").alias("id"))
        if stop is not None:
            raise BatchError(f"the key of row {stop} was used with another payload", [r.id for r in out.orderBy(order).limit(MAX_BATCH).collect()])
        return out

    def _append_frame(self, op: str, rows: DataFrame, allow_deleted: bool = False) -> int:
        """Check the ids of rows (id, v, meta, nums) and append them in the order of ids."""
        rows = settle(rows.select(F.col("id").cast("long").alias("id"), "v", "meta", "nums"), "mutation")
        if rows.where(F.col("id").isNull() | ~F.col("id").between(0, self.count - 1)).limit(1).count():
            raise OSError("unknown id")
        if not allow_deleted and rows.join(self.state().where("deleted").select("id"), "id", "left_semi").limit(1).count():
            raise OSError("a document is deleted")
        n = rows.count()
        if n:
            log = allocate(rows, "id", self.m["seq"] + 1).select(F.col("new_id").cast("long").alias("seq"), F.lit(op).alias("op"), "id", "v", "meta", "nums", F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("digest"))
            self._publish(logs=[*self.m["logs"], self._save(log, "log")], seq=self.m["seq"] + n)
        return n

    def _frame(self, rows: DataFrame, vectors: bool, metadata: bool) -> DataFrame:
        none_v = F.lit(None).cast("array<double>")
        maps = [F.coalesce(F.col(c), F.expr(f"cast(map() as {t})")).alias(c) if metadata and c in rows.columns else F.expr(f"cast({'map()' if metadata else 'null'} as {t})").alias(c) for c, t in (("meta", "map<string,array<string>>"), ("nums", "map<string,array<bigint>>"))]
        if vectors and rows.where(~V.is_valid(V.doubles("v"), self.m["dim"])).limit(1).count():
            raise ValueError(f"vectors have {self.m['dim']} finite components, not all zero")
        return rows.select("id", (V.unit(V.doubles("v").cast("array<float>").cast("array<double>")) if vectors else none_v).alias("v"), *maps)

    def update_frame(self, rows: DataFrame) -> int:
        """Replace vectors and metadata of rows (id, v[, meta, nums]), one row an id."""
        return self._append_frame("update", self._frame(rows, True, True))

    def set_metadata_frame(self, rows: DataFrame) -> int:
        """Replace the metadata of rows (id, meta, nums), one row an id."""
        return self._append_frame("set", self._frame(rows, False, True))

    def delete_frame(self, ids: DataFrame) -> int:
        return self._append_frame("delete", self._frame(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), False, False), True)

    def add_metadata_frame(self, ids: DataFrame, metadata: Mapping[str, Any]) -> int:
        """Add one value to any number of documents; an unknown or deleted id rejects the whole call."""
        meta, nums = M.encode(metadata, self.specs)
        if len(meta) != 1 or len(next(iter(meta.values()))) != 1:
            raise ValueError("one field with one value")
        field, (value,) = next(iter(meta.items()))
        number = nums.get(field)
        rows = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        rows = rows.withColumn("meta", F.create_map(F.lit(field), F.array(F.lit(value))))
        rows = rows.withColumn("nums", F.create_map(F.lit(field), F.array(*(F.lit(int(x)).cast("long") for x in number))) if number else F.expr("cast(map() as map<string,array<bigint>>)"))
        return self._append_frame("add", self._frame(rows, False, True))

    # ---- search ----

    def search(self, queries: DataFrame, top_k: int, where: Mapping[str, Any] | None = None, allowed: DataFrame | None = None, params: SearchParams | None = None) -> DataFrame:
        """(qid, rank, id, score) for a batch of queries (qid, q). Filters come before every cap; few eligible rows are scored exactly."""
        p = params or SearchParams.default(V.padded_dim(self.m["dim"]), (self.m["index"] or {"k": 1})["k"], not self.m["index"])
        if not 1 <= top_k <= min(p.rerank, p.top_k or p.rerank):
            raise ValueError("top_k lies in 1..rerank, and within the profile's")
        if queries.where(~V.is_valid(V.doubles("q"), self.m["dim"])).limit(1).count():
            raise ValueError("query vectors must be finite and not zero")
        if p.max_bytes is not None and queries.count() * p.rerank * 24 > p.max_bytes:
            raise MemoryError("the candidates of this batch exceed max_bytes")
        sift = self._sieve(where, allowed)
        filtered = bool(where) or allowed is not None
        if not (self.m["index"] or self.m["entries"]):
            return topk.exact_top_k(sift(self.state()), queries, top_k)
        if filtered and sift(self.state()).select("id").limit(p.exact_limit + 1).count() <= p.exact_limit or not filtered and self.m["count"] <= p.exact_limit:
            return topk.exact_top_k(sift(self.state()), queries, top_k)
        tiers = []
        low = F.col("id") < self.m["base_n"]
        untouched, touched = self._untouched(), self._touched() if self.m["logs"] else None
        rest = sift(untouched.where(~low)) if self.m["base"] or not self.m["index"] else None
        if touched is not None:
            more = sift(touched.where(~low | F.col("moved")) if self.m["index"] else touched)
            rest = more if rest is None else rest.select("id", "v").unionByName(more.select("id", "v"))
        if self.m["index"]:
            usable = self._usable(sift if filtered else None)
            probes, hit = self.frozen_candidates(queries, p, sift if filtered else None, usable)
            vectors = untouched.where(low).select("id", "v")
            if touched is not None:
                vectors = vectors.unionByName(touched.where(low & ~F.col("moved")).select("id", "v"))
            if hit is None:
                entries = usable(self.spark.read.parquet(self.m["index"]["assigned"]).select("id", "cell")).join(vectors, "id")
                tiers.append(topk.scan_cells(probes, entries, queries, top_k))
            else:
                tiers.append(ivf.rerank(hit, vectors, queries, top_k))
        if rest is not None:
            if self.m["entries"]:
                tail = self._logs().where((F.col("seq") > self.m["packed_seq"]) & F.col("v").isNotNull()).select("id").distinct()
                old = rest.select("id", "v").join(tail, "id", "left_anti")
                tiers.append(self._live_best(queries, p, old, top_k))
                rest = rest.join(tail, "id", "left_semi")
            tiers.append(topk.exact_top_k(rest, queries, top_k))
        return topk.rank(merge(*tiers), top_k, digits=topk.DIGITS).select("qid", "rank", "id", "score")  # equal vectors tie whichever tier scored them

    def _sieve(self, where: Mapping[str, Any] | None, allowed: DataFrame | None):
        """A function that keeps the visible rows that pass the filters."""
        keep = ~F.col("deleted") & (M.where(where, self.values, self.specs) if where else F.lit(True))
        ids = allowed.select(F.col(allowed.columns[0]).cast("long").alias("id")).distinct() if allowed is not None else None

        def sift(rows: DataFrame) -> DataFrame:
            rows = rows.where(keep)
            return rows.join(ids, "id", "left_semi") if ids is not None else rows

        return sift

    def _usable(self, sift=None):
        """A function that takes from the frozen tier's entries what is filtered, moved or deleted."""
        low, touched = F.col("id") < self.m["base_n"], self._touched() if self.m["logs"] else None
        if sift is not None:
            good = sift(self._untouched().where(low)).select("id")
            if touched is not None:
                good = good.unionByName(sift(touched.where(low & ~F.col("moved"))).select("id"))
            return lambda e: e.join(good, "id", "left_semi")
        gone = [self._base().where("deleted").select("id")] if self.m["base"] else []
        gone += [touched.where(F.col("deleted") | F.col("moved")).select("id")] if touched is not None else []
        bad = reduce(DataFrame.unionAll, gone).distinct() if gone else None
        return lambda e: e.join(bad, "id", "left_anti") if bad is not None else e

    def frozen_candidates(self, queries: DataFrame, p: SearchParams, sift=None, usable=None) -> tuple[DataFrame, DataFrame | None]:
        """(probes, candidates (qid, id)) of the frozen tier: cells first; their entries lose what is filtered, moved or deleted before any
        cap. Candidates are None where no cap can drop one, as there are no codes or fewer entries than the budget: all entries of the
        probed cells are candidates then."""
        index, usable = self.m["index"], usable or self._usable(sift)
        cells, assigned = (self.spark.read.parquet(index[t]) for t in ("cells", "assigned"))
        probes = settle(self._probes(queries, cells, assigned, p, sift is not None), "probes")
        near = probes.select("cell").distinct()
        pad = V.padded_dim(self.m["dim"])
        if not (index.get("codes") or index.get("transform")) or assigned.count() <= p.rerank:
            return probes, None
        if index.get("codes"):
            codes = usable(self.spark.read.schema(residual.CODES).parquet(*index["codes"]).join(near, "cell", "left_semi"))
            return probes, residual.candidates(probes, codes, queries, cells, index["seed"], pad, p.rerank, index["m"])
        t = index["transform"]
        codes = usable(self.spark.read.schema(transform.CODES).parquet(t["codes"]).join(near, "cell", "left_semi"))
        return probes, transform.candidates(codes, queries, np.array(t["scale"]), t["bits"], index["seed"], pad, p.rerank, probes)

    def _live_best(self, queries: DataFrame, p: SearchParams, old: DataFrame, top_k: int) -> DataFrame:
        """(qid, id, score) of the packed live rows ``old`` (id, v). A budget of all cells or entries needs neither probes nor codes."""
        entries = self.spark.read.parquet(self.m["entries"]).select("id", "cell")
        if entries.count() > p.rerank:
            return ivf.rerank(self.live_candidates(queries, p, old), old, queries, top_k)
        if p.nprobe >= entries.select("cell").distinct().count():
            return topk.exact_top_k(old.join(entries.select("id"), "id", "left_semi"), queries, top_k)
        return topk.scan_cells(self._live_probes(queries, p.nprobe, entries), entries.join(old, "id"), queries, top_k)

    def live_candidates(self, queries: DataFrame, p: SearchParams, old: DataFrame) -> DataFrame:
        """(qid, id) of the packed live tier: entries of the probed cells by code, twice ``rerank`` of them, then distinct ids."""
        codes = self.spark.read.schema(residual.CODES).parquet(self.m["live_codes"])
        probes = settle(self._live_probes(queries, p.nprobe, codes), "probes")
        codes = codes.join(probes.select("cell").distinct(), "cell", "left_semi").join(old.select("id"), "id", "left_semi")
        return residual.candidates(probes, codes, queries, self._live_cells(), LIVE_SEED, V.padded_dim(self.m["dim"]), p.rerank, 2)

    def _probes(self, queries: DataFrame, cells: DataFrame, assigned: DataFrame, p: SearchParams, filtered: bool) -> DataFrame:
        k = self.m["index"]["k"]
        routed = ivf.route(queries, cells, min(p.nprobe, k))
        least = p.filtered_minimum if filtered and p.filtered_minimum else p.minimum
        if least:
            n = ivf.adaptive_probes(routed, least, p.gap, min(p.nprobe, k))
            routed = routed.join(F.broadcast(n), "qid").where(F.col("rank") <= F.col("probes")).drop("probes")
        if p.code_bytes is not None:
            sizes = ivf.histogram(assigned, k, 72).select("cell", (F.col("n") * 72).alias("bytes"))
            routed = ivf.byte_budget(routed, sizes, p.code_bytes)
        return routed

    def _centres(self) -> np.ndarray | None:
        """The int8 centres of the live cells, bounded by ``max_cells``."""
        if not self.m["centres"]:
            return None
        rows = self.spark.read.parquet(self.m["centres"]).orderBy("cell").toLocalIterator()
        return np.array([r.q8 for r in rows], np.int8)

    def _live_cells(self) -> DataFrame:
        return self.spark.read.parquet(self.m["centres"]).select("cell", "q8", F.lit(127.0).alias("top"))

    def _live_probes(self, queries: DataFrame, nprobe: int, entries: DataFrame) -> DataFrame:
        """(qid, cell): the best cells of each query among those that hold entries."""
        rows = queries.select(F.col("qid").alias("id"), F.col("q").alias("v"))
        filled = np.array(sorted(r.cell for r in entries.select("cell").distinct().collect()), np.int32)
        return split.attach(rows, self._centres()[filled], min(nprobe, len(filled)), filled).select(F.col("id").alias("qid"), "cell")

    def recall(self, queries: DataFrame, top_k: int, params: SearchParams) -> DataFrame:
        truth = topk.exact_top_k(self.state().where(~F.col("deleted")), queries, top_k)
        return ivf.recall(self.search(queries, top_k, params=params), truth, top_k)

    def diagnose(self, queries: DataFrame, top_k: int, params: SearchParams, truth: DataFrame | None = None) -> DataFrame:
        """(qid, watched, routed, candidates): how many true neighbours the frozen tier's probed cells hold, and how many survive the cap."""
        if not self.m["index"] or self.m["logs"]:
            raise ValueError("losses are told for a frozen index without a log")
        truth = truth if truth is not None else topk.exact_top_k(self.state().where(~F.col("deleted")), queries, top_k)
        probes, kept = self.frozen_candidates(queries, params)
        return ivf.losses(truth, probes, self.spark.read.parquet(self.m["index"]["assigned"]), kept)

    # ---- maintenance ----

    def _live(self) -> DataFrame:
        """(id, v) of what no frozen cell holds: later ids, and replaced vectors."""
        low = F.col("id") < self.m["base_n"]
        rows = self._untouched().where(~low & ~F.col("deleted")).select("id", "v")
        if not self.m["logs"]:
            return rows
        return rows.unionByName(self._touched().where(~F.col("deleted") & (~low | F.col("moved"))).select("id", "v"))

    def pack(self, rebuild: bool = False) -> dict[str, int]:
        """Route what is live into cells, split until none exceeds the capacity, and encode the entries; later rows are searched exactly
        until the next pack. ``rebuild`` grows the cells anew from the first live vector on."""
        centres = None if rebuild else self._centres()
        vecs = settle(self._live(), "live")
        entries = settle(split.attach(vecs, centres).select("id", "slot", "cell"), "entries") if centres is not None else None
        centres, entries, done = split.grow(vecs, self.m["capacity"], self.m["max_cells"], centres, entries)
        if not len(centres):
            self._publish(entries=None, centres=None, live_codes=None, packed_seq=self.m["seq"])
            return self.cell_stats()
        table = self._save(self.spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, q8 array<int>"), "centres")
        kept = self._save(entries, "entries", "cell")
        codes = residual.encode(self.spark.read.parquet(kept), vecs, self.spark.read.parquet(table), LIVE_SEED, V.padded_dim(self.m["dim"]))
        self._publish(entries=kept, centres=table, live_codes=self._save(codes, "live_codes", "cell"), splits=self.m["splits"] + done["splits"], rewritten=self.m["rewritten"] + done["rewritten"], packed_seq=self.m["seq"])
        return self.cell_stats()

    flush_splits = pack

    def rebuild_cells(self) -> dict[str, int]:
        """Derive the live cells again from the state, as after a damaged or lost table of theirs."""
        return self.pack(rebuild=True)

    def unpacked(self) -> int:
        """Rows with vectors behind the last pack."""
        return self._logs().where((F.col("seq") > self.m["packed_seq"]) & F.col("v").isNotNull()).count()

    def cell_stats(self) -> dict[str, int]:
        base = {"max_cells": self.m["max_cells"], "capacity": self.m["capacity"], "splits": self.m["splits"], "rewritten": self.m["rewritten"], "packed_seq": self.m["packed_seq"], "seq": self.m["seq"], "unpacked": self.unpacked()}
        if not self.m["entries"]:
            return {**base, "cells": 0, "filled_cells": 0, "largest_cell": 0, "smallest_cell": 0, "entries": 0, "pending": 0}
        return {**base, "cells": self.spark.read.parquet(self.m["centres"]).count(), **split.cell_stats(self.spark.read.parquet(self.m["entries"]), self.m["capacity"])}

    @property
    def cell_capacity(self) -> int:
        return self.m["capacity"]

    def set_cell_capacity(self, capacity: int) -> None:
        """Takes effect with the next pack; raising it merges nothing. Refused while a cell holds over ``SCRATCH`` entries more and could
        still be split: pack first, or lower it in steps."""
        if not split.MIN_CAPACITY <= capacity <= split.MAX_CAPACITY:
            raise ValueError("capacity lies in 64..65536")
        s = self.cell_stats()
        if s["largest_cell"] > capacity + SCRATCH and s["cells"] < self.m["max_cells"]:
            raise OSError(f"a cell holds {s['largest_cell']} entries")
        self._publish(capacity=capacity)

    def compact(self) -> int:
        """Fold the log into a new base; ids, scores, metadata and idempotency keys stay. Returns the log rows saved."""
        rows = self._logs().count()
        if not rows:
            return 0
        base = self._save(self.state(), "base", "id")
        ledger = self._save(self._ledger(), "ledger")
        index, residuals, coded = self.m["index"], bool((self.m["index"] or {}).get("codes")), (self.m["index"] or {}).get("transform")
        if index:  # replaced frozen vectors move to the cells of their new place
            live = settle(self._live().where(F.col("id") < self.m["base_n"]), "live")
            old, cells = self.spark.read.parquet(index["assigned"]), self.spark.read.parquet(index["cells"])
            new = ivf.spill(ivf.assign(live, cells, index["m"]), index["eps"])
            assigned = self._save(old.join(live.select("id"), "id", "left_anti").unionByName(new.select(*old.columns)), "assigned", "cell")
            index = {k: v for k, v in index.items() if k not in ("codes", "codes_for", "transform")} | {"assigned": assigned}
        self._publish(base=base, logs=[], ledger=ledger, entries=None, centres=None, live_codes=None, packed_seq=self.m["seq"], index=index)
        if residuals:
            self.build_residual()
        if coded:
            self.build_transform(coded["bits"], len(coded["scale"]))
        return rows

    def snapshot(self) -> int:
        """The version to open for the state as it is now."""
        return self.m["version"]

    def tables(self) -> list[str]:
        i = self.m["index"] or {}
        codes = [*(i.get("codes") or []), (i.get("transform") or {}).get("codes")]
        return [p for p in (self.m["frozen"], self.m["base"], self.m.get("ledger"), self.m["entries"], self.m["centres"], self.m["live_codes"], i.get("cells"), i.get("assigned"), *codes, *self.m["logs"]) if p]
