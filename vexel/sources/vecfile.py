"""Vector files: a header of two little-endian 32-bit integers (rows, dimension), then the rows as float16 (``.f16bin``) or float32
(``.fbin``). A Python data source reads row ranges in parallel; a writer makes such files from a frame.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = 8


def kind_of(path: str) -> np.dtype:
    return np.dtype("<f2" if path.endswith(".f16bin") else "<f4")


def decode(raw: bytes, kind: np.dtype) -> np.ndarray:
    """float32 values; infinities and NaNs of half precision become its largest finite value with their sign."""
    x = np.frombuffer(raw, kind).astype(np.float32)
    if kind.itemsize == 2:
        bits = np.frombuffer(raw, "<u2")
        x = np.where(bits & 0x7C00 == 0x7C00, np.where(bits & 0x8000, np.float32(-65504), np.float32(65504)), x)
    return x


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step, self.limit = options["path"], int(options.get("rows", 65536)), int(options.get("limit", -1))
        self.kind = kind_of(self.path)
        with open(self.path, "rb") as f:
            n, self.dim = (int(x) for x in np.frombuffer(f.read(HEADER), "<u4"))
        if os.path.getsize(self.path) < HEADER + n * self.dim * self.kind.itemsize:
            raise OSError(f"{self.path} is shorter than its header says")
        self.n = n if self.limit < 0 else min(n, self.limit)

    def partitions(self) -> list[RowRange]:
        return [RowRange(a, min(a + self.step, self.n)) for a in range(0, self.n, self.step)] or [RowRange(0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        width = self.dim * self.kind.itemsize
        with open(self.path, "rb") as f:
            for a in range(part.first, part.last, 8192):
                b = min(a + 8192, part.last)
                f.seek(HEADER + a * width)
                x = decode(f.read((b - a) * width), self.kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * self.dim + 1, self.dim, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], ["id", "v"])


class VectorSource(DataSource):
    """``spark.read.format("vecfile").load("x.f16bin")``: (id long, v array<float>). Options: rows a partition, limit."""

    @classmethod
    def name(cls) -> str:
        return "vecfile"

    def schema(self) -> str:
        return "id long, v array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(dict(self.options))


def read_vectors(spark: SparkSession, path: str, **options: int) -> DataFrame:
    spark.dataSource.register(VectorSource)
    return spark.read.format("vecfile").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_vectors(df: DataFrame, path: str, vec_col: str = "v", id_col: str = "id") -> int:
    """Write rows in id order to one file in a folder that the executors share: each task writes its range of rows at its place, the
    driver the header last, so a torn file is invalid."""
    from ..operators.live import allocate
    from ..plans.store import settle

    kind, part = kind_of(path), path + ".part"
    rows = settle(allocate(df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v")), "id", 0), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if size.n and size.least != size.most:
        raise ValueError("vectors differ in length")
    dim = size.most or 0
    with open(part, "wb") as f:
        f.truncate(HEADER + size.n * dim * kind.itemsize)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(part, "r+b") as f:
            for b in batches:
                for at, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    f.seek(HEADER + at * dim * kind.itemsize)
                    f.write(np.asarray(v, kind).tobytes())
                    n += 1
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.select("new_id", "v").repartitionByRange("new_id").sortWithinPartitions("new_id").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    with open(part, "r+b") as f:
        f.write(np.array([size.n, dim], "<u4").tobytes())
    os.replace(part, path)
    return size.n


def read_workload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, truth) of an NPZ workload with arrays queries, ids, partitions and, if there, groups."""
    z = np.load(path, allow_pickle=False)
    n = len(z["queries"])
    if not n == len(z["ids"]) == len(z["partitions"]):
        raise ValueError("arrays of a workload have one length")
    groups = z["groups"] if "groups" in z.files else np.array([""] * n)
    rows = [(i, [float(x) for x in q], str(p), str(g)) for i, (q, p, g) in enumerate(zip(z["queries"], z["partitions"], groups))]
    truth = [(i, k + 1, int(x)) for i, ids in enumerate(z["ids"]) for k, x in enumerate(ids)]
    return spark.createDataFrame(rows, "qid long, q array<float>, partition string, grp string"), spark.createDataFrame(truth, "qid long, rank int, id long")
