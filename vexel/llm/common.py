"""Shared parts of the training-data operators: work tables, bounded buckets, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch when whole texts cross to Python: a worker holds one batch, or one text that is longer.
TEXT_BYTES = 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes. A plan reads the setting when it runs, so it stays; batches of other queries keep their rows
    and are only cut where they exceed the bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set a temporary one serves a local master; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vexel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vexel_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete a work table that nothing reads any more."""
    path = getattr(df, "_vexel_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows_as_bytes(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, one row at a time."""
    for v in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()):
        yield v.as_py()


def popcount(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a)


class Forest:
    """Union-find over the rows of one bounded chunk; tells which links merge two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def blocked(keyed: DataFrame, key: str, item: str, block_rows: int, weight: Column | None = None) -> DataFrame:
    """Split each bucket ``key`` into units that fit in a task, whatever its size.

    A bucket with more than ``block_rows`` rows (or of that ``weight``) is dealt into blocks by a hash of ``item`` and every pair of
    blocks becomes a unit, so each pair of rows meets in at least one unit and no unit holds more than about two blocks. Returns the
    rows with columns ``unit_i``, ``unit_j`` and ``mine`` (the row's own block), grouped and sorted by (key, unit_i, unit_j) within partitions.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hot = keyed.groupBy(key).agg(size.alias("n")).where(F.col("n") > block_rows).select(key, F.ceil(F.col("n") / block_rows).cast("int").alias("nb"))
    hot = write_table(hot, "hot-keys")  # at most a row for each block: its size is then known, and a short table joins without a shuffle by key
    rows = keyed.join(hot, key, "left")
    mine = F.pmod(F.xxhash64(item), F.col("nb")).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("nb").isNull(), F.lit(0)).otherwise(mine))
    rows = rows.withColumn("other", F.explode(F.when(F.col("nb").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))))
    rows = rows.withColumn("unit_i", F.least("mine", "other")).withColumn("unit_j", F.greatest("mine", "other")).drop("other", "nb")
    return rows.repartition(key, "unit_i", "unit_j").sortWithinPartitions(key, "unit_i", "unit_j")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by integer ``keys``, about ``most`` rows at a time: yields (table, bounds); group g is rows bounds[g]:bounds[g+1]."""
    held: list[pa.RecordBatch] = []

    def cut(rows: list[pa.RecordBatch], last: bool) -> tuple[pa.Table | None, np.ndarray | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(rows).combine_chunks()
        if not t.num_rows:
            return None, None, []
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        if last:
            return t, np.append(starts, t.num_rows), []
        if len(starts) < 2:
            return None, None, t.to_batches()
        return t.slice(0, starts[-1]), starts, t.slice(starts[-1]).to_batches()

    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            t, bounds, held = cut(held, False)
            n = sum(x.num_rows for x in held) - (0 if t is not None else 0)
            if t is None:
                n = 0  # one group goes on: look again after as many rows
            if t is not None:
                yield t, bounds
    if held:
        t, bounds, _ = cut(held, True)
        if t is not None:
            yield t, bounds


def hamming_links(prints: DataFrame, keys_of: Callable[[DataFrame], DataFrame], words: int, most: int, block_rows: int = 8192) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints at Hamming distance ``most`` or less that share a block key.

    ``prints`` has ``id`` (long, distinct) and ``fp0..`` (``words`` longs); ``keys_of`` adds the block keys as rows with a
    column ``key``. Links inside a chunk of buckets that close a cycle are left out: components stay the same and the number
    of links never exceeds the number of rows.
    """
    cols = [f"fp{i}" for i in range(words)]
    rows = blocked(keys_of(prints).select("key", "id", *cols), "key", "id", block_rows)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in sorted_groups(batches, ["key", "unit_i", "unit_j"]):
            ids = t.column("id").to_numpy()
            fp = [t.column(c).to_numpy().view(np.uint64) for c in cols]
            sizes = np.diff(bounds)
            forest, out = Forest(), []

            def add(a: np.ndarray, b: np.ndarray) -> None:
                for x, y in zip(ids[a].tolist(), ids[b].tolist()):
                    if x != y and forest.join(x, y):
                        out.append((x, y))

            small = sizes <= 32
            left = np.repeat(np.where(small, bounds[1:], 0), sizes) - np.arange(len(ids))  # rows left in a small group, this one included
            s, at = 1, np.flatnonzero(left > 1)
            while len(at):
                d = sum(popcount(f[at] ^ f[at + s]).astype(np.int16) for f in fp)
                ok = at[d <= most]
                add(ok, ok + s)
                s += 1
                at = at[left[at] > s]
            for g in np.flatnonzero(~small):
                lo, hi = bounds[g], bounds[g + 1]
                of = np.arange(lo, hi)  # trees inside the group: in a group of near copies the first rows join the rest
                for r in range(lo, hi, 128):
                    e = min(r + 128, hi)
                    d = sum(popcount(f[r:e, None] ^ f[None, r:hi]).astype(np.int16) for f in fp)
                    ok = np.triu(d <= most, 1)
                    for i in np.flatnonzero(ok.any(axis=1)).tolist():
                        mine, j = of[i + r - lo], np.flatnonzero(ok[i])
                        roots, at = np.unique(of[j + r - lo], return_index=True)
                        if len(at := at[roots != mine]):
                            add(np.full(len(at), i + r), j[at] + r)
                            of[np.isin(of, roots)] = mine
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of undirected ``edges`` (a, b long); ``component`` is the smallest node.

    Each round, every node joins the neighbour (itself included) whose salted hash is least, edges are relabelled, and loops
    and repeats go, so the number of live nodes shrinks by a constant factor a round: O(log n) rounds of partial aggregates and
    equi-joins, with state in tables of the shared folder. A hub's edges are pre-aggregated before the shuffle and AQE splits
    its join partition. Nodes without an edge do not appear.
    """
    edges = write_table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = write_table(nodes.select("node", F.col("node").alias("root")), "cc-labels")
    salt = 0
    while edges.limit(1).count():
        salt += 1
        rank = lambda c, k=salt: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("u"), F.least(F.col("m"), rank("a")).getField("v").alias("to"))
        hook = write_table(hook, "cc-hook")
        left, right = hook.select(F.col("u").alias("a"), F.col("to").alias("ra")), hook.select(F.col("u").alias("b"), F.col("to").alias("rb"))
        nxt = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        nxt = write_table(nxt, "cc-edges")
        moved = labels.join(hook.select(F.col("u").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        moved = write_table(moved, "cc-labels")
        for old in (edges, hook, labels):
            drop_table(old)
        edges, labels = nxt, moved
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    out = write_table(labels.join(least, "root").select("node", "component"), "cc-out")
    drop_table(edges)
    drop_table(labels)
    return out


def partitions_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))
