"""Structured Streaming ingestion of the mutation log: each micro-batch is committed once, and its rows are in the log when its marker is.

``foreachBatch`` writes a batch under its own id (a retry overwrites the same folder) and then its marker; readers take marked batches
only, so a crash between the two is invisible and the restarted query writes the batch again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.store import Files, shared_dir


class MutationLog:
    """An append-only log in ``path``: ``batches/batch=N`` and markers ``commits/N``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.files = Files(spark, path)

    def append(self, df: DataFrame, batch: int) -> None:
        if not self.files.exists(f"commits/{batch}"):
            df.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")
            self.files.write(f"commits/{batch}", b"")

    def committed(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("commits") if n.isdigit())

    def read(self, upto: int | None = None) -> DataFrame:
        done = [b for b in self.committed() if upto is None or b <= upto]
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/batches/batch={b}") for b in done]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)


def ingest(stream: DataFrame, log: MutationLog, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run a stream of mutations into ``log`` until the available rows are in; ``after`` is called with each committed batch (to split
    cells, pack or compact), in the single writer's thread."""

    def commit(df: DataFrame, batch: int) -> None:
        log.append(df, batch)
        if after is not None:
            after(df, batch)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Maintenance:
    """What runs after each batch in the single writer: pack once ``pack_rows`` rows wait unpacked, compact once the log holds
    ``compact_rows``. A pack splits to the end before the next batch is taken, so writers wait for overflowing cells. The first
    error is kept and raised again at each later call."""

    def __init__(self, collection, pack_rows: int = 100_000, compact_rows: int = 1_000_000):
        if pack_rows < 1 or compact_rows < 1:
            raise ValueError("thresholds are positive")
        self.collection, self.pack_rows, self.compact_rows = collection, pack_rows, compact_rows
        self.packs = self.compactions = 0
        self.error: Exception | None = None

    def __call__(self, df: DataFrame | None = None, batch: int = 0) -> None:
        if self.error is not None:
            raise RuntimeError("maintenance stopped after an error") from self.error
        try:
            if self.collection.stats()["log_rows"] >= self.compact_rows:
                self.collection.compact()
                self.compactions += 1
            if self.collection.unpacked() >= self.pack_rows:
                self.collection.pack()
                self.packs += 1
        except Exception as e:
            self.error = e
            raise


def ingest_collection(stream: DataFrame, collection, checkpoint: str, after: Maintenance | None = None) -> StreamingQuery:
    """Stream rows (seq, v[, meta, nums], key) into a collection. Rows carry keys, so a batch that is tried again after a crash gets the
    ids it had."""

    def commit(df: DataFrame, batch: int) -> None:
        collection.insert_frame(df)
        if after is not None:
            after(df, batch)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """Land ``rows`` as files, stream them into a new log one file a batch, and read the log back."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartitionByRange(files, "seq").write.parquet(f"{root}/in")
    log = MutationLog(spark, f"{root}/log", rows.schema)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = ingest(stream, log, f"{root}/checkpoint")
    query.awaitTermination()
    return log.read()
