"""Immutable versions on any file system Spark can reach: Parquet tables named by a manifest that is written last.

Readers pin a manifest and see one version; a crash before the manifest leaves files nobody refers to. The latest manifest is the
one with the greatest number whose file is complete (it ends with its own digest).
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set a temporary one serves a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vexel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of an iterative plan by a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}" if name else self.root))

    def names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> bytes:
        rows = self.spark.read.format("binaryFile").load(f"{self.root}/{name}").select("content").collect()
        return bytes(rows[0].content)

    def write(self, name: str, data: bytes) -> None:
        """Write beside, then rename: a reader sees all of it or none."""
        part = self._path(f"{self.root}/{name}.part-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        if not self._fs.rename(part, self._path(f"{self.root}/{name}")):
            self._fs.delete(part, False)
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Manifests:
    """Numbered manifests in ``_manifests`` of a collection's folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)
        self.root = self.files.root

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("_manifests") if n.endswith(".json"))

    def load(self, version: int | None = None) -> dict[str, Any]:
        """A complete manifest; with no version the newest complete one."""
        for v in [version] if version is not None else reversed(self.versions()):
            body, _, digest = self.files.read(f"_manifests/{v:012d}.json").decode().rpartition("\n")
            if hashlib.sha256(body.encode()).hexdigest() == digest:
                return json.loads(body)
            if version is not None:
                raise OSError(f"manifest {v} is damaged")
        raise OSError(f"no collection in {self.root}")

    def publish(self, manifest: dict[str, Any]) -> None:
        """Fails if another writer published this version first."""
        name = f"_manifests/{manifest['version']:012d}.json"
        if self.files.exists(name):
            raise OSError(f"version {manifest['version']} exists: another writer was first")
        body = json.dumps(manifest, sort_keys=True)
        self.files.write(name, f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode())

    def table(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"
