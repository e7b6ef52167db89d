"""``python -m vexel``: create, build, convert, pack, compact, validate, bench, calibrate and serve collections."""

from __future__ import annotations

import argparse
import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import calibrate as C
from .plans.collection import Collection, SearchParams
from .sources.vecfile import read_vectors, read_workload


def _vectors(spark: SparkSession, path: str):
    return read_vectors(spark, path) if path.endswith("bin") else spark.read.parquet(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vexel")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("create", help="an empty collection")
    a.add_argument("path")
    a.add_argument("--dim", type=int, required=True)
    a.add_argument("--capacity", type=int)
    a = sub.add_parser("build", help="a frozen index of a vector file or table")
    a.add_argument("base")
    a.add_argument("path")
    a.add_argument("k", type=int)
    for name, kind, default in (("eps", float, 0.2), ("m", int, 3), ("seed", int, 42), ("nmax", int, 0)):
        a.add_argument(f"--{name}", type=kind, default=default)
    a.add_argument("--coarse", type=int, default=0, help="cells of a coarse level, 0 for none")
    a.add_argument("--neighbours", type=int, default=64)
    a.add_argument("--tqbits", type=int, choices=(1, 2, 4), help="add transform codes of so many bits")
    a.add_argument("--cdim", type=int, help="dimensions of the transform codes")
    a = sub.add_parser("convert", help="add residual codes to a frozen index; goes on where it broke off")
    a.add_argument("path")
    for name, text in (("pack", "route, split and encode the live vectors"), ("compact", "fold the log into a new base"), ("stats", "counters"), ("validate", "read and check the frozen index")):
        a = sub.add_parser(name, help=text)
        a.add_argument("path")
    a = sub.add_parser("bench", help="time a batch of queries")
    a.add_argument("path")
    a.add_argument("queries")
    a.add_argument("--nprobe", type=int, default=64)
    a.add_argument("--rerank", type=int, default=400)
    a.add_argument("--top-k", type=int, default=10)
    a = sub.add_parser("calibrate", help="choose budgets for a workload")
    a.add_argument("path")
    a.add_argument("workload")
    a.add_argument("--target", type=float, default=0.95)
    a.add_argument("--max-probes", type=int, default=1024)
    a.add_argument("--max-rerank", type=int, default=2000)
    a.add_argument("--max-seconds", type=float, help="of a batch; accept by a statistical bound, and the best choice within it")
    a.add_argument("--checkpoint", help="file that a broken calibration goes on from")
    a = sub.add_parser("serve")
    a.add_argument("path")
    a.add_argument("--host", default="127.0.0.1")
    a.add_argument("--port", type=int, default=8080)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("vexel").getOrCreate()
    if a.command == "create":
        print(json.dumps(Collection.create(spark, a.path, a.dim, a.capacity).m))
    elif a.command == "build":
        c = Collection.build_index(spark, a.path, _vectors(spark, a.base), a.k, a.eps, a.m, a.seed, a.nmax, a.coarse, a.neighbours)
        if a.tqbits:
            c.build_transform(a.tqbits, a.cdim)
        print(json.dumps({k: v for k, v in c.m["index"].items() if k != "transform"}))
    elif a.command == "convert":
        c = Collection.open(spark, a.path)
        c.build_residual()
        print(json.dumps({"codes_for": c.m["index"]["codes_for"]}))
    elif a.command in ("pack", "compact", "stats", "validate"):
        c = Collection.open(spark, a.path)
        print(json.dumps({"pack": c.pack, "compact": lambda: {"rows_saved": c.compact()}, "stats": lambda: c.stats() | c.cell_stats(), "validate": lambda: {"valid": c.validate() is None}}[a.command]()))
    elif a.command == "bench":
        c, q = Collection.open(spark, a.path), _vectors(spark, a.queries).select(F.col("id").alias("qid"), F.col("v").alias("q"))
        began = time.perf_counter()
        n = c.search(q, a.top_k, params=SearchParams(a.nprobe, a.rerank)).count()
        print(json.dumps({"rows": n, "seconds": round(time.perf_counter() - began, 3)}))
    elif a.command == "calibrate":
        c = Collection.open(spark, a.path)
        queries, truth = read_workload(spark, a.workload)
        measure, most = C.measure_collection(c, queries, truth), (a.max_probes, a.max_rerank)
        if a.max_seconds is None and not a.checkpoint:
            profile = C.autocalibrate(measure, (8, 100), most, a.target, c.fingerprint())
        else:
            kept = Path(a.checkpoint) if a.checkpoint else None
            load, save = (lambda: kept.read_text() if kept and kept.exists() else None), (lambda t: kept and kept.write_text(t))
            n = queries.where("partition = 'validation'").count()
            profile = C.calibrate_snapshot(measure, (8, 100), most, a.target, c.fingerprint(), n, a.max_seconds, load=load, save=save)
        print(profile.to_json())
    else:
        from .service import Service, serve

        serve(Service(Collection.open(spark, a.path), os.environ.get("VEXEL_API_KEY")), a.host, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
