import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import ivf, live, split, topk
from vexel.streaming.ingest import MutationLog, ingest


def frame(spark, x, names=("id", "v")):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], f"{names[0]} long, {names[1]} array<double>")


def normals(n, d, seed):
    return np.random.default_rng(seed).normal(size=(n, d))


def test_exact_top_k_ties_prefix_allowed_and_blocks(spark):
    x = normals(73, 16, 71)
    x[9] = x[3]
    df, q = frame(spark, x), frame(spark, x[:5], ("qid", "q"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [[int(i) for i in np.lexsort((np.arange(73), -np.round(u @ u[n], 12)))[:5]] for n in range(5)]
    got = {}
    for r in topk.exact_top_k(df.repartition(3), q, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert [got[n] for n in range(5)] == want and got[3][:2] == [3, 9]
    few = topk.exact_top_k(df, q, 60, where=F.col("id") < 60, allowed=df.where("id % 2 = 0").select("id"))
    assert few.groupBy("qid").count().where("count <> 30").count() == 0
    with pytest.raises(ValueError):
        topk.check_enough(few, q, 31)
    with pytest.raises(ValueError):
        topk.exact_top_k(df, spark.createDataFrame([(0, [0.0] * 16)], "qid long, q array<double>"), 1)
    assert len(list(topk.query_blocks(q, limit=1))) == 5


def test_exhaustive_budgets_equal_exact(spark):
    x = normals(300, 16, 5)
    df, q = frame(spark, x), frame(spark, x[:6] + 0.1, ("qid", "q"))
    cells = ivf.cells(df, ivf.anchor_ids(300, 12, 52))
    exact = topk.exact_top_k(df, q, 10)
    before = None
    for m in (1, 2, 4):
        a = ivf.assign(df, cells, m)
        assert a.count() == 300 * m and a.groupBy("id").agg(F.countDistinct("cell").alias("n")).where(F.col("n") != m).count() == 0
        assert [tuple(r)[:3] for r in ivf.search(q, df, a, cells, 12, 10).orderBy("qid", "rank").collect()] == [tuple(r)[:3] for r in exact.orderBy("qid", "rank").collect()]
        r = [ivf.recall(ivf.search(q, df, a, cells, n, 10), exact, 10).agg(F.avg("recall")).first()[0] for n in (1, 4, 12)]
        assert r[0] <= r[1] <= r[2] == 1 and (before is None or r[1] >= before - 0.1)
        before = r[1]
    assert ivf.spill(ivf.assign(df, cells, 3), 0.0).count() < ivf.spill(ivf.assign(df, cells, 3), 0.5).count() <= 900
    with pytest.raises(ValueError):
        ivf.assign(df, cells, 5)


def test_adaptive_probes_and_budget(spark):
    routed = spark.createDataFrame([(0, r, r, s) for r, s in zip(range(1, 9), [100, 99, 98, 95, 60, 50, 40, 30])] + [(1, r, r, 100 - 30 * (r > 1)) for r in range(1, 9)], "qid long, rank int, cell int, s long")
    for minimum, gap, want in ((2, 0.2, {0: 8, 1: 2}), (2, 0.04, {0: 4, 1: 2}), (1, 0.5, {0: 8, 1: 8}), (3, 0.0, {0: 3, 1: 3}), (5, 0.99, {0: 8, 1: 8})):
        assert {r.qid: r.probes for r in ivf.adaptive_probes(routed, minimum, gap, 8).collect()} == want, (minimum, gap)
    sizes = spark.createDataFrame([(c, 40) for c in range(1, 9)], "cell int, bytes long")
    got = ivf.byte_budget(routed, sizes, 100).where("qid = 0").orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2] and all(r.budget_limited for r in got)
    assert [r["rank"] for r in ivf.byte_budget(routed, sizes, 1).where("qid = 0").collect()] == [1]
    assert not any(r.budget_limited for r in ivf.byte_budget(routed, sizes, 1000).collect())


def simulate(rows, base_n):
    """The rules of the log, row by row."""
    vec, tags, gone, ledger, nxt = {i: i for i in range(base_n)}, {i: set() for i in range(base_n)}, set(), {}, base_n
    rejected, outcome = set(), {}
    for seq, op, i, src, tag, token, digest in rows:
        if op == "insert":
            if token is not None and token in ledger:
                outcome[seq] = ("replay", ledger[token][1]) if ledger[token][0] == digest else ("conflict", None)
                continue
            outcome[seq] = ("insert", nxt)
            if token is not None:
                ledger[token] = (digest, nxt)
            vec[nxt], tags[nxt] = src, {tag}
            nxt += 1
        elif i not in vec or (i in gone and op != "delete"):
            rejected.add(seq)
        elif op == "delete":
            gone.add(i)
        else:
            if op == "update":
                vec[i] = src
            tags[i] = tags[i] | {tag} if op == "add_metadata" else {tag}
    return vec, {(i, t) for i, ts in tags.items() for t in ts if t}, gone, rejected, outcome


def random_log(n=400, base_n=20):
    r = random.Random(4)
    ops = ["insert", "update", "set_metadata", "add_metadata", "delete"]
    return [(s, r.choices(ops, [3, 3, 2, 3, 1])[0], r.randrange(base_n + 25), r.randrange(99), f"k{r.randrange(4)}", r.choice([None, *"abcdefghij"]), str(r.randrange(2))) for s in range(n)]


LOG = "seq long, op string, id long, vsrc long, tag string, token string, digest string"


def check_fold(s, want):
    vec, tags, gone, rejected, outcome = want
    assert {r.id: r.vsrc for r in s.vectors.collect()} == vec and {tuple(r) for r in s.tags.collect()} == tags
    assert {r.id for r in s.deleted.collect()} == gone and {r.seq for r in s.rejected.collect()} == rejected
    assert {r.seq: (r.outcome, r.id) for r in s.inserts.collect()} == outcome


def test_fold_matches_a_row_by_row_simulation(spark):
    rows = random_log()
    base = spark.createDataFrame([(i, i) for i in range(20)], "id long, vsrc long")
    check_fold(live.fold(spark.createDataFrame(rows, LOG).repartition(5), base), simulate(rows, 20))
    empty = live.fold(spark.createDataFrame([], LOG), base)
    assert empty.vectors.count() == 20 and empty.rejected.count() == 0 and live.stats(empty).first().active == 20


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    rows = random_log()
    df = spark.createDataFrame(rows, LOG)
    log = MutationLog(spark, str(tmp_path / "log"), df.schema)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    df.where("seq < 200").repartitionByRange(3, "seq").write.parquet(str(tmp_path / "in"))

    def fail(batch, number):
        if number == 1:
            raise RuntimeError("lost before the acknowledgement")

    with pytest.raises(Exception):
        ingest(stream(), log, str(tmp_path / "cp"), fail).awaitTermination()
    done = log.committed()
    df.where("seq >= 200").repartitionByRange(2, "seq").write.mode("append").parquet(str(tmp_path / "in"))
    ingest(stream(), log, str(tmp_path / "cp")).awaitTermination()
    assert done == [0, 1] and len(log.committed()) == 5 and log.read().count() == 400
    base = spark.createDataFrame([(i, i) for i in range(20)], "id long, vsrc long")
    check_fold(live.fold(log.read(), base), simulate(rows, 20))


def test_splits_reach_the_capacity_and_keep_every_entry(spark):
    r = np.random.default_rng(49)
    x = np.concatenate([r.normal(0, 0.07, (300, 8)) + np.eye(8)[a] for a in (0, 1)])
    df = frame(spark, x)
    centres, entries, done = split.grow(df, 64)
    sizes = [c["count"] for c in entries.groupBy("cell").count().collect()]
    assert max(sizes) <= 64 and sum(sizes) == 2 * 600 and len(centres) == done["splits"] + 2
    assert entries.groupBy("id", "slot").count().where("count <> 1").count() == 0
    assert split.default_capacity(1) == 64 and split.default_capacity(33) == 66 and split.default_capacity(1024) == 2048
    with pytest.raises(ValueError):
        split.grow(df, 3)
