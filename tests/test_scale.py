"""What queries of many rows rest on: scores in tiles, cells scanned without rows for pairs, numbers drawn once."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import ivf, live, residual, split, topk, transform
from vexel.plans import calibrate as C
from vexel.plans.collection import Collection, SearchParams
from vexel.registry.collection_queries import bodies

RNG = np.random.default_rng(5)
X = np.round(RNG.normal(size=(400, 16)), 3)
X[200:] = X[:200]  # every vector twice: ties in all results


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("scale"))
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>").repartition(3).write.parquet(f"{root}/v")
    v = spark.read.parquet(f"{root}/v")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    cells = ivf.cells(v, list(range(8)))
    ivf.assign(v, cells, 2).write.parquet(f"{root}/a")
    ivf.route(q, cells, 8).write.parquet(f"{root}/r")
    return v, q, cells, spark.read.parquet(f"{root}/a"), spark.read.parquet(f"{root}/r")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(k, keep=lambda q: range(len(X))):
    u = X / np.linalg.norm(X, axis=1, keepdims=True)
    out = []
    for q in range(0, len(X), 20):
        best = sorted((-round(float(u[q] @ u[i]), 12), i) for i in keep(q))[:k]
        out += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    return out


def test_held_is_the_sorted_best_whatever_the_order_and_the_tiles():
    s, ids = np.round(RNG.normal(size=(7, 300)), 1), RNG.permutation(300)
    for step in (1, 13, 300):
        held, entries = topk.Held(7, 10, distinct=True), topk.Held(7, 10)
        for at in range(0, 300, step):
            for h in (held, entries):
                h.add(np.arange(7), s[:, at : at + step], ids[at : at + step])
                h.add(np.arange(3), s[:3, at : at + step], ids[at : at + step])  # the same entries from another cell
        for q in range(7):
            want = sorted(zip(-s[q], ids))[:10]
            assert list(zip(-held.s[q], held.i[q])) == want
            assert list(zip(-entries.s[q], entries.i[q])) == (sorted([*want, *want])[:10] if q < 3 else want)


def test_no_tile_is_larger_than_its_bound():
    for n, m in ((1, 1), (30_000, 10_000), (5_000_000, 3), (10, 1_000_000)):
        size = [(a.stop - a.start) * (b.stop - b.start) for a, b in topk.tiles(n, m)]
        assert sum(size) == n * m and max(size) <= topk.TILE


def test_exact_results_tie_by_id_in_any_tile_and_block(spark, tables, monkeypatch):
    v, q, *_ = tables
    assert [r[:3] for r in rows(topk.exact_top_k(v, q, 10))] == brute(10)
    monkeypatch.setattr(topk, "TILE", 50)
    monkeypatch.setattr(topk, "WIDE", 7)
    assert [r[:3] for r in rows(topk.exact_top_k(v, q, 10))] == brute(10)
    assert topk.all_scores(v, q).count() == 20 * 400


def test_codes_keep_the_same_entries_in_any_tile(spark, tables, monkeypatch):
    v, q, cells, assigned, routed = tables
    scale = transform.scales(v, 4, 52, 16, every=4)
    codes = transform.encode(assigned, v, scale, 4, 52, 16)
    res = residual.encode(assigned, v, cells, 52, 16)
    run = lambda: [rows(x) for x in (transform.candidates(codes, q, scale, 4, 52, 16, 20), transform.candidates(codes, q, scale, 4, 52, 16, 20, keep=60, prefix=8), transform.candidates(codes, q, scale, 4, 52, 16, 20, routed.where("rank <= 3")), residual.candidates(routed.where("rank <= 3"), res, q, cells, 52, 16, 20, 2))]
    want = run()
    for module in (topk, transform):
        monkeypatch.setattr(module, "OUT_ROWS", 40)
    monkeypatch.setattr(topk, "TILE", 50)
    monkeypatch.setattr(topk, "WIDE", 7)
    assert run() == want and all(want)


def test_cells_are_searched_without_a_row_for_each_pair(spark, tables, monkeypatch):
    v, q, cells, assigned, routed = tables
    near = {n: {} for n in (3, 8)}
    for n in near:
        of = {}
        for r in assigned.collect():
            of.setdefault(r.cell, set()).add(r.id)
        for r in routed.where(F.col("rank") <= n).collect():
            near[n].setdefault(r.qid, set()).update(of[r.cell])
    monkeypatch.setattr(ivf, "probe", None)
    for n in near:
        want = brute(10, lambda x: near[n][x])
        assert [r[:3] for r in rows(ivf.search(q, v, assigned, cells, n, 10))] == want
        blocks = topk.scan_cells(routed.where(F.col("rank") <= n), assigned.join(v, "id"), q, 10)
        with monkeypatch.context() as m:
            m.setattr(topk, "QUERY_BYTES", 3000)
            assert len(list(topk.probed_blocks(routed, q, 160))) > 1
            more = topk.scan_cells(routed.where(F.col("rank") <= n), assigned.join(v, "id"), q, 10)
            for found in (blocks, more):
                assert [r[:3] for r in rows(topk.rank(found, 10, digits=12).select("qid", "rank", "id"))] == want


def test_counters_and_losses_equal_the_join_of_probes_and_entries(spark, tables):
    v, q, cells, assigned, routed = tables
    probes = routed.where("rank <= 4")
    pairs = probes.join(assigned, "cell")
    want = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("e"), F.countDistinct("id").alias("d"))
    got = ivf.entry_counters(probes, assigned)
    assert rows(got) == rows(want)
    assert "distinct id" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair of query and entry is made to be counted
    truth = topk.exact_top_k(v, q, 10).select("qid", "id")
    assert rows(ivf.first_rank(truth, routed, assigned)) == rows(routed.join(assigned, "cell").groupBy("qid", "id").agg(F.min("rank")).join(truth, ["qid", "id"], "left_semi"))
    lost = {r.qid: (r.watched, r.routed, r.candidates) for r in ivf.losses(truth, probes, assigned).collect()}
    hit = {r.qid: r.n for r in pairs.select("qid", "id").distinct().join(truth, ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert lost == {x: (10, hit.get(x, 0), hit.get(x, 0)) for x in range(0, 400, 20)}


def test_ids_are_numbered_once_where_ranges_come_from_a_sample(spark):
    old = spark.conf.get("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "1")
    try:
        df = spark.range(0, 20_000, 1, 5).select((F.col("id") * 3).alias("seq"), F.col("id").cast("string").alias("other"))
        got = live.allocate(df, "seq", 7)
        assert got.where("new_id <> seq / 3 + 7 or new_id is null").count() == 0 and got.select("new_id").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", old)


def test_live_cells_are_attached_in_bounded_steps(spark, tables, monkeypatch):
    v, centres = tables[0], np.array(np.rint(X[:9] * 30), np.int8)
    want = {m: rows(split.attach(v, centres, m)) for m in (2, 6)}
    monkeypatch.setattr(split, "TILE", 20)
    assert {m: rows(split.attach(v, centres, m)) for m in (2, 6)} == want


def test_budgets_of_all_entries_need_no_codes(spark, tables, tmp_path, monkeypatch):
    v, q, *_ = tables
    c = Collection.create(spark, str(tmp_path / "c"), 16, 64)
    c.insert_frame(v.select(F.col("id").alias("seq"), "v"))
    c.pack()
    monkeypatch.setattr(residual, "candidates", None)
    for nprobe in (1_000_000, c.cell_stats()["filled_cells"]):
        assert [r[:3] for r in rows(c.search(q, 10, params=SearchParams(nprobe, 1_000_000, exact_limit=0)))] == brute(10)
    some = c.search(q, 10, params=SearchParams(3, 1_000_000, exact_limit=0))
    assert some.groupBy("qid").count().where("count = 10").count() == 20


def test_requests_stay_under_the_bound_of_a_body():
    rows = [(i, [0.123456789 + i] * 64) for i in range(100)]
    parts = list(bodies(iter(rows), 5000))
    assert len(parts) > 1 and [x for ids, v in parts for x in zip(ids, v)] == rows
    assert max(len(json.dumps({"vectors": v, "top_k": 10})) for _, v in parts) <= 5000 + 1024


def test_probes_grow_with_the_cells_until_the_recall_is_reached(spark, tmp_path):
    x = RNG.normal(size=(2000, 16))
    c = Collection.create(spark, str(tmp_path / "c"), 16, 64)
    c.insert_frame(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seq long, v array<double>"))
    c.pack()
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 2000, 40)], "qid long, q array<double>")
    few = c.recall(q, 10, SearchParams(2, 50, exact_limit=0)).agg(F.avg("recall")).first()[0]
    probes, recall = C.reach(c, q, 10, 0.9, 2, 50)
    assert few < 0.9 <= recall and 2 < probes <= c.cell_stats()["filled_cells"]
