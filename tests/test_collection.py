import hashlib
import json
import threading
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.operators import ivf, split
from vexel.plans import backup
from vexel.plans import calibrate as C
from vexel.plans.collection import BatchError, Collection, IdempotencyConflict, SearchParams
from vexel.service import Client, ClientError, Service, serve
from vexel.sources.vecfile import read_vectors, write_vectors


def normals(n, d, seed):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


def frame(spark, x, names=("qid", "q")):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], f"{names[0]} long, {names[1]} array<double>")


def brute(x, q, k, keep=None):
    u, w = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    s = w.astype(float) @ u.T.astype(float)
    if keep is not None:
        s[:, [i for i in range(len(x)) if i not in keep]] = -9
    return [[int(i) for i in np.lexsort((np.arange(len(x)), -r))[:k] if r[i] > -9] for r in s]


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return [out.get(i, []) for i in range(max(out, default=-1) + 1)]


def test_mutations_filters_and_maintenance(spark, tmp_path):
    x, q = normals(30, 8, 1), normals(3, 8, 2)
    c = Collection.create(spark, str(tmp_path / "c"), 8)
    Q = frame(spark, q)
    assert c.search(Q, 5).count() == 0 and c.compact() == 0
    assert c.insert_batch(x[:20], [{"g": "a" if i % 2 else "b", "n": i} for i in range(20)]) == list(range(20))
    assert c.insert(x[20], {"g": "a"}, "key") == 20 and c.insert(x[20], {"g": "a"}, "key") == 20
    with pytest.raises(IdempotencyConflict):
        c.insert(x[21], {"g": "a"}, "key")
    with pytest.raises(BatchError) as e:
        c.insert_batch([x[21], x[22], x[23]], None, ["k1", "key", "k2"])
    assert e.value.committed_ids == [21] and c.count == 22
    with pytest.raises(ValueError):
        c.insert_batch([x[22], x[23] * np.nan])
    assert c.count == 22
    x[5] = x[29]
    c.update(5, x[5], {"g": "new"})
    c.delete(3, 4)
    c.delete(3)
    for bad in (lambda: c.update(3, x[3]), lambda: c.set_metadata(4, {}), lambda: c.add_metadata([0, 3], {"t": "x"}), lambda: c.update(99, x[0])):
        with pytest.raises(OSError):
            bad()
    c.add_metadata([0, 1], {"t": "x"})
    c.set_metadata(1, {"z": True})
    alive = set(range(22)) - {3, 4}

    def check():
        assert found(c.search(Q, 5)) == brute(x[:22], q, 5, alive)
        assert found(c.search(Q, 22, {"g": "a"})) == brute(x[:22], q, 22, {i for i in range(20) if i % 2 and i in alive} - {1, 5} | {20})
        assert found(c.search(Q, 5, {"g": "new"})) == [[5]] * 3 and found(c.search(Q, 5, {"t": ("exists",)})) == [[0]] * 3
        assert found(c.search(Q, 5, {"z": True})) == [[1]] * 3 and found(c.search(Q, 9, {"n": ("range", 6, 8)})) == brute(x[:22], q, 9, {6, 7, 8})
        assert c.search(Q, 5, allowed=spark.createDataFrame([], "id long")).count() == 0
        assert found(c.search(Q, 5, allowed=spark.createDataFrame([(3,), (7,), (7,), (999,)], "id long"))) == [[7]] * 3

    check()
    keys = c.keys()
    assert "g=new" in keys and "g:*" in keys and "n.b3=0" in keys
    before = c.snapshot()
    assert c.compact() > 0 and c.compact() == 0 and c.keys() == keys
    check()
    assert c.insert(x[20], {"g": "a"}, "key") == 20 and c.stats()["deleted"] == 2 and c.stats()["active"] == 20
    old = Collection.open(spark, str(tmp_path / "c"), before)
    with pytest.raises(OSError):
        old.insert(x[0])
    saved = backup.create(c, str(tmp_path / "b"))
    c.delete(0)
    r = backup.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))
    assert saved and found(r.search(Q, 5)) == brute(x[:22], q, 5, alive) and r.insert(x[9]) == 22
    other = Collection.open(spark, str(tmp_path / "r"))
    other.delete(1)
    with pytest.raises(OSError):  # the first writer of a version wins
        r.delete(2)
    part = next((tmp_path / "b").glob("base-*/part-*"))
    part.write_bytes(part.read_bytes()[:-1] + b"!")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(OSError):
        backup.restore(spark, str(tmp_path / "b"), str(tmp_path / "r2"))


def test_frozen_index_live_tier_and_splits(spark, tmp_path):
    x, q = normals(400, 16, 3), normals(4, 16, 4)
    Q = frame(spark, q)
    c = Collection.build_index(spark, str(tmp_path / "c"), frame(spark, x[:300], ("id", "v")), k=8, m=2, eps=9.0)
    near = Collection.build_index(spark, str(tmp_path / "h"), frame(spark, x[:300], ("id", "v")), k=8, m=2, eps=9.0, coarse=4, neighbours=8)
    tables = [sorted(map(tuple, spark.read.parquet(t.m["index"]["assigned"]).select("id", "slot", "cell").collect())) for t in (c, near)]
    assert tables[0] == tables[1]  # all cells are neighbours: the same assignment
    assert c.insert_batch(x[300:]) == list(range(300, 400))
    y = x.copy()
    y[7] = x[399] + 0.01
    c.update(7, y[7])
    c.delete(11, 310)
    alive = set(range(400)) - {11, 310}
    P = partial(SearchParams, exact_limit=10)  # take the cells
    full = P(8, 400)
    want = brute(y, q, 10, alive)
    assert found(c.search(Q, 10, params=full)) == want
    c.build_residual()
    assert found(c.search(Q, 10, params=full)) == want  # exhaustive budgets: codes change nothing
    assert found(c.search(Q, 10, params=P(8, 60))) == want  # 4-bit codes: a rerank of 60 still holds the best ten
    stats = c.pack()
    assert stats["largest_cell"] <= c.cell_capacity and stats["entries"] == 2 * 100
    assert found(c.search(Q, 10, params=P(1000, 400))) == want
    c.insert(q[0])
    assert found(c.search(Q, 1, params=full))[0] == [400]
    some = c.recall(Q, 10, P(2, 400)).agg(F.avg("recall")).first()[0]
    assert 0.2 < some <= 1
    adaptive = P(8, 400, minimum=2, gap=0.3, code_bytes=10_000)
    assert c.search(Q, 10, params=adaptive).count() == 40
    c.compact()
    assert found(c.search(Q, 10, params=P(1000, 400)))[1:] == want[1:]
    print(c.fingerprint())
    with pytest.raises(ValueError):
        SearchParams.from_profile(C.Profile("x", {"nprobe": 1, "rerank": 1}, "validated", [], True), c.fingerprint())


def test_residual_kernels_agree_with_the_columns(spark):
    from vexel.functions import codes as K
    from vexel.functions import vectors as V
    from vexel.operators import ivf, residual

    x = normals(120, 64, 9)
    df, Q = frame(spark, x, ("id", "v")), frame(spark, x[:5])
    cells = ivf.cells(df, ivf.anchor_ids(120, 4, 52))
    assigned = ivf.assign(df, cells, 2)
    codes = residual.encode(assigned, df, cells, 52, 64)
    got = {(r.cell, r.id): r for r in codes.collect()}
    u = V.with_rotated(df.select("id", V.unit(F.col("v")).alias("v")), "v", "r", 52)
    a = V.with_rotated(cells.select("cell", V.unit(V.doubles("q8")).alias("a")), "a", "ar", 52)
    want = assigned.join(u, "id").join(a, "cell").select("cell", "id", "a", "ar", K.residual_encode(F.col("v"), F.col("r"), F.col("a"), F.col("ar"), 64).alias("e"))
    for r in want.collect():
        g = got[r.cell, r.id]
        assert abs(g.beta - r.e.beta) < 1e-12 and abs(g.gain - r.e.gain) < 1e-9 and list(g.code) == r.e.code
    probes = ivf.route(Q, cells, 3)
    q = u.where("id < 5").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("r").alias("rq"))
    s = V.let(K.residual_query(F.col("q"), F.col("rq"), F.col("a"), F.col("ar"), 64), lambda y: K.residual_score(F.col("e.code"), F.col("e.beta"), F.col("e.gain"), y, 4))
    slow = ivf.candidates_by_code(ivf.probe(probes, want).join(q, "qid").select("qid", "id", F.round(s, 9).alias("score")), 20, 2)
    fast = residual.candidates(probes, codes, Q, cells, 52, 64, 20, 2)
    assert {(r.qid, r.id, round(r.score, 7)) for r in slow.collect()} == {(r.qid, r.id, round(r.score, 7)) for r in fast.collect()}


def test_capacity_and_limits(spark, tmp_path):
    for kw in ({"dim": 0}, {"dim": 2000}, {"dim": 8, "cell_capacity": 3}, {"dim": 8, "max_cells": 1}):
        with pytest.raises(ValueError):
            Collection.create(spark, str(tmp_path / "x"), **kw)
    c = Collection.create(spark, str(tmp_path / "c"), 4, cell_capacity=64)
    c.insert_batch(normals(200, 4, 5))
    a = c.pack()
    assert a["largest_cell"] <= 64 and a["entries"] == 400 and a["cells"] > 2
    c.set_cell_capacity(4096)
    assert c.pack()["cells"] == a["cells"]
    two = Collection.create(spark, str(tmp_path / "t"), 4, cell_capacity=64, max_cells=2)
    two.insert_batch(normals(200, 4, 6))
    got = two.pack()
    assert {k: got[k] for k in ("cells", "splits", "largest_cell", "entries", "pending", "unpacked")} == {"cells": 2, "splits": 0, "largest_cell": 200, "entries": 400, "pending": 2, "unpacked": 0}
    with pytest.raises(FileExistsError):
        Collection.create(spark, str(tmp_path / "c"), 4)


def test_vector_files(spark, tmp_path):
    x = normals(1000, 5, 7)
    df = frame(spark, x, ("id", "v"))
    for name, kind in (("a.f16bin", np.float16), ("a.fbin", np.float32)):
        assert write_vectors(df, str(tmp_path / name)) == 1000
        got = read_vectors(spark, str(tmp_path / name), rows=300).orderBy("id").collect()
        assert np.array_equal(np.array([r.v for r in got], np.float32), x.astype(kind).astype(np.float32))
    assert read_vectors(spark, str(tmp_path / "a.fbin"), limit=10).count() == 10
    (tmp_path / "torn.fbin").write_bytes((tmp_path / "a.fbin").read_bytes()[:-3])
    with pytest.raises(Exception, match="shorter"):
        read_vectors(spark, str(tmp_path / "torn.fbin")).count()


def test_calibration():
    recalls = [1.0, 0.9, 0.8, 1.0] * 200
    assert 0.85 < C.recall_lower_bound(recalls) < 0.925 and C.recall_lower_bound([0.0, 1.0]) == 0
    table = {1: 0.5, 2: 0.8, 4: 0.97, 8: 1.0}
    measure = lambda part, nprobe, rerank: C.Measurement(nprobe, rerank, [table[nprobe]] * 500, nprobe / 10, routed=table[nprobe])
    p = C.calibrate(measure, [(n, 100) for n in table], 0.95, "f")
    assert p.validated and p.configuration == {"nprobe": 4, "rerank": 100} and C.Profile.from_json(p.to_json()) == p
    assert C.calibrate(measure, [(1, 100)], 0.95, "f").status == "no_configuration"
    assert C.autocalibrate(measure, (1, 100), (8, 400), 0.95, "f").configuration["nprobe"] == 4
    saved = []
    s = C.calibrate_snapshot(measure, (1, 100), (8, 400), 0.9, "f", 500, save=saved.append)
    assert s.status == "validated" and s.configuration["nprobe"] == 4
    calls = []
    again = C.calibrate_snapshot(lambda *a: calls.append(a) or measure(*a), (1, 100), (8, 400), 0.9, "f", 500, load=lambda: saved[-1])
    assert again.configuration == s.configuration and not calls
    assert C.calibrate_snapshot(measure, (1, 100), (8, 400), 0.9, "f", 500, max_seconds=0.2).status == "latency_tradeoff"
    with pytest.raises(ValueError):
        C.calibrate_snapshot(measure, (1, 100), (8, 400), 0.9, "f", 5)
    with pytest.raises(ValueError):
        C.calibrate_snapshot(measure, (1, 100), (8, 400), 0.9, "g", 500, load=lambda: saved[-1])


def test_service(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 4)
    server = serve(Service(c, "secret"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        api = Client(url, "secret", timeout=300)
        assert api.health()["ok"] and api.insert(vector=[1, 0, 0, 0], metadata={"g": "a"}, key="k") == {"id": 0}
        assert api.insert_batch(vectors=[[0, 1, 0, 0], [1, 1, 0, 0]]) == {"ids": [1, 2]}
        assert [r["id"] for r in api.search(vector=[1, 0, 0, 0], top_k=2)["results"][0]] == [0, 2]
        assert [r["id"] for r in api.search(vector=[1, 0, 0, 0], where={"g": {"regex": "a"}})["results"][0]] == [0]
        api.delete(id=2)
        for status, call in ((409, lambda: api.insert(vector=[0, 0, 1, 0], key="k")), (400, lambda: api.insert(vector=[0, 0])), (404, lambda: api.update(id=2, vector=[1, 0, 0, 0])), (404, lambda: api.nothing()), (401, lambda: Client(url).health()), (400, lambda: api.search(vector=[1, 0, 0, 0], where={"g": {"x": 1}}))):
            with pytest.raises(ClientError) as e:
                call()
            assert e.value.status == status
        assert json.dumps(api.stats())
    finally:
        server.shutdown()
        server.server_close()


def rows_of(spark, x, first=0, keys=None, order=None):
    order = order or list(range(len(x)))
    data = [(order[i], [float(y) for y in v], {"g": ["a" if i % 2 else "b"], "n": [str(i)]}, {"n": [i]}, keys[i] if keys else None) for i, v in enumerate(x)]
    return spark.createDataFrame(data, "seq long, v array<float>, meta map<string,array<string>>, nums map<string,array<bigint>>, key string")


def test_frames_do_what_lists_do(spark, tmp_path):
    x, q = normals(40, 8, 11), frame(spark, normals(3, 8, 12))
    a, b = (Collection.create(spark, str(tmp_path / n), 8) for n in "ab")
    keys = [f"k{i}" if i % 3 else None for i in range(40)]
    a.insert_batch(x, [{"g": "a" if i % 2 else "b", "n": i} for i in range(40)], keys)
    got = b.insert_frame(rows_of(spark, x, keys=keys)).orderBy("seq").collect()
    assert [(r.seq, r.id) for r in got] == [(i, i) for i in range(40)] and b.count == 40
    again = {r.seq: r.id for r in b.insert_frame(rows_of(spark, x, keys=keys)).collect()}  # keyed rows get their ids, the others new ones
    assert all(again[i] == i for i in range(40) if keys[i]) and sorted(again[i] for i in range(40) if not keys[i]) == list(range(40, 54))
    b.delete_frame(spark.range(40, 54))
    for c in (a, b):
        c.add_metadata(range(0, 40, 4), {"t": "x"}) if c is a else c.add_metadata_frame(spark.range(0, 40, 4), {"t": "x"})
        c.add_metadata([1], {"n": 500}) if c is a else c.add_metadata_frame(spark.range(1, 2), {"n": 500})
        c.delete(2, 3) if c is a else c.delete_frame(spark.range(2, 4))
        c.set_metadata(5, {"g": "z"}) if c is a else c.set_metadata_frame(spark.createDataFrame([(5, {"g": ["z"]})], "id long, meta map<string,array<string>>"))
        c.update(6, x[7], {"g": "new"}) if c is a else c.update_frame(spark.createDataFrame([(6, [float(y) for y in x[7]], {"g": ["new"]})], "id long, v array<float>, meta map<string,array<string>>"))
    flat = lambda c: sorted((r.id, {k: sorted(v) for k, v in r.meta.items()}, {k: sorted(v) for k, v in r.nums.items() if v}, [round(y, 6) for y in r.v]) for r in c.state().where("not deleted").collect())
    assert flat(a) == flat(b) and a.keys() == b.keys()
    for where in (None, {"t": "x"}, {"n": ("range", 100, 600)}, {"g": ("re", "^(z|ne)")}, {"g": "a", "t": ("exists",)}):
        assert found(a.search(q, 5, where)) == found(b.search(q, 5, where))
    before = b.count
    for bad, error in ((lambda: b.delete_frame(spark.range(99, 100)), OSError), (lambda: b.add_metadata_frame(spark.range(2, 5), {"t": "y"}), OSError), (lambda: b.insert_frame(rows_of(spark, x[:1] * np.nan)), ValueError)):
        with pytest.raises(error):
            bad()
    with pytest.raises(BatchError) as e:
        b.insert_frame(rows_of(spark, x[[0, 1, 9]], keys=["new", "k1", "k2"]))  # k1 comes with its payload of then only by its vector
    assert b.count == before + 1 and e.value.committed_ids[0] == before
    with pytest.raises(ValueError):
        b.keys(most=2)


def test_stream_with_maintenance(spark, tmp_path):
    x = normals(120, 8, 13)
    c = Collection.create(spark, str(tmp_path / "c"), 8, cell_capacity=64)
    rows_of(spark, x, keys=[f"k{i}" for i in range(120)]).repartitionByRange(3, "seq").write.parquet(str(tmp_path / "in"))
    from vexel.registry.collection_queries import BATCH
    from vexel.streaming.ingest import Maintenance, ingest_collection

    keep = Maintenance(c, pack_rows=30, compact_rows=70)
    stream = lambda: spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest_collection(stream(), c, str(tmp_path / "ck"), keep).awaitTermination()
    assert c.count == 120 and keep.packs >= 1 and keep.compactions >= 1 and c.unpacked() < 30
    ingest_collection(stream(), c, str(tmp_path / "ck2"), keep).awaitTermination()  # all batches once more: their keys are known
    assert c.count == 120
    q = normals(3, 8, 14)
    seq = {hashlib.sha256(f"k{i}".encode()).hexdigest(): i for i in range(120)}  # files arrive in any order, so ids are told by their keys
    seq_of = {r.id: seq[r.token] for r in c._ledger().collect()}
    assert [[seq_of[i] for i in row] for row in found(c.search(frame(spark, q), 5, params=SearchParams(1000, 1000, exact_limit=0)))] == brute(x, q, 5)
    keep.collection = None
    with pytest.raises(AttributeError):
        keep()
    keep.collection = c
    with pytest.raises(RuntimeError):
        keep()


def test_blocks_of_cells_equal_one_block(spark):
    x = frame(spark, normals(300, 8, 15), ("id", "v"))
    cells, old = ivf.cells(x, list(range(40))), ivf.cells(x, list(range(50, 58)))
    assert len(list(ivf.cell_blocks(cells, 64))) > 4
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    q = x.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    for one, many in ((ivf.assign(x, cells, 3), ivf.assign(x, cells, 3, limit=64)), (ivf.route(q, cells, 7), ivf.route(q, cells, 7, limit=64)), (ivf.neighbours(old, cells, 6), ivf.neighbours(old, cells, 6, limit=64))):
        assert rows(one) == rows(many)
    near = ivf.neighbours(old, cells, 6)
    assert rows(ivf.assign_through(x, old, near, cells, 2)) == rows(ivf.assign_through(x, old, near, cells, 2, limit=64))
    every = ivf.neighbours(old, cells, 40)
    assert rows(ivf.assign_through(x, old, every, cells, 2)) == rows(ivf.assign(x, cells, 2))
    centres = np.array([r.q8 for r in cells.orderBy("cell").collect()], np.int8)
    assert rows(split.attach(x, centres)) == rows(split.attach(x, centres, limit=64))
    far = spark.createDataFrame([(3_000_000_000, [1.0] * 8), (4_000_000_000, [0.5, 1.0] * 4)], "id long, v array<double>")
    assert [r.cell for r in ivf.cells(far, [4_000_000_000, 3_000_000_000]).orderBy("cell").collect()] == [0, 1]


def test_codes_are_bound_resumed_and_checked(spark, tmp_path):
    x = normals(200, 8, 16)
    c = Collection.build_index(spark, str(tmp_path / "c"), frame(spark, x, ("id", "v")), 8, 1e9, 2, 7)
    c.build_residual(ranges=4)
    parts = sorted((tmp_path / "c").glob("codes-*/cells-*"))
    assert len(parts) == 4
    times = {p: (p / "_SUCCESS").stat().st_mtime_ns for p in parts}
    (parts[1] / "_SUCCESS").unlink()  # as if the build had died there
    c.build_residual(ranges=4)
    assert {p for p in parts if (p / "_SUCCESS").stat().st_mtime_ns != times[p]} == {parts[1]}
    opened = Collection.open(spark, str(tmp_path / "c"), validate=True)
    q = normals(4, 8, 17)
    assert found(opened.search(frame(spark, q), 5, params=SearchParams(8, 200, exact_limit=0))) == brute(x, q, 5)
    c._publish(index={**c.m["index"], "seed": 8})
    with pytest.raises(OSError):
        Collection.open(spark, str(tmp_path / "c"))
    c._publish(index={**c.m["index"], "seed": 7, "k": 9, "codes": None, "codes_for": None})
    with pytest.raises(OSError):
        Collection.open(spark, str(tmp_path / "c"), validate=True)


def test_calibration_of_a_collection(spark, tmp_path):
    x, q = normals(300, 8, 18), normals(40, 8, 19)
    c = Collection.build_index(spark, str(tmp_path / "c"), frame(spark, x, ("id", "v")), 16, 0.2, 2, 7)
    truth = spark.createDataFrame([(i, k + 1, j) for i, near in enumerate(brute(x, q, 5)) for k, j in enumerate(near)], "qid long, rank int, id long")
    parts = lambda group: spark.createDataFrame([(i, [float(y) for y in v], "calibration" if i % 2 else "validation", group(i)) for i, v in enumerate(q)], "qid long, q array<double>, partition string, grp string")
    m = C.measure_collection(c, parts(lambda i: ""), truth)
    few, all_ = m("train", 1, 100), m("train", 16, 300)
    assert few.routed < 1 and few.recall == pytest.approx(few.routed) and (all_.recall, all_.routed) == (1.0, 1.0) and len(few.recalls) == 20
    p = C.autocalibrate(m, (1, 100), (16, 300), 0.9, c.fingerprint())
    assert p.status == "validated" and p.configuration["rerank"] == 100 and 1 < p.configuration["nprobe"] <= 16
    used = SearchParams.from_profile(p, c.fingerprint())
    assert used.nprobe == p.configuration["nprobe"]
    with pytest.raises(ValueError):
        C.measure_collection(c, parts(lambda i: "one"), truth)
    c.delete(3)
    with pytest.raises(ValueError):
        C.measure_collection(c, parts(lambda i: ""), truth)
    with pytest.raises(ValueError):
        c.search(frame(spark, q), 5, params=SearchParams(4, 100, top_k=4))
    with pytest.raises(MemoryError):
        c.search(frame(spark, q), 5, params=SearchParams(4, 100, max_bytes=1000))
