from collections import Counter

import numpy as np

from vexel.llm import embeddings
from vexel.llm.queries import op6_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, id long, digest string"


def brute(rows):
    """(id, links, component) of each row; rows are told apart by their place, as ids may repeat."""
    ok = [(k, np.array(v, np.float32).astype(float), l) for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a, l) in enumerate(ok):
        for j, b, k in ok[n + 1 :]:
            if l == k and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root(k)] = i if i is None else min(i, least.get(root(k), i))
    return Counter((rows[k][0], links[k], least[root(k)]) for k in range(len(rows)))


def rows():
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    out = []
    for i in range(900):
        b = base[min(int(r.exponential(8)), 59)]
        out.append((i, [float(x) for x in (b + r.normal(size=16) * r.choice([0.02, 0.1, 0.3])) * r.choice([1, 7])], int(r.integers(0, 3))))
    out += [(900 + i, out[i % 7][1], out[i % 7][2]) for i in range(100)]  # copies
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 5, [1.0] * 5]
    out += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(1010, out[0][1], None), (1011, [1e-30] * 16, 0), (1012, [1e30] * 16, 0)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*x, 1, "clash") for x in data], SCHEMA)


def found(df):
    return Counter((r.id, r.n_links, r.component_id) for r in df.collect())


def test_matches_brute_force_with_hot_lists_split(spark):
    data = rows()
    want = brute(data)
    assert max(n for _, n, _ in want) > 40
    for block in (None, 64):
        assert found(embeddings.near_duplicates(frame(spark, data), list_rows=40, block=block)) == want


def test_two_levels_of_lists(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEVEL", 4)
    data = rows()
    assert found(embeddings.near_duplicates(frame(spark, data), list_rows=30)) == brute(data)


def test_rows_that_repeat_an_id(spark):
    """Valid and invalid vectors, and different ones, under one id: each row has the links of its own vector."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]
    data = [(1, a, 1), (1, None, 1), (1, b, 1), (2, c, 1), (3, b, 1), (1, b, 1), (4, a, 1), (5, a, 2), (1, [0.0] * 3, 1)]
    assert found(embeddings.near_duplicates(frame(spark, data))) == brute(data)


def test_recall_of_probes(spark):
    """Many lists, noise in all of 64 directions up to the threshold: over 0.99 of the links, and none that is none."""
    r = np.random.default_rng(5)
    base = r.normal(size=(700, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = r.normal(size=base.shape)
    near = base + noise / np.linalg.norm(noise, axis=1, keepdims=True) * r.uniform(0.1, 0.22, (700, 1))
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.vstack((base, near)))]
    want = sum(n * k for (_, n, _), k in brute(data).items())
    got = {r.id: r.n_links for r in embeddings.near_duplicates(frame(spark, data), list_rows=20).collect()}
    assert want > 500 and 0.99 * want <= sum(got.values()) <= want
    assert found(embeddings.near_duplicates(frame(spark, data), list_rows=20, spread=float("inf"))) == brute(data)


def test_query_and_null_ids(spark, tmp_path):
    data = [(1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (7, [0.0, 1.0], 1)]
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in op6_embeddings(spark, str(tmp_path)).collect()}
    assert out == {(1, 1, 1, True), (5, 1, 1, False), (7, 0, 7, True), (None, 0, None, False)}


def test_empty(spark):
    assert embeddings.near_duplicates(frame(spark, [])).count() == 0
