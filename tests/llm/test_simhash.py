import random

import numpy as np
import xxhash

from tests.llm.helpers import docs_dir, frame
from vexel.llm import simhash
from vexel.llm.queries import op9_simhash


def slow_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(prints, k):
    ids = sorted(prints)
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= k:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in ids}


def corpus():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(vocab, k=r.randint(1, 400))) for _ in range(60)]
    for i in range(60):
        t = texts[i].split()
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice(vocab)
        texts.append("  ".join(t).upper())
    return texts + ["", None, "  \t ", "one", "ONE", "one two", "é  x y", "a" * 200_000] + texts[:3]


def test_matches_brute_force(spark, tmp_path):
    texts = corpus()
    out = {r.doc_id: r for r in op9_simhash(spark, docs_dir(spark, tmp_path, frame(spark, texts))).collect()}
    prints = {i: slow_print(t) for i, t in enumerate(texts)}
    want = slow_components(prints, 2)
    assert len(set(want.values())) < len(texts) - 10
    for i in prints:
        assert out[i].fingerprint == f"{prints[i]:016x}" and out[i].component_id == want[i]


def test_hot_buckets_are_split(spark):
    rows = [(i, i << 3 & 0xFF00 | i & 31) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, fp0 long")
    from pyspark.sql import functions as F

    links = simhash.hamming_links(df, lambda p: p.withColumn("key", F.lit(1).cast("long")), 1, 2, block_rows=200)
    comp = {r.node: r.component for r in simhash.components(links).collect()}
    want = slow_components(dict(rows), 2)
    assert {i: comp.get(i, i) for i, _ in rows} == want


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    out = simhash.near_duplicates(frame(spark, ["a b c", "a b c"], ids=[None, 4])).collect()
    assert sorted((r.id is None, r.component_id is None) for r in out) == [(False, False), (True, True)]


def test_stage_keeps_one_of_each_group(spark):
    r = random.Random(9)
    base = [" ".join(f"v{r.randrange(500)}" for _ in range(300)) for _ in range(20)]
    near = []
    for t in base:
        w = t.split()
        w[100] = "changed"
        near.append(" ".join(w))
    texts = base + near + base[:5] + ["", None, " "]
    kept = {x.doc_id for x in simhash.keep_first(frame(spark, texts)).collect()}
    assert kept == set(range(20)) | {45, 46, 47}
    rows = simhash.keep_first(frame(spark, [base[0], base[0], base[1], base[1], None], ids=[None, None, 8, 8, None])).collect()
    assert sorted(str(x.doc_id) for x in rows) == ["8", "None", "None", "None"]
    rows = simhash.keep_first(frame(spark, [base[0], base[1], base[1], near[1], base[2], near[2]], ids=[4, 4, 4, 9, 6, 6])).collect()  # different texts under one id
    assert sorted((x.doc_id, x.text in base[:2]) for x in rows) == [(4, True), (4, True), (6, False)]
    assert len({x.text for x in rows}) == 3


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stage_links_exactly_the_pairs_at_four_fifths(spark):
    """Pairs close to the bound on both sides, of many sizes: words cut one by one from the end of a text."""
    r = random.Random(31)
    texts, sides = [], [0, 0]
    for k in range(240):
        t = [f"p{k}x{i}" for i in range(r.choice([8, 9, 12, 20, 60, 300, 1200]))]
        cut = (len(t) - 4) // 5 + k % 2
        texts += [" ".join(t), " ".join(t[: len(t) - cut])]
        same = similar(shingles(texts[-2]), shingles(texts[-1]))
        sides[same] += 1
    assert min(sides) > 80
    out = {x.id: x.component_id for x in simhash.wide_near_duplicates(frame(spark, texts)).collect()}
    for k in range(0, len(texts), 2):
        assert (out[k] == out[k + 1]) == similar(shingles(texts[k]), shingles(texts[k + 1])), len(texts[k].split())


def test_partition_keys_cover_every_pair_of_the_bound():
    r = np.random.default_rng(3)
    for _ in range(4000):
        n = int(r.integers(4, 400))
        x = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        m = int(r.integers(-(-4 * n // 5), n * 5 // 4 + 1))  # size of the other set
        most = (n + m) // 9
        both = -(-(n + m - most) // 2)
        if both > min(n, m):
            continue
        y = np.unique(np.concatenate((r.choice(x, both, replace=False), r.integers(0, 1 << 64, m - both, np.uint64))))
        if len(np.setxor1d(x, y)):
            assert np.intersect1d(simhash.partition_keys(x), simhash.partition_keys(y)).size, (n, m)


def test_bands_find_large_sets_at_the_bound():
    """Random pairs at similarity 0.8 just above the size where bands begin, and far above: at least 0.999 share a band."""
    r, lost = np.random.default_rng(6), 0
    for k in range(3000):
        n = (104, 130, 300, 2000)[k % 4]
        x = r.integers(0, 1 << 64, n, np.uint64)
        y = np.concatenate((x[: n - n // 9], r.integers(0, 1 << 64, n // 9, np.uint64)))
        lost += not np.intersect1d(simhash.band_keys(x), simhash.band_keys(y)).size
    assert lost <= 3
    assert simhash.set_keys(np.zeros(0, np.uint64)).size == 0


def test_groups_of_copies_and_hot_lines(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_BUCKET", 8)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 16 * 8 * 40)
    r = random.Random(8)
    line = " ".join(f"c{i}" for i in range(12))
    base = [f"b{i}" for i in range(60)]
    texts = [line + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(0, 8))) for _ in range(150)]
    texts += [" ".join(base[:i] + ["z"] + base[i + 1 :]) for i in range(60)] + texts[:20]
    out = {x.id: x.component_id for x in simhash.wide_near_duplicates(frame(spark, texts)).collect()}
    sets, comp = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if comp[i] != comp[j] and similar(sets[i], sets[j]):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    assert out == dict(enumerate(comp))


def test_stage_takes_its_candidates_from_simhash(spark, monkeypatch):
    """Without any other keys: texts within the bits that the blocks cover link exactly when they are 0.8 similar, and none below it does."""
    monkeypatch.setattr(simhash, "set_keys", lambda h: h[:0])
    r = random.Random(12)
    texts = []
    for k in range(60):
        t = [f"s{r.randrange(4000)}" for _ in range(r.choice([40, 300, 1200]))]
        texts += [" ".join(t), " ".join("new" if i % (len(t) // (k % 4 + 1)) == 7 else w for i, w in enumerate(t)), " ".join(t[: len(t) * 7 // 10])]
    texts += ["one", "two", "one two three", ""]
    sets = [shingles(t) for t in texts]
    prints = []
    for s in sets:
        h = np.array([xxhash.xxh64_intdigest(" ".join(x), 42) for x in s if x], np.uint64)
        words = [simhash._mix(h, w) if w else h for w in range(8)]
        prints.append([sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in w.tolist()) > len(w)) for w in words])
    out = {x.id: x.component_id for x in simhash.wide_near_duplicates(frame(spark, texts)).collect()}
    found = [0, 0]
    for i in range(len(texts)):
        for j in range(i):
            bits = sum((x ^ y).bit_count() for x, y in zip(prints[i], prints[j]))
            same = similar(sets[i], sets[j])
            if same and bits < 32:
                found[0] += 1
                assert out[i] == out[j], (i, j, bits)
            if same and bits >= 32:
                found[1] += out[i] == out[j]
            assert same or out[i] != out[j], (i, j, bits)
    assert found[0] > 20 and found[1] > 10


def test_groups_of_near_copies_give_spanning_links(spark):
    """A bucket in which nearly all rows are within the bits: components as by brute force, no more links than rows."""
    r = random.Random(4)
    rows = [(i, (i % 3 << 40) | 1 << r.randrange(30)) for i in range(700)] + [(700 + i, (1 << 60) - 1 << 2 ^ 1 << 8 * i) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, fp0 long")
    from pyspark.sql import functions as F

    links = simhash.hamming_links(df, lambda p: p.withColumn("key", F.lit(1).cast("long")), 1, 2).collect()
    want = slow_components(dict(rows), 2)
    comp = simhash.components(spark.createDataFrame([(x.a, x.b) for x in links], "a long, b long"))
    comp = {x.node: x.component for x in comp.collect()}
    assert {i: comp.get(i, i) for i, _ in rows} == want and len(links) < len(rows)
