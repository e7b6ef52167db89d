import hashlib
import random
import re

import numpy as np

from tests.llm.helpers import docs_dir, frame
from vexel.llm import substrings as s
from vexel.llm.queries import op3_substrings


def brute(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for j in range(len(w) - 12) if i is not None else ():
            k = tuple(w[j : j + 13])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - 12) if i is not None else ():
            if least[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(11)
    vocab = [f"w{i}é" for i in range(200)]
    say = lambda n: r.choices(vocab, k=n)
    passages = [say(r.randint(10, 60)) for _ in range(12)]
    loop = say(5)
    texts = []
    for _ in range(160):
        w = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            w += r.choice([say(r.randint(0, 30)), p, p[r.randrange(len(p)) :], p[: r.randrange(len(p))], loop * r.randint(1, 8)])
        texts.append(r.choice([" ", "\n", " \t"]).join(w))
    return texts + ["", None, " \n\t", texts[3], texts[3], "a b   c", "z " * 30_000, "z " * 40]


def test_matches_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "UNIT_BYTES", 1500)  # some sources get several units
    texts = corpus()
    ids = [i * 3 for i in range(len(texts))]
    random.Random(1).shuffle(ids)
    ids[7] = ids[8] = ids[9] = 100_000  # rows that repeat an id
    ids[20] = None
    df = frame(spark, texts, ids=ids).repartition(3)
    want = brute(list(zip(ids, texts)))
    assert sum(x[2] > 0 for x in want) > 60
    got = op3_substrings(spark, docs_dir(spark, tmp_path, df)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == want
    # many small packs and buckets: the paths between packs
    got = s.remove_repeats(df, pack_chars=2000, bucket_edges=300, keep_text=True).collect()
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want
    assert all((r.text is None) == (r.n_words == 0 and texts[ids.index(r.id)] is None) for r in got if r.id is not None and r.id != 100_000)


def test_window_hashes_depend_on_the_words_only():
    a, b = s.Words.cut([b"x " * 3 + b" ".join(b"k%d" % i for i in range(40))]), s.Words.cut([b"longer words first " + b"\t".join(b"k%d" % i for i in range(40))])
    assert np.array_equal(a.edges()[1][-28:], b.edges()[1][-28:]) and len(set(a.edges()[1])) == len(a.edges()[1])
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(s._unplanes(s._planes(h)), h)


def test_empty(spark):
    assert s.remove_repeats(frame(spark, [])).count() == 0
