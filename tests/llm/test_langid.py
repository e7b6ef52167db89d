import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import docs_dir, frame
from vexel.llm import langid
from vexel.llm.queries import op1_langid

WORDS = {"xx": ["korel", "vaska", "mindo", "paruta", "selk"], "yy": ["thring", "owth", "eagh", "shrew", "whyte"], "zz": ["ñuole", "cisión", "aéro", "quiebo", "llarra"]}


def corpus(r, n):
    langs = [r.choice(sorted(WORDS)) for _ in range(n)]
    return [" ".join(r.choices(WORDS[x], k=r.randint(3, 60))) for x in langs], langs


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    r = random.Random(2)
    texts, langs = corpus(r, 400)
    odd = ["", None, "123 --- 456", "\n\t ", "Привет как дела это другой язык", "korel " * 300_000, texts[0], texts[0]]
    out = {x.doc_id: x for x in op1_langid(spark, docs_dir(spark, tmp_path, frame(spark, texts + odd, langs=langs + [None] * len(odd)))).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in out if out[i].held_out and i < 400} == set(held)
    assert sum(out[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in out.values())
    for i in (400, 401, 402, 403):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out[404].rejected and out[404].lang_pred in WORDS and not out[405].rejected and out[405].lang_pred == "xx"


def test_labels_do_not_reach_the_prediction(spark):
    texts, langs = corpus(random.Random(3), 120)
    df = frame(spark, texts, langs=langs)
    model = langid.train(df)
    a = sorted((x.id, x.lang_pred, x.score) for x in langid.predict(df, model).collect())
    b = sorted((x.id, x.lang_pred, x.score) for x in langid.predict(frame(spark, texts, langs=["xx"] * 120), model).collect())
    assert a == b


def test_no_labels_and_empty_table(spark):
    df = frame(spark, ["some text", None], langs=[None, None])
    assert {(x.lang_pred, x.rejected) for x in langid.predict(df, langid.train(df)).collect()} == {("und", True)}
    assert langid.predict(frame(spark, []), langid.train(frame(spark, []))).count() == 0


def grams(text):
    """n-grams as strings, the plain way."""
    t, out = " ", []
    for c in text:
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or t[-1] != " ":
            t += c
    t = t if t[-1] == " " else t + " "
    for n in (1, 2, 3):
        out += [t[i : i + n] for i in range(len(t) - n + 1)]
    return [g for g in out if g != " "]


def test_counts_equal_plain_n_grams(monkeypatch):
    """As many different n-grams with the same counts (up to collisions of buckets), however the text is cut into steps."""
    r = random.Random(1)
    for step in (1 << 20, 7, 3):
        monkeypatch.setattr(langid, "_STEP", step)
        for _ in range(200):
            text = "".join(r.choices("abcXé 1.\n中", k=r.randint(0, 60)))
            want, got = Counter(grams(text)), langid.ngram_counts(text)
            if not any(c.isalpha() for c in text):
                assert got is None
                continue
            assert got.sum() == sum(want.values()), text
            if len(want) == np.count_nonzero(got):
                assert sorted(got[got > 0]) == sorted(want.values())


def test_prediction_equals_brute_force(spark, monkeypatch):
    """With one centroid a language: mean of weighted unit vectors over plain n-grams, greatest cosine."""
    monkeypatch.setattr(langid, "BUCKETS", 1 << 24)  # next to no collisions
    monkeypatch.setattr(langid, "_SHIFT", np.uint32(8))
    r = random.Random(8)
    texts, langs = corpus(r, 24)
    counts = [Counter(grams(t)) for t in texts]
    df = Counter(g for c in counts for g in c)
    idf = lambda g: math.log((1 + len(texts)) / (1 + df[g])) + 1

    def unit(c):
        v = {g: (1 + math.log(n)) * idf(g) for g, n in c.items()}
        s = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / s for g, x in v.items()}

    sums = defaultdict(Counter)
    for c, lang in zip(counts, langs):
        for g, x in unit(c).items():
            sums[lang][g] += x
    size = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in sums.items()}
    # The model's own arithmetic on the same sample, without Spark, as its k-means would need 16 M columns a row there.
    rows = [langid.ngram_counts(t) for t in texts]
    n = sum(x > 0 for x in map(np.asarray, rows))
    weights = (np.log((1 + len(texts)) / (1 + n)) + 1).astype(np.float32)
    names, cols = sorted(set(langs)), []
    for lang in names:
        cols.append(langid.spherical_kmeans(np.array([langid.weigh(x[None].astype(np.float32), weights)[0] for x, k in zip(rows, langs) if k == lang]), 1)[0])
    model = langid.Model(names, np.array(cols).T, weights, {k: ([0.0], [0.0]) for k in names})
    for t in texts[:8] + ["korel owth", "x", "shrew cisión selk vaska"]:
        u = unit(Counter(grams(t)))
        want = {k: sum(x * sums[k][g] for g, x in u.items()) / size[k] for k in names}
        lang, score, _ = model.score(t)
        assert lang == max(sorted(want), key=want.get) and score == pytest.approx(max(want.values()), abs=2e-3)


def test_model_depends_on_the_rows_alone(spark):
    texts, langs = corpus(random.Random(6), 300)
    df = frame(spark, texts, langs=langs)
    models = [langid.train(x, sample=40) for x in (df.coalesce(1), df.repartition(7), df.orderBy("text", ascending=False))]
    for m in models[1:]:
        assert m.langs == models[0].langs and np.array_equal(m.centroids, models[0].centroids) and m.least == models[0].least


def test_unknown_scripts_and_random_letters_are_rejected_at_any_length(spark):
    r = random.Random(9)
    long = {k: ["".join(r.choices(w, k=1)[0][: r.randint(3, 6)] + r.choice(["a", "en", "umi", "ak"]) for _ in range(1)) for w in [v] for _ in range(400)] for k, v in WORDS.items()}
    langs = [r.choice(sorted(long)) for _ in range(200)]
    texts = [" ".join(r.choices(long[x], k=int(10 ** r.uniform(0.7, 3.3)))) for x in langs]
    model = langid.train(frame(spark, texts, langs=langs))
    say = lambda letters, n: " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(n))
    for n in (20, 500, 3000, 20_000):
        for letters in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", [chr(c) for c in range(0x4E00, 0x5E00)], "abcdefghijklmnopqrstuvwxyz"):
            assert model.score(say(letters, n))[2], (letters[:3], n)
        own = [model.score(" ".join(r.choices(long[x], k=n))) for x in long for _ in range(5)]
        assert not any(bad for _, _, bad in own)
    assert not model.score(texts[0] + "\n" + texts[0])[2] and not model.score((" ".join(texts[0].split()[:5]) + "\n") * 3000)[2]


def test_rows_that_repeat_and_null_ids(spark):
    texts, langs = corpus(random.Random(3), 60)
    df = frame(spark, texts + [texts[0]] * 3, ids=[*range(60), None, 0, 0], langs=langs + ["xx"] * 3)
    model = langid.train(df)
    assert langid.predict(df, model).count() == 63 and langid.keep_known(df, model).schema == df.schema


def test_long_text_counts_whole():
    n = langid._STEP
    a, b = langid.ngram_counts("abc " * (n // 4 + 5)), langid.ngram_counts("abc " * 10)
    assert set(a.nonzero()[0]) == set(b.nonzero()[0]) and a.sum() > n
