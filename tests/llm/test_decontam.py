import random

from tests.llm.helpers import frame
from vexel.llm import decontam as d
from vexel.llm.queries import op2_decontam


def table(item, text):
    """For each end the least edit distance of the item to any part of the text that ends there, by the plain table."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return prev


def slow(item, text):
    """(least distance, maximal runs of ends within the budget), or None."""
    k = int(d.RATE * len(item)) if len(item) >= d.FUZZY else 0
    if len(item) < d.FUZZY:
        n = sum(text.startswith(item, a) and d.on_boundaries(text, a, a + len(item)) for a in range(len(text)))
        return (0, n) if n and item else None
    ok = [x <= k for x in table(item, text)[1:]]
    return (min(table(item, text)), sum(x and not y for x, y in zip(ok, [False, *ok]))) if any(ok) else None


def test_bit_vectors_give_the_table_distance():
    r = random.Random(1)
    for _ in range(2000):
        a, b = "".join(r.choices("abc", k=r.randint(1, 90))), "".join(r.choices("abcd", k=r.randint(0, 120)))
        assert list(d.scores(d.positions(a), len(a), b)) == table(a, b)[1:]


def test_repeating_items_edited_copies_and_their_counts():
    """Least distance and count over the whole text, whichever copy comes first and however the item repeats itself."""
    r = random.Random(4)
    for _ in range(300):
        unit = "".join(r.choices("ab c", k=r.randint(1, 9)))
        item = d.normalise((unit * 40)[: r.randint(1, 120)])
        if not item:
            continue
        text = ""
        for _ in range(r.randint(1, 4)):
            x = list(item)
            for _ in range(r.randint(0, 1 + len(x) // 15)):
                p = r.randrange(len(x) + 1)
                x[p : p + 1] = r.choice([[], ["z"], ["a", "b"]])
            text += "".join(x) + "".join(r.choices("abz ", k=r.randint(0, 30)))
        text = d.normalise(text)
        want = slow(item, text)
        assert d.Matcher([(7, item)]).leaks(text) == ([] if want is None else [(7, *want)]), (item, text)


def corpus():
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    items = [say(r.randint(8, 40)) for _ in range(25)] + ["", None, "tiny"]
    docs = []
    for i in range(120):
        t = say(r.randint(5, 120))
        if i % 3 == 0:
            x = list(r.choice(items[:25]))
            for _ in range(r.randint(0, int(len(x) * 0.07))):
                p = r.randrange(len(x))
                x[p : p + 1] = r.choice([[], ["z"], [x[p], "q"]])
            t = t[: len(t) // 2].rsplit(" ", 1)[0].upper() + ",\n  " + "".join(x).replace(" ", " - ", 1) + "! " + t[len(t) // 2 :]
        docs.append(t)
    return docs + ["", None, "tiny", " \n", items[0] * 400, docs[0], docs[0]], items


def tables(spark, tmp_path, docs, items):
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_matches_brute_force(spark, tmp_path):
    docs, items = corpus()
    got = {(r.doc_id, r.item_id): (r.distance, r.times) for r in op2_decontam(spark, tables(spark, tmp_path, docs, items)).collect()}
    want = {}
    for i, t in enumerate(docs):
        n = d.normalise(t or "")
        for j, x in enumerate(items):
            m = d.normalise(x or "")
            if m and len(n) < 3000 and (dist := slow(m, n)):
                want[i, j] = dist
    long = 120 + 4
    assert (long, 0) in got and {k: v for k, v in got.items() if k[0] != long} == want and len(want) > 25


def test_blocks_of_items_and_the_filter(spark):
    docs, items = corpus()
    df, bench = frame(spark, docs), spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    whole = {tuple(r) for r in d.find_leaks(df, bench).collect()}
    old = d.item_blocks.__defaults__
    try:
        d.item_blocks.__defaults__ = (200,)
        assert {tuple(r) for r in d.find_leaks(df, bench).collect()} == whole
        kept = d.drop_leaks(df, bench)
        assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {x[0] for x in whole}
    finally:
        d.item_blocks.__defaults__ = old
    assert d.find_leaks(df, bench.limit(0)).count() == 0 and d.find_leaks(frame(spark, []), bench).count() == 0


def test_null_ids_keep_their_leaks(spark):
    docs, bench = frame(spark, ["some words of an item here", "nothing"], ids=[None, None]), spark.createDataFrame([(None, "words of an item"), (3, "of an item")], "item_id long, text string")
    assert {tuple(r) for r in d.find_leaks(docs, bench).collect()} == {(None, None, 0, 1), (None, 3, 0, 1)}
    assert [r.text for r in d.drop_leaks(docs, bench).collect()] == ["nothing"]


def test_short_items_match_whole_words_only(spark):
    items = ["What is 2+2?", "水の沸点は何度ですか", "sum of three"]
    docs = ["so: WHAT is 2 + 2 ... four", "what is 2+25", "問題水の沸点は何度ですか。答え", "Sum of three, sum of three", "dimsum of three", "sum of threes", "sum of thre"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {tuple(r) for r in d.find_leaks(frame(spark, docs), bench).collect()} == {(0, 0, 0, 1), (2, 1, 0, 1), (3, 2, 0, 2)}
    assert {r.doc_id for r in d.drop_leaks(frame(spark, docs), bench).collect()} == {1, 4, 5, 6}
