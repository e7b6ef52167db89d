import random
import threading

import duckdb
import pytest

from vexel.llm.queries import OP8_SQL, op8_token_counts
from vexel.llm.token_counts import BATCH, Rollup

from .helpers import frame


def test_matches_a_dictionary_and_counts_each_batch_once(spark, tmp_path):
    r, state, roll = random.Random(6), {}, Rollup(spark, str(tmp_path / "roll"))
    assert roll.totals().count() == 0
    for batch in (3, 1, 7, 2, 6):
        rows = []
        for seq in range(60):
            rows.append((r.choice(["insert", "insert", "delete", "revise"]), seq, r.choice([None, *range(25)]), r.choice(["a", "b", None]), r.choice(["en", None]), r.choice(["t1", "t2"]), r.choice([None, 1, 5, 9])))
        last = {}
        for op, seq, doc, source, lang, tok, n in rows:
            if doc is not None:
                last[doc, tok] = (op, source, lang, n or 0)
        for key, (op, source, lang, n) in last.items():
            old = state.get(key)
            if op == "insert":
                state[key] = (source, lang, n)
            elif old:
                if op == "delete":
                    del state[key]
                else:
                    state[key] = (source if source is not None else old[0], lang if lang is not None else old[1], n)
        df = spark.createDataFrame(rows, BATCH)
        assert roll.commit(batch, df) and not roll.commit(batch, df)
    assert roll.committed() == [1, 2, 3, 6, 7]
    rows = [n for _, n in roll.state()["ledger"]]
    assert all(a > 2 * b for a, b in zip(rows, rows[1:]))
    assert {(x.doc_id, x.tokenizer): (x.source, x.lang, x.n_tokens) for x in roll.ledger().collect()} == state
    want = {}
    for (_, tok), (source, lang, n) in state.items():
        d, t = want.get((source, lang, tok), (0, 0))
        want[source, lang, tok] = (d + 1, t + n)
    assert {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in roll.totals().collect()} == want


    got = lambda: {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in Rollup(spark, roll.path).totals().collect()}
    assert roll.vacuum() > 0 and got() == want


def one(spark, op, doc, n):
    return spark.createDataFrame([(op, 0, doc, "s", "en", "t", n)], BATCH)


def test_batches_out_of_order(spark, tmp_path):
    """The order of commits counts, not that of batch ids: ledger and totals agree, also after a delete."""
    roll = Rollup(spark, str(tmp_path / "roll"))
    roll.commit(2, one(spark, "insert", 1, 5))
    roll.commit(1, one(spark, "revise", 1, 7))
    assert [x.n_tokens for x in roll.ledger().collect()] == [x.n_tokens for x in roll.totals().collect()] == [7]
    roll.commit(0, spark.createDataFrame([("delete", 0, 1, "s", "en", "t", 0), ("insert", 0, 2, "s", "en", "t", 1)], BATCH))
    assert [(x.n_docs, x.n_tokens) for x in roll.totals().collect()] == [(1, 1)]
    assert not any(roll.commit(b, one(spark, "insert", 9, 9)) for b in (0, 1, 2))


def test_of_two_writers_one_fails_and_its_retry_counts_once(spark, tmp_path):
    roll = Rollup(spark, str(tmp_path / "roll"))
    roll.commit(1, one(spark, "insert", 1, 4))
    other, publish, both, failed = Rollup(spark, roll.path), Rollup._publish, threading.Barrier(2, timeout=300), []

    def late(r, batch):
        r._publish = lambda state: (both.wait(), publish(r, state))
        try:
            r.commit(batch, one(spark, "insert", batch, batch))
        except Exception:
            failed.append(batch)

    threads = [threading.Thread(target=late, args=x) for x in ((roll, 10), (other, 20))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(failed) == 1
    fresh = Rollup(spark, roll.path)
    assert [x.n_tokens for x in fresh.totals().collect()] == [4 + 30 - failed[0]]
    assert fresh.commit(failed[0], one(spark, "insert", failed[0], failed[0])) and not fresh.commit(failed[0], one(spark, "insert", 1, 1))
    assert [(x.n_docs, x.n_tokens) for x in fresh.totals().collect()] == [(3, 34)]


def test_a_commit_that_died_is_invisible_and_redone(spark, tmp_path):
    roll = Rollup(spark, str(tmp_path / "roll"))
    roll.commit(1, one(spark, "insert", 1, 4))
    dead = Rollup(spark, roll.path)
    dead._publish = lambda state: 1 / 0
    with pytest.raises(ZeroDivisionError):
        dead.commit(2, one(spark, "insert", 2, 6))
    assert [x.n_tokens for x in Rollup(spark, roll.path).totals().collect()] == [4]
    assert roll.commit(2, one(spark, "insert", 2, 6)) and [(x.n_docs, x.n_tokens) for x in roll.totals().collect()] == [(2, 10)]
    (tmp_path / "roll" / "state" / "000000000003").touch()
    with pytest.raises(OSError):
        roll.commit(3, one(spark, "insert", 3, 1))


@pytest.mark.parametrize("empty", [False, True])
def test_query_equals_its_sql_on_awkward_rows(spark, tmp_path, empty):
    texts = ["a b -- c", None, "", "x1 ?! \u00e9", "one two three", "a a a", "b", "q ! r", "  \n ", "three more words", "less words", "z"]
    ids, src = [1, 2, 3, 4, 5, 5, None, 8, 9, 10, 10, 12], ["s", None, "s", "t", "s", "t", "s", None, "t", "u", None, "s"]
    frame(spark, [] if empty else texts, [] if empty else ids, langs=["en", None] * 6, sources=src).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(4, 1, 1), (5, 0, 0), (8, 0, 0), (10, 0, 0), (99, 0, 1), (None, 0, 1), (12, None, None), (5, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(db.sql(OP8_SQL).fetchall(), key=str)
    got = op8_token_counts(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()), key=str) == want and (empty or len(want) > 4)
