"""Token counts: delta-maintained rollups.

Additive totals of documents and tokens by (source, lang, tokenizer) are kept up to date by signed deltas. A batch holds operations
on documents: ``insert`` (+count), ``delete`` (-the count on record) and ``revise`` (-the count on record, +the new one). A commit
joins the batch with the ledger of counts on record and writes what changes as one table; the signed delta is added up from that
table, and totals plus delta are the new totals. All of it becomes visible with one state file, numbered by commit and created
without overwriting: of two writers of a number one fails, and what a commit that died has written is referred to by nothing.

A batch id in the state is skipped, so each batch counts once. The ledger follows the order of commits, whatever the batch ids:
batches may arrive in any order. Its tables are merged like those of a log-structured tree: each holds over twice the rows of
the next, so there are few of them and a row is rewritten a logarithmic number of times.

Defined results: within a batch, the last operation on a (doc_id, tokenizer) stands (greatest ``seq``, then greatest count, source and
language, null ones least). A delete or revise of what is not on record is rejected (no effect); an insert of what is on record acts
as a revise. Null counts count as 0; null sources and languages form their own group; null doc ids are rejected. Groups whose
documents all went disappear. Extra columns of a batch are ignored.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "op string, seq long, doc_id long, source string, lang string, tokenizer string, n_tokens long"
_CHANGE = "commit long, doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean, old struct<source:string,lang:string,n_tokens:bigint>"
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
GROUP = ("source", "lang", "tokenizer")


class Rollup:
    """State in ``path``: ``state/N`` names the tables of ledger and totals after commit N."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The newest state: {"commit", "done" (ranges of batch ids), "totals", "ledger" [[table, rows], ...] from old to new}."""
        p = self._hadoop(f"{self.path}/state")
        names = [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        if not names:
            return {"commit": 0, "done": [], "totals": None, "ledger": []}
        text = self.spark.read.text(f"{self.path}/state/{max(names)}", wholetext=True).first()
        if not text or not text.value.endswith("}\n"):
            raise OSError(f"state {max(names)} was not written to its end: remove it if its writer is gone")
        return json.loads(text.value)

    def _publish(self, state: dict) -> None:
        p = self._hadoop(f"{self.path}/state/{state['commit']:012d}")
        out = self._fs.create(p, False)  # fails if another writer was first
        out.write(bytearray((json.dumps(state) + "\n").encode()))
        out.close()

    def committed(self) -> list[int]:
        return [b for lo, hi in self.state()["done"] for b in range(lo, hi + 1)]

    def _changes(self, state: dict) -> list[DataFrame]:
        return [self.spark.read.schema(_CHANGE).parquet(p) for p, _ in state["ledger"]]

    def ledger(self) -> DataFrame:
        """(doc_id, tokenizer, source, lang, n_tokens) on record: the newest change of each key."""
        parts = self._changes(self.state()) or [self.spark.createDataFrame([], _CHANGE)]
        return _newest(parts).where("live").select("doc_id", "tokenizer", "source", "lang", "n_tokens")

    def totals(self) -> DataFrame:
        path = self.state()["totals"]
        t = self.spark.read.schema(_TOTALS).parquet(path) if path else self.spark.createDataFrame([], _TOTALS)
        return t.where("n_docs <> 0")

    def _table(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def commit(self, batch_id: int, batch: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        state = self.state()
        if any(lo <= batch_id <= hi for lo, hi in state["done"]):
            return False
        number = state["commit"] + 1
        count = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
        last = F.max_by(F.struct("op", "source", "lang", count.alias("n_tokens")), F.struct("seq", count, "source", "lang")).alias("b")
        ops = batch.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(last)
        same = lambda a, b: (a.doc_id == b.doc_id) & a.tokenizer.eqNullSafe(b.tokenizer)
        keys = ops.select("doc_id", "tokenizer")
        # Only what the batch touches leaves the ledger's tables: a small batch is broadcast, and nothing of the ledger is shuffled.
        touched = [t.join(keys, same(t, keys), "left_semi") for t in self._changes(state)] or [self.spark.createDataFrame([], _CHANGE)]
        old = _newest(touched).where("live").select("doc_id", "tokenizer", F.struct("source", "lang", "n_tokens").alias("old"))
        both = ops.join(old, same(ops, old), "left").select(ops.doc_id, ops.tokenizer, "b", "old")
        both = both.where((F.col("b.op") == "insert") | F.col("old").isNotNull())
        new = lambda c: F.when(F.col("b.op") == "insert", F.col(f"b.{c}")).otherwise(F.coalesce(f"b.{c}", f"old.{c}"))
        change = both.select(F.lit(number).cast("long").alias("commit"), "doc_id", "tokenizer", new("source").alias("source"), new("lang").alias("lang"), F.col("b.n_tokens").alias("n_tokens"), (F.col("b.op") != "delete").alias("live"), "old")
        path = self._table(change, "change")
        written = self.spark.read.schema(_CHANGE).parquet(path)
        before = [self.spark.read.schema(_TOTALS).parquet(state["totals"])] if state["totals"] else []
        totals = reduce(DataFrame.unionByName, [*before, _delta(written)]).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        ledger = self._merged([*state["ledger"], [path, written.count()]], number)
        self._publish({"commit": number, "done": _with(state["done"], batch_id), "totals": self._table(totals, "totals"), "ledger": ledger})
        return True

    def _merged(self, tables: list[list], number: int) -> list[list]:
        """Merge the newest tables until each holds over twice the rows of the next; deletions stay where an older table may hold the key."""
        keep = len(tables)
        rows = 0
        while keep and (keep == len(tables) or tables[keep - 1][1] <= 2 * rows):
            keep -= 1
            rows += tables[keep][1]
        if len(tables) - keep < 2:
            return [t for t in tables if t[1]] or tables[:1]
        merged = _newest([self.spark.read.schema(_CHANGE).parquet(p) for p, _ in tables[keep:]])
        path = self._table(merged.where("live") if not keep else merged, "ledger")
        return [*tables[:keep], [path, self.spark.read.schema(_CHANGE).parquet(path).count()]]

    def vacuum(self) -> int:
        """Delete the tables that the newest state does not name; no reader of an older state and no writer may be at work."""
        state = self.state()
        used = {p.rsplit("/", 1)[-1] for p in [state["totals"] or "", *(p for p, _ in state["ledger"])]}
        gone = [s.getPath() for s in self._fs.listStatus(self._hadoop(self.path)) if s.getPath().getName() not in used | {"state"}]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def _with(ranges: list[list[int]], x: int) -> list[list[int]]:
    """Sorted ranges of whole numbers with one more in them."""
    out: list[list[int]] = []
    for lo, hi in sorted([*ranges, [x, x]]):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return out


def _newest(tables: list[DataFrame]) -> DataFrame:
    cols = ("commit", "source", "lang", "n_tokens", "live", "old")
    rows = reduce(DataFrame.unionByName, tables).groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct(*cols), "commit").alias("x"))
    return rows.select("x.commit", "doc_id", "tokenizer", *(f"x.{c}" for c in cols[1:]))


def _delta(change: DataFrame) -> DataFrame:
    """The signed effect of a table of changes, pre-aggregated by group."""

    def signed(sign: int, s: str, l: str, n: str) -> Column:
        return F.struct(F.col(s).alias("source"), F.col(l).alias("lang"), F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * F.col(n)).alias("n_tokens"))

    plus = F.when(F.col("live"), signed(1, "source", "lang", "n_tokens"))
    minus = F.when(F.col("old").isNotNull(), signed(-1, "old.source", "old.lang", "old.n_tokens"))
    rows = change.select("tokenizer", F.explode(F.array(plus, minus)).alias("d")).where("d is not null").select("tokenizer", "d.*")
    return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words (runs of anything but ASCII white space) of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def operations(docs: DataFrame, op: str, tokenizer: str, count: Column, seq: int = 0) -> DataFrame:
    return docs.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), count.cast("long").alias("n_tokens"))
