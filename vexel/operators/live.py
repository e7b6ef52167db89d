"""The mutation log: folding it to the current state, rejected operations, idempotent inserts, merging with the frozen tier.

A log row is (seq, op, id, v/vsrc, tags, token, digest); order is ``seq``. Everything is windows, aggregates and equi-joins by id
or token; nothing is replayed row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import settle

OPS = ("insert", "update", "set_metadata", "add_metadata", "delete")


@dataclass
class Folded:
    """born(id, seq), vectors(id, vsrc), tags(id, tag), deleted(id, seq), rejected(seq, op, id), inserts(seq, token, outcome, id)."""

    born: DataFrame
    vectors: DataFrame
    tags: DataFrame
    deleted: DataFrame
    rejected: DataFrame
    inserts: DataFrame


def idempotent_inserts(log: DataFrame, base_n: int) -> DataFrame:
    """(seq, token, digest, vsrc, tag, outcome, id): the first row of a token inserts and gets the next id; later ones with its
    digest are replays that return that id, others are conflicts. Rows without a token always insert."""
    rows = log.where(F.col("op") == "insert")
    first = rows.where("token is not null").groupBy("token").agg(F.min("seq").alias("s0"), F.min_by("digest", "seq").alias("d0"))
    seen = rows.join(first, "token", "left").withColumns({"new": F.col("token").isNull() | (F.col("seq") == F.col("s0")), "s0": F.coalesce("s0", "seq")})
    seen = seen.withColumn("outcome", F.when(F.col("new"), "insert").when(F.col("digest").eqNullSafe(F.col("d0")), "replay").otherwise("conflict"))
    ids = allocate(seen.where("new").select("s0"), "s0", base_n)
    return seen.join(ids, "s0").select("seq", "token", "digest", "vsrc", "tag", "outcome", F.when(F.col("outcome") != "conflict", F.col("new_id")).alias("id"))


def allocate(rows: DataFrame, order: str, base_n: int, parts: int = 64) -> DataFrame:
    """``new_id`` = base_n, base_n + 1, ... in the order of ``order``: ranges are numbered inside, then shifted by the sizes before them
    (a table of at most ``parts`` rows), so no task sees all rows. The ranges are written: their bounds are drawn from a sample, and a
    second evaluation may draw others."""
    ranged = settle(rows.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))
    ranged = ranged.withColumn("n_in", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    before = sizes.withColumn("shift", F.coalesce(F.sum("size").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "shift")
    return ranged.join(F.broadcast(before), "part").withColumn("new_id", F.col("n_in") + F.col("shift") + F.lit(base_n - 1)).drop("part", "n_in", "shift")


def fold(log: DataFrame, base: DataFrame) -> Folded:
    """The state after the whole log. ``base``: the ids (dense from 0) that exist before it, with ``vsrc`` and no tags.

    A row applies if its id was born before it and not deleted before it; what does not apply is rejected. Deletes are terminal
    and idempotent. Tags: those since the last row that replaced them (birth, update, set), joined with what was added after it.
    """
    base_n = base.count()
    ins = idempotent_inserts(log, base_n)
    made = ins.where("outcome = 'insert'")
    born = base.select("id", F.lit(-1).cast("long").alias("seq"), "vsrc", F.lit(None).cast("string").alias("tag")).unionByName(made.select("id", "seq", "vsrc", "tag"))
    other = log.where(F.col("op") != "insert").select("seq", "op", "id", "vsrc", "tag")
    known = other.join(born.select("id", F.col("seq").alias("bs")), "id", "left").withColumn("exists", F.coalesce(F.col("bs") < F.col("seq"), F.lit(False)))
    deleted = known.where("op = 'delete' and exists").groupBy("id").agg(F.min("seq").alias("ds"))
    st = known.join(deleted, "id", "left").withColumn("ok", F.col("exists") & ((F.col("op") == "delete") | F.col("ds").isNull() | (F.col("seq") < F.col("ds"))))
    rejected = st.where(~F.col("ok")).select("seq", "op", "id")
    ok = st.where("ok").select("seq", "op", "id", "vsrc", "tag")
    changes = born.select("seq", F.lit("born").alias("op"), "id", "vsrc", "tag").unionByName(ok)
    vectors = changes.where("op in ('born', 'update')").groupBy("id").agg(F.max_by("vsrc", "seq").alias("vsrc"))
    reset = changes.where("op in ('born', 'update', 'set_metadata')").groupBy("id").agg(F.max("seq").alias("r"))
    tags = changes.where("op <> 'delete' and tag is not null").join(reset, "id").where("seq >= r").select("id", "tag").distinct()
    gone = deleted.select("id", F.col("ds").alias("seq"))
    return Folded(born.select("id", "seq"), vectors, tags, gone, rejected, ins)


def visible(state: Folded) -> DataFrame:
    """(id, vsrc) of what is not deleted."""
    return state.vectors.join(state.deleted.select("id"), "id", "left_anti")


def stats(state: Folded) -> DataFrame:
    """One row: allocated, deleted, active, idempotency_records."""
    a = state.born.agg(F.count(F.lit(1)).alias("allocated"))
    d = state.deleted.agg(F.count(F.lit(1)).alias("deleted"))
    t = state.inserts.where("token is not null").agg(F.countDistinct("token").alias("idempotency_records"))
    return a.crossJoin(d).crossJoin(t).select("allocated", "deleted", (F.col("allocated") - F.col("deleted")).alias("active"), "idempotency_records")


def add_all_or_nothing(log: DataFrame, born: DataFrame, deleted: DataFrame) -> DataFrame:
    """(seq, id, tag) of the ``add_metadata`` rows with ``ids`` whose every id exists and is not deleted at that point."""
    e = log.where("op = 'add_metadata'").select("seq", "tag", F.explode("ids").alias("id"))
    e = e.join(born.select("id", F.col("seq").alias("bs")), "id", "left").join(deleted.select("id", F.col("seq").alias("ds")), "id", "left")
    e = e.withColumn("ok", F.coalesce(F.col("bs") < F.col("seq"), F.lit(False)) & (F.col("ds").isNull() | (F.col("seq") < F.col("ds"))))
    whole = e.groupBy("seq").agg(F.min(F.col("ok").cast("int")).alias("all_ok")).where("all_ok = 1")
    return e.join(whole.select("seq"), "seq").select("seq", "id", "tag")


def merge(*tiers: DataFrame) -> DataFrame:
    """Frozen and live results (qid, id, score) as one, each id once by its best score."""
    out = tiers[0].select("qid", "id", "score")
    for t in tiers[1:]:
        out = out.unionByName(t.select("qid", "id", "score"))
    return out.groupBy("qid", "id").agg(F.max("score").alias("score"))
