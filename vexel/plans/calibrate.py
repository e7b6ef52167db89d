"""Search budgets against exact ground truth: recall, latency summaries, a statistical lower bound, and the choice of a configuration."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle


def latency_summary(df: DataFrame, col: str) -> DataFrame:
    """One row: mean, p50 and p95 with linear interpolation."""
    return df.agg(F.avg(col).alias("mean"), F.percentile(col, F.lit(0.5)).alias("p50"), F.percentile(col, F.lit(0.95)).alias("p95"))


def bernstein(df: DataFrame, col: str, delta: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mean, bound): the empirical Bernstein lower bound of the mean at confidence 1 - ``delta``, at least 0."""
    g = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.var_samp(col).alias("var"))
    log = F.log(F.lit(2.0 / delta))
    low = F.col("mean") - F.sqrt(F.lit(2.0) * F.col("var") * log / F.col("n")) - F.lit(7.0) * log / (F.lit(3.0) * (F.col("n") - 1))
    return g.select(*by, "n", "mean", F.greatest(F.lit(0.0), low).alias("bound"))


def recall_lower_bound(recalls: Sequence[float], delta: float = 0.05) -> float:
    """The same for values on the driver; needs two or more."""
    n = len(recalls)
    if n < 2 or not 0 < delta < 1:
        raise ValueError("two recalls or more and a confidence in (0, 1)")
    mean = sum(recalls) / n
    var = sum((x - mean) ** 2 for x in recalls) / (n - 1)
    log = math.log(2 / delta)
    return max(0.0, mean - math.sqrt(2 * var * log / n) - 7 * log / (3 * (n - 1)))


def smallest_sample(target: float, delta: float = 0.05, most: int = 1_000_000) -> int | None:
    """The least n at which even perfect recall could prove ``target``; None above ``most``."""
    n = math.ceil(7 * math.log(2 / delta) / (3 * (1 - target))) + 1 if target < 1 else most + 1
    return n if n <= most else None


def halves(queries: DataFrame, group: str) -> DataFrame:
    """``queries`` with ``partition``: of each predicate group the even occurrences train, the odd ones validate."""
    w = Window.partitionBy(group).orderBy("qid")
    return queries.withColumn("partition", F.when((F.row_number().over(w) - 1) % 2 == 0, "train").otherwise("validation"))


#: Queries for which a calibration traces where neighbours are lost.
TRACE = 64


def measure_collection(collection: Any, queries: DataFrame, truth: DataFrame) -> Measure:
    """A measure of a frozen collection without a log, for queries (qid, q, partition[, grp]) and their true neighbours (qid, rank, id).

    The partitions are ``train`` (or ``calibration``) and ``validation``. A group of related queries lies in one of them, as
    validation would not be independent otherwise. Recall counts over all queries of a partition; routing losses over ``TRACE``.
    """
    if collection.m["logs"] or not collection.m["index"]:
        raise ValueError("only a frozen index can be calibrated: compact it first")
    queries = queries.withColumn("partition", F.when(F.col("partition") == "calibration", "train").otherwise(F.col("partition")))
    if "grp" in queries.columns and queries.where("grp <> ''").groupBy("grp").agg(F.countDistinct("partition").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a group of queries lies in both partitions")
    k = truth.agg(F.max("rank")).first()[0]

    def measure(part: str, nprobe: int, rerank: int) -> Measurement:
        from .collection import SearchParams

        p = SearchParams(nprobe, max(rerank, k), exact_limit=0)
        q = queries.where(F.col("partition") == part).select("qid", "q")
        began = time.perf_counter()
        found = settle(collection.search(q, k, params=p).select("qid", "id", F.lit(1).alias("hit")), "found")
        seconds = time.perf_counter() - began
        t = truth.join(q.select("qid"), "qid", "left_semi").join(found, ["qid", "id"], "left")
        recalls = [r.r for r in t.groupBy("qid").agg((F.count("hit") / F.lit(float(k))).alias("r")).collect()]
        some = q.orderBy("qid").limit(TRACE)
        lost = collection.diagnose(some, k, p, truth.join(some.select("qid"), "qid", "left_semi")).agg(F.sum("watched").alias("w"), F.sum("routed").alias("r")).first()
        return Measurement(nprobe, rerank, recalls, seconds, (lost.r or 0) / max(lost.w or 0, 1))

    return measure


def reach(collection: Any, queries: DataFrame, top_k: int, target: float, nprobe: int, rerank: int) -> tuple[int, float]:
    """(probes, mean recall): the probes of a collection, doubled from ``nprobe`` on while they find less than ``target`` of the true
    neighbours and there are more cells. What a fixed number of probes finds falls as cells are split."""
    from ..operators import ivf, topk
    from .collection import SearchParams

    cells = max(collection.cell_stats()["filled_cells"], (collection.m["index"] or {"k": 0})["k"])
    truth = settle(topk.exact_top_k(collection.state().where(~F.col("deleted")), queries, top_k), "truth")
    while True:
        found = collection.search(queries, top_k, params=SearchParams(nprobe, rerank, exact_limit=0))
        recall = ivf.recall(found, truth, top_k).agg(F.avg("recall")).first()[0] or 0.0
        if recall >= target or nprobe >= cells:
            return nprobe, recall
        nprobe = min(2 * nprobe, cells)


@dataclass
class Measurement:
    nprobe: int
    rerank: int
    recalls: list[float]
    seconds: float
    routed: float = 1.0

    @property
    def recall(self) -> float:
        return sum(self.recalls) / max(len(self.recalls), 1)


@dataclass
class Profile:
    fingerprint: str
    configuration: dict[str, int] | None
    status: str
    measurements: list[dict[str, Any]] = field(default_factory=list)
    validated: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Profile:
        return cls(**json.loads(text))


#: measure(partition, nprobe, rerank) -> Measurement: one batched search job and its recall aggregate.
Measure = Callable[[str, int, int], Measurement]


def calibrate(measure: Measure, grid: Sequence[tuple[int, int]], target: float, fingerprint: str, groups: Sequence[str] = ("train",)) -> Profile:
    """The fastest configuration whose training recall meets ``target`` in every group, validated once on the other queries."""
    done: list[dict[str, Any]] = []
    fit: list[tuple[float, int, int]] = []
    for nprobe, rerank in grid:
        ms = [measure(g, nprobe, rerank) for g in groups]
        done += [{"partition": g, "nprobe": nprobe, "rerank": rerank, "recall": m.recall, "seconds": m.seconds} for g, m in zip(groups, ms)]
        if all(m.recall >= target for m in ms):
            fit.append((max(m.seconds for m in ms), nprobe, rerank))
    if not fit:
        return Profile(fingerprint, None, "no_configuration", done)
    _, nprobe, rerank = min(fit)
    v = measure("validation", nprobe, rerank)
    done.append({"partition": "validation", "nprobe": nprobe, "rerank": rerank, "recall": v.recall, "seconds": v.seconds})
    return Profile(fingerprint, {"nprobe": nprobe, "rerank": rerank}, "validated" if v.recall >= target else "quality_not_validated", done, v.recall >= target)


def autocalibrate(measure: Measure, start: tuple[int, int], most: tuple[int, int], target: float, fingerprint: str) -> Profile:
    """Double the probes while routing loses too many neighbours, else the rerank budget; stop at the budgets; validate once."""
    nprobe, rerank = start
    done = []
    while True:
        m = measure("train", nprobe, rerank)
        done.append({"partition": "train", "nprobe": nprobe, "rerank": rerank, "recall": m.recall, "routed": m.routed, "seconds": m.seconds})
        if m.recall >= target:
            break
        if m.routed < target and nprobe < most[0]:
            nprobe = min(2 * nprobe, most[0])
        elif rerank < most[1]:
            rerank = min(2 * rerank, most[1])
        elif nprobe < most[0]:
            nprobe = min(2 * nprobe, most[0])
        else:
            return Profile(fingerprint, {"nprobe": nprobe, "rerank": rerank}, "quality_not_validated", done)
    v = measure("validation", nprobe, rerank)
    done.append({"partition": "validation", "nprobe": nprobe, "rerank": rerank, "recall": v.recall, "seconds": v.seconds})
    return Profile(fingerprint, {"nprobe": nprobe, "rerank": rerank}, "validated" if v.recall >= target else "quality_not_validated", done, v.recall >= target)


def calibrate_snapshot(measure: Measure, start: tuple[int, int], most: tuple[int, int], target: float, fingerprint: str, n_validation: int, max_seconds: float | None = None, delta: float = 0.05, load: Callable[[], str | None] = lambda: None, save: Callable[[str], None] = lambda s: None) -> Profile:
    """Accept a configuration by its Bernstein bound. The stage that loses more neighbours grows; the quality choice, and the best
    one within ``max_seconds``, are frozen before each is audited once with delta / 2. ``load``/``save`` resume from a checkpoint."""
    need = smallest_sample(target, delta / 2)
    if need is None or n_validation < need:
        raise ValueError(f"{n_validation} validation queries cannot prove {target}: {need} are needed")
    state: dict[str, Any] = {"fingerprint": fingerprint, "next": list(start), "done": [], "quality": None, "quick": None, "audits": {}}
    if (old := load()) is not None:
        kept = json.loads(old)
        if kept["fingerprint"] != fingerprint:
            raise ValueError("the checkpoint belongs to another index")
        state = kept
    while state["quality"] is None:
        nprobe, rerank = state["next"]
        m = measure("train", nprobe, rerank)
        state["done"].append({"partition": "train", "nprobe": nprobe, "rerank": rerank, "recall": m.recall, "routed": m.routed, "seconds": m.seconds})
        if max_seconds is None or m.seconds <= max_seconds:
            state["quick"] = [nprobe, rerank]
        if recall_lower_bound(m.recalls, delta) >= target or (nprobe >= most[0] and rerank >= most[1]):
            state["quality"] = [nprobe, rerank]
        elif (1 - m.routed >= m.routed - m.recall and nprobe < most[0]) or rerank >= most[1]:
            state["next"] = [min(2 * nprobe, most[0]), rerank]
        else:
            state["next"] = [nprobe, min(2 * rerank, most[1])]
        save(json.dumps(state))
    choices = [c for c in (state["quality"], state["quick"]) if c]
    for c in choices:
        key = f"{c[0]}/{c[1]}"
        if key not in state["audits"]:
            v = measure("validation", *c)
            state["audits"][key] = [recall_lower_bound(v.recalls, delta / 2), v.seconds]
            state["done"].append({"partition": "validation", "nprobe": c[0], "rerank": c[1], "recall": v.recall, "seconds": v.seconds})
            save(json.dumps(state))
    bound, seconds = state["audits"][f"{choices[0][0]}/{choices[0][1]}"]
    conf = {"nprobe": choices[0][0], "rerank": choices[0][1]}
    if bound < target:
        return Profile(fingerprint, conf, "quality_not_validated", state["done"])
    if max_seconds is not None and seconds > max_seconds:
        return Profile(fingerprint, conf, "latency_tradeoff", state["done"], True)
    return Profile(fingerprint, conf, "validated", state["done"], True)
