import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import codes as C
from vexel.functions import metadata as M
from vexel.functions import vectors as V


def rows(spark, n=40, d=16, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_columns_agree_with_kernels(spark):
    x, df = rows(spark)
    u = V.unit(F.col("v"))
    out = df.select("id", u.alias("u"), V.quantize_i8(u).alias("q"), V.rotate(F.col("v"), 16, 52).alias("r"), V.norm(u).alias("n")).orderBy("id").collect()
    assert np.allclose([r.u for r in out], V.unit_rows(x), atol=1e-15)
    assert np.array_equal([r.q for r in out], V.quantize_rows(V.unit_rows(x)))
    assert np.allclose([r.r for r in out], V.rotate_rows(x, 52), atol=1e-12)
    kernel = V.with_rotated(df, "v", "r", 52).orderBy("id").collect()
    assert np.allclose([r.r for r in kernel], V.rotate_rows(x, 52), atol=1e-15) and V.with_rotated(df.limit(0), "v", "r", 52).count() == 0
    assert np.allclose(np.linalg.norm(V.rotate_rows(x, 52), axis=1), np.linalg.norm(x, axis=1))  # a rotation keeps lengths


def test_validity_and_padding(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([nan, 1.0],), ([inf, 1.0],), ([1.0],), (None,), ([None, 1.0],)], "v array<double>")
    assert [r.x for r in df.select(V.is_valid(F.col("v"), 2).alias("x")).collect()] == [True] + [False] * 6
    assert df.select(V.is_valid(F.col("v"), 2, False).alias("x")).collect()[1].x
    assert [V.padded_dim(d) for d in (1, 8, 9, 64, 65, 1000, 1024)] == [8, 8, 16, 64, 128, 1024, 1024]


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_residual_scores_follow_the_cosine(spark, bits):
    x, df = rows(spark, 60, 64, 3)
    df = V.with_rotated(df.select("id", V.unit(F.col("v")).alias("v")), "v", "r", 52)
    a = V.with_rotated(df.where("id = 0").select("v"), "v", "ar", 52).select(F.col("v").alias("a"), "ar")
    q = df.where("id < 8").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("r").alias("rq"))
    e = df.crossJoin(a).withColumn("e", C.residual_encode(F.col("v"), F.col("r"), F.col("a"), F.col("ar"), 64, bits)).crossJoin(q)
    s = V.let(C.residual_query(F.col("q"), F.col("rq"), F.col("a"), F.col("ar"), 64), lambda y: C.residual_score(F.col("e.code"), F.col("e.beta"), F.col("e.gain"), y, bits))
    got = e.where("id > 8").select(s.alias("s"), V.dot(F.col("q"), F.col("v")).alias("t")).toPandas()
    assert got.corr().iloc[0, 1] > {1: 0.7, 2: 0.85, 4: 0.98}[bits]
    assert C.residual_bits(128) == 4 and C.residual_bits(256) == 2 and C.residual_bits(512) == 1


def test_transform_codes_scale_and_norm(spark):
    df = spark.createDataFrame([([3.0, -9.0, 0.4], [1.0, 1.0, 2.0])], "r array<double>, s array<double>")
    assert df.select(C.tq_encode(F.col("r"), F.col("s"), 4).alias("c")).first().c == [3, -8, 1]
    assert df.select(C.tq_encode(F.col("r"), F.col("s"), 2).alias("c")).first().c == [1, -2, 1]
    assert df.select(C.tq_encode(F.col("r"), F.col("s"), 1).alias("c")).first().c == [1, 0, 1]
    score = df.select(C.tq_score(F.array(F.lit(2), F.lit(4)), F.array(F.lit(2.0), F.lit(1.0)), F.array(F.lit(3.0), F.lit(1.0))).alias("x")).first().x
    assert score == 3 * 1 - 0.5 + 4 - 8


def test_metadata_encoding():
    meta, nums = M.encode({"a": ["x", "y", "x"], "n": 12_345, "b": True, "e": [], "d": dt.datetime(2024, 3, 9, 12), "p": 2.675}, {"p": M.FloatSpec(2)})
    assert meta == {"a": ["x", "y"], "n": ["12345"], "b": ["true"], "e": [], "d": ["20240309"], "p": ["268" if round(267.5) == 268 else "267"]}
    assert set(M.keys(meta, nums)) >= {"a=x", "a=y", "a:*", "n=12345", "n.b3=12", "n.b6=0", "n.b9=0", "e:*", "b=true", "d=20240309"}
    for bad in ({"1a": "x"}, {"a": "\x01"}, {"a": "x" * 300}, {"n": -1}, {"n": 10**12}, {"a": [str(i) for i in range(300)]}):
        with pytest.raises(ValueError):
            M.encode(bad)
    for bad in ({"p": 1.5}, {"p": None}, {"p": {}}):
        with pytest.raises(TypeError):
            M.encode(bad)


DOCS = [{"lang": "en", "n": 5, "t": ["a", "b"]}, {"lang": "de", "n": 12, "ok": True}, {"lang": "de", "n": [3, 900], "e": []}, {"s": "12"}, {}]
CASES = [
    ({"lang": "de"}, {1, 2}), ({"lang": ["en", "de"]}, {0, 1, 2}), ({"lang": []}, set()), ({"n": ("range", 900, 10)}, {1, 2}), ({"n": ("range", 6, 11)}, set()),
    ({"e": ("exists",)}, {2}), ({"ok": True}, {1}), ({"ok": "true"}, {1}), ({"s": 12}, {3}), ({"s": ("range", 0, 99)}, set()), ({"n": "12"}, {1}), ({"lang": ("re", "^d")}, {1, 2}),
    ({"lang": ("re", "zz")}, set()), ({"lang": "de", "n": ("range", 0, 5)}, {2}), ({"t": ("a", "q")}, {0}), ({}, {0, 1, 2, 3, 4}), (None, {0, 1, 2, 3, 4}), ({"none": "x"}, set()),
]


def test_filters(spark):
    df = spark.createDataFrame([(i, *M.encode(d)) for i, d in enumerate(DOCS)], "id long, meta map<string,array<string>>, nums map<string,array<bigint>>")
    values = lambda f, p: M.matching(df, f, p)
    for cond, want in CASES:
        assert {r.id for r in df.where(M.where(cond, values)).collect()} == want, cond
    assert {r.id: sorted(r.k) for r in df.select("id", M.key_column(F.col("meta"), F.col("nums")).alias("k")).collect()} == {i: sorted(M.keys(*M.encode(d))) for i, d in enumerate(DOCS)}
    assert M.where_from_json({"a": {"range": [1, 2]}, "b": {"regex": "x"}, "c": {"exists": True}, "d": [1]}) == {"a": ("range", 1, 2), "b": ("re", "x"), "c": ("exists",), "d": [1]}
    with pytest.raises(ValueError):
        M.where_from_json({"a": {"other": 1}})
    assert random.Random(1)
