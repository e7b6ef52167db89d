"""Compact codes of vectors: transform-quantised codes of 1, 2 or 4 bits a dimension, and residual codes against a cell's centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import dot, largest, let

#: Mean absolute value to standard deviation of a normal variable.
SIGMA = 1.2533
#: The largest value that the gain may take (half precision at rest).
GAIN_MAX = 65504.0


def tq_levels(bits: int) -> float:
    return (1 << (bits - 1)) - 1 + 0.5


def tq_scale(rotated: DataFrame, bits: int, vec_col: str = "r", id_col: str = "id", every: int = 64) -> DataFrame:
    """(d, scale): of each rotated dimension, from the rows whose id is a multiple of ``every``; about three sigma fill the levels."""
    e = rotated.where(F.col(id_col) % every == 0).select(F.posexplode(vec_col).alias("d", "x"))
    return e.groupBy("d").agg((F.lit(tq_levels(bits)) / (F.lit(3.0) * F.lit(SIGMA) * F.avg(F.abs("x")) + F.lit(1e-9))).alias("scale"))


def tq_encode(r: Column, scale: Column, bits: int) -> Column:
    if bits == 1:
        return F.transform(r, lambda x: F.when(x >= 0, 1).otherwise(0))
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    return F.zip_with(r, scale, lambda x, s: F.greatest(F.lit(low), F.least(F.lit(high), F.rint(x * s).cast("int"))))


def tq1_score(code: Column, q8: Column) -> Column:
    """Sum of the query's int8 values where the bit is set."""
    return F.aggregate(F.zip_with(code, q8, lambda b, q: b * q), F.lit(0), lambda s, x: s + x)


def tq_score(code: Column, scale: Column, q: Column) -> Column:
    """q . c - |c|^2 / 2 of the decoded code c: the ranking by squared distance (rounding changes norms, so a plain product is biased)."""
    c = F.zip_with(code, scale, lambda x, s: x / s)
    return let(c, lambda c: F.aggregate(F.zip_with(q, c, lambda x, y: x * y - F.lit(0.5) * y * y), F.lit(0.0), lambda s, x: s + x))


def residual_bits(dim: int) -> int:
    return 4 if dim <= 128 else 2 if dim <= 256 else 1


def residual_dims(dim: int) -> int:
    return min(dim, 512)


def minus(a: Column, factor: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - factor * y)


def residual_encode(v: Column, r: Column, a: Column, ar: Column, dim: int, bits: int | None = None) -> Column:
    """struct(beta, gain, code): ``r`` and ``ar`` are the rotated vector and the rotated unit centre ``a``."""
    bits = bits or residual_bits(dim)
    levels, cd = float((1 << bits) - 1), residual_dims(dim)

    def encode(w: Column) -> Column:
        top = F.greatest(largest(F.slice(w, 1, cd)), F.lit(1e-30))
        if bits == 1:
            code = F.transform(F.slice(w, 1, cd), lambda x: F.when(x >= 0, 1).otherwise(0))
        else:
            code = let(top, lambda t: F.transform(F.slice(w, 1, cd), lambda x: F.greatest(F.lit(0), F.least(F.lit(int(levels)), F.rint((x / t + 1) * levels * F.lit(0.5)).cast("int")))))

        def pack(c: Column) -> Column:
            denom = F.aggregate(F.zip_with(F.slice(w, 1, cd), c, lambda x, u: x * (u * 2 - int(levels))), F.lit(0.0), lambda s, x: s + x)
            return F.struct((dot(w, w) / F.greatest(denom, F.lit(1e-20))).alias("gain"), c.alias("code"))

        return let(code, pack)

    return let(dot(v, a), lambda b: let(minus(r, b, ar), lambda w: let(encode(w), lambda e: F.struct(b.alias("beta"), e.getField("gain").alias("gain"), e.getField("code").alias("code")))))


def residual_query(q: Column, rq: Column, a: Column, ar: Column, dim: int) -> Column:
    """struct(qa, qs, q8): the query against one cell, its own projection on the centre taken out."""
    cd = residual_dims(dim)

    def weigh(w: Column, qa: Column) -> Column:
        return let(largest(w), lambda top: F.struct(qa.alias("qa"), (top / F.lit(127.0)).alias("qs"), F.transform(w, lambda x: F.rint(x / (top + F.lit(1e-9)) * F.lit(127.0)).cast("int")).alias("q8")))

    return let(dot(q, a), lambda qa: let(F.slice(minus(rq, qa, ar), 1, cd), lambda w: weigh(w, qa)))


def residual_score(code: Column, beta: Column, gain: Column, query: Column, bits: int) -> Column:
    levels = (1 << bits) - 1
    d = F.aggregate(F.zip_with(code, query.getField("q8"), lambda u, x: x * (u * 2 - levels)), F.lit(0), lambda s, x: s + x)
    return d * query.getField("qs") * gain + beta * query.getField("qa")
