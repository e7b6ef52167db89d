"""Vector arithmetic: Column builders that stay in the JVM, and numpy kernels for Arrow batches.

The Column forms are the readable contract (tests hold the kernels to them); the kernels are what heavy plans use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

MAX_DIM = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_i8(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    return let(norm(v), lambda n: F.transform(v, lambda x: x / n))


def is_valid(v: Column, dim: int, nonzero: bool = True) -> Column:
    """Right length, all components finite, and not the zero vector if asked."""
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0) if nonzero else ok, F.lit(False))


def padded_dim(dim: int) -> int:
    """The least power of two that is 8 or more and holds ``dim``."""
    return max(8, 1 << (dim - 1).bit_length())


def pad(v: Column, dim: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), dim - F.size(v)))


def largest(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x)))


def quantize_i8(v: Column, top: Column | None = None) -> Column:
    """Round half to even of x * 127 / (max |x| + 1e-9); ``top`` replaces the vector's own maximum (anchors share one)."""
    return let(F.lit(127.0) / ((largest(v) if top is None else top) + F.lit(1e-9)), lambda s: F.transform(v, lambda x: F.rint(x * s).cast("int")))


_MASK = (1 << 64) - 1


def splitmix64(state: int) -> tuple[int, int]:
    """(next state, output) of the public generator."""
    state = (state + 0x9E3779B97F4A7C15) & _MASK
    z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return state, z ^ (z >> 31)


#: Fixed value: what the seed is mixed with before signs are drawn.
SIGN_SALT = 0x51CA


def signs(dim: int, seed: int) -> list[int]:
    state, out = seed ^ SIGN_SALT, []
    for _ in range(dim):
        state, z = splitmix64(state)
        out.append(1 if z & 1 else -1)
    return out


def rotate(v: Column, dim: int, seed: int) -> Column:
    """Walsh-Hadamard transform of the signed vector over sqrt(dim): quadratic in ``dim`` and interpreted, for small inputs."""
    signed = F.zip_with(v, F.array(*(F.lit(float(s)) for s in signs(dim, seed))), lambda x, s: x * s)
    at = F.sequence(F.lit(0), F.lit(dim - 1))

    def row(sv: Column) -> Column:
        one = lambda i: F.aggregate(F.zip_with(sv, at, lambda x, j: F.when(F.bit_count(i.bitwiseAND(j)) % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.lit(float(dim)))
        return F.transform(at, one)

    return let(signed, row)


def rotate_rows(v: np.ndarray, seed: int) -> np.ndarray:
    """The same for the rows of a matrix, in n log n."""
    n, d = v.shape
    x = v * np.array(signs(d, seed), np.float64)
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def matrix(col) -> np.ndarray:
    """Rows of an Arrow list column (or a pandas series of arrays) as doubles."""
    if hasattr(col, "values") and hasattr(col, "offsets"):
        flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
        return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)
    return np.array([np.asarray(x, np.float64) for x in col])


def unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def quantize_rows(v: np.ndarray, top: float | None = None) -> np.ndarray:
    m = np.abs(v).max(1, keepdims=True) if top is None else top
    return np.rint(v * (127.0 / (m + 1e-9))).astype(np.int32)


def with_rotated(df: DataFrame, vec_col: str, out_col: str, seed: int) -> DataFrame:
    """``df`` with the seeded rotation of ``vec_col`` (its length a power of two), by the kernel over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index(vec_col)))
            r = rotate_rows(x, seed) if len(x) else x.reshape(0, 0)
            n = r.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(r) * n + 1, n or 1, dtype=np.int32)), pa.array(r.ravel())) if len(r) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, out_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out_col, ArrayType(DoubleType()))]))
