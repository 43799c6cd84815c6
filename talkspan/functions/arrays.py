"""Vectors and arrays in rows, by higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Over the components that both have."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n <= 0, F.lit(0.0)).otherwise(total(F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(1))), F.slice(b, 1, F.greatest(n, F.lit(1))), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2(v: Column, floor: float = 1e-12) -> Column:
    """Unit vector; the norm counts as `floor` at least. Pass a column, not an expression: it is read per component."""
    return F.transform(v, lambda x: x / F.greatest(F.lit(floor), norm(v)))


def cosine_distance(a: Column, b: Column, guard: float = 1e-10) -> Column:
    """1 - cosine; 1 if a has a component that is not finite."""
    odd = F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(odd, F.lit(1.0)).otherwise(1 - dot(a, b) / F.greatest(F.lit(guard), norm(a) * norm(b)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def argmax(v: Column) -> Column:
    """Index from 0 of the first greatest component."""
    return F.array_position(v, F.array_max(v)) - 1


def argsort(v: Column) -> Column:
    """Indexes from 0 by rising value, stable."""
    return F.transform(F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def top_k(v: Column, k: int) -> Column:
    """Indexes from 0 of the k greatest; the earlier at a tie."""
    keyed = F.transform(v, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["i"])


def softmax(v: Column, floor: float = 1e-12) -> Column:
    """Shifted by the greatest; no component below floor."""
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: F.greatest(F.lit(floor), x / total(e)))


def log_sum_exp(v: Column) -> Column:
    return F.array_max(v) + F.log(total(F.transform(v, lambda x: F.exp(x - F.array_max(v)))))


def gather(samples: Column, spans: Column) -> Column:
    """Samples of the spans (start, end), clamped to the array, one after another."""
    n = F.size(samples)

    def one(s: Column) -> Column:
        a = F.greatest(F.lit(0), s["start"]).cast("int")
        return F.slice(samples, a + 1, F.greatest(F.lit(0), F.least(n, s["end"].cast("int")) - a))

    return F.flatten(F.transform(spans, one))


def padded(v: Column, n: int) -> Column:
    """v cut or filled up with zeros to n."""
    return F.concat(F.slice(v, 1, n), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - F.size(v)).cast("int")))


def pre_emphasis(v: Column, c: float) -> Column:
    """x[i] - c * x[i-1]; the first sample against itself."""
    return F.transform(v, lambda x, i: x - c * F.element_at(v, F.greatest(i, F.lit(1))))


#: Windows over n points, i from 0; phases in full turns per n - 1 points, or per n where periodic.
_COSINES = {"hanning": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08), "hann": (0.5, 0.5, 0.0), "povey": (0.5, 0.5, 0.0)}


def window_function(kind: str, n: int) -> Column:
    """array<double> of n weights. Unknown kinds raise."""
    i = F.sequence(F.lit(0), F.lit(n - 1))
    if kind == "rectangular":
        return F.transform(i, lambda x: F.lit(1.0))
    if kind == "sine":
        return F.transform(i, lambda x: F.sin(x * (math.pi / (n - 1))))
    if kind not in _COSINES:
        raise ValueError(f"unknown window {kind!r}")
    a, b, c = _COSINES[kind]
    turn = 2 * math.pi / (n if kind == "hann" else n - 1)
    curve = lambda x: a - b * F.cos(x * turn) + c * F.cos(x * (2 * turn))
    return F.transform(i, lambda x: F.pow(curve(x), F.lit(0.85)) if kind == "povey" else curve(x))


def lifter(n: int, q: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 1 + 0.5 * q * F.sin(i * (math.pi / q)))


def dct(rows: int, columns: int) -> Column:
    """Orthonormal DCT-II matrix, by rows."""
    def row(k: Column) -> Column:
        scale = F.when(k == 0, F.lit(math.sqrt(1 / columns))).otherwise(F.lit(math.sqrt(2 / columns)))
        return F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: scale * F.cos((j + 0.5) * k * (math.pi / columns)))

    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), row)
