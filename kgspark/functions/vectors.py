"""Vector functions on array columns, inside the JVM."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Null if one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def require_dim(v: Column, dim: int) -> Column:
    """The vector, or an error at run time if its length is another."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vector of length {dim} expected, got "), F.size(v).cast("string"))).cast("array<float>"))


def usable(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def rrf(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank share of a rank from 1."""
    return 1.0 / (F.lit(k) + rank)


@F.pandas_udf(T.StringType())
def encode_float32(v: pd.Series) -> pd.Series:
    """Base64 of the little-endian float32 values."""
    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_float32(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))
