"""Vector functions over array columns, computed in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes as an array."""
    return blobs.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())
