"""Vectors as arrays, and a deterministic embedding of texts for use without a hosted model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import SETTINGS
from quarry.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def measured(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, which loses no bit, and the squares of their lengths."""
    m = np.asarray(m, np.float64)
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, initial=0.0))[1][:, None])
    return m, (m * m).sum(axis=1)


def cosines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], blank: float = 0.0) -> np.ndarray:
    """Cosine of each row of a with each of b, both measured(): one root and one division, so whole numbers give the same double
    in any order of summing. blank where a vector has no length."""
    scale = np.sqrt(np.outer(a[1], b[1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale == 0, blank, a[0] @ b[0].T / scale)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves of the product with 10^digits away from zero, which is round() in the SQL."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    with np.errstate(invalid="ignore"):
        return np.copysign(whole + (scaled - whole >= 0.5), x) / 10.0**digits


def rounded_column(c: Column, digits: int) -> Column:
    """rounded() of a column; F.round(c, digits) takes halves of the shortest decimal instead."""
    return F.round(c * 10.0**digits) / 10.0**digits


def hashed(c: Column, role: str = "similarity", dimension: int = SETTINGS.dimension) -> Column:
    """Signed counts of hashed tokens; queries and passages share a space, other roles have their own."""
    seed = "" if role in ("query", "passage", "similarity") else role

    @F.pandas_udf("array<double>")
    def vector(rows: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for terms in rows:
            v = np.zeros(dimension)
            for term in terms if terms is not None else ():
                if term not in known:
                    h = hashlib.md5((seed + term).encode()).hexdigest()
                    known[term] = (int(h[:7], 16) % dimension, 1.0 if int(h[7], 16) % 2 == 0 else -1.0)
                at, sign = known[term]
                v[at] += sign
            out.append(v)
        return pd.Series(out)

    return vector(tokens(c))
