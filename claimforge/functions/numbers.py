"""Rates, rounding and similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """part / whole, rounded; 0 where there is no whole."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), places), F.lit(0.0))


def whole_median(x: Column) -> Column:
    """The exact median, cut to an integer."""
    return F.coalesce(F.median(x).cast("int"), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the JVM has no such function."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
