"""Student-t tail probability, vectorised for Arrow batches of aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)  # made for each call: one that was used can not be sent to workers


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated from the tail."""
    value = np.ones_like(x)
    for m in range(steps, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1.0 + odd / (1.0 + even / value)
    return 1.0 / value


def regularised_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for x in [0, 1]."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        part = np.where((y <= 0.0), 0.0, front * _beta_fraction(p, q, y))
    return np.where(flip, 1.0 - part, part)


def two_sided_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's t."""
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(dof) & (dof > 0)
    out[ok] = regularised_beta(dof[ok] / 2.0, np.full(ok.sum(), 0.5), dof[ok] / (dof[ok] + t[ok] ** 2))
    return out


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    p = two_sided_p(t.to_numpy(dtype=float, na_value=np.nan), dof.to_numpy(dtype=float, na_value=np.nan))
    return pd.Series(p).astype(object).where(~np.isnan(p), None).astype("Float64")
