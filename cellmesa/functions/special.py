"""Special functions that Spark lacks: erfc as one SQL expression, Student's t tail as a vectorised function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cody's rational approximations of erf and erfc (Math. Comp. 23, 1969), as numerator and denominator
# coefficients, highest power first.
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0e0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
MID_DEN = (1.0e0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
FAR_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
FAR_DEN = (1.0e0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c:.17e})"
    return text


def erfc_sql(x: str) -> str:
    """erfc of a non-negative SQL expression, as text that Spark and DuckDB both read."""
    z, r = f"(({x}) * ({x}))", f"(1.0e0 / (({x}) * ({x})))"
    near = f"1.0e0 - ({x}) * {_horner(ERF_NUM, z)} / {_horner(ERF_DEN, z)}"
    mid = f"exp(-{z}) * {_horner(MID_NUM, f'({x})')} / {_horner(MID_DEN, f'({x})')}"
    far = f"exp(-{z}) / ({x}) * ({1 / math.sqrt(math.pi):.17e} - {r} * {_horner(FAR_NUM, r)} / {_horner(FAR_DEN, r)})"
    return f"(CASE WHEN ({x}) <= 0.46875e0 THEN {near} WHEN ({x}) <= 4.0e0 THEN {mid} WHEN ({x}) < 26.5e0 THEN {far} ELSE 0.0e0 END)"


def normal_p_sql(z: str) -> str:
    """Two-sided p-value of a normal score."""
    return erfc_sql(f"(abs({z}) * {1 / math.sqrt(2):.17e})")


def normal_p(z: str) -> Column:
    """The same for a column. The argument is bound once, as a lambda's variable: were it inlined at each of its places in the
    polynomials, generated methods would outgrow the JVM's limit."""
    name = "x_"
    return F.expr(f"transform(array(abs({z}) * {1 / math.sqrt(2):.17e}), {name} -> {erfc_sql(name)})[0]")


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction, elementwise."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny, c = 1e-300, np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.nanmax(np.abs(step - 1), initial=0) < 1e-15:
                break
        value = front * h
    value = np.where(y <= 0, 0.0, value)
    return np.where(swap, 1 - value, value)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= t) of Student's t; null or NaN scores give 1."""
    x, n = t.to_numpy(float), df.to_numpy(float)
    bad = ~np.isfinite(n) | np.isnan(x)
    x, n = np.where(bad, 0.0, x), np.where(bad, 1.0, n)
    p = incomplete_beta(n / 2, np.full_like(n, 0.5), n / (n + x * x))
    return pd.Series(np.where(bad, 1.0, p))
