"""Scalar functions that Spark lacks, as column expressions or driver functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_TAU = 2.5066282746310002


def normal_density(residual: Column) -> Column:
    return F.exp(-0.5 * residual * residual) / F.lit(ROOT_TAU)


def chi2_tail(x: float, dof: int = 1) -> float:
    """P(chi-squared > x): 1 for x <= 0; by the recurrence of the regularised upper gamma over dof."""
    if math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2
    if dof % 2:
        total, term, at = math.erfc(math.sqrt(half)), math.sqrt(half) * math.exp(-half) / math.gamma(1.5), 1.5
    else:
        total, term, at = math.exp(-half), half * math.exp(-half), 2.0
    k = 1 if dof % 2 else 2
    while k < dof:
        total += term
        term *= half / at
        at, k = at + 1, k + 2
    return total


def chi2_tail_column(x: Column, terms: int = 400) -> Column:
    """chi2_tail of one degree of freedom inside the JVM.

    erfc(z), z = sqrt(x / 2): below 2 by the series of erf, above by the continued fraction from its end.
    """
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    zz = z * z
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    step = lambda acc, i: F.struct((acc["term"] * 2 * zz / (2 * i + 1)).alias("term"), (acc["total"] + acc["term"] * 2 * zz / (2 * i + 1)).alias("total"))
    series = 1 - 2 / math.sqrt(math.pi) * z * F.exp(-zz) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda acc: acc["total"])
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), z, lambda acc, i: z + (i / 2.0) / acc)
    return F.when(x <= 0, 1.0).when(z < 2, series).otherwise(F.exp(-zz) / (math.sqrt(math.pi) * fraction))


def python_float(x: float) -> str:
    return repr(float(x))


def fixed(x: float, digits: int) -> str:
    """Half to even on the exact binary value."""
    return format(x, f".{digits}f")
