"""Dense vector arithmetic on ARRAY<DOUBLE> columns via higher-order functions.

Sums run left to right (``aggregate``), the same order a sequential loop uses,
so results are reproducible across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(x, w) -> Column:
    """sum_j x_j * w_j, accumulated left to right."""
    return F.aggregate(F.zip_with(_c(x), _c(w), lambda a, b: a * b),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def sq_norm(x) -> Column:
    """sum_j x_j^2."""
    return F.aggregate(_c(x), F.lit(0.0).cast("double"), lambda acc, v: acc + v * v)


def scale(x, c) -> Column:
    c = F.lit(c) if not isinstance(c, (Column, str)) else _c(c)
    return F.transform(_c(x), lambda v: v * c)


def add(x, y) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a + b)


def axpy(a, x, y) -> Column:
    """y + a * x element-wise."""
    a = F.lit(a) if not isinstance(a, (Column, str)) else _c(a)
    return F.zip_with(_c(x), _c(y), lambda u, v: v + a * u)
