"""Label mapping and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_pm1(col, mode: str = "zero_neg", k: float | None = None) -> Column:
    """Map a raw label to +1 / -1 (as DOUBLE).

    modes: ``zero_neg`` 0 -> -1 else +1; ``any_positive`` >0 -> +1 (use on a sum or
    count); ``unknown_pos`` {0:-1, 1:+1}, anything else +1; ``threshold`` >= k -> +1;
    ``parity`` odd -> +1; ``nonzero`` != 0 -> +1.
    """
    c = _c(col)
    pos, neg = F.lit(1.0), F.lit(-1.0)
    if mode == "zero_neg":
        return F.when(c == 0, neg).otherwise(pos)
    if mode == "any_positive":
        return F.when(c > 0, pos).otherwise(neg)
    if mode == "unknown_pos":
        return F.when(c == 0, neg).when(c == 1, pos).otherwise(pos)
    if mode == "threshold":
        if k is None:
            raise ValueError("threshold mode needs k")
        return F.when(c >= F.lit(k), pos).otherwise(neg)
    if mode == "parity":
        return F.when(F.pmod(c.cast("long"), F.lit(2)) == 1, pos).otherwise(neg)
    if mode == "nonzero":
        return F.when(c != 0, pos).otherwise(neg)
    raise ValueError(f"unknown label mode {mode!r}")


def to_01(col) -> Column:
    """+1 -> 1, anything else -> 0."""
    return F.when(_c(col) == 1, F.lit(1)).otherwise(F.lit(0))


def coerce_zero(col) -> Column:
    """A 0 prediction/label counts as +1 (before accuracy/F1 scoring)."""
    c = _c(col)
    return F.when(c == 0, F.lit(1.0)).otherwise(c.cast("double"))


def is_finite_vec(x) -> Column:
    """True when every element of the array is finite (no NaN, no +-Inf)."""
    return F.forall(_c(x), lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def sign_pred(score, tie: float = 1.0) -> Column:
    """sign(score) with the tie value used when score == 0; non-finite scores count as 0."""
    s = _c(score)
    s = F.when(F.isnan(s) | (F.abs(s) == F.lit(float("inf"))), F.lit(0.0)).otherwise(s)
    return F.when(s > 0, F.lit(1.0)).when(s < 0, F.lit(-1.0)).otherwise(F.lit(float(tie)))
