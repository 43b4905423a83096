"""Perturbation and drift injection on labelled streams.

Random factors are integer hashes of (seed, id), so any engine reproduces
them; class-local ranks come from the range-partitioned index.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlearn.functions.hashing import hash_unit
from streamlearn.operators.order import DEFAULT_ORDER, with_index


def drift_expr(x: Column, mode: str) -> Column:
    """The transformed feature vector for one drift mode."""
    if mode == "square":
        return F.transform(x, lambda v: v * v)
    if mode == "sincos":
        two_pi = 2.0 * math.pi
        return F.transform(x, lambda v, i: F.when(i == 0, F.sin(F.lit(two_pi) * v))
                           .when(i == 1, F.cos(F.lit(two_pi) * v)).otherwise(v))
    if mode == "exp":
        return F.transform(x, lambda v: F.exp(v) - 1.0)
    if mode == "radial":
        n2 = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
        return F.transform(x, lambda v: F.exp(-n2) * v)
    raise ValueError(mode)


def inject_drifts(df: DataFrame, modes: Sequence[str], cut_frac: float = 0.5, keys: Sequence[str] = (),
                  order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """D1 for several modes in one pass: each row once per mode (column ``mode``); rows at position >=
    int(cut_frac * n) get the mode's transform."""
    d = with_index(df, order, keys)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, list(keys)) if keys else d.crossJoin(F.broadcast(n))      # one row of counts
    late = F.col("idx") >= F.floor(F.lit(cut_frac) * F.col("_n"))
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.when(late, drift_expr(F.col("x"), m)).otherwise(F.col("x")).alias("x")) for m in modes])
    rest = [c for c in d.columns if c not in ("x", "_n")]
    return d.select(*rest, F.explode(each).alias("_m")).select(*rest, "_m.mode", "_m.x")


def inject_drift(df: DataFrame, mode: str, cut_frac: float = 0.5, keys: Sequence[str] = (),
                 order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """Rows at position >= int(cut_frac * n) get the drift transform."""
    return inject_drifts(df, [mode], cut_frac, keys, order).drop("mode")


def _balance(df: DataFrame, y: str = "y") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_n"),
                  F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_np"),
                  F.sum(F.when(F.col(y) == -1, 1).otherwise(0)).alias("_nn"))


#: Powers and sines are rounded to multiples of this: math libraries differ in their last bit, and a sign may hang on it.
FACTOR_GRID = 2.0 ** -20


def _on_grid(v: Column) -> Column:
    return F.floor(v / FACTOR_GRID + 0.5) * F.lit(FACTOR_GRID)


def outlier_factor(seed: int = 42, steps: Sequence[str] = ("positives", "negatives", "late", "shift"), unit: Column | None = None) -> Column:
    """D2-D5 as one factor of x, from the columns y, id, idx (position), cr (rank within the class) and the numbers
    of rows _n, of positives _np and of negatives _nn.  ``unit`` is ``hash_unit("id", seed)`` where a caller has it."""
    ratio = F.col("_np") / F.col("_n")
    extreme = ratio > 0.85
    pos, neg = F.col("y") == 1, F.col("y") == -1
    f = F.lit(1.0)
    # a step that does not apply multiplies by one: with f in both branches the expression would double with every step
    if "positives" in steps:
        u = hash_unit("id", seed) if unit is None else unit
        lo_hi = F.when(extreme, F.lit(2.0)).otherwise(F.lit(1.0))
        f = f * F.when(pos, _on_grid(F.pow(F.lit(10.0), (u * 2.0 - 1.0) * lo_hi))).otherwise(1.0)
    if "negatives" in steps:
        t = F.when(F.col("_nn") > 1, F.lit(2.0 * math.pi) * F.col("cr") / (F.col("_nn") - 1)).otherwise(F.lit(0.0))
        sc = F.when(extreme, F.lit(0.05) + F.lit(0.45) * (F.lit(1.0) + _on_grid(F.sin(t)))).otherwise(F.lit(0.1))
        f = f * F.when(neg, sc).otherwise(1.0)
    if "late" in steps:
        start = F.floor(F.when(extreme, F.lit(0.5)).otherwise(F.lit(0.75)) * F.col("_np"))
        m = F.col("_np") - start
        lin = F.when(m > 1, F.lit(10.0) + F.lit(190.0) * (F.col("cr") - start) / (m - 1)).otherwise(F.lit(10.0))
        boost = F.when(extreme, lin).otherwise(F.lit(50.0))
        f = f * F.when(pos & (F.col("_np") > 4) & (F.col("cr") >= start), boost).otherwise(1.0)
    if "shift" in steps:
        f = f * F.when(extreme & (F.col("idx") >= F.floor(F.lit(0.75) * F.col("_n"))), 5.0).otherwise(1.0)
    return f


def perturb(df: DataFrame, seed: int = 42, order: Sequence[str] = DEFAULT_ORDER,
            steps: Sequence[str] = ("positives", "negatives", "late", "shift")) -> DataFrame:
    """D2-D5 composed (the outlier-injection recipe), in this order:

    * D2 positives: x *= 10^U, U uniform in (-1, 1), or (-2, 2) when the positive ratio > 0.85
    * D3 negatives: x *= 0.1; extreme: x *= 0.05 + 0.45 (1 + sin t), t = 2 pi r/(n_neg - 1)
    * D4 late positives (only if > 4): rank >= int(.75 n_pos) x *= 50; extreme:
      rank >= int(.5 n_pos) x *= linspace(10, 200) over those rows
    * D5 extreme only: rows with idx >= int(.75 n) x *= 5

    Position and class rank come from one range-partitioned index; the class
    counts are one tiny row.
    """
    d = with_index(df, order, col="idx", within="y", within_col="cr")
    d = d.crossJoin(F.broadcast(_balance(d)))      # one row of counts
    f = outlier_factor(seed, steps)
    out = d.withColumn("factor", f).withColumn("x", F.transform("x", lambda v: v * F.col("factor")))
    return out.drop("_n", "_np", "_nn")
