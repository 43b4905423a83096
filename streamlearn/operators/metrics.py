"""Grouped classification metrics (M1-M8), all as conditional-sum aggregations.

Every metric is a single hash aggregation with partial (map-side) combine, so
the shuffle carries one small row per group and task regardless of data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamlearn.operators.scan import prefix_scan


def _div(a: Column, b: Column) -> Column:
    """a / b, or 0.0 when b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def confusion_counts(df: DataFrame, g: Sequence[str], y="y", pred="pred") -> DataFrame:
    """TP/FP/TN/FN; -1 is the negative class, anything else (+1, or a 0 tie
    prediction) counts as positive, as in M2."""
    yp, pp = F.col(y) != -1, F.col(pred) != -1
    return df.groupBy(*g).agg(
        _cnt(yp & pp).alias("tp"), _cnt(~yp & pp).alias("fp"),
        _cnt(~yp & ~pp).alias("tn"), _cnt(yp & ~pp).alias("fn"))


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fnr, fpr from tp/fp/tn/fn (0 when undefined)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return (df.withColumn("precision", prec).withColumn("recall", rec)
              .withColumn("f1", _f1(prec, rec))
              .withColumn("fnr", _div(fn, fn + tp)).withColumn("fpr", _div(fp, fp + tn)))


def class1_metrics(df: DataFrame, g: Sequence[str], y="y", pred="pred") -> DataFrame:
    """M1: precision, recall, fnr, fpr, f1 for the positive class.

    Predictions may be -1, 0 or +1.  A 0 prediction counts as positive when a
    negative value (label or prediction) is present in the group, which is
    what the three-label confusion-matrix fallback amounts to.
    """
    yv, pv = F.col(y), F.col(pred)
    agg = df.groupBy(*g).agg(
        _cnt((yv > 0) & (pv > 0)).alias("_pp"), _cnt((yv > 0) & (pv == 0)).alias("_pz"),
        _cnt((yv > 0) & (pv < 0)).alias("_pn"), _cnt((yv <= 0) & (pv > 0)).alias("_np"),
        _cnt((yv <= 0) & (pv == 0)).alias("_nz"), _cnt((yv <= 0) & (pv < 0)).alias("_nn"),
        _cnt((yv < 0) | (pv < 0)).alias("_neg"))
    z = F.col("_neg") > 0
    out = agg.select(
        *g,
        (F.col("_pp") + F.when(z, F.col("_pz")).otherwise(0)).alias("tp"),
        (F.col("_np") + F.when(z, F.col("_nz")).otherwise(0)).alias("fp"),
        (F.col("_nn") + F.when(z, 0).otherwise(F.col("_nz"))).alias("tn"),
        (F.col("_pn") + F.when(z, 0).otherwise(F.col("_pz"))).alias("fn"))
    return rates(out).select(*g, "precision", "recall", "fnr", "fpr", "f1")


def confusion(df: DataFrame, g: Sequence[str], y="y", pred="pred") -> DataFrame:
    """M2: precision, recall, f1, fpr, fnr, tp, fp, tn, fn (-1 is negative, else positive)."""
    yp, pp = F.col(y) != -1, F.col(pred) != -1
    c = df.groupBy(*g).agg(
        _cnt(yp & pp).alias("tp"), _cnt(~yp & pp).alias("fp"),
        _cnt(~yp & ~pp).alias("tn"), _cnt(yp & ~pp).alias("fn"))
    return rates(c).select(*g, "precision", "recall", "f1", "fpr", "fnr", "tp", "fp", "tn", "fn")


def acc_f1(df: DataFrame, g: Sequence[str], y="y", pred="pred") -> DataFrame:
    """M3: accuracy and F1 after coercing 0 to +1."""
    yc = F.when(F.col(y) == 0, 1.0).otherwise(F.col(y))
    pc = F.when(F.col(pred) == 0, 1.0).otherwise(F.col(pred))
    c = df.groupBy(*g).agg(
        _cnt((yc == 1) & (pc == 1)).alias("tp"), _cnt((yc != 1) & (pc == 1)).alias("fp"),
        _cnt((yc != 1) & (pc != 1)).alias("tn"), _cnt((yc == 1) & (pc != 1)).alias("fn"),
        _cnt(yc == pc).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    c = rates(c)
    return c.select(*g, _div(F.col("_ok"), F.col("_n")).alias("accuracy"), "f1")


def full_metrics(df: DataFrame, g: Sequence[str], y="y", pred="pred") -> DataFrame:
    """M4: M2 plus specificity and accuracy."""
    c = confusion(df, g, y, pred)
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    return (c.withColumn("specificity", _div(tn, tn + fp))
             .withColumn("accuracy", _div(tp + tn, tp + tn + fp + fn)))


def micro_macro(df: DataFrame, g: Sequence[str], entity: str, y="y", pred="pred") -> DataFrame:
    """M5: pooled (micro) and per-entity-averaged (macro) metrics.

    Two aggregation levels: counts per (g, entity) -- the only pass over the
    rows -- then a small aggregation per g over those counts.
    """
    per = rates(confusion_counts(df, list(g) + [entity], y, pred))
    return per.groupBy(*g).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("tn").alias("tn"), F.sum("fn").alias("fn"),
        F.count(F.lit(1)).alias("n_entities"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.avg("fpr").alias("macro_fpr"), F.avg("fnr").alias("macro_fnr"),
    ).transform(rates).select(
        *g, "n_entities", "tp", "fp", "tn", "fn",
        F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"),
        F.col("f1").alias("micro_f1"), F.col("fpr").alias("micro_fpr"), F.col("fnr").alias("micro_fnr"),
        "macro_precision", "macro_recall", "macro_f1", "macro_fpr", "macro_fnr")


def micro_macro_from_counts(counts: DataFrame, g: Sequence[str], entity: str) -> DataFrame:
    """M5 from per-entity tp/fp/tn/fn rows (e.g. the fold's model table)."""
    per = rates(counts.select(*g, entity, "tp", "fp", "tn", "fn"))
    return _micro_macro(per, g)


def _micro_macro(per: DataFrame, g: Sequence[str]) -> DataFrame:
    return per.groupBy(*g).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("tn").alias("tn"), F.sum("fn").alias("fn"),
        F.count(F.lit(1)).alias("n_entities"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.avg("fpr").alias("macro_fpr"), F.avg("fnr").alias("macro_fnr"),
    ).transform(rates).select(
        *g, "n_entities", "tp", "fp", "tn", "fn",
        F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"),
        F.col("f1").alias("micro_f1"), F.col("fpr").alias("micro_fpr"), F.col("fnr").alias("micro_fnr"),
        "macro_precision", "macro_recall", "macro_f1", "macro_fpr", "macro_fnr")


def per_entity_metrics(df: DataFrame, entity: str, algo: str = "algo", algos: Sequence[str] | None = None,
                       metrics: Sequence[str] = ("precision", "recall", "fnr", "fpr"),
                       y="y", pred="pred") -> DataFrame:
    """M6: per-entity metrics wide by algorithm (``{algo}_{metric}`` columns).

    Pivot values are given (or discovered once from the small algorithm list)."""
    per = rates(confusion_counts(df, [entity, algo], y, pred))
    if algos is None:
        algos = sorted(r[0] for r in per.select(algo).distinct().collect())
    aggs = [F.first(m).alias(m) for m in metrics]
    wide = per.groupBy(entity).pivot(algo, list(algos)).agg(*aggs)
    if len(metrics) == 1:
        wide = wide.select(entity, *[F.col(a).alias(f"{a}_{metrics[0]}") for a in algos])
    return wide


def running_rates(df: DataFrame, keys: Sequence[str], order: Sequence[str], y="y", pred="pred") -> DataFrame:
    """M7: cumulative FNR, FPR, predicted threats and progress per stream, by one keyed prefix scan (a stream of any
    length spans tasks)."""
    yp, pp = F.col(y) > 0, F.col(pred) > 0
    one = lambda c: F.when(c, 1).otherwise(0)
    flags = {"cum_fn": yp & ~pp, "cum_tp": yp & pp, "cum_fp": ~yp & pp, "cum_tn": ~yp & ~pp}
    d = df.select("*", *[one(c).alias(f"_{n}") for n, c in flags.items()])
    out = prefix_scan(d, keys, order, {n: f"_{n}" for n in flags}, "seen").drop(*[f"_{n}" for n in flags])
    out = out.withColumn("threats", F.col("cum_tp") + F.col("cum_fp")).withColumn("seen", F.col("seen") + 1)
    return (out.withColumn("fnr", _div(F.col("cum_fn"), F.col("cum_fn") + F.col("cum_tp")))
               .withColumn("fpr", _div(F.col("cum_fp"), F.col("cum_fp") + F.col("cum_tn"))))


def slice_accuracy(df: DataFrame, g: Sequence[str], y="y", pred="pred") -> DataFrame:
    """M8: mean of (pred == y)."""
    return df.groupBy(*g).agg(F.avg(F.when(F.col(pred) == F.col(y), 1.0).otherwise(0.0)).alias("accuracy"))


SELECT_METRICS = ("recall", "f1", "fnr_min", "accuracy")


def selection_metric(name: str) -> Column:
    """A model-selection score over tp/fp/tn/fn columns; larger is better."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    if name == "recall":
        return _div(tp, tp + fn)
    if name == "f1":
        p, r = _div(tp, tp + fp), _div(tp, tp + fn)
        return _f1(p, r)
    if name == "fnr_min":
        return 1.0 - _div(fn, fn + tp)
    if name == "accuracy":
        return _div(tp + tn, tp + tn + fp + fn)
    raise ValueError(f"unknown selection metric {name!r}")
