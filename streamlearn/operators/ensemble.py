"""Ensembles (E1-E3): vote weights, weighted majority vote, comparison rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlearn.operators.metrics import confusion_counts, rates, selection_metric


def vote_weights(val_preds: DataFrame, metric: str = "recall", model: str = "algo",
                 g: Sequence[str] = ()) -> DataFrame:
    """Per model, validation metric floored at 0.001, normalised to sum 1
    within each group ``g`` (the model list is small)."""
    c = confusion_counts(val_preds, [*g, model])
    c = c.withColumn("_m", F.greatest(selection_metric(metric), F.lit(0.001)))
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    return c.select(*g, model, (F.col("_m") / F.sum("_m").over(w)).alias("weight"))


def weighted_vote(preds: DataFrame, weights: DataFrame, row: Sequence[str] = ("id",),
                  model: str = "algo", g: Sequence[str] = ()) -> DataFrame:
    """sum(weight * pred) > 0 -> +1 else -1, per row.  The weight table has
    one row per group and model; Spark broadcasts it if it is small."""
    j = preds.join(weights, [*g, model])
    out = j.groupBy(*g, *row).agg(F.sum(F.col("weight") * F.col("pred")).alias("vote"),
                                  F.first("y").alias("y"))
    return out.withColumn("pred", F.when(F.col("vote") > 0, 1.0).otherwise(-1.0))


def compare_ensemble(ens_preds: DataFrame, model_preds: DataFrame, model: str = "algo",
                     g: Sequence[str] = ()) -> DataFrame:
    """The ensemble row, the best single model by recall (first name on a
    tie) and a difference row (ensemble - best; fnr and fn signed so lower is
    better)."""
    e = rates(confusion_counts(ens_preds, list(g))).withColumn("model", F.lit("ensemble"))
    m = rates(confusion_counts(model_preds, [*g, model]))
    w = Window.partitionBy(*g).orderBy(F.desc("recall"), F.col(model)) if g else \
        Window.partitionBy(F.lit(0)).orderBy(F.desc("recall"), F.col(model))
    best = m.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r") \
            .withColumnRenamed(model, "model")
    cols = ["precision", "recall", "f1", "fpr", "fnr", "tp", "fp", "tn", "fn"]
    e = e.select(*g, "model", *cols)
    best = best.select(*g, "model", *cols)
    d = e.alias("e").join(best.alias("b"), list(g)) if g else e.alias("e").crossJoin(best.alias("b"))
    lower_better = {"fnr", "fpr", "fn", "fp"}
    diff = d.select(*[F.col(f"e.{k}") for k in g], F.lit("difference").alias("model"),
                    *[(F.col(f"b.{c}") - F.col(f"e.{c}") if c in lower_better else F.col(f"e.{c}") - F.col(f"b.{c}"))
                      .cast("double").alias(c) for c in cols])
    to_d = lambda df: df.select(*g, "model", *[F.col(c).cast("double").alias(c) for c in cols])
    return to_d(e).unionByName(to_d(best)).unionByName(diff)
