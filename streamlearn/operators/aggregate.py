"""Aggregations and feature building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlearn.functions.labels import to_pm1


def aggregate_periods(df: DataFrame, features: Sequence[str], ts: str = "timestamp",
                      label: str = "label", mode: str = "any", entity: str | None = "user_id",
                      period: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """A1 / A2: one row per timestamp (or per ``period`` bucket, e.g. '10 minutes').

    ``any``: feature sums, y = +1 if any row is positive.  ``majority``: feature
    sums, y = +1 if sum(label) > count/2, plus ``user_count`` = count of entity.
    Partial aggregation runs map-side, so the shuffle holds one row per period
    and task.
    """
    t = F.window(ts, period).start if period else F.col(ts)
    g = [*keys, t.alias("ts")]
    aggs = [F.sum(F.col(c).cast("double")).alias(c) for c in features]
    if mode == "any":
        aggs.append(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_lab"))
        out = df.groupBy(*g).agg(*aggs)
        return out.withColumn("y", to_pm1("_lab", "any_positive")).drop("_lab")
    if mode == "majority":
        aggs += [F.sum(F.col(label)).alias("_s"), F.count(F.lit(1)).alias("_c")]
        if entity:
            aggs.append(F.count(F.col(entity)).cast("double").alias("user_count"))
        out = df.groupBy(*g).agg(*aggs)
        return (out.withColumn("y", F.when(F.col("_s") > F.col("_c") / 2.0, 1.0).otherwise(-1.0))
                   .drop("_s", "_c"))
    raise ValueError(mode)


def vector_moments(df: DataFrame, col: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` group (one row in all without ``by``, none for no vectors): ``n``, and per position the ``mean`` and the
    population standard deviation ``sd`` of the vectors in ``col``.

    One aggregation whose buffers are whole vectors, merged on the map side first: a task shuffles one row per group,
    whatever the width, and no coordinate becomes a row.  Null vectors take no part; all vectors of a group have one length.
    """
    g = list(by) or [F.lit(0).alias("_all")]
    s = (df.filter(F.col(col).isNotNull()).select(*g, array_to_vector(F.col(col).cast("array<double>")).alias("_v"))
           .groupBy(*(by or ["_all"])).agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("_s")))
    n = F.col("_s.count").cast("double")
    return s.select(*by, F.col("_s.count").alias("n"), vector_to_array("_s.mean").alias("mean"),
                    F.transform(vector_to_array("_s.variance"), lambda v: F.sqrt(v * (n - 1.0) / n)).alias("sd"))


def fit_scaler(df: DataFrame, col: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """A3 / A4: per-feature mean and population std (0 std -> 1), fitted on ``df``: one row per ``by`` group with ``mu``/``sd``
    arrays of length d."""
    return vector_moments(df, col, by).select(
        *by, F.col("mean").alias("mu"), F.transform("sd", lambda v: F.when(v == 0, 1.0).otherwise(v)).alias("sd"))


def apply_scaler(df: DataFrame, scaler: DataFrame, col: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """(x - mu) / sd element-wise.  Without ``by`` the scaler is one row and is broadcast (fitted on nothing: null vectors);
    with ``by`` it is joined on the group keys."""
    j = df.join(scaler, list(by)) if by else df.join(F.broadcast(scaler), F.lit(True), "left")
    z = F.zip_with(F.zip_with(col, "mu", lambda v, m: v - m), "sd", lambda v, s: v / s)
    return j.withColumn(col, z).drop("mu", "sd")


def class_balance(df: DataFrame, g: Sequence[str] = (), y: str = "y") -> DataFrame:
    """A5: n, n_pos, n_neg, pos_ratio per group."""
    return (df.groupBy(*g).agg(F.count(F.lit(1)).alias("n"),
                               F.sum(F.when(F.col(y) > 0, 1).otherwise(0)).cast("long").alias("n_pos"),
                               F.sum(F.when(F.col(y) > 0, 0).otherwise(1)).cast("long").alias("n_neg"))
              .withColumn("pos_ratio", F.col("n_pos") / F.col("n")))


def class_weights(df: DataFrame, g: Sequence[str] = (), y: str = "y") -> DataFrame:
    """n/(2 n_pos) and n/(2 n_neg); 1 when the class is empty."""
    b = class_balance(df, g, y)
    return b.select(*g,
                    F.when(F.col("n_pos") > 0, F.col("n") / (2.0 * F.col("n_pos"))).otherwise(1.0).alias("pos_weight"),
                    F.when(F.col("n_neg") > 0, F.col("n") / (2.0 * F.col("n_neg"))).otherwise(1.0).alias("neg_weight"))


def entity_sequences(df: DataFrame, keys: Sequence[str] = ("stream",),
                     order: Sequence[str] = ("ts", "id", "x", "y")) -> DataFrame:
    """Rows of each entity contiguous and in order (hash partition + local
    sort), never collected into per-entity lists."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)
