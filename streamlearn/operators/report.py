"""Report tables over result rows (Q1-Q8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_gain(res: DataFrame, g: Sequence[str] = ("data_type", "ratio"), method: str = "method",
              metric: str = "f1", a: str = "online", b: str = "kernel") -> DataFrame:
    """Q1: mean metric per group and method, wide, with gain = b - a."""
    p = res.groupBy(*g).pivot(method, [a, b]).agg(F.avg(metric))
    return p.withColumn("gain", F.col(b) - F.col(a))


def median_metric(res: DataFrame, g: Sequence[str] = ("algo", "method", "ratio"), metric: str = "f1") -> DataFrame:
    """Q2: exact median per group."""
    return res.groupBy(*g).agg(F.median(metric).alias("median_" + metric))


def top_k(res: DataFrame, k: int = 3, part: Sequence[str] = ("method",), metric: str = "median_f1",
          tie: str = "algo") -> DataFrame:
    """Q3: top-k rows per partition by metric (ties by name)."""
    w = Window.partitionBy(*part).orderBy(F.desc(metric), F.col(tie))
    return res.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def report(res: DataFrame, sort: Sequence[str] = ("algo", "dataset"), digits: int = 4) -> DataFrame:
    """Q4: sorted, doubles rounded."""
    cols = [F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float")
            else F.col(f.name) for f in res.schema.fields]
    return res.select(*cols).orderBy(*sort)


def best_row(res: DataFrame, metric: str = "f1", part: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Q5: the argmax row per partition (first by ``tie`` on equal metric)."""
    order = [F.desc(metric)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(*part).orderBy(*order) if part else Window.partitionBy(F.lit(0)).orderBy(*order)
    return res.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def approach_summary(res: DataFrame, pattern: str = "KAGGLE|CreditFraud", suffix: str = "_test",
                     name: str = "name", metric: str = "f1") -> DataFrame:
    """Q6: keep datasets matching ``pattern`` and ending in ``suffix``; split
    ``algo_approach`` names in two; count rows and mean metric per approach."""
    d = res.filter(F.col("dataset").rlike(pattern) & F.col("dataset").endswith(suffix))
    parts = F.split(F.col(name), "_", 2)
    d = d.withColumn("algorithm", parts[0]).withColumn("approach", F.coalesce(parts[1], F.lit("")))
    return d.groupBy("approach").agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean_" + metric))


def selected_approaches(res: DataFrame, pattern: str = "KAGGLE|CreditFraud", suffix: str = "_test", name: str = "name",
                        metrics: Sequence[str] = ("f1", "precision", "recall")) -> DataFrame:
    """Q6, the table: test rows of the matching datasets whose name is ``algorithm_approach``, with the approach capitalised,
    best F1 first (``rank``; ties by algorithm, approach, dataset)."""
    d = res.filter(F.col("dataset").rlike(pattern) & F.col("dataset").contains(suffix) & F.col(name).contains("_"))
    parts = F.split(F.col(name), "_", 2)
    cap = F.concat(F.upper(F.substring(parts[1], 1, 1)), F.lower(F.expr(f"substring(split({name}, '_', 2)[1], 2)")))
    d = d.select("dataset", parts[0].alias("algorithm"), cap.alias("selected_approach"), *metrics)
    w = Window.orderBy(F.desc(metrics[0]), "algorithm", "selected_approach", "dataset")          # a report: one row per dataset and algorithm
    return d.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def f1_matrix(res: DataFrame, algos: Sequence[str], row: str = "dataset", col: str = "algo",
              metric: str = "f1") -> DataFrame:
    """Q7: dataset x algorithm matrix, missing cells 0."""
    return res.groupBy(row).pivot(col, list(algos)).agg(F.first(metric)).na.fill(0.0)


def by_approach(res: DataFrame, approaches: Sequence[str], col: str = "approach",
                row: str = "dataset") -> DataFrame:
    """Q8: rows per dataset in a fixed approach order."""
    pos = F.array_position(F.array(*[F.lit(a) for a in approaches]), F.col(col))
    return res.withColumn("approach_pos", pos).orderBy(row, "approach_pos")
