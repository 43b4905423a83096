"""Continual-learning evaluation: forgetting measures.

Accuracy tables are long: (algo, task, round, acc) or (algo, k, j, acc).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlearn.functions.names import base_task
from streamlearn.operators.metrics import confusion


def round_forgetting(acc: DataFrame, algo: str = "algo", task: str = "task", rnd: str = "round",
                     trained: str = "trained") -> DataFrame:
    """per (algo, round): mean over the tasks *not* trained in that round
    of max(0, acc_before - acc_after); acc_before is the previous round's
    accuracy of the same task (round -1 is the untrained snapshot)."""
    w = Window.partitionBy(algo, task).orderBy(rnd)
    d = acc.withColumn("_prev", F.lag("acc").over(w)).filter(F.col("_prev").isNotNull())
    d = d.filter(F.col(task) != F.col(trained))
    return d.groupBy(algo, rnd).agg(F.avg(F.greatest(F.col("_prev") - F.col("acc"), F.lit(0.0))).alias("forgetting"))


def overall_forgetting(rf: DataFrame, algo: str = "algo") -> DataFrame:
    """mean round forgetting per algorithm."""
    return rf.groupBy(algo).agg(F.avg("forgetting").alias("overall_forgetting"))


def forgetting_timeline(acc: DataFrame, algo: str = "algo", rnd: str = "round") -> DataFrame:
    """F3 timeline: best task accuracy per round."""
    return acc.groupBy(algo, rnd).agg(F.max("acc").alias("max_acc"))


def peak_drop(acc: DataFrame, algo: str = "algo", k: str = "k", j: str = "j") -> DataFrame:
    """for k > j, drop = A[j][j] - A[k][j]; positive drops only; mean and
    population std (0 when there is none).  A self equi-join on (algo, j)."""
    diag = acc.filter(F.col(k) == F.col(j)).select(algo, j, F.col("acc").alias("_peak"))
    later = acc.filter(F.col(k) > F.col(j))
    d = later.join(diag, [algo, j]).withColumn("_drop", F.col("_peak") - F.col("acc"))
    pos = d.filter(F.col("_drop") > 0).groupBy(algo).agg(F.avg("_drop").alias("avg_forgetting"),
                                                        F.stddev_pop("_drop").alias("std_forgetting"))
    algos = acc.select(algo).distinct()
    return (algos.join(pos, algo, "left")
                 .select(algo, F.coalesce("avg_forgetting", F.lit(0.0)).alias("avg_forgetting"),
                         F.coalesce("std_forgetting", F.lit(0.0)).alias("std_forgetting")))


def final_task_metrics(preds: DataFrame, g: Sequence[str] = ("algo", "task")) -> DataFrame:
    """M2 metrics per (algorithm, task) on the full task data."""
    return confusion(preds, list(g))


def task_changes(tasks: DataFrame, order: str = "pos", task: str = "task") -> DataFrame:
    """F8: rows where the base task (prefix before '_') differs from the previous one."""
    w = Window.orderBy(order)   # one row per task: a small ordered list
    d = tasks.withColumn("_b", base_task(task)).withColumn("_pb", F.lag("_b").over(w))
    return d.withColumn("changed", F.col("_pb").isNotNull() & (F.col("_b") != F.col("_pb"))) \
            .withColumnRenamed("_b", "base_task").drop("_pb")
