"""Continual learning over task rounds (F1), over sliding windows (F4 with F5) and over chunks of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamlearn.functions.vectors import dot
from streamlearn.operators.aggregate import vector_moments
from streamlearn.operators.order import DEFAULT_ORDER, with_counts
from streamlearn.operators.scan import prefix_scan
from streamlearn.plans.fold import fold_models, fold_predictions
from streamlearn.plans.learners import LearnerConfig


def _models_by_key(models: DataFrame, configs: Sequence[LearnerConfig], keys: Sequence[str], phase: str, first: int, last: int) -> DataFrame:
    """One row per key with an array column ``_a0``, ``_a1``, ... per configuration: its (w, b) after each value ``first`` .. ``last``
    of ``phase``.  A value without rows has the model before it; before the first model the entry is null."""
    each = F.array_sort(F.collect_list(F.struct(phase, "w", F.coalesce("b", F.lit(0.0)).alias("b"))))       # one per value of phase
    m = models.groupBy(*keys, "algo").agg(each.alias("_m"))
    m = m.withColumn("_m", F.transform(F.sequence(F.lit(first), F.lit(last)),
                                       lambda k: F.try_element_at(F.filter("_m", lambda s: s[phase] <= k), F.lit(-1))))
    return m.groupBy(*keys).agg(*[F.max(F.when(F.col("algo") == c.label, F.col("_m"))).alias(f"_a{i}") for i, c in enumerate(configs)])


def _pooled_accuracy(rows: DataFrame, wide: DataFrame, configs: Sequence[LearnerConfig], keys: Sequence[str], by: str, phase: str,
                     first: int, last: int) -> DataFrame:
    """Accuracy on the rows of every ``by`` under every rule and snapshot, pooled over keys: (by, algo, phase, acc).

    A row meets the models of its key as one array and stays one row; its hits are one vector, summed per ``by``.  A null
    model is zero and predicts +1."""
    said = lambda s: F.when(F.coalesce(dot("x", s["w"]) + s["b"], F.lit(0.0)) >= 0, 1.0).otherwise(-1.0)
    ok = F.transform(F.flatten(F.array(*[f"_a{i}" for i in range(len(configs))])), lambda s: F.when(said(s) == F.col("y"), 1.0).otherwise(0.0))
    hits = vector_moments(rows.join(wide, list(keys)).select(by, ok.alias("_ok")), "_ok", [by])
    cells = F.array(*[F.struct(F.lit(c.label).alias("algo"), F.lit(k).alias(phase)) for c in configs for k in range(first, last + 1)])
    # a count of hits is whole: equal accuracies stay equal
    acc = F.zip_with(cells, "mean", lambda c, v: F.struct(c["algo"].alias("algo"), c[phase].alias(phase), (F.round(v * F.col("n")) / F.col("n")).alias("acc")))
    return hits.select(by, F.inline(acc))


def task_rounds(df: DataFrame, configs: Sequence[LearnerConfig], tasks: Sequence[str], chunk: int = 500, head: int = 200,
                keys: Sequence[str] = ("stream",), order: Sequence[str] = DEFAULT_ORDER) -> tuple[DataFrame, DataFrame]:
    """models of a key persist over rounds; round r trains on ``chunk`` rows of task r from row r * chunk on,
    wrapping around (R10; a task shorter than a chunk gives each row once).

    Returns the models after every round (keys, algo, round, w, b) and the accuracy table (algo, task, round,
    trained, acc): of each task's first ``head`` rows (R12; shorter tasks are left out) under the models after each
    round, and before the first (round -1), where the model is zero and predicts +1.  Accuracies are pooled over keys.
    A round without rows of a key leaves its models as they are.

    All snapshots come from one fold, which takes every taught row once.  Places in a task come from a keyed prefix scan, so
    a task of a key may span partitions; at most ``chunk`` rows a round go on to the fold, however long the stream is.
    """
    keys, rounds = list(keys), len(tasks)
    names = F.array(*[F.lit(t) for t in tasks])
    d = df.withColumn("round", F.array_position(names, F.col("task")).cast("int") - 1).filter("round >= 0")
    d = with_counts(prefix_scan(d, [*keys, "task"], order, position="_i"), [*keys, "task"])
    taught = d.withColumn("_p", F.pmod(F.col("_i") - F.col("round") * chunk, F.col("_n"))).filter(F.col("_p") < chunk)
    folded = fold_models(taught, configs, keys, ["_p", *order], snapshots="round")
    wide = _models_by_key(folded, configs, keys, "round", -1, rounds - 1)
    tagged = lambda label: lambda m, k: F.struct(F.lit(label).alias("algo"), (k - 1).alias("round"), m.alias("m"))
    after = F.flatten(F.array(*[F.transform(f"_a{i}", tagged(c.label)) for i, c in enumerate(configs)]))
    models = (wide.select(*keys, F.inline(after)).filter(F.col("m").isNotNull())
              .select(*keys, "algo", "round", "m.w", "m.b"))
    seen = d.filter((F.col("_i") < head) & (F.col("_n") >= head)).select(*keys, "task", "x", "y")
    acc = _pooled_accuracy(seen, wide, configs, keys, "task", "round", -1, rounds - 1)
    return models, acc.withColumn("trained", F.when(F.col("round") >= 0, F.element_at(names, F.col("round") + 1)))


def step_forgetting(df: DataFrame, configs: Sequence[LearnerConfig], W: int = 250, keys: Sequence[str] = ("stream",),
                    order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """per step j >= W of a sliding-window run (F4) of every key and rule: keys, algo, id, y, pred and ``forgetting``,
    the share of past rows W .. j-1 right before the step's training and wrong after it (first step 0).

    The re-evaluation is rows x steps of a key by definition; it runs inside the key's fold as one product a step, so no
    pair becomes a row."""
    run = [LearnerConfig.of(c.label, "step_forgetting", inner=c.name, W=W, **dict(c.params)) for c in configs]
    steps = fold_predictions(df, run, keys, order).filter(~F.isnan("pred"))
    return steps.select(*keys, "algo", "id", "y", "pred", F.col("score").alias("forgetting"))


def forgetting_summary(steps: DataFrame, g: Sequence[str] = ("stream", "algo")) -> DataFrame:
    """mean and population standard deviation of step forgetting per group, with the number of steps."""
    return steps.groupBy(*g).agg(F.count(F.lit(1)).alias("steps"), F.avg("forgetting").alias("forgetting"),
                                 F.stddev_pop("forgetting").alias("deviation"))


def chunk_accuracies(df: DataFrame, configs: Sequence[LearnerConfig], chunks: int = 10, keys: Sequence[str] = ("stream",),
                     order: Sequence[str] = DEFAULT_ORDER) -> DataFrame:
    """The accuracy table of F6 (algo, k, j, acc): each key's rows are cut into ``chunks`` runs of equal size, its models
    persist over them, and the models after run k are scored on run j <= k.  Accuracies are pooled over keys; a key with
    fewer rows than chunks has its last model stand for the empty runs.

    All snapshots come from one fold, and no row is multiplied by models.
    """
    keys = list(keys)
    of = Window.partitionBy(*keys)
    run = F.floor((F.row_number().over(of.orderBy(*order)) - 1) * chunks / F.count(F.lit(1)).over(of)).cast("int")
    d = df.withColumn("chunk", run)
    wide = _models_by_key(fold_models(d, configs, keys, order, snapshots="chunk"), configs, keys, "chunk", 0, chunks - 1)
    acc = _pooled_accuracy(d.withColumnRenamed("chunk", "j"), wide, configs, keys, "j", "k", 0, chunks - 1)
    return acc.filter("k >= j").select("algo", "k", "j", "acc")
