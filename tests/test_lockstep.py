"""Lock-step folds give the scalar fold's models to the last bit."""

import random

import pytest

from conftest import SF_SMALL
from streamlearn.plans import MAIN_SEVEN, LearnerConfig, fold_models
from streamlearn.plans import kernels, lockstep  # noqa: F401
from streamlearn.plans.protocols import kernel_epochs, with_class_weights
from streamlearn.sources import fixtures as FX

LINEAR = [*MAIN_SEVEN, LearnerConfig.of("pa_study", "pa_study"), LearnerConfig.of("gradient", "gradient"),
          LearnerConfig.of("live", "ogc_live", eta=0.3), LearnerConfig.of("tie", "perceptron", tie=1.0)]
KERNEL = [LearnerConfig.of("ogc", "batch_kogc", gamma=0.5, max_sv=1000), LearnerConfig.of("ogc small", "batch_kogc", gamma=0.5, max_sv=5),
          LearnerConfig.of("pa", "batch_kpa", gamma=0.7, C=0.5), LearnerConfig.of("pa small", "batch_kpa", gamma=0.7, max_sv=4)]


def table(df):
    """Rows with null ids of vectors (NaN) as None."""
    plain = lambda v: tuple(None if x != x else x for x in v) if isinstance(v, list) else v
    return {(r["stream"], r["algo"]): tuple(map(plain, r)) for r in df.collect()}


def check(df, configs, **kw):
    a, b = table(fold_models(df, configs, lockstep=True, **kw)), table(fold_models(df, configs, lockstep=False, **kw))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k], k


@pytest.mark.parametrize("by", ["l_partkey", "l_suppkey"])
def test_linear(spark, by):
    check(FX.line_stream(spark, SF_SMALL, by), LINEAR)


def test_kernels_with_epochs_weights_and_budgets(spark):
    s = with_class_weights(FX.user_stream(spark, SF_SMALL))
    a = table(kernel_epochs(s, KERNEL, 3, shuffle=True))
    from streamlearn.plans import protocols
    old = protocols.fold_models
    try:
        protocols.fold_models = lambda *args, **kw: old(*args, lockstep=True, **kw)
        b = table(kernel_epochs(s, KERNEL, 3, shuffle=True))
    finally:
        protocols.fold_models = old
    assert a == b and max(len(r[4]) for r in a.values()) > 5


def uneven(spark):
    """Streams of 1 to 30 rows and one of 700, two widths, null ids, equal rows, a null key."""
    rng = random.Random(9)
    rows = []
    for s in [*range(40), None]:
        d = 2 if s is None or s % 3 else 4
        for i in range(700 if s == 7 else 1 + (s or 0) * 7 % 30):
            rows.append((None if s is None else f"s{s}", None if rng.random() < 0.1 else rng.randrange(400), [rng.randrange(-9, 10) / 8 for _ in range(d)], rng.choice([-1.0, 1.0])))
    df = spark.createDataFrame(rows, "stream string, id long, x array<double>, y double").selectExpr("stream", "timestamp_seconds(id) as ts", "id", "x", "y")
    return df.union(df.filter("id % 11 = 0"))


@pytest.mark.parametrize("batch", ["10000", "13"])
def test_uneven_streams(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(uneven(spark), LINEAR)
        check(uneven(spark), KERNEL)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty_and_choice(spark):
    df = FX.user_stream(spark, SF_SMALL)
    assert fold_models(df.limit(0), LINEAR, lockstep=True).count() == 0
    assert lockstep.cohort_count(df, ["stream"], LINEAR) == 0                       # 15 users: one by one
    assert lockstep.cohort_count(df, ["id"], LINEAR) >= 1
    assert not lockstep.has_lockstep([*LINEAR, LearnerConfig.of("full", "arow_full")])
    assert not lockstep.has_lockstep([LearnerConfig.of("still", "batch_kogc", frozen=True)])


@pytest.mark.parametrize("batch", ["10000", "13"])
def test_start_models(spark, batch):
    """Whole and partial states, a model without rows, streams and configurations without a model; refused before."""
    from pyspark.sql import functions as F
    from streamlearn.plans.fold import STATE_COLS
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = uneven(spark)
        m = fold_models(df, LINEAR, lockstep=False).select("stream", "algo", *STATE_COLS).filter("not (stream = 's3' or (stream = 's5' and algo = 'tie'))")
        m = m.withColumn("sigma", F.when(F.col("stream") != "s8", F.col("sigma"))).withColumn("b", F.when(F.col("stream") == "s9", 0.25).otherwise(F.col("b")))
        m = m.localCheckpoint()
        rest = df.filter("stream is null or stream <> 's4'")
        for only in (False, True):
            assert any(n.startswith("_pos") for n in _names(fold_models(rest, LINEAR, init=m, init_only=only, lockstep=True)))
            check(rest, LINEAR, init=m, init_only=only)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def _names(df):
    import re
    return re.findall(r"_pos#\d+", df._jdf.queryExecution().optimizedPlan().toString())
