"""Sliding windows in lock step give the keyed fold's predictions."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from streamlearn.plans import LearnerConfig, fold_predictions, windows
from streamlearn.sources import fixtures as FX
from test_lockstep import uneven

INNER = [("pa", {}), ("pa_study", {}), ("perceptron", {}), ("perceptron", {"tie": 1.0}), ("gradient", {}), ("ogc_live", {"eta": 0.3})]


def rules(w):
    return [LearnerConfig.of(f"r{n}", "sliding", inner=i, W=w, **p) for n, (i, p) in enumerate(INNER)]


def rows(df):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)


def check(df, configs, **kw):
    a, b = fold_predictions(df, configs, lockstep=True, **kw), fold_predictions(df, configs, lockstep=False, **kw)
    assert a.dtypes == b.dtypes and rows(a) == rows(b)


@pytest.mark.parametrize("batch", ["10000", "13"])
def test_uneven_streams(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(uneven(spark), rules(1))
        check(uneven(spark), rules(7))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_users(spark):
    s = FX.user_stream(spark, SF_MID)
    assert windows.window_cohorts(s, ["stream"], rules(20)) > 0
    assert "_pt" in fold_predictions(s, rules(20))._jdf.queryExecution().optimizedPlan().toString()     # one by one before
    check(s, rules(20))


def test_infinite_features(spark):
    """Rows with infinite, zero and undefined features: a rule that takes no step leaves its model alone."""
    x = F.expr("array(case when id % 17 = 5 then double('inf') when id % 23 = 6 then double('nan') when id % 5 = 0 then 0.0D else id % 9 / 4.0D end, "
               "if(id % 5 = 0, 0.0D, id % 4 - 1.5D))")
    df = spark.range(900).select((F.col("id") % 20).cast("string").alias("stream"), F.timestamp_seconds("id").alias("ts"), "id", x.alias("x"),
                                 F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("y"))
    check(df, rules(6))


def test_choice(spark):
    df = uneven(spark)
    assert windows.has_windows(rules(5)) and not windows.has_windows([*rules(5), *rules(6)])
    assert not windows.has_windows([LearnerConfig.of("a", "sliding", inner="arow")]) and not windows.has_windows([LearnerConfig.of("pa")])
    assert windows.window_cohorts(df.filter("stream in ('s1', 's2')"), ["stream"], rules(5)) == 0
    assert fold_predictions(df.limit(0), rules(5), lockstep=True).count() == 0


@pytest.mark.parametrize("lockstep", [True, False])
def test_null_features_fail(spark, lockstep):
    df = uneven(spark).withColumn("x", F.when(F.col("id") == 7, F.expr("transform(x, v -> cast(null as double))")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="TypeError"):
        fold_predictions(df, rules(3), lockstep=lockstep).collect()
