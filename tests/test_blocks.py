"""Products of packed blocks: every distinct row meets a model once, and no pair becomes a row."""

import pytest
from pyspark.sql import functions as F

from streamlearn.operators.score import score_kernel
from streamlearn.plans.protocols import pooled_scores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kernel_rows_are_not_copied_per_block(spark):
    import math
    x = [[i % 7 / 2.0, i % 3 / 4.0] for i in range(200)]
    v = [[j / 5.0, -j / 9.0] for j in range(31)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(x)], "id long, x array<double>")
    sv = spark.createDataFrame([(p, (-1.0) ** j) for j, p in enumerate(v)], "x array<double>, alpha double")
    got = score_kernel(df, sv, 0.5, block=4)
    assert "Generate" not in plan(got)                       # before, a row was exploded once per tile of vectors
    want = [sum((-1.0) ** j * math.exp(-0.5 * sum((a - b) ** 2 for a, b in zip(p, q))) for j, q in enumerate(v)) for p in x]
    assert {r.id: r.score for r in got.collect()} == {i: pytest.approx(w) for i, w in enumerate(want)}


def test_pooled_scores_count_equal_rows(spark):
    points = [([0.5, -1.0], 1.0), ([0.5, -1.0], -1.0), ([-2.0, 1.0], 1.0), ([3.0, 0.0], -1.0)]
    rows = [p for n, p in zip((5, 2, 3, 7), points) for _ in range(n)]
    val = spark.createDataFrame(rows, "x array<double>, y double")
    models = spark.createDataFrame([(k, w) for k, w in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0], [1.0, 2.0]])], "k int, w array<double>").withColumn("b", F.lit(0.0))
    got = pooled_scores(val, models)
    assert "HashAggregate(keys=[x" in plan(got) or "Aggregate [x" in got._jdf.queryExecution().optimizedPlan().toString()   # before, every row was packed
    want = {}
    for k, w in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0], [1.0, 2.0]]):
        said = [(x[0] * w[0] + x[1] * w[1] >= 0, y > 0) for x, y in rows]
        tp, fp, fn = sum(a and b for a, b in said), sum(a and not b for a, b in said), sum(b and not a for a, b in said)
        want[k] = pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    assert {r.k: r.val_score for r in got.collect()} == want
