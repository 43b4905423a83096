"""The scenario grid in lock step: rules, counts and scenarios equal the walk row by row."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from streamlearn.functions.hashing import hash32, hash32_int, hash63, hash_unit, with_hash32
from streamlearn.operators.drift import outlier_factor
from streamlearn.plans import MAIN_SEVEN, LearnerConfig, fold_models, grid, lockstep
from streamlearn.plans.fold import COUNT_FIELDS, fold_counts
from streamlearn.sources import fixtures as FX
from test_lockstep import check, uneven

SINGLE = [LearnerConfig.of("PA", "kpa", gamma=1.0), LearnerConfig.of("Perceptron", "kperceptron", gamma=0.5), LearnerConfig.of("OGC", "kogc", gamma=2.0),
          LearnerConfig.of("AROW", "karow", gamma=1.0, r=0.1), LearnerConfig.of("RDA", "krda", gamma=1.0, lam=0.01, rda_gamma=0.7),
          LearnerConfig.of("SCW", "kscw", gamma=1.0, C=1.0, eta=0.9), LearnerConfig.of("AdaRDA", "kadarda", gamma=1.0, lam=0.01)]
SMALL = [LearnerConfig.of(c.label + " small", c.name, max_sv=3 + n, **dict(c.params)) for n, c in enumerate(SINGLE)]

MAIN = [LearnerConfig("main " + c.label, c.name, c.params) for c in MAIN_SEVEN]


@pytest.mark.parametrize("batch", ["10000", "13"])
def test_single_pass_rules(spark, batch):
    """Rules without and with a budget, null ids and keys, a stream that goes on alone."""
    assert lockstep.has_lockstep([*SINGLE, *SMALL])                                  # none had a form before
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check(uneven(spark), [*SINGLE, *SMALL])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_long_streams_go_alone(spark):
    """Ten streams longer than ``OPEN_STEPS``: more than the few that go alone anyway."""
    n = lockstep.OPEN_STEPS + 40
    df = spark.range(10 * n).selectExpr("cast(id % 10 as string) as stream", "timestamp_seconds(id) as ts", "id",
                                        "array((id * 37) % 101 / 16.0D, (id * 53) % 29 / 8.0D) as x", "if((id * 7919) % 13 < 6, 1.0D, -1.0D) as y")
    check(df, [SINGLE[0], SINGLE[3], SINGLE[6], MAIN[3]])


def test_cohorts_are_bounded_by_rows(spark):
    df = spark.range(2 * lockstep.OPEN_ROWS).select((F.col("id") % 300).alias("stream"))
    few = lockstep.cohort_count(df, ["stream"], SINGLE)
    assert lockstep.cohort_count(df, ["stream"], SINGLE, 100) >= 200 > few           # 13 million rows, 30,000 streams


def test_counts_without_models(spark):
    s = uneven(spark)
    names = ["stream", "algo", *[f.name for f in COUNT_FIELDS]]
    rows = lambda d: sorted(map(tuple, d.select(*names).collect()), key=repr)
    want = rows(fold_models(s, [*MAIN, *SINGLE], lockstep=False))
    for cohorts in (0, 1, 3):
        got = fold_counts(s, [*MAIN, *SINGLE], cohorts=cohorts)
        assert got.columns == names and rows(got) == want


def test_grid_in_lock_step(spark):
    """Streams of many users: the same grid as stream by stream; one shuffle of the rows, no join."""
    events = FX.user_task_stream(spark, SF_MID).withColumnRenamed("task", "dataset").select("dataset", "stream", "ts", "id", "x", "y")
    args = (MAIN_SEVEN, SINGLE, (0.5, 0.9))
    kw = {"keys": ["dataset", "stream"], "by": ["dataset"]}
    a = grid.run_grid(events, *args, **kw)
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "_pt" in plan and "SortMergeJoin" not in plan
    old = grid.cohort_count
    try:
        grid.cohort_count = lambda *args: 0
        b = grid.run_grid(events, *args, **kw)
        assert "_pt" not in b._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    finally:
        grid.cohort_count = old


def test_hashes_step_by_step(spark):
    d = spark.sql("select explode(array(0L, 1L, 7L, 4294967295L, 4294967296L, -5L, cast(null as bigint))) as k").withColumn("odd", F.col("k") % 2 != 0)
    d = with_hash32(with_hash32(d, "a", "k", 42), "b", "k", (F.col("odd"), 7), 8)
    d = d.withColumn("c", hash32("k", 42)).withColumn("e", F.when(F.col("odd"), hash32("k", 7)).otherwise(hash32("k", 8)))
    for r in d.collect():
        assert r["a"] == r["c"] and r["b"] == r["e"]
        assert r["k"] is None or r["a"] == hash32_int(r["k"], 42)


def test_draws_and_factors(spark):
    """Draw i of a class takes the row at rank hash63(i) mod size; x is times the outlier factor."""
    rows = [("s", i, [float(i)], 1.0 if i % 5 == 0 else -1.0) for i in range(43)] + [(None, i, [1.0], -1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "stream string, id long, x array<double>, y double").selectExpr("stream", "timestamp_seconds(id) as ts", "id", "x", "y")
    got = grid.scenarios(df, (0.7,)).collect()
    ids = [r["id"] for r in sorted((r for r in got if r["stream"] == "s"), key=lambda r: r["idx"]) if r["y"] > 0]
    want = [5 * (r["h"] % 9) for r in spark.range(30).select(hash63("id", 43).alias("h")).collect()]
    assert ids == sorted(want)
    d = spark.createDataFrame([r.asDict() for r in got if r["stream"] == "s"], "idx int, id long, y double, x array<double>")
    n_pos = sum(r["y"] > 0 for r in got if r["stream"] == "s")
    d = (d.withColumn("_n", F.lit(len(ids) + d.count() - n_pos)).withColumn("_np", F.lit(n_pos)).withColumn("_nn", F.col("_n") - F.col("_np"))
          .withColumn("cr", F.expr("row_number() over (partition by y order by idx) - 1")))
    both = d.withColumn("f", outlier_factor(42)).withColumn("g", outlier_factor(42, unit=hash_unit("id", 42))).collect()
    assert all(r["f"] == r["g"] and r["x"] == [r["id"] * r["f"]] for r in both) and len({r["f"] for r in both}) > 5


@pytest.mark.parametrize("cohorts", [0, 2])
def test_null_features_fail(spark, cohorts):
    df = uneven(spark).withColumn("x", F.when(F.col("id") == 7, F.expr("transform(x, v -> cast(null as double))")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="TypeError"):
        fold_counts(df, [*MAIN, *SINGLE], cohorts=cohorts).collect()
