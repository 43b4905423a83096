"""Task rounds (F1) against plain loops: wrapped chunks, short tasks, absent tasks."""

import numpy as np
import pytest

from streamlearn.plans import LearnerConfig
from streamlearn.plans.continual import task_rounds

RULES = [LearnerConfig.of("PA", "pa_study"), LearnerConfig.of("AROW", "arow", r=0.5)]
TASKS = ["a", "b", "c"]
# rows of each key's tasks: longer and shorter than a chunk, shorter than a slice, none
SIZES = {"k1": {"a": 40, "b": 33, "c": 7, "z": 5}, "k2": {"b": 12, "c": 25}, "k3": {"a": 9}, "k4": {"z": 11}}


def stream(spark):
    rng, rows = np.random.default_rng(4), []
    for k, sizes in SIZES.items():
        for t, n in sizes.items():
            for _ in range(n):
                x = [float(v) / 8 for v in rng.integers(-8, 9, 3)]
                rows.append((k, t, len(rows) % 17, len(rows), x, 1.0 if x[0] + rng.normal() > 0 else -1.0))
    df = spark.createDataFrame(rows, "stream string, task string, s long, id long, x array<double>, y double")
    return rows, df.selectExpr("stream", "task", "timestamp_seconds(s) as ts", "id", "x", "y")


def plain(rows, config, chunk, head):
    """(models per key and round, hits and counts per task and round)."""
    models, hits = {}, {}
    for k in SIZES:
        of = {t: sorted([r for r in rows if r[0] == k and r[1] == t], key=lambda r: (r[2], r[3])) for t in TASKS}
        learner, snaps = config.make(3), {-1: [0.0] * 3}
        taught = False
        for r, t in enumerate(TASKS):
            n = len(of[t])
            for i in range(min(chunk, n)):
                row = of[t][(r * chunk + i) % n]
                learner.step(list(row[4]), row[5])
                taught = True
            snaps[r] = list(learner.w)
            if taught:
                models[k, r] = snaps[r]
        for t in TASKS:
            for row in of[t][:head] if len(of[t]) >= head else []:
                for r, w in snaps.items():
                    hits.setdefault((t, r), []).append((1.0 if sum(a * b for a, b in zip(row[4], w)) >= 0 else -1.0) == row[5])
    return models, hits


@pytest.mark.parametrize("chunk,head", [(10, 8), (3, 1), (100, 30)])
def test_task_rounds(spark, chunk, head):
    rows, df = stream(spark)
    models, acc = task_rounds(df, RULES, TASKS, chunk, head)
    got_m = {(r.algo, r.stream, r["round"]): list(r.w) for r in models.collect()}
    got_a = {(r.algo, r.task, r["round"]): (r.acc, r.trained) for r in acc.collect()}
    want_m, want_a = {}, {}
    for c in RULES:
        m, h = plain(rows, c, chunk, head)
        want_m |= {(c.label, *k): w for k, w in m.items()}
        want_a |= {(c.label, *k): (np.mean(v), TASKS[k[1]] if k[1] >= 0 else None) for k, v in h.items()}
    assert got_m == want_m
    assert got_a.keys() == want_a.keys()
    for k, (a, t) in want_a.items():
        assert got_a[k][0] == pytest.approx(a) and got_a[k][1] == t


def test_no_row_is_multiplied(spark):
    """The plan of the rounds explodes no row and crosses none with models."""
    _, df = stream(spark)
    models, acc = task_rounds(df, RULES, TASKS, 5, 5)
    for d in (models, acc):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan
    assert "Generate" not in models.drop("w", "b")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[1]


def test_empty(spark):
    _, df = stream(spark)
    models, acc = task_rounds(df.filter("false"), RULES, TASKS)
    assert models.count() == 0 and acc.count() == 0
