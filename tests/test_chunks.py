"""Snapshots of persistent models (F6) against plain loops; moments of whole vectors."""

import numpy as np
import pytest

from conftest import SF_SMALL
from streamlearn.operators.aggregate import apply_scaler, fit_scaler, vector_moments
from streamlearn.operators.forgetting import peak_drop
from streamlearn.plans import LearnerConfig, fold_models
from streamlearn.plans.continual import chunk_accuracies
from streamlearn.sources import fixtures as FX

RULES = [LearnerConfig.of("PA", "pa_study"), LearnerConfig.of("AROW", "arow", r=0.5)]


def plain_accuracies(streams, config, chunks):
    """Models kept after every chunk by hand; every row under every later model."""
    hit, n = np.zeros((chunks, chunks)), np.zeros(chunks)
    for rows in streams:
        learner, runs = config.make(len(rows[0][0])), [i * chunks // len(rows) for i in range(len(rows))]
        snapshots = []
        for k in range(chunks):
            for (x, y), run in zip(rows, runs):
                if run == k:
                    learner.step(list(x), y)
            snapshots.append(list(learner.w))
        for (x, y), j in zip(rows, runs):
            n[j] += 1
            for k in range(j, chunks):
                hit[k, j] += (1.0 if np.dot(x, snapshots[k]) >= 0 else -1.0) == y
    return {(config.label, k, j): hit[k, j] / n[j] for j in range(chunks) for k in range(j, chunks) if n[j]}


@pytest.mark.parametrize("chunks", [1, 4, 100])
def test_chunk_accuracies(spark, chunks):
    """100 chunks are more than any user has rows: earlier models stand for the empty ones."""
    s = FX.user_stream(spark, SF_SMALL)
    streams = [list(zip(g.x, g.y)) for _, g in s.toPandas().sort_values(["ts", "id"]).groupby("stream")]
    acc = chunk_accuracies(s, RULES, chunks)
    got = {(r.algo, r.k, r.j): r.acc for r in acc.collect()}
    want = {k: v for c in RULES for k, v in plain_accuracies(streams, c, chunks).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    if chunks == 4:
        for r in peak_drop(acc).collect():
            drops = [want[r.algo, j, j] - want[r.algo, k, j] for k in range(4) for j in range(k)]
            drops = [v for v in drops if v > 0] or [0.0]
            assert (r.avg_forgetting, r.std_forgetting) == pytest.approx((np.mean(drops), np.std(drops)))


def test_last_snapshot_is_the_model(spark):
    s = FX.user_stream(spark, SF_SMALL).selectExpr("*", "cast(id % 3 as int) as part")
    cfg = [*RULES, LearnerConfig.of("KPA", "kpa", gamma=0.5, C=1.0)]
    whole = {(r.stream, r.algo): r for r in fold_models(s, cfg, order=["part", "ts", "id", "x", "y"], lockstep=False).collect()}
    snaps = fold_models(s, cfg, snapshots="part").collect()
    assert len({(r.stream, r.algo, r.part) for r in snaps}) == len(snaps) > len(whole)
    last = {}
    for r in sorted(snaps, key=lambda r: r.part):
        assert r.n > (last[r.stream, r.algo].n if (r.stream, r.algo) in last else 0)
        last[r.stream, r.algo] = r
    for k, r in whole.items():
        assert (last[k].n, list(last[k].w), last[k].sigma, last[k].mistakes) == (r.n, list(r.w), r.sigma, r.mistakes)


def test_wide_vectors_without_exploding(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3.0, 2.0, size=(300, 64))
    x[:, 7] = 4.5                                    # zero variance
    rows = [("a" if i % 3 else "b", list(map(float, r))) for i, r in enumerate(x)] + [("c", list(map(float, x[0]))), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x array<double>").repartition(5)
    got = {r.g: r for r in fit_scaler(df, by=["g"]).collect()}
    assert set(got) == {"a", "b", "c"} and list(got["c"].sd) == [1.0] * 64
    for g, pick in (("a", np.arange(300) % 3 > 0), ("b", np.arange(300) % 3 == 0)):
        sd = x[pick].std(0)
        sd[7] = 1.0
        assert np.allclose(got[g].mu, x[pick].mean(0)) and np.allclose(got[g].sd, sd) and got[g].sd[7] == 1.0
    z = apply_scaler(df, fit_scaler(df))
    assert "Generate" not in z._jdf.queryExecution().optimizedPlan().toString()
    m = np.array([r.x for r in z.filter("g in ('a', 'b')").collect()])
    assert m.shape == (300, 64) and np.abs(m.mean(0)).max() < 0.05
    none = df.filter("g = 'd'")
    assert vector_moments(none).count() == 0 and [r.x for r in apply_scaler(none, fit_scaler(none)).collect()] == [None]
