"""Keyed folds against a plain sequential loop (the brute-force oracle)."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from streamlearn.plans import MAIN_SEVEN, LearnerConfig, fold_models, fold_predictions
from streamlearn.plans import kernels  # noqa: F401
from streamlearn.sources import fixtures as FX

STUDY = [
    LearnerConfig.of("pa_study", "pa_study"), LearnerConfig.of("gradient", "gradient"),
    LearnerConfig.of("ogc_live", "ogc_live", eta=0.1), LearnerConfig.of("ogl", "ogl"),
    LearnerConfig.of("ogl_partial", "ogl", clip=False), LearnerConfig.of("arow_full", "arow_full", r=1.0),
    LearnerConfig.of("arow_bias", "arow_bias"), LearnerConfig.of("rda_bias", "rda_bias"),
    LearnerConfig.of("scw_full", "scw_full", C=0.1, eta=0.95), LearnerConfig.of("scw_bias", "scw_bias"),
    LearnerConfig.of("adarda_bias", "adarda_bias"), LearnerConfig.of("perc_tie1", "perceptron", tie=1.0),
]

def brute(pdf, cfgs, keys=("stream",)):
    out = {}
    pdf = pdf.sort_values([*keys, "ts", "id"], kind="mergesort")
    for k, g in pdf.groupby(list(keys)):
        for c in cfgs:
            L = c.make(len(g.x.iloc[0]))
            for x, y in zip(g.x, g.y):
                L.step(list(x), y)
            out[(k if isinstance(k, str) else k[0], c.label)] = (L.state(), L.mistakes)
    return out


@pytest.mark.parametrize("cfgs", [list(MAIN_SEVEN), STUDY], ids=["main", "study"])
def test_fold_equals_sequential_loop(spark, cfgs):
    s = FX.line_stream(spark, SF_SMALL, "l_suppkey")
    got = {(r.stream, r.algo): r for r in fold_models(s, cfgs).collect()}
    want = brute(s.toPandas(), cfgs)
    assert set(got) == set(want)
    for k, (st, mistakes) in want.items():
        r = got[k]
        assert r.mistakes == mistakes, k
        assert list(r.w) == pytest.approx(st["w"], rel=1e-12, abs=1e-12), k


def test_split_configs_equals_single_pass(spark):
    s = FX.user_stream(spark, SF_SMALL)
    a = {(r.stream, r.algo): list(r.w) for r in fold_models(s, MAIN_SEVEN).collect()}
    b = {(r.stream, r.algo): list(r.w) for r in fold_models(s, MAIN_SEVEN, split_configs=True).collect()}
    assert a == b


def test_predictions_one_per_row_and_config(spark):
    s = FX.user_stream(spark, SF_SMALL)
    n = s.count()
    p = fold_predictions(s, MAIN_SEVEN)
    assert p.count() == n * len(MAIN_SEVEN)
    assert p.filter(~F.col("pred").isin(-1.0, 0.0, 1.0)).count() == 0


def test_warm_start_continues_state(spark):
    s = FX.user_stream(spark, SF_SMALL)
    cfg = [LearnerConfig.of("Perceptron", "perceptron")]
    from streamlearn.operators.order import temporal_split
    t = temporal_split(s, 0.5, keys=["stream"]).drop("idx")
    a, b = t.filter("part='train'").drop("part"), t.filter("part='test'").drop("part")
    m1 = fold_models(a, cfg).select("stream", "algo", "w", "sigma", "g", "g1t", "b", "t")
    m2 = {r.stream: list(r.w) for r in fold_models(b, cfg, init=m1).collect()}
    full = {r.stream: list(r.w) for r in fold_models(s, cfg).collect()}
    assert m2 == full


def test_kernel_budgets(spark):
    """Oldest out, smallest out, or new rows ignored, against plain lists; without a budget nothing leaves."""
    s = FX.user_stream(spark, SF_SMALL)
    rows = sorted(map(tuple, s.select("stream", "ts", "id", "x", "y").collect()))
    cfg = [LearnerConfig.of("free", "kperceptron", gamma=0.5), LearnerConfig.of("oldest", "batch_kperceptron", gamma=0.5, max_sv=7),
           LearnerConfig.of("smallest", "batch_kogc", gamma=0.5, max_sv=7), LearnerConfig.of("ignore", "batch_kadarda", gamma=0.5, max_sv=7, lam=0.01)]
    got = {(r.stream, r.algo): r for r in fold_models(s, cfg).collect()}
    for stream in {r[0] for r in rows}:
        sets = {c.label: [] for c in cfg}                      # [x, alpha, id]
        for _, _, rid, x, y in (r for r in rows if r[0] == stream):
            for label, sv in sets.items():
                f = sum(a * math.exp(-0.5 * sum((u - v) ** 2 for u, v in zip(x, z))) for z, a, _ in sv)
                if label == "free" and not sv:
                    f = 1.0
                p = (1.0 if f > 0 else -1.0) if label == "smallest" else (1.0 if f >= 0 else -1.0)
                if label == "ignore":
                    if 1.0 - y * f > 0 and len(sv) < 7:
                        sv.append((x, max(1 - 0.01 * 2, 0) / 2 * y, rid))
                elif p != y:
                    new = (x, 2.0 * y if label == "smallest" else y, rid)
                    if label == "free" or len(sv) < 7:
                        sv.append(new)
                    elif label == "oldest":
                        sv[:] = sv[1:] + [new]
                    else:
                        j = min(range(7), key=lambda i: abs(sv[i][1]))
                        sv[j] = new
        for label, sv in sets.items():
            assert list(got[(stream, label)].w) == pytest.approx([a for _, a, _ in sv]), (stream, label)
    assert max(len(r.w) for r in got.values()) > 7


def test_kernel_state_goes_on_where_it_stopped(spark):
    """Two folds with the state passed on equal one fold, ids included."""
    s = FX.user_stream(spark, SF_SMALL)
    cfg = [LearnerConfig.of(n, n, gamma=0.5) for n in ("batch_karow", "batch_kscw", "batch_krda", "batch_kadarda", "batch_kgradient", "batch_kpa", "krda", "kadarda")]
    from streamlearn.plans.protocols import kernel_epochs
    one = {(r.stream, r.algo): list(r.w) for r in kernel_epochs(s, cfg, 2).collect()}
    m = fold_models(s, cfg).select("stream", "algo", "w", "sigma", "g", "g1t", "b", "t")
    two = {(r.stream, r.algo): list(r.w) for r in fold_models(s, cfg, init=m).collect()}
    assert set(one) == set(two)
    for k in one:
        assert one[k] == pytest.approx(two[k]), k


def test_kernel_scoring_in_blocks(spark):
    """The matrix form, one block or many, against a plain sum."""
    import numpy as np
    from streamlearn.operators.score import score_kernel, score_multi_kernel
    rng = np.random.default_rng(2)
    v, a, x = rng.normal(size=(23, 4)), rng.normal(size=23), rng.normal(size=(40, 4))
    g = [0.3, 0.6] * 12
    sv = spark.createDataFrame([(list(map(float, r)), float(b), float(c), i % 2) for i, (r, b, c) in enumerate(zip(v, a, g))],
                               "x array<double>, alpha double, gamma double, member int")
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, x array<double>")
    want = [sum(b * np.exp(-c * ((r - s) ** 2).sum()) for s, b, c in zip(v, a, g)) for r in x]
    for block in (1000, 5, 1):
        got = {r.id: (r.score, r.pred) for r in score_kernel(df, sv, "gamma", block).collect()}
        assert [got[i][0] for i in range(40)] == pytest.approx(want) and all(p == (1.0 if s >= 0 else -1.0) for s, p in got.values())
    assert [r.score for r in score_multi_kernel(df, sv).orderBy("id").collect()] == pytest.approx([w / 2 for w in want])
    none = score_kernel(df, sv.limit(0)).collect()
    assert {(r.score, r.pred) for r in none} == {(0.0, 1.0)}


def test_sliding_window_matches_reference_loop(spark):
    """F4 against a direct transcription of the protocol on plain lists."""
    from streamlearn.plans.learners import LEARNERS
    W = 30
    cfg = [LearnerConfig.of("PA", "sliding", inner="pa_study", W=W)]
    s = FX.task_stream(spark, SF_SMALL)
    got = fold_predictions(s, cfg).filter(~F.isnan("pred"))
    got = {(r.stream, r.id): r.pred for r in got.collect()}
    pdf = s.toPandas().sort_values(["stream", "ts", "id"], kind="mergesort")
    want = {}
    for k, g in pdf.groupby("stream"):
        X, Y, ids = [list(v) for v in g.x], list(g.y), list(g.id)
        m = LEARNERS["pa_study"](len(X[0]))
        for j in range(W, len(X)):
            for i in range(j - W, j):
                m.step(X[i], Y[i])
            sc = sum(a * b for a, b in zip(X[j], m.w))
            want[(k, ids[j])] = 1.0 if sc >= 0 else -1.0
    assert got == want
