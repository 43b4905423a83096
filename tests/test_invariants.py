"""Invariants from the test strategy: counts, splits, degenerate configs."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from streamlearn.operators import metrics as M
from streamlearn.operators import order as R
from streamlearn.operators.aggregate import apply_scaler, fit_scaler
from streamlearn.plans import LearnerConfig, fold_models, fold_predictions
from streamlearn.plans.learners import AROW, AROWFull
from streamlearn.sources import fixtures as FX


def test_confusion_sums_and_recall_fnr(spark):
    s = FX.user_stream(spark, SF_SMALL)
    p = fold_predictions(s, [LearnerConfig.of("P", "perceptron")])
    for r in M.confusion(p, ["stream"]).collect():
        assert r.tp + r.fp + r.tn + r.fn > 0
        if r.tp + r.fn > 0:
            assert r.recall + r.fnr == pytest.approx(1.0)
    tot = M.confusion(p, ["algo"]).first()
    assert tot.tp + tot.fp + tot.tn + tot.fn == s.count()


def test_splits_exact_and_disjoint(spark):
    s = FX.line_stream(spark, SF_SMALL)
    n = s.count()
    t = R.temporal_split(s, 0.8)
    assert t.filter("part='train'").count() == int(0.8 * n)
    h = R.hash_split(s, (0.8, 0.2), ("train", "test"))
    assert h.count() == n and h.filter("part='train'").count() == int(0.8 * n)
    e = R.entity_split(FX.user_stream(spark, SF_SMALL), "stream")
    per = e.groupBy("stream").agg(F.countDistinct("part").alias("k"))
    assert per.filter("k > 1").count() == 0


def test_index_is_a_permutation(spark):
    s = FX.line_stream(spark, SF_SMALL)
    n = s.count()
    i = R.with_index(s)
    r = i.agg(F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()
    assert tuple(r) == (0, n - 1, n)


def test_resample_keeps_size(spark):
    s = FX.line_stream(spark, SF_SMALL)
    n = s.count()
    for ratio in (0.1, 0.5, 0.9):
        r = R.resample_ratio(s, ratio)
        assert r.count() == n
        assert r.filter("y = 1").count() == int(n * ratio)


def test_scw_eta_half_never_updates(spark):
    s = FX.user_stream(spark, SF_SMALL)
    p = fold_predictions(s, [LearnerConfig.of("SCW", "scw", C=1.0, eta=0.5)])
    assert p.filter("pred <> 1.0").count() == 0


def test_rda_lambda_one_zero_weights_on_scaled_data(spark):
    s = FX.line_stream(spark, SF_SMALL)
    z = apply_scaler(s, fit_scaler(s))
    m = fold_models(z, [LearnerConfig.of("RDA", "rda", lam=1.0, gamma=1.0)]).first()
    assert all(v == 0.0 for v in m.w)


def test_arow_diag_equals_full_when_one_feature():
    a, b = AROW(1, r=0.1), AROWFull(1, r=0.1)
    import random
    rnd = random.Random(3)
    for _ in range(200):
        x, y = [rnd.uniform(-2, 2)], rnd.choice([-1.0, 1.0])
        assert a.step(x, y)[0] == b.step(x, y)[0]
    assert a.w[0] == pytest.approx(b.w[0], rel=1e-6)


def test_vote_weights_sum_to_one(spark):
    from streamlearn.operators.ensemble import vote_weights
    s = FX.user_stream(spark, SF_SMALL)
    p = fold_predictions(s, [LearnerConfig.of("P", "perceptron"), LearnerConfig.of("O", "ogc")])
    w = vote_weights(p, "recall").agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(1.0)


def test_threshold_tuning_matches_bruteforce(spark):
    import numpy as np
    from streamlearn.plans.protocols import tune_threshold
    s = FX.user_stream(spark, SF_SMALL).withColumn("score", F.floor(F.col("x")[0] * 4) - F.col("x")[1])   # many ties
    best = tune_threshold(s, 1.5).first()
    pdf = s.select("score", "y").toPandas()
    thr = np.percentile(pdf.score, range(1, 100))
    bestf, bestk = -1, None
    for k, t in enumerate(thr, 1):
        pr = pdf.score >= t
        tp = int((pr & (pdf.y > 0)).sum()); fp = int((pr & (pdf.y <= 0)).sum()); fn = int((~pr & (pdf.y > 0)).sum())
        p, r = tp / (tp + fp + 1e-9), tp / (tp + fn + 1e-9)
        f = (1 + 2.25) * p * r / (2.25 * p + r + 1e-9)
        if f > bestf:
            bestf, bestk = f, k
    assert best.k == bestk and best.fbeta == pytest.approx(bestf)


def test_percentiles_of_a_column_with_ties(spark):
    import numpy as np
    from streamlearn.plans.protocols import exact_percentiles
    v = [3.0] * 70 + [float(i % 7) for i in range(60)] + [None]
    df = spark.createDataFrame([(x,) for x in v], "score double").repartition(3)
    shares = [i / 100 for i in range(1, 100)]
    assert exact_percentiles(df, "score", shares) == pytest.approx(np.percentile([x for x in v if x is not None], range(1, 100)).tolist())
    assert exact_percentiles(df.limit(0), "score", shares) == []


def test_epochs_of_a_configuration_do_not_depend_on_the_others(spark):
    from streamlearn.plans.protocols import fit_epochs
    s = FX.user_stream(spark, SF_SMALL)
    t = R.temporal_split(s, 0.8, keys=["stream"]).drop("idx")
    tr, te = t.filter("part='train'").drop("part"), t.filter("part='test'").drop("part")
    alone = LearnerConfig.of("Perceptron", "perceptron")
    others = [alone, LearnerConfig.of("OGC", "ogc"), LearnerConfig.of("AROW", "arow", r=0.1)]
    pick = lambda df: {r.stream: (r.epoch, r.val_score, r.misses, list(r.w)) for r in df.filter("algo = 'Perceptron'").collect()}
    assert pick(fit_epochs(tr, te, [alone], max_epochs=4, patience=1)) == pick(fit_epochs(tr, te, others, max_epochs=4, patience=1))


def test_shuffles_are_unrelated(spark):
    """Adjacent rows of one shuffle are rarely adjacent in the next."""
    from streamlearn.functions.hashing import hash32
    df = spark.range(2000)
    order = lambda k: [r.id for r in df.orderBy(hash32(F.col("id").bitwiseXOR(hash32(F.lit(k), 49)), 42)).collect()]
    a, b = order(0), order(1)
    pairs = lambda o: {frozenset(p) for p in zip(o, o[1:])}
    assert len(pairs(a) & pairs(b)) < 20


def test_fold_runs_once_per_query(spark):
    """The plan that scores or averages models holds one Arrow fold for each distinct fold."""
    from streamlearn.plans import protocols as T
    s = FX.user_stream(spark, SF_SMALL)
    cfg = [LearnerConfig.of("P", "perceptron")]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert plan(T.average_models(fold_models(s, cfg))) == 1
    assert plan(T.best_of_shuffles(s, s, cfg, k=2)) == 0          # the model table was written before it is scored
    assert plan(T.fit_epochs(s, s, cfg, max_epochs=2, patience=1)) == 0
